"""Analytics over event ledgers in which participants with fixed budgets compete for a pool of items."""
