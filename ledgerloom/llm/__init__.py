"""Training-data operators: ten self-contained stages over document tables.

Nothing outside this folder imports it, and it imports nothing from the rest of the library.
"""
