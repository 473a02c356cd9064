"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted spellings of roles.
ROLE_ALIASES = {
    "batter": "Batter",
    "batsman": "Batter",
    "batswoman": "Batter",
    "bowler": "Bowler",
    "all-rounder": "All-rounder",
    "all rounder": "All-rounder",
    "allrounder": "All-rounder",
    "wicketkeeper": "Wicketkeeper",
    "wicket keeper": "Wicketkeeper",
    "keeper": "Wicketkeeper",
}
#: White space that trimming removes beyond what Spark's trim does.
_JS_SPACE = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{_JS_SPACE}]+|[{_JS_SPACE}]+$", "")


def clean_text(c: Column) -> Column:
    """Without control characters, trimmed."""
    return js_trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1F\x7F]", ""))


def utf16_length(c: Column) -> Column:
    """Characters beyond the basic plane count twice."""
    return F.char_length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


MAX_SAFE = 9_007_199_254_740_991


def parse_integer(c: Column, low: int = 0, high: int = MAX_SAFE) -> Column:
    """A whole number as scripts read it: blank is 0, exponents and trailing zeros count, hexadecimal too; null if it isn't one in range."""
    t = js_trim(c.cast("string"))
    decimal = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    exact = F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("decimal(38,0)"))
    based = F.when(t.rlike(r"^0[xX][0-9a-fA-F]{1,16}$"), F.conv(F.substring(t, 3, 16), 16, 10).try_cast("decimal(38,0)"))
    based = F.coalesce(based, F.when(t.rlike(r"^0[bB][01]+$"), F.conv(F.substring(t, 3, 64), 2, 10).try_cast("decimal(38,0)")), F.when(t.rlike(r"^0[oO][0-7]+$"), F.conv(F.substring(t, 3, 22), 8, 10).try_cast("decimal(38,0)")))
    whole = F.when((decimal == F.floor(decimal)) & (F.abs(decimal) <= MAX_SAFE), decimal.try_cast("decimal(38,0)"))
    n = F.when(t == "", F.lit(0).cast("decimal(38,0)")).otherwise(F.coalesce(exact, based, whole))
    return F.when(n.between(low, high), n.try_cast("bigint"))


def amount(c: Column) -> Column:
    """Like parse_integer after thousands separators are gone."""
    return parse_integer(F.replace(c, F.lit(","), F.lit("")))


def normal_role(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in ROLE_ALIASES.items() for x in kv])
    return F.try_element_at(names, F.lower(js_trim(c)))


def parse_boolean(c: Column) -> Column:
    t = F.lower(js_trim(F.coalesce(c, F.lit(""))))
    return F.when(t.isin("", "true", "yes", "1"), True).when(t.isin("false", "no", "0"), False)


def indian_grouping(c: Column) -> Column:
    """Lakh and crore grouping; a dash for null."""
    sign, digits = F.when(c < 0, "-").otherwise(""), F.abs(c).cast("string")
    head, tail = F.expr("null"), F.right(digits, F.lit(3))
    head = F.regexp_replace(F.substring(digits, F.lit(1), F.length(digits) - 3), r"(\d)(?=(\d\d)+$)", "$1,")
    return F.when(c.isNull(), "—").otherwise(F.concat(sign, F.when(F.length(digits) > 3, F.concat(head, F.lit(","), tail)).otherwise(digits)))


def pad(c: Column, width: int) -> Column:
    """Left zero padding that never truncates."""
    t = c.cast("string")
    return F.when(F.length(t) < width, F.lpad(t, width, "0")).otherwise(t)


def initials(c: Column) -> Column:
    """First letters of the first and last word, or the first three characters of a single one, in upper case."""
    words = F.filter(F.split(js_trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")
    first = lambda w: F.substring(w, 1, 1)
    return F.upper(F.when(F.size(words) > 1, F.concat(first(F.get(words, F.lit(0))), first(F.element_at(words, -1)))).otherwise(F.substring(F.coalesce(F.get(words, F.lit(0)), F.lit("")), 1, 3)))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def parse_tiers(c: Column) -> Column:
    """Lines ``ceiling: increment``; ``*`` is an open ceiling; separators of thousands are allowed."""
    lines = F.filter(F.split(c, r"\r?\n"), lambda x: F.trim(x) != "")
    part = lambda x, i: F.trim(F.get(F.split(x, ":"), F.lit(i)))
    return F.transform(lines, lambda x: F.struct(F.when(part(x, 0) != "*", amount(part(x, 0))).alias("up_to"), amount(part(x, 1)).alias("increment")))


def tier_text(up_to: Column, increment: Column) -> Column:
    return F.concat(F.coalesce(up_to.cast("string"), F.lit("*")), F.lit(": "), increment.cast("string"))


def cookies(c: Column) -> Column:
    """name -> decoded value; the last of a name wins; a value that can't be decoded is empty."""
    pairs = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda p: F.trim(p)), lambda p: F.instr(p, "=") > 1)
    rows = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.coalesce(F.try_url_decode(F.replace(F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))), F.lit("+"), F.lit("%2B"))), F.lit("")).alias("v")))
    last = F.filter(rows, lambda r, i: ~F.exists(F.slice(rows, i + 2, F.size(rows)), lambda o: o["k"] == r["k"]))
    return F.map_from_entries(last)


def derived_id(prefix: str, *keys: Column) -> Column:
    """A prefix and eight hexadecimal digits that follow from the keys, so that a task that runs again makes the same id."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]), 256), 1, 8))


def action_text(c: Column) -> Column:
    return F.regexp_replace(c, r"[._]", " ")


def size_kb(c: Column) -> Column:
    return F.format_string("%.1f KB", c / 1024)


#: Shown names of statuses.
STATUS_TEXT = {
    "not-started": "Not started",
    "live": "Live",
    "paused": "Paused",
    "completed": "Completed",
    "available": "Available",
    "current": "On the block",
    "sold": "Sold",
    "unsold": "Unsold",
    "waiting": "Waiting",
}
#: Headlines by status, then by result.
STATUS_LINE = {"not-started": "Auction is ready to begin", "paused": "Auction paused by the operator", "completed": "Auction complete · thank you"}
RESULT_LINE = {"sold": "Player sold", "unsold": "Player unsold", "live": "Live bidding"}


def _named(c: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c)


def status_text(c: Column) -> Column:
    """The shown name, an unknown status itself, or 'Unknown' for none."""
    return F.coalesce(_named(c, STATUS_TEXT), F.nullif(c, F.lit("")), F.lit("Unknown"))


def status_class(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(F.nullif(c, F.lit("")), F.lit("not-started"))), "[^a-z-]", "-")


def headline(status: Column, result: Column) -> Column:
    return F.coalesce(_named(status, STATUS_LINE), _named(result, RESULT_LINE), F.lit("Next player coming up"))


def currency(c: Column, symbol: str = "₹") -> Column:
    """A rounded amount with its sign; a dash for null."""
    whole = F.floor(c + F.lit(0.5)).cast("long")
    return F.when(c.isNull(), "—").otherwise(F.concat(F.lit(symbol), indian_grouping(whole)))


def date_time(ts: Column, with_date: bool = True) -> Column:
    """Day, month and minutes, or a time of day with seconds, in the session's time zone; a dash for null."""
    text = F.lower(F.date_format(ts, "hh:mm a" if with_date else "hh:mm:ss a"))
    return F.coalesce(F.concat(F.date_format(ts, "dd MMM, "), text) if with_date else text, F.lit("—"))
