"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality_rules import BINS, FENCES, PRIOR, RATIOS

_WS = r"\x20\x09-\x0D"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_OP7 = r"""
with d as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
i as (select cast(item_id as varchar) item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
s as (select item_id, w, least(10, len(w)) n from i where len(w) > 0),
iw as (select distinct item_id, n, array_to_string(w[p:p + n - 1], ' ') g from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) p from s)),
dw as (select rid, p, n, array_to_string(w[p:p + n - 1], ' ') g from (select rid, w, n, unnest(range(1, len(w) - n + 2)) p from d, (select distinct n from s))),
hit as (select rid, p, n, item_id from dw join iw using (n, g)),
words as (select rid, count(distinct q) n_hit from (select rid, unnest(range(p, p + n)) q from (select distinct rid, p, n from hit)) group by 1),
items as (select rid, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct rid, item_id from hit) group by 1)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join words using (rid) left join items using (rid)
"""


def _op9() -> str:
    ratio = {r: f"cast(1000 * {a} // greatest({b}, 1) as bigint)" for r, (a, b, _) in RATIOS.items()}
    spread = " ".join(f"when '{r}' then {s}" for r, (_, _, s) in RATIOS.items())
    sketch = " union all ".join(f"select lang, source, '{r}' ratio, case when r_{r} <= {BINS} then r_{r} else r_{r} - r_{r} % cast(pow(2, length(bin(r_{r})) - 7) as bigint) end bin from m" for r in RATIOS)

    def level(name: str, keys: str) -> str:
        by = f"{keys}, " if keys else ""
        return f"""{name}_q as (select {by}ratio, bin, sum(n) over (partition by {by}ratio order by bin) upto, sum(n) over (partition by {by}ratio) total from (select {by}ratio, bin, count(*) n from sk group by {by}ratio, bin)),
 {name} as (select {by}ratio, cast(max(total) as bigint) n, min(bin) filter (4 * upto >= total) q1, min(bin) filter (4 * upto >= 3 * total) q3 from {name}_q group by {by}ratio)"""

    mixed = lambda q: f"(a.n * a.{q} + {PRIOR} * ((b.n * b.{q} + {PRIOR} * z.{q}) // (b.n + {PRIOR}))) // (a.n + {PRIOR})"
    within = " and ".join(f"r_{r} <= (select q3 + {FENCES} * greatest(q3 - q1, case ratio {spread} end) from up where up.lang is not distinct from m.lang and up.source is not distinct from m.source and up.ratio = '{r}')" for r in RATIOS)
    return rf"""
with d as (select row_number() over () rid, doc_id, lang, source, coalesce(text, '') t from documents),
w as (select rid, regexp_extract_all(t, '[^{_WS}]+') w from d),
g as (select rid, p, w[p:p + 2] g from (select rid, w, unnest(range(1, len(w) - 1)) p from w)),
f as (select rid, p from (select rid, p, count(*) over (partition by rid, g) c from g) where c > 1),
rep as (select rid, count(distinct q) n from (select rid, unnest(range(p, p + 3)) q from f) group by 1),
c as (select d.rid, doc_id, lang, source, cast(len(w) as bigint) n_words, length(regexp_replace(t, '[{_WS}]+', '', 'g')) word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) n_symbols,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_WS}]')) ls, coalesce(rep.n, 0) n_repeat_words from d join w using (rid) left join rep using (rid)),
b0 as (select *, cast(len(ls) as bigint) n_lines, cast(len(ls) - len(list_distinct(ls)) as bigint) n_dup_lines from c),
m as (select *, {", ".join(f"{x} r_{r}" for r, x in ratio.items())} from b0),
sk as ({sketch}),
{level("a", "lang, source")},
{level("b", "lang")},
{level("z", "")},
up as (select a.lang, a.source, a.ratio, {mixed("q1")} q1, {mixed("q3")} q3 from a join b on a.lang is not distinct from b.lang and a.ratio = b.ratio join z on z.ratio = a.ratio),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, {within} inside from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and inside kept from v
"""


def _op10() -> str:
    names = "|".join(_either_case(x) for x in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
    quote = "[\"'']?"
    rules = [
        ("assign", rf"({names}){quote}\x20*[:=]\x20*{quote}([A-Za-z0-9+/_.=-]+)", 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20),
        ("hex", "[0-9a-f]+", 0, 24),
        ("pem", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    ]
    parts = []
    for k, (kind, pattern, group, least) in enumerate(rules):
        parts.append(
            f"select rid, '{kind}' kind, {k} no, unnest(range(1, len(m) + 1)) j, m, g, v, {least} least from (select rid, regexp_extract_all(t, '{pattern}') m, string_split_regex(t, '{pattern}') g, regexp_extract_all(t, '{pattern}', {group}) v from d)"
        )
    return f"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
x as ({" union all ".join(parts)}),
p as (select rid, kind, no, cast(list_sum(list_transform(g[1:j], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda y: length(y))), 0) as bigint) s, length(m[j]) n from x where length(v[j]) >= least),
a as (select rid, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
 string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, no) filter (kind <> 'pem') base, string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, no) spans from p group by 1)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join a using (rid)
"""


ORACLES: dict[str, str] = {"op7_decontamination": _OP7, "op9_quality_rules": _op9(), "op10_secret_scan": _op10()}
