"""The pipeline against a plain version of its stages on a small corpus with planted cases."""

import functools
import random
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402
from test_operators import WORD, brute_counts, brute_first_copies, library_counts, single_linkage  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item = prose(15)
    passage = prose(60)
    docs = {i: "\n".join(prose(40) for _ in range(3)) for i in range(40)}
    docs[100] = " ".join(x + "%%%" for x in prose(120).split())  # junk
    docs[101] = "too short"
    docs[102] = docs[3]  # copy: loses all its lines
    docs[103] = docs[104] = docs[5].replace(" ", "  ", 1)
    docs[105] = f"{prose(70)}\n{passage}"
    docs[106] = f"{prose(70)}\n{passage}\n{prose(30)}"
    docs[107] = f"{prose(50)} {item} {prose(50)}"
    near = prose(200).split()
    docs[108] = " ".join(near)
    near[90] = "changed"
    docs[109] = " ".join(near)
    d = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", "src0", len(t)) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d), docs, item, passage


def test_stages_take_effect(spark, corpus):
    d, docs, item, passage = corpus
    cur, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    cols = cur.columns
    for name, stage in corpus_pipeline.STAGES:
        cur = stage(spark, cur, d).cache()
        seen[name] = cur
        if name != "packing":
            assert cur.columns == cols
    ids = lambda n: {r["doc_id"] for r in seen[n].collect()}
    text = lambda n: {r["doc_id"]: r["text"] for r in seen[n].collect()}
    assert set(docs) - ids("quality_rules") == {100, 101}
    assert ids("line_dedup") == ids("quality_rules")
    lines = text("line_dedup")
    assert lines[102] == "" and lines[105].endswith(passage) and passage not in lines[106]
    assert all(lines[i] == docs[i] for i in range(40))
    stays = ids("near_dedup")
    assert set(range(40)) <= stays and 108 in stays and 109 not in stays and len(stays & {102, 104}) <= 1
    clean = text("decontamination")
    assert item not in clean[107] and clean[107].split() == docs[107].replace(item, "").split()
    packed = seen["packing"]
    assert {r["doc_id"] for r in packed.collect()} == {i for i, t in clean.items() if t}
    want = packed.groupBy("doc_id").agg(F.sum("seq_tokens").alias("n"))
    got = corpus_pipeline.run(spark, d).groupBy("doc_id").agg(F.sum("seq_tokens").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


# run() against plain Python over the same documents -----------------------------------------------------------------


def plain_rules(docs):
    """docs: id -> (text, lang, source). Ratios in thousandths; a group's quartiles are averaged with those of the level above, which weighs 20 documents."""
    least = {"symbols": 20, "dup_lines": 170, "repeats": 100, "word_length": 1500}
    counts, ratios = {}, {}
    for i, (text, _, _) in docs.items():
        n, chars, symbols, dup, rep = counts[i] = brute_counts(text)
        lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
        pairs = {"symbols": (symbols, chars), "dup_lines": (dup, lines), "repeats": (rep, n), "word_length": (chars, n)}
        ratios[i] = {k: 1000 * a // max(b, 1) for k, (a, b) in pairs.items()}
    kept = []
    for i, (_, lang, source) in docs.items():
        ok = counts[i][0] >= 50 and 100 * counts[i][4] <= 50 * counts[i][0]
        for r, spread in least.items():
            quart = None
            for members in (docs, [j for j in docs if docs[j][1] == lang], [j for j in docs if docs[j][1:] == (lang, source)]):
                xs = sorted(x if x <= 20_000 else x - x % 2 ** (x.bit_length() - 7) for x in (ratios[j][r] for j in members))
                own = [xs[-(-k * len(xs) // 4) - 1] for k in (1, 3)]
                quart = own if quart is None else [(len(xs) * q + 20 * above) // (len(xs) + 20) for q, above in zip(own, quart, strict=True)]
            ok &= ratios[i][r] <= quart[1] + 3 * max(quart[1] - quart[0], spread)
        if ok:
            kept.append(i)
    return kept


def plain_clean(text, items):
    """The text without benchmark windows, cut until there are none; None if they cover over half of the words at first."""
    first = True
    while True:
        at = [m.span() for m in re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text)]
        ws = [text[a:b].lower() for a, b in at]
        hit = set()
        for w in items:
            n = min(10, len(w))
            for p in range(len(w) - n + 1):
                for q in range(len(ws) - n + 1):
                    if ws[q : q + n] == w[p : p + n]:
                        hit |= set(range(q, q + n))
        if first and len(hit) > 0.5 * len(ws):
            return None
        first = False
        if not hit:
            return text
        out, end = [], 0
        for q in sorted(hit):
            if q - 1 not in hit:
                out.append(text[end : at[q][0]])
            end = at[q][1] if q + 1 not in hit else end
        text = "".join([*out, text[end:]])


def least_padded(lengths, buckets=16):
    """The least sum of bucket lengths over all ways to choose so many upper bounds."""
    xs = sorted(set(lengths))
    below = [sum(n <= x for n in lengths) for x in xs]

    @functools.cache
    def best(j, k):
        if j < 0:
            return 0
        if not k:
            return float("inf")
        return min(best(i - 1, k - 1) + xs[j] * (below[j] - (below[i - 1] if i else 0)) for i in range(j + 1))

    return best(len(xs) - 1, buckets)


def test_run_is_the_plain_version(spark, corpus):
    d, docs, item, _ = corpus
    rows = {i: (t, "en", "src0") for i, t in docs.items()}
    texts = {i: docs[i] for i in plain_rules(rows)}
    gone = brute_first_copies(texts)
    texts = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in texts.items()}
    ids = sorted(texts)
    stay = [ids[k] for k in single_linkage([texts[i] for i in ids])]
    texts = {i: plain_clean(texts[i], [item.split()]) for i in stay}
    texts = {i: t for i, t in texts.items() if t is not None}
    want = set()
    for i, n in zip(texts, library_counts(texts.values()), strict=True):
        want |= {(i, k, min(2048, n - 2048 * k)) for k in range(-(-n // 2048))}
    out = corpus_pipeline.run(spark, d).collect()
    assert {(r["doc_id"], r["seq_no"], r["seq_tokens"]) for r in out} == want and len(out) == len(want)
    assert all(r["seq_tokens"] <= r["bucket_len"] for r in out)
    assert sum(r["bucket_len"] for r in out) == least_padded([n for _, _, n in want])
    batches = {}
    for r in out:
        batches.setdefault(r["batch_id"], []).append(r["bucket_len"])
    assert all(len(set(b)) == 1 and sum(b) <= 65_536 for b in batches.values())
