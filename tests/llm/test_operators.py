"""Each operator against brute force, and on the awkward tables of conftest."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, html_extract, line_dedup, packing, quality_model, quality_rules, secret_scan, sharding, simhash, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# 1 ------------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    import xxhash

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, radius=2):
    """rows: (id, fp) -> component of each row."""
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= radius:
                up[find(a)] = find(b)
    low = {}
    for i, f in rows:
        if i is not None:
            low[find(f)] = min(low.get(find(f), i), i)
    return [(i, f"{f:016x}", low.get(find(f))) for i, f in rows]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB cÄ\n\t\x0b日İ　"), max_size=60))
def test_fingerprint_is_brute_force(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("words", [1, 2])
def test_bit_sliced_distances(words):
    r = np.random.default_rng(1)
    f = r.integers(0, 2**63, (640, words), dtype=np.int64).astype(np.uint64)
    for k in range(1, 640, 2):
        f[k] = f[k - 1]
        for b in r.choice(64 * words, r.integers(0, 30), replace=False):
            f[k, b // 64] ^= np.uint64(1 << int(b % 64))
    far = lambda a, b: sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(a, b, strict=True))
    for radius in (0, 2, 3, 5, 24):
        got = simhash.within(simhash.bit_planes(f), f.reshape(-1, 64, words), radius)
        for t in range(10):
            for q in range(64):
                want = [far(f[t * 64 + q], x) <= radius for x in f[t * 64 : t * 64 + 64]]
                assert [bool(int(got[t, q]) >> i & 1) for i in range(64)] == want


@pytest.mark.parametrize("tile", [1024, 8])
def test_components(spark, monkeypatch, tile):
    """Chains, stars, dense groups and buckets above the tile."""
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = list(base)
    for b in base[:20]:  # chains of single-bit steps
        for _ in range(r.randrange(8)):
            b ^= 1 << r.randrange(64)
            fps.append(b)
    hub = r.getrandbits(64)
    fps += [hub ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(i)]
    rows = [(i, f) for i, f in enumerate(fps)]
    signed = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for f, i in {f: i for i, f in reversed(rows)}.items()], "fp long, low long").withColumn("n", F.lit(1))
    got = simhash.classes(signed, 2, tile).groupBy("root").agg(F.collect_list("low").alias("m")).collect()
    want = {}
    for i, _, c in brute_components(rows):
        want.setdefault(c, set()).add(i)
    firsts = {f: i for i, f in reversed(rows)}
    assert {frozenset(x["m"]) for x in got} == {frozenset(m & set(firsts.values())) for m in want.values()}


def test_near_duplicates(spark, tidy, nothing):
    got = sorted(map(tuple, simhash.near_duplicates(tidy).collect()), key=str)
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in tidy.collect()]
    assert got == sorted(brute_components(rows), key=str)
    assert simhash.near_duplicates(nothing).collect() == []


def jaccard(a, b):
    grams = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("part", [2048, 16])
def test_deduplicate_catches_near_copies_only(spark, monkeypatch, part):
    """Brute-force similarity on planted families; a bucket size of 16 makes hot buckets of them."""
    monkeypatch.setattr(simhash, "PART", part)
    r = random.Random(21)
    word = lambda: f"u{r.randrange(20_000)}"
    texts, family = [], []
    for f in range(60):
        base = [word() for _ in range(r.randrange(60, 400))]
        for _ in range(r.choice([1, 1, 4, 30])):
            t = list(base)
            for _ in range(int(len(t) * 0.012)):  # a Jaccard similarity of some 0.9 to the base
                t[r.randrange(len(t))] = word()
            texts.append(" ".join(t))
            family.append(f)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = [x["doc_id"] for x in simhash.deduplicate(docs).collect()]
    of = Counter(family[i] for i in kept)
    assert set(of) == set(range(60))  # every family stays
    close = [(i, j) for i in kept for j in kept if i < j and family[i] == family[j] and jaccard(texts[i], texts[j]) >= 0.8]
    assert len(close) <= 3


def single_linkage(texts, least=0.8):
    """The smallest place of each group of a similarity graph, by brute force."""
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and jaccard(texts[i], texts[j]) >= least:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return sorted(set(label))


def test_deduplicate_pairs_within_a_hot_bucket(spark, monkeypatch):
    """Pairs of near copies among moderately similar texts from one template: all of a bucket meets, however it is dealt into parts."""
    monkeypatch.setattr(simhash, "PART", 4)
    r = random.Random(22)
    word = lambda: f"u{r.randrange(20_000)}"
    template, texts = [word() for _ in range(150)], []
    for _ in range(60):
        t = [*template, *(word() for _ in range(60))]
        texts.append(" ".join(t))
        t[-r.randrange(8, 30)] = word()
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x["doc_id"] for x in simhash.deduplicate(docs).collect()) == single_linkage(texts)


def test_near_pairs_of_runs_are_brute_force():
    """Bit planes against brute force, over several buckets and labels."""
    r = random.Random(23)
    words = simhash.SET_BITS // 64
    prints = []
    for k in range(300):
        base = prints[r.randrange(k)] if k > 5 and r.random() < 0.7 else [r.getrandbits(64) for _ in range(words)]
        flip = list(base)
        for _ in range(r.randrange(120)):
            flip[r.randrange(words)] ^= 1 << r.randrange(64)
        prints.append(flip)
    keys, labels = np.sort(np.array([r.randrange(4) for _ in prints])), np.zeros(300, int)
    for k in range(4):
        labels[keys == k] = np.sort([r.randrange(20) for _ in range((keys == k).sum())])
    far = lambda i, j: sum(bin(x ^ y).count("1") for x, y in zip(prints[i], prints[j], strict=True))
    want = {(i, j) for i in range(300) for j in range(i) if keys[i] == keys[j] and labels[i] != labels[j] and far(i, j) <= simhash.SET_RADIUS}
    found = [(a, b) for i, j in simhash.near_in_runs(keys, np.array(prints, dtype=np.uint64), simhash.SET_RADIUS, labels, 2) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(want) > 100 and len(found) == len(want) and set(found) == want


@pytest.mark.parametrize(("part", "most"), [(2048, 1 << 25), (40, 1 << 25), (2048, 9000)])
def test_blocks_join_what_brute_force_joins(spark, part, most):
    """Links of all blocks together with the labels given join the same sets as all pairs of a bucket with a similarity of 0.8; a block gives no more links than rows."""
    r = random.Random(24)
    sets = {}
    for s in range(1, 240):
        base = sets[r.randrange(1, min(s, 12))] if s > 12 and r.random() < 0.9 else {r.getrandbits(62) for _ in range(r.choice([5, 30, 90]))}
        keep = r.sample(sorted(base), max(1, int(len(base) * r.uniform(0.85, 1))))
        sets[s] = {*keep, *(r.getrandbits(62) for _ in range(len(base) - len(keep)))}
    rows, label = [], {s: s if r.random() < 0.8 else -(s % 5) for s in sets}
    for s, g in sets.items():
        h = np.array(sorted(g), dtype="<u8")
        _, fp = simhash.sketch(h)
        keys = [(r.randrange(2) << 6) | t for t in range(3)]
        rows += [(k, s, label[s], fp.tolist(), keys, h.view("<i8").tolist()) for k in keys]
    df = spark.createDataFrame(rows, "key long, s long, label long, fp array<long>, keys array<long>, grams array<long>")
    one = df.select("s", "fp", "keys", "grams").dropDuplicates(["s"])
    dealt = simhash.in_parts(df.select("key", "s", "label"), one.select("s", F.size("grams").alias("w")), part, most)
    got = [tuple(x) for x in simhash.settled(dealt.join(one, "s"), simhash.SET_BITS, 0.8).collect()]
    close = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert all(a > b and close(a, b) for a, b in got)

    def joined(pairs):
        up = {s: s for s in sets}
        root = lambda x: x if up[x] == x else root(up[x])
        first = {}
        for s in sets:
            up[root(s)] = root(first.setdefault(label[s], s))
        for a, b in pairs:
            up[root(a)] = root(b)
        return {frozenset(s for s in sets if root(s) == t) for t in {root(s) for s in sets}}

    members = {}
    for k, s, *_ in rows:
        members.setdefault(k, []).append(s)
    want = {(a, b) for m in members.values() for a in m for b in m if a > b and close(a, b)}
    assert joined(got) == joined(want) and len(want) > len(got) > 20


@pytest.mark.parametrize("part", [2048, 10])
def test_stars_join_to_the_first_row(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    words = simhash.SET_BITS // 64
    rows = [(k, s, [(s >> 3) % 3] * words) for k in (5, 6) for s in range(1, 120) if k == 5 or s % 2]
    df = spark.createDataFrame(rows, "key long, s long, fp array<long>")
    far = {s: f[0] for _, s, f in rows}
    want = {(s, 1) for s in far if s != 1 and bin(far[s] ^ far[1]).count("1") * words <= 20}
    assert {tuple(x) for x in simhash.star_pairs(df, 20).collect()} == want


def test_deduplicate_recall_by_similarity(spark):
    """Pairs of texts by their exact similarity: from 0.8 on at least 0.95 of them are found in each band, below none is."""
    r = random.Random(25)
    word = lambda: f"u{r.randrange(20_000)}"
    texts = []
    for k in range(500):
        base = [word() for _ in range(r.choice([12, 30, 80, 250]))]
        share = r.uniform(0.02, 0.25)
        texts += [" ".join(base), " ".join([*base[: len(base) - max(1, int(len(base) * share))], *(word() for _ in range(max(1, int(len(base) * share))))])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {x["doc_id"] for x in simhash.deduplicate(docs).collect()}
    bands = {}
    for k in range(500):
        j = jaccard(texts[2 * k], texts[2 * k + 1])
        bands.setdefault(0.0 if j < 0.8 else 0.8 if j < 0.85 else 0.85 if j < 0.9 else 0.9, []).append(2 * k + 1 not in kept)
        assert 2 * k in kept
    assert set(bands) == {0.0, 0.8, 0.85, 0.9} and not any(bands.pop(0.0))
    assert all(np.mean(found) >= 0.95 for found in bands.values()), {b: np.mean(f) for b, f in bands.items()}


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("b", "one two three"), ("a", "one two three"), (None, "other words")], "doc_id string, text string")
    got = {(x["doc_id"], x["component_id"]) for x in simhash.near_duplicates(docs).collect()}
    assert got == {("b", "a"), ("a", "a"), (None, None)}


def test_deduplicate_keeps_the_threshold(spark):
    """Texts just above and below the similarity, and short ones that share a shingle."""
    r = random.Random(24)
    word = lambda: f"u{r.randrange(20_000)}"
    texts = ["a b c d e f", "a b c d e g", "b c d e f g"]
    for k in range(120):
        n = r.randrange(60, 300)
        base = [word() for _ in range(n)]
        new = int(n * (0.1 if k % 2 else 0.15))  # words put in place of the last ones: a similarity of some 0.82 or 0.74
        texts += [" ".join(base), " ".join(base[: n - new] + [word() for _ in range(new)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x["doc_id"] for x in simhash.deduplicate(docs).collect()) == single_linkage(texts)
    assert simhash.expected_recall(0.8) > 0.99


def test_deduplicate_awkward(tidy, nothing):
    kept = simhash.deduplicate(tidy)
    assert kept.columns == tidy.columns
    rows = kept.collect()
    assert sorted((x["doc_id"] is None, x["doc_id"]) for x in rows) == [(False, 1), (False, 2), (False, 4), (False, 5), (False, 8), (True, None)]
    assert simhash.deduplicate(nothing).collect() == []


# 2 ------------------------------------------------------------------------------------------------------------------


def test_classifier_learns_and_covers_whole_texts(spark, tidy, nothing):
    r = random.Random(1)
    good = lambda: " ".join("".join(r.choice("etaoinshr") for _ in range(r.randrange(2, 8))) for _ in range(r.randrange(20, 60)))
    bad = lambda: " ".join("".join(r.choice("etaoinshr") for _ in range(4)) + r.choice(["%%%", "###"]) for _ in range(r.randrange(20, 60)))
    rows = [(i, good() if i % 2 else bad(), i % 2) for i in range(400)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2], 0) for x in rows] + [(None, 1, 0), (3, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.fit(docs, labels)
    out = {x["doc_id"]: x for x in quality_model.score(docs, model).collect()}
    held = [i for i, o in out.items() if o["held_out"]]
    assert 60 < len(held) < 140
    assert np.mean([(out[i]["score"] >= 0.7) == bool(i % 2) for i in held]) > 0.95
    # junk at the very end of a long text counts
    far = spark.createDataFrame([(1, " ".join(good() for _ in range(300))), (2, " ".join(good() for _ in range(300)) + " " + bad())], "doc_id long, text string")
    s = {x["doc_id"]: x["score"] for x in quality_model.score(far, model).collect()}
    assert s[2] < s[1]
    odd = quality_model.score(tidy, model)
    assert odd.count() == tidy.count() and odd.where("score is null or score < 0 or score > 1 or held_out is null").count() == 0
    assert quality_model.score(nothing, model).collect() == []
    blank = quality_model.fit(docs, labels.limit(0))
    assert quality_model.score(docs.limit(3), blank).where("score <> 0.5").count() == 0


def test_training_bytes_are_bounded_by_class_in_hash_order():
    rows = [(y, (i * 7919) % 101, i, 10) for i in range(100) for y in [int(i >= 50)]]
    chosen = quality_model.within_bytes(rows, 400)
    assert sum(i < 50 for i in chosen) == sum(i >= 50 for i in chosen) == 20  # no class vanishes, though classes are ordered by id
    assert {i for i in chosen if i < 50} == {r[2] for r in sorted(rows)[:20]}
    assert quality_model.within_bytes([(0, 1, 1, 900), (0, 2, 2, 20), (1, 3, 3, 20)], 100) == [2, 3]


def brute_score(model, text):
    """The network by its definition: loops over windows, chunks and filters, in double precision."""
    z = quality_model
    x = list((text or "").encode() or b"\0")
    x += [0] * (z.WIDTH - len(x) if len(x) < z.WIDTH else -(len(x) - z.WIDTH) % z.STRIDE)
    act = []
    for at in range(0, len(x) - z.WIDTH + 1, z.STRIDE):
        v = sum(model.emb[x[at + k]].astype(float) @ model.conv[k].astype(float) for k in range(z.WIDTH))
        act.append(np.maximum(v + model.cb, 0))
    n = len(act)
    starts = {0} if n <= z.CHUNK else {*range(0, n - z.CHUNK + 1, z.CHUNK // 2), n - z.CHUNK}
    best = np.full(z.HIDDEN, -np.inf)
    for s in starts:
        part = np.array(act[s : s + z.CHUNK])
        feature = np.concatenate([part.mean(0), np.sqrt((part**2).mean(0) + 1e-6)])
        best = np.maximum(best, np.maximum(feature @ model.dense + model.db, 0))
    return 1 / (1 + np.exp(-(best @ model.out + model.ob[0])))


def test_scores_are_brute_force(spark):
    r = random.Random(17)
    model = quality_model.new_model()
    model.out += 0.3
    texts = [None, "", "a", "naïve", "日本語 text " * 30] + ["".join(r.choice("abc é#%\n") for _ in range(r.randrange(1, 900))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in quality_model.score(docs, model).collect():
        assert abs(x["score"] - brute_score(model, texts[x["doc_id"]])) < 1e-3, texts[x["doc_id"]]


def test_held_out_accuracy(spark):
    """On labelled rows that training never sees."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = quality_model.score(docs, quality_model.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 60
    assert np.mean([x["predicted"] == x["quality"] for x in out]) >= 0.9


def test_slabs_and_chunks_agree():
    model = quality_model.new_model()
    tables = model.tables()
    x = quality_model.to_bytes("".join(chr(97 + i * i % 26) for i in range(40_001)))
    whole = np.maximum(quality_model.chunk_features(quality_model.activations(tables, model.cb, x)) @ model.dense + model.db, 0).max(0)
    assert np.allclose(whole, quality_model.pooled(model, tables, x), atol=1e-4)


# 3 ------------------------------------------------------------------------------------------------------------------


def library_counts(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    return [len(tok.encode(t or "", add_special_tokens=False)) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab'sL 19.,!\n\t　\x85\x1c日é😀İ", "  ", "<|endoftext|>", " the"]), max_size=40).map("".join), max_size=5))
def test_token_counts_are_the_library_s(texts):
    assert token_counts.encoder("byte_bpe_50k.json").lengths(texts) == library_counts(texts)


def test_calls_are_balanced_by_bytes(monkeypatch):
    """Every part goes through the library, in calls of about equal bytes; long texts are spread over several."""
    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(16)
    for _ in range(50):
        sizes = [r.choice([1, 10, 1000, 30_000]) for _ in range(r.randrange(1, 200))]
        ranges = token_counts.balanced(sizes, 50_000)
        assert [x for a, b in ranges for x in range(a, b)] == list(range(len(sizes)))
        sums = [sum(sizes[a:b]) for a, b in ranges]
        assert max(sums) <= sum(sizes) / max(1, -(-sum(sizes) // 50_000)) + max(sizes)
    enc, calls = token_counts.Encoder("byte_bpe_50k.json"), []
    own = enc.encode
    enc.encode = lambda parts: calls.append(sum(len(p.encode()) for p in parts)) or own(parts)
    texts = ["naïve text " * r.randrange(1, 400) for _ in range(300)] + [None, "", "long words and é " * 60_000]
    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    assert enc.lengths(texts) == [len(tok.encode(t or "", add_special_tokens=False)) for t in texts]
    total = sum(len((t or "").encode()) for t in texts)
    assert sum(calls) == total and len(calls) >= total // token_counts.CALL_BYTES and max(calls) < 2 * token_counts.CALL_BYTES


def test_long_texts_are_cut_at_safe_places(monkeypatch):
    r = random.Random(2)
    text = "".join(r.choice(["a", " ", "  ", "\n", " b", "don't ", "日本", "7 "]) for _ in range(20_000))
    parts = token_counts.parts_of(text, 100)
    assert len(parts) > 50 and "".join(parts) == text
    assert sum(library_counts(parts)) == library_counts([text])[0]


def test_token_table(tidy, nothing):
    rows = token_counts.count_tokens(tidy).collect()
    texts = [r["text"] for r in tidy.collect()]
    want = Counter((r["doc_id"], len((t or "").encode()), n, n > 512) for r, t, n in zip(tidy.collect(), texts, library_counts(texts), strict=True))
    assert Counter(map(tuple, rows)) == want
    assert token_counts.count_tokens(nothing).collect() == []


def test_other_vocabularies(spark):
    import public_tokenizers
    import sentencepiece

    texts = ["The quick  brown fox", "", "naïve 日本"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, "piece_bpe_32k.model").collect()}
    assert got == {i: len(sp.encode(t)) for i, t in enumerate(texts)}
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, "byte_bpe_50k.tiktoken").collect()}
    assert got == dict(enumerate(library_counts(texts)))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab'sL 19.,!\n\té\x85日", "  ", " the", "don't "]), max_size=40).map("".join), max_size=5))
def test_ranks_count_what_the_library_counts(texts):
    assert token_counts.encoder("byte_bpe_50k.tiktoken").lengths(texts) == library_counts(texts)


# 4 ------------------------------------------------------------------------------------------------------------------


def words(r, n):
    return " ".join(f"v{r.randrange(4000)}" for _ in range(n))


def test_line_dedup_deletes_later_runs_and_nothing_else(spark):
    r = random.Random(5)
    passage = [words(r, 20), words(r, 25), words(r, 15)]
    short = words(r, 8)
    one = words(r, 60)
    own = [[words(r, r.randrange(5, 40)) for _ in range(6)] for _ in range(8)]
    texts = {
        1: own[0][:3] + passage + own[0][3:],
        2: [short, *own[1]],
        3: own[2][:2] + passage + own[2][2:] + [short],
        4: [*passage, *own[3], *passage],
        5: own[4][:1] + [one] + own[4][1:] + [short],
        6: own[5][:4] + ["  " + one + "\t"] + own[5][4:],
        7: own[6][:2] + passage[:2] + own[6][2:],  # 45 words: too short a run
    }
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {x["doc_id"]: x for x in line_dedup.dedup_lines(docs, removed="n").collect()}
    gone = {i: g["n"] for i, g in got.items()}
    assert gone == {1: 0, 2: 0, 3: 3, 4: 6, 5: 0, 6: 1, 7: 0}
    assert got[3]["text"].split("\n") == own[2] + [short]
    assert got[4]["text"].split("\n") == own[3]
    assert got[6]["text"].split("\n") == own[5]


def brute_first_copies(texts):
    """Runs of 50 words or more that stand earlier, in (id, line) order, line by line."""
    lines = {i: t.split("\n") for i, t in texts.items()}
    order = sorted(lines)
    out = {}
    for d in order:
        gone = set()
        for f in order:
            if f > d:
                break
            for shift in range(-len(lines[f]) + 1, len(lines[d])):
                if f == d and shift <= 0:
                    continue
                run = []
                for i in range(len(lines[d]) + 1):
                    q = i - shift
                    if i < len(lines[d]) and 0 <= q < len(lines[f]) and lines[d][i] == lines[f][q]:
                        run.append(i)
                        continue
                    if sum(len(lines[d][x].split()) for x in run) >= 50:
                        gone |= set(run)
                    run = []
        out[d] = gone
    return out


def test_line_dedup_against_all_pairs(spark):
    """Passages of three lines that start with a unique line: the earliest holder is the same for every fingerprint of a run."""
    r = random.Random(11)
    pool = [[words(r, r.randrange(20, 45)) for _ in range(3)] for _ in range(12)]
    texts = {}
    for d in range(60):
        parts = []
        for _ in range(r.randrange(1, 5)):
            parts += [words(r, r.randrange(3, 30))] if r.random() < 0.5 else r.choice(pool)
        texts[d] = "\n".join(parts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(docs).collect()}
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone) for (d, t), gone in zip(texts.items(), brute_first_copies(texts).values(), strict=True)}
    assert got == want


def test_line_dedup_with_several_holders(spark):
    """An earlier text holds just part of a repeated run; runs put together from several texts, with short lines at their edges."""
    r = random.Random(12)
    common, next_line = words(r, 38), words(r, 15)
    texts = {0: "\n".join([words(r, 40), common, words(r, 40)])}
    for d in range(1, 5):
        texts[d] = "\n".join([words(r, 40), common, next_line, words(r, 40)])
    texts[5] = "\n".join([words(r, 40), common, words(r, 40), common, next_line])
    pool = [words(r, r.choice([3, 8, 15, 25, 38, 55])) for _ in range(14)]
    for d in range(6, 70):
        parts = []
        for _ in range(r.randrange(1, 4)):
            at = r.randrange(len(pool))
            parts += [*pool[at : at + r.randrange(1, 7)], words(r, r.randrange(3, 30))]
        texts[d] = "\n".join(parts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in line_dedup.dedup_lines(docs).collect()}
    assert all(common not in got[d] for d in (2, 3, 4))
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone) for (d, t), gone in zip(texts.items(), brute_first_copies(texts).values(), strict=True)}
    assert got == want


def test_line_dedup_of_many_equal_lines(spark):
    """Linear in the lines of a text: 20,000 equal ones within seconds of what fifty take."""
    import time

    line = words(random.Random(13), 18)
    took = []
    for n in (50, 50, 20_000):
        docs = spark.createDataFrame([(1, "\n".join([line] * n)), (2, "\n".join([line] * 4))], "doc_id long, text string")
        start = time.time()
        got = {x["doc_id"]: (x["n"], x["text"]) for x in line_dedup.dedup_lines(docs, removed="n").collect()}
        took.append(time.time() - start)
        assert got == {1: (n - 1, line) if n > 3 else None, 2: (4, "")} or got == {1: (n - 3, "\n".join([line] * 3)), 2: (4, "")}
    assert took[2] < took[1] + 30


def test_line_dedup_with_other_ids(spark):
    line = words(random.Random(14), 60)
    docs = spark.createDataFrame([("b", line), ("a", line), (None, line), ("a", "own")], "doc_id string, text string")
    got = sorted((x["doc_id"] or "", x["text"]) for x in line_dedup.dedup_lines(docs).collect())
    assert got == sorted([("", ""), ("a", line), ("a", "own"), ("b", "")])


def test_line_dedup_awkward(tidy, nothing):
    out = line_dedup.dedup_lines(tidy)
    assert out.columns == tidy.columns and out.count() == tidy.count()
    assert Counter(map(str, out.collect())) == Counter(map(str, tidy.collect()))  # all runs are short
    assert line_dedup.dedup_lines(nothing).collect() == []


# 5 ------------------------------------------------------------------------------------------------------------------

PAGES = [
    ("<html><body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>First &amp; only.<p>Second\n  one<br>goes on</article><footer>All rights</footer></body></html>", "Title\nFirst & only.\nSecond one goes on"),
    ("<body><div class='site-header'><a>Home</a></div><div id=content><h2>Head</h2><div><p>" + "Long enough prose. " * 20 + "</p><p>Hi.</p></div><aside>Ad ad</aside></div><div class='comments'><p>" + "Reader says much. " * 10 + "</p></div></body>", None),
    (None, ""),
    ("", ""),
    ("<p></p><script>var a = '<p>x</p>';</script>", ""),
    ("just text", "just text"),
    ("<div class='has-sidebar'><article><div class='article-header'><h1>T</h1></div><p>One.</p><div class='ad'>Buy</div><p>Two.</p></article><div id='sidebar'>Links</div></div><article class='comment'><p>" + "I say so. " * 30 + "</p></article>", "T\nOne.\nTwo."),
    ("<form id=all><div id=cookie-notice>We use cookies</div><div><h2>H</h2><p>" + "Words and words. " * 20 + "</p></div><div class=social-share>Share</div></form>", "H\n" + ("Words and words. " * 20).strip()),
    ("<article><p>Caf&eacute; &#x1F600; &nbsp;x</p><form><input value=a>Subscribe</form><p>End</article>", "Café 😀 x\nEnd"),
]


def test_html(spark, tidy):
    for html, want in PAGES:
        if want is not None:
            assert html_extract.extract(html) == want
    text = html_extract.extract(PAGES[1][0])
    assert text.startswith("Head\nLong enough prose.") and text.endswith("Hi.") and "Reader" not in text and "Home" not in text and "Ad" not in text
    pages = spark.createDataFrame([(i, f"u{i}", h, "x") for i, (h, _) in enumerate(PAGES)] + [(None, None, None, None)], "page_id long, url string, html string, text string")
    out = html_extract.main_text(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == len(PAGES) + 1
    assert out.where("n_chars <> char_length(text) or text is null").count() == 0
    assert html_extract.main_text(pages.limit(0)).collect() == []


def test_html_cluster_decides_where_the_mark_misleads():
    """A marked list of teasers beside unmarked prose: the prose is what comes out. Where the mark holds the prose it is the container."""
    teasers = "".join(f"<li><a href=x><b>Teaser</b> <i>number</i> {i}</a></li>" for i in range(25))
    prose = "".join(f"<p>{'Plain sentences of an essay that goes on. ' * 5}{i}</p>" for i in range(6))
    text = html_extract.extract(f"<body><article>{teasers}</article><div>{prose}</div></body>")
    assert "essay" in text and "Teaser" not in text
    text = html_extract.extract(f"<body><div>{teasers}</div><article>{prose}</article></body>")
    assert text.count("\n") == 5 and "Teaser" not in text


def brute_cluster(ratios, sizes):
    """Smoothing by the formula over all lines, the threshold by the definition, every range of lines tried."""
    import math

    n = len(ratios)
    g = lambda d: math.exp(-d * d / (2 * 1.5**2)) if abs(d) <= 4 else 0
    x = [sum(g(i - j) * ratios[j] for j in range(n)) / sum(g(i - j) for j in range(n)) for i in range(n)]
    bar = min(np.std(x), 0.8 * max(x))
    ranges = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if all(v >= bar for v in x[i:j])]
    return max(ranges, key=lambda r: (sum(sizes[r[0] : r[1]]), r[1] - r[0], -r[0]))


def test_html_clusters_are_brute_force():
    r = random.Random(15)
    for _ in range(200):
        sizes = [r.choice([1, 5, 20, 200, 400]) for _ in range(r.randrange(1, 25))]
        ratios = [c / r.choice([1, 1, 2, 5]) for c in sizes]
        lo, hi = html_extract.cluster(ratios, sizes)
        a, b = brute_cluster(ratios, sizes)
        assert sum(sizes[lo:hi]) == sum(sizes[a:b])


def test_html_every_page_goes_through_the_clusters(monkeypatch):
    """All pages of sf0.01 with text reach the clustering, with a line for each line of their blocks."""
    import pyarrow.parquet as pq

    calls = []
    monkeypatch.setattr(html_extract, "cluster", lambda ratios, sizes, do=html_extract.cluster: calls.append(len(ratios)) or do(ratios, sizes))
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    texts = [html_extract.extract(h) for h in pages]
    assert len(calls) == len(pages) and all(n >= t.count("\n") + 1 for n, t in zip(calls, texts, strict=True))
    assert html_extract.extract("<p>one\ntwo three\n\n<p>four") == "one two three\nfour" and calls[-1] == 3


def test_html_is_linear_in_depth():
    import time

    for page in ("<div>t " * 40_000, "<b><div>" + "<span>x" * 20_000 + "</b>" * 20_000 + "y<hr>" * 20_000, "<p>" + "<i>" * 20_000 + "<div>a</div>" * 20_000):
        start = time.time()
        assert html_extract.extract(page)
        assert time.time() - start < 15


def test_html_deep_and_broken():
    assert html_extract.extract("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"
    assert html_extract.extract("<p>a<p>b</b></i></div><table><tr><td>c<td>d</table>") != ""


# 6 ------------------------------------------------------------------------------------------------------------------


def test_boundaries_are_optimal():
    from itertools import combinations

    r = random.Random(4)
    for _ in range(30):
        hist = {r.randrange(1, 60): r.randrange(1, 9) for _ in range(r.randrange(1, 9))}
        k = r.randrange(1, 5)
        cost = lambda bounds: sum(n * (min(b for b in bounds if b >= x) - x) for x, n in hist.items())  # noqa: E731, B023
        got = packing.optimal_boundaries(hist, k)
        ls = sorted(hist)
        best = min(cost([*c, ls[-1]]) for c in combinations(ls[:-1], min(k, len(ls)) - 1))
        assert len(got) <= k and cost(got) == best


def test_packing_places_every_token_once(spark, tidy, nothing):
    r = random.Random(6)
    lens = spark.createDataFrame([(i, r.choice([0, 1, 7, 7, 7, 100, 2048, 5000, r.randrange(1, 3000)])) for i in range(3000)] + [(None, 9), (1, None)], "doc_id long, n_tokens long")
    out = packing.pack_lengths(lens, buckets=6, batch_tokens=8192).cache()
    assert out.agg(F.sum("seq_tokens")).first()[0] == lens.agg(F.sum("n_tokens")).first()[0]
    assert out.where("seq_tokens > bucket_len or seq_tokens < 1 or seq_tokens > 2048").count() == 0
    full = out.groupBy("batch_id").agg(F.sum("bucket_len").alias("t"), F.countDistinct("bucket_len").alias("b"))
    assert full.where("t > 8192 or b <> 1").count() == 0
    assert out.groupBy("bucket_len").count().count() <= 6
    assert packing.pack(tidy).where("batch_id is null").count() == 0
    assert packing.pack(nothing).collect() == []


def test_packing_spreads_null_and_repeated_ids(spark):
    lens = spark.range(40_000).select(F.when(F.col("id") % 3 > 0, 7).alias("doc_id"), F.lit(1500).cast("long").alias("n_tokens"))
    out = packing.pack_lengths(lens, batch_tokens=8192).cache()
    assert out.count() == 40_000
    group = out.groupBy(F.substring_index("batch_id", "-", 2).alias("g")).agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("none"))
    rows = group.collect()
    assert len(rows) > 50 and max(x["n"] for x in rows) < 3 * 40_000 / len(rows) and all(x["none"] for x in rows)
    assert out.groupBy("batch_id").agg(F.sum("bucket_len").alias("t")).where("t > 8192").count() == 0


# 7 ------------------------------------------------------------------------------------------------------------------


def brute_contamination(text, items):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    hit, found = set(), set()
    for name, w in items:
        n = min(10, len(w))
        for p in range(len(w) - n + 1) if n else ():
            for q in range(len(ws) - n + 1):
                if ws[q : q + n] == w[p : p + n]:
                    hit |= set(range(q, q + n))
                    found.add(name)
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [2_000_000, 30])
def test_contamination(spark, tidy, nothing, block, monkeypatch):
    monkeypatch.setattr(decontaminate.blocks_of, "__defaults__", ("item_id", "text", block))
    r = random.Random(8)
    vocab = [f"t{i}" for i in range(6)] + ["été", "9"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)] + [(50, None), (51, "--"), (3, "t0, T1; t2")]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(40))) + " " + (items[r.randrange(12)][1] or "")) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(tidy.select("doc_id", "text"))
    coded = [(str(i), re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())) for i, t in items]
    marked = decontaminate.mark(docs.select("doc_id", "text"), bench, block_words=block)
    got = Counter((x["doc_id"], x["found"]["n_words"], sum(x["found"]["ends"]) - sum(x["found"]["starts"]), len(x["found"]["items"])) for x in marked.collect())
    assert got == Counter((x["doc_id"], *brute_contamination(x["text"], coded)[:3]) for x in docs.collect())
    out = Counter(map(tuple, decontaminate.contamination(docs, bench).collect()))
    assert out == Counter((x["doc_id"], *brute_contamination(x["text"], coded)) for x in docs.collect())
    assert decontaminate.contamination(nothing, bench).collect() == []
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated or n_items > 0").count() == 0


def test_clean_cuts_spans_and_drops_covered_documents(spark, tidy, nothing):
    item = " ".join(f"q{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    prose = " ".join(f"z{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"{prose} {item.upper().replace(' ', ', ')}; {prose}"), (2, f"a {item} b"), (3, prose)], "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in decontaminate.clean(docs, bench).collect()}
    assert got == {1: f"{prose} ; {prose}", 3: prose}
    # the same with many blocks
    many = bench.unionByName(spark.createDataFrame([(2, "r1 r2"), (3, "r3")], "item_id long, text string"))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(decontaminate.blocks_of, "__defaults__", ("item_id", "text", 5))
        assert {x["doc_id"]: x["text"] for x in decontaminate.clean(docs, many).collect()} == got
    # a cut that brings a passage together
    halves = item.split()
    nested = spark.createDataFrame([(9, f"{prose} {' '.join(halves[:5])} {item} {' '.join(halves[5:])} {prose}")], "doc_id long, text string")
    assert decontaminate.clean(nested, bench).first()["text"].split() == prose.split() * 2
    same = decontaminate.clean(tidy, bench)
    assert same.columns == tidy.columns and Counter(map(str, same.collect())) == Counter(map(str, tidy.collect()))
    assert decontaminate.clean(nothing, bench).collect() == []


# 8 ------------------------------------------------------------------------------------------------------------------


def test_clean_rescans_with_many_blocks(spark, monkeypatch):
    """Passages inside passages, with a benchmark of several blocks."""
    r = random.Random(41)
    items = [words(r, 15) for _ in range(4)]
    inner = items[0].split()
    for x in items[1:]:
        inner = [*x.split()[:7], *inner, *x.split()[7:]]
    prose = words(r, 200)
    docs = spark.createDataFrame([(1, f"{prose} {' '.join(inner)} {prose}"), (2, prose), (3, f"{prose} {items[1]}"), (4, items[2]), (5, None)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    one = {x["doc_id"]: x["text"] for x in decontaminate.clean(docs, bench).collect()}
    monkeypatch.setattr(decontaminate.blocks_of, "__defaults__", ("item_id", "text", 20))
    monkeypatch.setattr(decontaminate.mark, "__defaults__", (*decontaminate.mark.__defaults__[:-1], 20))
    many = {x["doc_id"]: x["text"] for x in decontaminate.clean(docs, bench).collect()}
    assert many == one and many[1].split() == prose.split() * 2 and set(many) == {1, 2, 3, 5}



def test_lookup_table_is_even_and_stable():
    names = [f"s{i}" for i in range(10)]
    t = sharding.lookup_table(names, 1009)
    n = Counter(t)
    assert max(n.values()) - min(n.values()) <= 1
    less = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(t, less, strict=True) if a != 9)
    assert moved < 0.25 * 1009
    for bad in ((["a"], 4), ([], 7), (["a", "a"], 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def brute_table(names, slots):
    """Each shard's whole preference list is written down; in turns, a shard takes its first free entry."""
    number = lambda what, n: int.from_bytes(hashlib.sha256(f"{what}:{n}".encode()).digest()[:8], "big")
    wish = {n: [(number("offset", n) % slots + j * (1 + number("skip", n) % (slots - 1))) % slots for j in range(slots)] for n in names}
    owner = {}
    while True:
        for n in names:
            owner[next(s for s in wish[n] if s not in owner)] = n
            if len(owner) == slots:
                return owner


@pytest.mark.parametrize(("n", "slots"), [(1, 2), (3, 7), (7, 101), (5, 5)])
def test_lookup_table_is_brute_force(spark, n, slots):
    names = [f"node {i}" for i in range(n)]
    want = brute_table(names, slots)
    assert [names[i] for i in sharding.lookup_table(names, slots)] == [want[s] for s in range(slots)]
    table = sharding.slot_table(spark, names, slots)
    assert {x["slot"]: x["shard"] for x in table.collect()} == want
    assert "ExistingRDD" not in table._jdf.queryExecution().toString()


def test_placement_is_brute_force(spark, tidy):
    """Every row's slot by a hash computed outside Spark, its shard by the written-down preference lists."""
    import xxhash

    names, slots = ["a", "b", "c"], 13
    want = brute_table(names, slots)
    for r in sharding.place(tidy.select("doc_id"), "doc_id", names, slots).collect():
        # the engine's hash of a row: each column's hash is the next one's seed; nulls change nothing, a flag is hashed as an int
        h = 42 if r["doc_id"] is None else xxhash.xxh64_intdigest(r["doc_id"].to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(int(r["doc_id"] is None).to_bytes(4, "little"), h)
        slot = (h - (1 << 64) if h >> 63 else h) % slots
        assert (r["slot"], r["shard"]) == (slot, want[slot])


def test_placement_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "x", "y", 2)], "slot long, shard string, s string, k0 long")
    out = sharding.place(docs, ["slot", "shard"], 3, 11)
    assert out.columns == ["slot", "shard", "slot", "shard"] and out.count() == 1


def test_placement(tidy, nothing):
    out = sharding.place(tidy).collect()
    assert len(out) == tidy.count()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add((r["slot"], r["shard"]))
    assert all(len(x) == 1 for x in by.values())
    names = [f"shard-{i:05d}" for i in range(sharding.SHARDS)]
    table = sharding.lookup_table(names)
    assert all(names[table[r["slot"]]] == r["shard"] for r in out)
    assert sharding.place(nothing).collect() == []
    assert sharding.place(tidy, ["source", "lang"]).count() == tidy.count()


# 9 ------------------------------------------------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(grams)
    covered = {q for i, g in enumerate(grams) if n[g] > 1 for q in range(i, i + 3)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, tidy, nothing):
    r = random.Random(9)
    made = [(100 + i, "".join(r.choice(["a ", "b ", "c\n", "# ", "\n", "\t", "dd ", "a b c "]) for _ in range(r.randrange(120))), "en", "s0") for i in range(80)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string").unionByName(tidy.select("doc_id", "text", "lang", "source"))
    out = quality_rules.measure(docs).collect()
    got = Counter(tuple(x)[:7] for x in out)
    want = Counter()
    for x in docs.collect():
        c = brute_counts(x["text"])
        want[(x["doc_id"], *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert got == want
    assert not any(x["kept"] and x["base_failed"] for x in out)
    assert quality_rules.measure(nothing).collect() == []
    kept = quality_rules.keep(tidy)
    assert kept.columns == tidy.columns and {x["doc_id"] for x in kept.collect()} <= {5}
    assert quality_rules.keep(nothing).collect() == []


def test_extreme_ratios_pass_no_fence(spark):
    """A group of long words: what is far above its fence goes, its own words stay."""
    r = random.Random(43)
    word = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    rows = [(i, " ".join(word(r.randrange(25, 31)) for _ in range(60)), "xx", "s0") for i in range(150)]
    rows.append((999, " ".join(word(400) for _ in range(60)), "xx", "s0"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {x["doc_id"] for x in quality_rules.measure(docs).where("not kept").collect()} == {999}


def test_thresholds_follow_language_and_source(spark):
    """Symbols that are usual in one source are odd in another; groups that are too small take their language's fence."""
    r = random.Random(10)
    plain = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(80))
    noisy = lambda: " ".join(f"w{r.randrange(10**6)}" + "#" * r.randrange(3) for _ in range(80))
    rows = [(i, plain(), "en", "prose") for i in range(150)] + [(1000 + i, noisy(), "en", "code") for i in range(150)] + [(2000, noisy(), "en", "prose"), (3000, plain(), "en", "tiny"), (3001, plain(), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    gone = {x["doc_id"] for x in quality_rules.measure(docs).where("not kept").collect()}
    assert gone == {2000}


# 10 -----------------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute_secrets(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    out += [(m.start(), 3, "pem", m.end()) for m in re.finditer("-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", text)]
    text = lambda rows: ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(rows))
    n = Counter(k for _, _, k, _ in out)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(text([x for x in out if x[1] < 3]).encode()).hexdigest(), text(out)


def test_secrets(spark, tidy, nothing):
    r = random.Random(12)
    bits = ["password", "Token", "API_KEY", "apikey", "ſecret", " : ", "=", '"', "'", "abc123", "x", "AKIA" + "A1" * 8, "AKIA123", "0123456789abcdef" * 2, "deadbeef", "😀", "日", "\n", " ", "-----BEGIN RSA PRIVATE KEY-----", "K"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(40)))) for i in range(200)]
    docs = spark.createDataFrame(rows + rows[:20], "doc_id long, text string").unionByName(tidy.select("doc_id", "text"))
    got = Counter(map(tuple, secret_scan.secrets(docs).collect()))
    assert got == Counter((x["doc_id"], *brute_secrets(x["text"])) for x in docs.collect())
    assert secret_scan.secrets(nothing).collect() == []


def test_ledger_scans_only_unseen_pairs(spark):
    v1 = spark.createDataFrame([(1, "token=abcdef1"), (2, "token=abcdef1"), (3, "clean")], "doc_id long, text string")
    v2 = spark.createDataFrame([(1, "token=abcdef1"), (4, "secret: zzzzzz9")], "doc_id long, text string")
    n = len(secret_scan.RULES)
    first = secret_scan.update_ledger(v1)
    assert first.count() == 2 * n
    fresh = secret_scan.update_ledger(v2, first)
    assert fresh.count() == n and fresh.select("blob").distinct().count() == 1
    digits = secret_scan.Rule("digits", "[0-9]+", 0, 1)
    more = secret_scan.update_ledger(v2, first.unionByName(fresh), rules=(*secret_scan.RULES, digits))
    assert {(x["rule_version"], len(x["places"])) for x in more.collect()} == {(digits.version, 1)} and more.count() == 2  # the new rule scans alone
    assert secret_scan.Rule("digits", "[0-9]+", 0, 2).version != digits.version
    out = secret_scan.findings(v1.unionByName(v2), first.unionByName(fresh)).collect()
    assert sorted((x["doc_id"], len(x["spans"])) for x in out) == [(1, 1), (1, 1), (2, 1), (3, 0), (4, 1)]


def test_own_rules_are_used(spark):
    docs = spark.createDataFrame([(1, "code 12345 token=abcdefgh")], "doc_id long, text string")
    got = secret_scan.secrets(docs, rules=(secret_scan.Rule("dig", "[0-9]+", 0, 4),)).first()
    assert got["spans"] == "dig:5:10" and got["n_dig"] == 1


def test_ledger_stays_between_runs(spark, tmp_path):
    """Two runs on one ledger folder: the second adds the unseen blob's pairs only, and both give what a run on an empty ledger gives."""
    at = str(tmp_path / "ledger")
    v1 = spark.createDataFrame([(1, "token=abcdef1"), (2, "token=abcdef1"), (3, "clean"), (None, None)], "doc_id long, text string")
    v2 = v1.unionByName(spark.createDataFrame([(4, "secret: zzzzzz9"), (5, "clean")], "doc_id long, text string"))
    n = len(secret_scan.RULES)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(secret_scan.secrets(v1, ledger_path=at)) == rows(secret_scan.secrets(v1))
    assert spark.read.parquet(at).count() == 3 * n
    assert rows(secret_scan.secrets(v2, ledger_path=at)) == rows(secret_scan.secrets(v2))
    assert spark.read.parquet(at).count() == 4 * n
    secret_scan.secrets(v2, ledger_path=at).collect()
    assert spark.read.parquet(at).count() == 4 * n
