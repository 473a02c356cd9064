"""SimHash near-duplicate detection with bit-sliced Hamming comparison.

1. *Fingerprints.* Whole texts go to Python as Arrow batches; each shingle is hashed with XXH64 and a
   fingerprint bit is set if it is set in over half of the hashes.
2. *Candidates.* Distinct fingerprints only (copies collapse first). A fingerprint is cut into
   ``radius + 2`` blocks; two fingerprints within the radius agree in at least two of them, so every pair of blocks gives
   a bucket key. Buckets above ``tile`` distinct fingerprints are cut again by the same rule on the bits that the
   key leaves open, until the open bits alone bound a bucket: exact, with no caps.
3. *Comparison.* A bucket run is laid out as bit planes of 64 lanes a word. XORing a query's bit with a
   plane updates 64 distances at once in a carry-save counter that saturates above the radius; a block of
   lanes is abandoned when all of them have passed it.
4. *Components.* Each bucket yields a spanning star (at most one link for each member), and links are contracted by
   alternating large-star/small-star rounds on written tables.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; fewer words than the
shingle length make one shingle of the whole sequence; repeated rows each get a row; null ids never become a
component id unless the whole component has none; ids may be of any type that can be ordered; other columns are dropped, so clashing names don't matter.

``deduplicate`` links texts by the Jaccard similarity of their five-word shingle sets: longer fingerprints, compared by the same bit planes inside buckets of
sets that share minima, give candidates, which are verified exactly where they are found.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, grown, materialize, release, shield, split_by_keys

BITS = 64
#: Distinct fingerprints of a bucket that are compared directly; larger buckets are cut again.
TILE = 1024
_CHUNK = 1 << 15
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of one whole text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, last, strict=True)], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, _CHUNK):  # bounded memory however long the text is
        part = np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long): one row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, fp long")


def within(planes: np.ndarray, queries: np.ndarray, radius: int, block: int = 16, ignore: np.ndarray | None = None) -> np.ndarray:
    """Bit-sliced comparison.

    planes: (tiles, bits) words; lane i of word [t, b] is bit b of tile t's i-th fingerprint. queries: (tiles, q, bits // 64) fingerprints.
    Gives (tiles, q) words whose set lanes are within ``radius`` of the query; lanes set in ``ignore`` (tiles, q) don't count. A query leaves its tile's
    block of 64 lanes as soon as all of them have passed the radius, which is looked at after each ``block`` planes.
    """
    tiles, q, words = queries.shape
    bits = words * 64
    result = np.zeros(tiles * q, dtype=np.uint64)
    over = np.zeros(tiles * q, dtype=np.uint64) if ignore is None else ignore.reshape(-1)
    alive = np.nonzero(over != _ALL)[0]
    over, tile, qs = over[alive], alive // q, queries.reshape(-1, words)[alive]
    digits = [np.zeros(len(alive), dtype=np.uint64) for _ in range(max(1, int(radius).bit_length()))]
    for start in range(0, bits if len(alive) else 0, block):
        for b in range(start, start + block):
            bit = (qs[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)
            carry = planes[tile, b] ^ (np.uint64(0) - bit)  # lanes that differ in this bit
            for d in digits:  # carry-save: add one bit to every lane's counter
                both = carry & d
                np.bitwise_xor(d, carry, out=d)
                carry = both
            over |= carry
        passed = over | _greater(digits, radius)
        if start + block >= bits:
            result[alive] = ~passed
            break
        live = passed != _ALL
        if not live.all():
            alive, tile, qs, over = alive[live], tile[live], qs[live], over[live]
            digits = [d[live] for d in digits]
            if not len(alive):
                break
    return result.reshape(tiles, q)


def _greater(digits: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose binary counter is above ``radius``."""
    gt = np.zeros_like(digits[0])
    eq = np.full_like(digits[0], _ALL)
    for i in reversed(range(len(digits))):
        if radius >> i & 1:
            eq &= digits[i]
        else:
            gt |= eq & digits[i]
            eq &= ~digits[i]
    return gt


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(tiles, bits) words from (tiles * 64, words) fingerprints."""
    n, words = fps.shape
    bits = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(-1, 64, 8 * words), axis=2, bitorder="little")
    lanes = np.ascontiguousarray(bits.transpose(0, 2, 1))  # tile, bit, lane
    return np.packbits(lanes, axis=2, bitorder="little").view("<u8").reshape(-1, 64 * words)


_BELOW = np.array([(1 << i) - 1 for i in range(65)], dtype=np.uint64)  # the lowest i lanes


def near_in_runs(keys: np.ndarray, fps: np.ndarray, radius: int, labels: np.ndarray | None = None, tiles_at_once: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i > j within the radius, by parts. Rows are sorted by key, then by label if there are labels; all rows of a key with different labels are compared."""
    n, words = fps.shape
    if not n:
        return
    tiles = -(-n // 64)
    padded = np.zeros((tiles * 64, words), dtype=np.uint64)
    padded[:n] = fps
    planes, queries = bit_planes(padded), padded.reshape(-1, 64, words)
    at = np.arange(n)
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    begin = np.full(tiles * 64, n)  # a row meets those from the begin of its key ...
    begin[:n] = np.maximum.accumulate(np.where(first, at, 0))
    end = np.zeros(tiles * 64, int)  # ... to the begin of its label, or to itself
    end[:n] = at if labels is None else np.maximum.accumulate(np.where(first | np.concatenate([[True], labels[1:] != labels[:-1]]), at, 0))
    # the furthest tile back that a row of tile t still has to meet
    back = np.arange(tiles) - begin[np.arange(tiles) * 64] // 64
    for off in range(int(back.max(initial=0)) + 1):
        t = np.nonzero(back >= off)[0]
        for part in np.array_split(t, max(1, len(t) // tiles_at_once)):
            if not len(part):
                continue
            base = (part - off)[:, None] * 64
            rows = part[:, None] * 64 + np.arange(64)
            meet = _BELOW[np.clip(end[rows] - base, 0, 64)] & ~_BELOW[np.clip(begin[rows] - base, 0, 64)]
            hit = within(planes[part - off], queries[part], radius, ignore=~meet)
            rows, cols = np.nonzero(hit)
            if not len(rows):
                continue
            lanes = np.unpackbits(hit[rows, cols].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, lane = np.nonzero(lanes)
            yield part[rows[r]] * 64 + cols[r], (part[rows[r]] - off) * 64 + lane


def links_in_runs(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs i > j of a key within the radius."""
    found = list(near_in_runs(keys, fps, radius))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _masks(radius: int, open_mask: int = (1 << BITS) - 1) -> list[int]:
    """Keys for one level: the open bits in ``radius + 2`` blocks, two of which agree for a pair within the radius."""
    bits = [b for b in range(BITS) if open_mask >> b & 1]
    k = min(radius + 2, len(bits))
    blocks = [sum(1 << b for b in bits[i::k]) for i in range(k)]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_rows(fps: DataFrame, radius: int, tile: int, held: list) -> DataFrame:
    """(k1, k2, fp): rows of every bucket with two fingerprints at least; no bucket passes ``tile``
    unless its open bits alone bound it."""
    keyed = fps.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(_signed(m)).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for m in _masks(radius)])).alias("k"),
    ).select("fp", F.col("k.m").alias("m"), F.col("k.v").alias("v"))
    sizes = keyed.groupBy("m", "v").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialize(sizes, "simhash-buckets", held)
    shared = materialize(keyed.join(sizes, ["m", "v"]), "simhash-rows", held)
    small = shared.where(F.col("n") <= tile).select("m", "v", "fp")
    deeper = []
    if shared.where(F.col("n") > tile).limit(1).count():
        full = (1 << BITS) - 1
        for m in _masks(radius):
            sub = [s | m for s in _masks(radius, full & ~m)]
            inner = [t | s for s in sub for t in _masks(radius, full & ~s)]
            big = shared.where((F.col("n") > tile) & (F.col("m") == F.lit(_signed(m))))
            deeper.append(
                big.select("fp", F.explode(F.array(*[F.struct(F.lit(_signed(s)).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(s))).alias("v")) for s in inner])).alias("k")).select(F.col("k.m").alias("m"), F.col("k.v").alias("v"), "fp")
            )
    for d in deeper:
        small = small.unionByName(d.distinct())
    return small


def links(fps: DataFrame, radius: int = 2, tile: int = TILE, held: list | None = None) -> DataFrame:
    """(a, b) with a > b: a spanning forest of the links in each bucket, from distinct fingerprints ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_f = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
        for b in batches:
            k = np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)], axis=1)
            k = np.concatenate([rest_k, k])
            f = np.concatenate([rest_f, b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)])
            whole = np.nonzero((k != k[-1]).any(axis=1))[0]
            cut = int(whole[-1]) + 1 if len(whole) else 0  # the last bucket may go on in the next batch
            if cut:
                yield from out(k[:cut], f[:cut])
            rest_k, rest_f = k[cut:], f[cut:]
        if len(rest_f):
            yield from out(rest_k, rest_f)

    def out(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([[0], np.cumsum((k[1:] != k[:-1]).any(axis=1))])
        root = spanning(len(f), *links_in_runs(ids, f[:, None], radius))
        own = np.nonzero(root != np.arange(len(f)))[0]
        yield pa.RecordBatch.from_arrays([pa.array(f[own].view(np.int64)), pa.array(f[root[own]].view(np.int64))], ["a", "b"])

    held = [] if held is None else held
    rows = bucket_rows(fps, radius, tile, held)
    found = rows.repartition("m", "v").sortWithinPartitions("m", "v").select("m", "v", "fp").mapInArrow(run, "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node reachable; nodes without a link are absent.

    Alternating large-star and small-star rounds: every round hangs nodes on smaller ones, and the links settle as stars
    in about log^2 rounds. Each round is a written table, so lost executors only cost a round. Hubs are never
    gathered: a node's minimum is an aggregate with map-side combination, which is then joined back.
    """
    spark = edges.sparkSession
    held: list[str] = []
    cur = materialize(edges.select("a", "b").where("a > b").distinct(), "links", held)
    before = None
    for _ in range(max_rounds):
        # large star: the larger neighbours of a node hang on the smallest of its neighbourhood
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        now: list[str] = []
        # minima are written before they are joined: both sides of the join are then plain exchanges, and a hub's rows can be split
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "links-low", now)
        large = cur.select(F.col("b").alias("u"), F.col("a").alias("v")).join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the smaller neighbours of a node, and itself, hang on the smallest of them
        large = materialize(large, "links", now)
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "links-low", now)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        nxt = materialize(small, "links", now)
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(spark, held)
        held, cur = now, nxt
        if state == before:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def classes(groups: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(fp, low, n, root) from distinct fingerprints with their smallest id and number of rows."""
    held: list[str] = []
    edges = materialize(links(groups.select("fp"), radius, tile, held), "simhash-links")
    release(groups.sparkSession, held)
    comp = components(edges)
    return groups.join(comp, groups["fp"] == comp["node"], "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, tile: int = TILE) -> DataFrame:
    """(id_col, fingerprint, component_id): one row for each input row."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    groups = materialize(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), "simhash-groups")
    roots = materialize(classes(groups, radius, tile), "simhash-roots")
    least = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    label = materialize(roots.join(least, "root").select("fp", "component_id"), "simhash-classes")
    return rows.join(label, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies: least similarity of shingle sets; minima in a key and keys of a set; keys whose buckets are first linked as stars.
SIMILARITY, BAND, TABLES, STARS = 0.8, 8, 42, 4
#: Bits of the fingerprints of shingle sets, and the radius within which two of them are candidates: at a similarity of 0.8 the expected
#: distance is 155 with a standard deviation of 11.5.
SET_BITS, SET_RADIUS = 1024, 192
#: Rows of a bucket, and bytes of their sets, that make a part; larger buckets are compared part by part, every part with every other.
PART, PART_BYTES = 2048, 32 << 20


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of one whole text; a text of fewer words is one shingle."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, last, strict=True)], dtype="<u8"))


@functools.cache
def _mixers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.default_rng(20)
    odd = lambda n: r.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)
    return odd(BAND * TABLES), odd(BAND * TABLES), odd(SET_BITS // 8)


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one set: a key for each table, hashed together from BAND minima with the table's number in the low six bits, and the SimHash of SET_BITS bits. Each
    shingle adds a random signed byte to every bit's sum, so that sets of a few shingles follow the law of angles too."""
    import xxhash

    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(SET_BITS // 64, np.int64)
    a, b, c = _mixers()
    low, total = np.full(BAND * TABLES, _ALL), np.zeros(SET_BITS, np.float32)
    for i in range(0, len(hashes), 512):  # bounded memory however long the text is
        x = hashes[i : i + 512, None]
        x = x ^ (x >> np.uint64(31))
        low = np.minimum(low, (x * a + b).min(axis=0))
        y = x * c
        y ^= y >> np.uint64(32)
        # sums of whole numbers, exact as long as a set has fewer than 100,000 shingles and off by parts per million beyond
        total += np.ones(len(x), np.float32) @ y.view(np.int8).astype(np.float32)
    raw = low.astype("<u8").tobytes()
    keys = [(xxhash.xxh64_intdigest(raw[8 * BAND * t : 8 * BAND * (t + 1)], t) << 6 | t) & 0xFFFFFFFFFFFFFFFF for t in range(TABLES)]
    return np.array(keys, dtype=np.uint64).view(np.int64), np.packbits(2 * total + np.float32(len(hashes)) > 0, bitorder="little").view("<i8")


def expected_recall(similarity: float) -> float:
    """Chance that two sets of equal size and this Jaccard similarity share a key and lie within the radius."""
    from math import acos, comb, pi

    p = acos(2 * similarity / (1 + similarity)) / pi
    near = sum(comb(SET_BITS, k) * p**k * (1 - p) ** (SET_BITS - k) for k in range(SET_RADIUS + 1))
    return (1 - (1 - similarity**BAND) ** TABLES) * near


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(s, grams): the sorted shingle hashes of (s, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, shingle).view("<i8") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["s", "grams"])

    return texts.mapInArrow(run, "s long, grams array<long>")


def similar(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], similarity: float, shingle: int, held: list) -> DataFrame:
    """The (a, b) of ``pairs`` whose shingle sets have at least this Jaccard similarity, computed exactly. ``texts`` gives (s, text) for a table of s."""
    pairs = materialize(pairs, "near-pairs", held)
    ids = pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).distinct()
    sets = materialize(shingle_sets(texts(ids), shingle), "shingle-sets", held)
    side = lambda x: sets.select(F.col("s").alias(x), F.col("grams").alias(f"g{x}"))
    both = pairs.join(grown(side("b")), "b").join(grown(side("a")), "a")
    shared = F.size(F.array_intersect("ga", "gb"))
    return both.where(shared >= F.lit(similarity) * (F.size("ga") + F.size("gb") - shared) - F.lit(1e-9)).select("a", "b")


def _runs(cols: list[np.ndarray]) -> np.ndarray:
    """Numbers of the runs of equal rows."""
    change = np.zeros(len(cols[0]), bool)
    for c in cols:
        change[1:] |= c[1:] != c[:-1]
    return np.cumsum(change)


def _lists(column: pa.Array) -> list[np.ndarray]:
    ends = column.offsets.to_numpy()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True)]


def star_pairs(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b) with a > b: every set of a bucket with the bucket's first one, if their fingerprints are within the radius, from (key, s, fp). A large bucket streams past
    its first row."""

    def pairs(key: np.ndarray, s: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        i, j = links_in_runs(key, fp, radius)
        ok = np.concatenate([[True], key[1:] != key[:-1]])[j]
        a, b = s[i[ok]], s[j[ok]]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                cols = [part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False), np.stack(_lists(part.column(2))).view(np.uint64)]
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)] if rest else cols
                yield pairs(*cols)
                last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last bucket may go on: its first row is all it needs
                rest = [c[last : last + 1] for c in cols]

    dealt = rows.select("key", "s", "fp").repartition("key").sortWithinPartitions("key", "s")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def settled(rows: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(a, b) with a > b: links that join what the verified pairs of each block join, from (key, i, j, label, s, part, fp, keys, grams). Rows with one label
    are joined already. In a block, pairs with different labels are compared by bit planes; those within the radius that no earlier table has brought together are verified on
    their sets, unless links of the block join them by then. So a block gives fewer links than it has rows, whatever its pairs are."""

    def links(cols: dict[str, np.ndarray | list]) -> Iterator[tuple[int, int]]:
        block, label, part, split = _runs([cols[k] for k in ("key", "i", "j")]), cols["label"], cols["part"], cols["i"] != cols["j"]
        n, grams, keys, table = len(block), cols["grams"], cols["keys"], cols["key"] & 63
        up = np.maximum.accumulate(np.where(np.diff(_runs([block, label]), prepend=-1) > 0, np.arange(n), 0)).tolist()
        tables = np.arange(keys.shape[1])

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for i, j in near_in_runs(block, cols["fp"], radius, label, 128):
            for at in range(0, len(i), 1 << 16):
                a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                before = ((keys[a] == keys[b]) & (tables < table[a][:, None])).any(axis=1)
                ok = ~before & (~split[a] | (part[a] != part[b]))  # a block of two parts: only pairs across
                for x, y in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
                    p, q = root(x), root(y)
                    if p == q:
                        continue
                    g, h = grams[x], grams[y]
                    least = similarity * (len(g) + len(h)) / (1 + similarity) - 1e-9  # of the intersection
                    if min(len(g), len(h)) >= least and len(np.intersect1d(g, h, assume_unique=True)) >= least:
                        up[max(p, q)] = min(p, q)
                        yield cols["s"][x], cols["s"][y]

    def out(cols: dict[str, np.ndarray | list]) -> pa.RecordBatch:
        found = np.array(list(links(cols)), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found.max(axis=1, initial=-(1 << 63))), pa.array(found.min(axis=1, initial=(1 << 63) - 1))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray | list] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {n: batch.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(names[:6])}
            cols |= {"fp": np.stack(_lists(batch.column(6))).view(np.uint64), "keys": np.stack(_lists(batch.column(7))), "grams": _lists(batch.column(8))}
            if rest is not None:
                cols = {n: rest[n] + c if n == "grams" else np.concatenate([rest[n], c]) for n, c in cols.items()}
            block = _runs([cols[k] for k in ("key", "i", "j")])
            cut = int(np.searchsorted(block, block[-1]))  # the last block may go on in the next batch
            if cut:
                yield out({n: c[:cut] for n, c in cols.items()})
            rest = {n: c[cut:] for n, c in cols.items()}
        if rest is not None:
            yield out(rest)

    names = ["key", "i", "j", "label", "s", "part", "fp", "keys", "grams"]
    dealt = rows.select(*names).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "label", "s")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def in_parts(rows: DataFrame, sizes: DataFrame, part: int, part_bytes: int) -> DataFrame:
    """(key, i, j, label, s, part): the rows (key, s, label) of buckets that have two labels, a bucket above ``part`` rows or ``part_bytes`` of sets (sizes: s, w shingles) dealt into
    parts by hash; each part meets itself and every other one in a block (i, j) of its own: exact, and no block is large."""
    of = rows.join(grown(sizes), "s").groupBy("key").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    of = of.select("key", F.ceil(F.greatest(F.col("n") / part, F.col("w") * 8 / part_bytes)).cast("long").alias("parts"))
    dealt = rows.join(grown(of), "key").withColumn("part", F.pmod(F.xxhash64("s"), F.col("parts")))
    blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.struct(F.least("part", o).alias("i"), F.greatest("part", o).alias("j")))
    return dealt.select("key", "s", "label", "part", F.explode(blocks).alias("x")).select("key", "x.i", "x.j", "label", "s", "part")


def near_links(groups: DataFrame, texts: Callable[[DataFrame], DataFrame], similarity: float, shingle: int, held: list, radius: int = SET_RADIUS) -> DataFrame:
    """(a, b): verified links that join all sets which a chain of verified candidate pairs joins, from distinct sets (s, keys, fp)."""
    bands = groups.select("s", F.explode("keys").alias("key"))
    buckets = materialize(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "near-buckets", held)
    shared = materialize(bands.join(grown(buckets), "key"), "near-rows", held)
    # stars first: a large group of copies is joined by a link or a few for each member
    star = shared.where(F.col("key").bitwiseAND(F.lit(63)) < STARS).join(grown(groups.select("s", "fp")), "s")
    first = materialize(similar(star_pairs(star, radius), texts, similarity, shingle, held), "near-links")
    comp = components(first)
    # then every pair of a bucket that isn't joined yet
    rows = shared.join(grown(comp), shared["s"] == comp["node"], "left").select("key", "s", F.coalesce("root", "s").alias("label"))
    apart = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    rows = materialize(rows.join(grown(apart), "key"), "near-labelled", held)
    sets = materialize(shingle_sets(texts(rows.select("s").distinct()), shingle), "shingle-sets", held)
    dealt = in_parts(rows, sets.select("s", F.size("grams").alias("w")), PART, PART_BYTES)
    second = settled(dealt.join(grown(sets), "s").join(grown(groups.select("s", "fp", "keys")), "s"), radius, similarity)
    return first.unionByName(second)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """Keep one row of each group of near copies, with all columns of ``docs``: the one with the smallest id (rows without an id come
    last, ties go to the smallest set hash); of rows that repeat both, any one.

    Near copies are texts whose sets of ``shingle``-word shingles have a Jaccard similarity of ``similarity`` or more, and what a chain of such pairs
    joins. Sets that share a key of minima form a bucket; inside each bucket SimHash fingerprints are compared by bit planes, and pairs within the radius are
    candidates (``expected_recall``). Every link is then verified on the sets themselves, so nothing below the similarity is ever linked. Wordless texts are
    copies of each other.
    """
    inner, place, restore = shield(docs)
    i, at = place(id_col), docs.columns.index(text_col)
    longs = T.ArrayType(T.LongType())
    out = T.StructType([*inner.schema.fields, T.StructField("s", T.LongType()), T.StructField("keys", longs), T.StructField("fp", longs)])
    wire = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sets = [shingle_set(t, shingle) for t in b.column(at).to_pylist()]
            ids = np.array([xxhash.xxh64_intdigest(x.tobytes(), 7) if len(x) else 0 for x in sets], dtype=np.uint64).view(np.int64)
            keys, fps = zip(*map(sketch, sets), strict=True) if sets else ((), ())
            cols = [c.cast(f.type) for c, f in zip(b.columns, wire, strict=False)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ids), *(pa.array(list(x), wire.field(len(wire) - 1).type) for x in (keys, fps))], schema=wire)

    rows = materialize(inner.mapInArrow(run, out), "fingerprinted")
    groups = materialize(rows.groupBy("s").agg(F.min(i).alias("low"), F.count("*").alias("n"), F.first("keys").alias("keys"), F.first("fp").alias("fp")), "near-groups")

    def texts(ids: DataFrame) -> DataFrame:
        # the id is a key too: thousands of copies share a set, but not an id
        need = groups.join(grown(ids), "s", "left_semi").select(F.col("s").alias("n_s"), F.col("low").alias("n_low"))
        near, _ = split_by_keys(rows, F.col("s"), ids, held)
        found = near.join(grown(need), (F.col("s") == F.col("n_s")) & F.col(i).eqNullSafe(F.col("n_low")), "left_semi")
        return found.select("s", F.col(place(text_col)).cast("string").alias("text")).dropDuplicates(["s"])

    held: list[str] = []
    edges = materialize(near_links(groups, texts, similarity, shingle, held), "near-links")
    release(docs.sparkSession, held)
    comp = materialize(components(edges), "near-roots")
    roots = groups.join(grown(comp), F.col("s") == F.col("node"), "left").select("s", "low", F.coalesce("root", "s").alias("root"))
    best = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "s"))
    chosen = roots.groupBy("root").agg(best.alias("best")).select(F.col("best.s").alias("c_s"), F.col("best.low").alias("c_low"))
    # rows that are alone with their set and have no link stay where they are
    suspects = groups.where("n > 1").select("s").unionByName(comp.select(F.col("node").alias("s"))).unionByName(comp.select(F.col("root").alias("s")))
    maybe, alone = split_by_keys(rows, F.col("s"), suspects)
    kept = maybe.join(grown(chosen), (F.col("s") == F.col("c_s")) & F.col(i).eqNullSafe(F.col("c_low")), "left_semi")
    repeated = maybe.groupBy("s", F.col(i).alias("id")).agg(F.count("*").alias("n")).where("n > 1")
    repeated = materialize(repeated.select(F.col("s").alias("r_s"), F.col("id").alias("r_id")), "repeated")
    if not repeated.limit(1).count():
        return restore(kept.unionByName(alone))
    same = (F.col("s") == F.col("r_s")) & F.col(i).eqNullSafe(F.col("r_id"))
    once = kept.join(repeated, same, "left_semi").dropDuplicates(["s", i])
    return restore(kept.join(repeated, same, "left_anti").unionByName(once).unionByName(alone))
