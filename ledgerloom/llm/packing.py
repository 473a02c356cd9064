"""Packing into optimal length buckets.

Documents are cut into sequences of at most ``max_len`` tokens. A global histogram of sequence lengths, whose size is bounded by ``max_len``, goes to the
driver, where dynamic programming chooses the ``buckets`` boundaries that minimise padding. Inside each bucket,
batches of a fixed token budget are formed: a bucket's rows are dealt to groups by a hash of their row number, so many groups that each holds
about ``GROUP_BATCHES`` batches whatever the bucket's size, and rows are numbered within their group. One hot length only
means more groups.

Defined results: null and empty texts and texts without tokens have no sequence (they are absent); repeated rows give repeated
sequences; ties in a group's order don't change batch sizes; the last batch of a group may be short; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .token_counts import count_tokens

MAX_LEN, BUCKETS, BATCH_TOKENS, GROUP_BATCHES = 2048, 16, 65_536, 64
#: The 50k vocabulary as ranks: the same tokens as the .json file's, but a special string inside a text is ordinary text.
TOKENIZER = "byte_bpe_50k.tiktoken"


def optimal_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets, with the least total padding over all ways to choose them."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    n = np.array([histogram[x] for x in lengths.tolist()], dtype=np.int64)
    count = np.concatenate([[0], np.cumsum(n)])
    m, k = len(lengths), min(buckets, len(lengths))
    # cost of a bucket over lengths[i:j] is lengths[j - 1] * rows, less the tokens, which every choice pays alike
    best = np.concatenate([[0], lengths * count[1:]])
    cut = np.zeros((k + 1, m + 1), dtype=np.int64)
    for b in range(2, k + 1):
        new = best.copy()
        for j in range(b, m + 1):
            cost = best[b - 1 : j] + lengths[j - 1] * (count[j] - count[b - 1 : j])
            i = int(cost.argmin())
            new[j], cut[b, j] = cost[i], i + b - 1
        best = new
    out, j = [], m
    for b in range(k, 0, -1):
        out.append(int(lengths[j - 1]))
        j = int(cut[b, j])
    return out[::-1]


def sequences(lengths: DataFrame, id_col: str, n_col: str, max_len: int) -> DataFrame:
    """(id, _row, seq_no, seq_tokens): full sequences and the rest of each document."""
    n = F.col(n_col)
    nos = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / max_len).cast("long"))).alias("seq_no")
    rows = lengths.where(n > 0).select(F.col(id_col), "_row", n.alias("_n"), nos)
    return rows.select(id_col, "_row", "seq_no", F.least(F.lit(max_len).cast("long"), F.col("_n") - F.col("seq_no") * max_len).alias("seq_tokens"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, max_len: int = MAX_LEN, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """(id_col, seq_no, seq_tokens, bucket_len, batch_id): one row for each sequence; a batch has at most
    ``batch_tokens`` tokens, padding to its bucket's length counted."""
    lengths = count_tokens(docs, tokenizer, id_col, text_col).select(id_col, "n_tokens")
    return pack_lengths(lengths, id_col, "n_tokens", max_len, buckets, batch_tokens)


def pack_lengths(lengths: DataFrame, id_col: str = "doc_id", n_col: str = "n_tokens", max_len: int = MAX_LEN, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    # rows get numbers that are written with them: null and repeated ids are dealt to groups like any others, and a retried task reads the same numbers
    numbered = materialize(lengths.select(id_col, n_col).withColumn("_row", F.monotonically_increasing_id()), "token-counts")
    seqs = sequences(numbered, id_col, n_col, max_len)
    histogram = {r["seq_tokens"]: r["n"] for r in seqs.groupBy("seq_tokens").agg(F.count("*").alias("n")).collect()}  # max_len rows at most
    bounds = optimal_boundaries(histogram, buckets)
    if not bounds:
        return seqs.select(id_col, "seq_no", "seq_tokens", F.lit(0).cast("long").alias("bucket_len"), F.lit("").alias("batch_id"))
    bucket, groups, rows_each = F.lit(bounds[-1]), F.lit(1), F.lit(1)
    low = 0
    plan = []
    for b in bounds:
        rows = sum(n for x, n in histogram.items() if low < x <= b)
        each = max(1, batch_tokens // b)
        plan.append((b, each, max(1, -(-rows // (each * GROUP_BATCHES)))))
        low = b
    for b, each, g in reversed(plan):
        at = F.col("seq_tokens") <= b
        bucket, rows_each, groups = F.when(at, b).otherwise(bucket), F.when(at, each).otherwise(rows_each), F.when(at, g).otherwise(groups)
    dealt = seqs.select(id_col, "_row", "seq_no", "seq_tokens", bucket.cast("long").alias("bucket_len"), rows_each.alias("_each"), F.pmod(F.xxhash64("_row", "seq_no"), groups.cast("long")).alias("_group"))
    order = Window.partitionBy("bucket_len", "_group").orderBy(F.xxhash64("_row", "seq_no", F.lit(1)), "_row", "seq_no")
    batch = F.floor((F.row_number().over(order) - 1) / F.col("_each"))
    return dealt.select(id_col, "seq_no", "seq_tokens", "bucket_len", F.concat_ws("-", "bucket_len", "_group", batch.cast("string")).alias("batch_id"))
