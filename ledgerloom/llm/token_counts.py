"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut before single spaces that stand between two non-space characters, once a piece has ``PIECE``
characters. No piece of a byte-level pre-tokenizer runs over such a place (a piece takes a space only at its start), so counts of the
parts add up to the count of the whole, and a very long text never meets the encoder at once. The parts of an Arrow batch go to
the encoder in calls of about equal UTF-8 bytes (``balanced``): many short texts share a call, a long one fills several.

Every part goes through the library of the vocabulary file: ``tokenizers`` for .json, ``sentencepiece`` for .model, ``tiktoken`` for .tiktoken. Other
vocabularies than byte-level ones have no safe places; their texts are not cut.

Defined results: null counts as empty (0 bytes, 0 tokens); special strings inside texts are what the tokenizer file makes of them by default; no
begin, end or added tokens; no truncation or padding; one row for each input row; extra columns are dropped.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a part at least before it is cut, and about the bytes that go to the encoder in one call.
PIECE, CALL_BYTES = 1 << 15, 1 << 18
OVER = 512
SAFE = re.compile(r"(?<=\S) (?=\S)")


def library(name: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """Lengths of a list of texts in one call of the vocabulary's library, and whether texts may be cut at safe places."""
    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its cores already
    path = str(public_tokenizers.path(name))
    if name.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(x) for x in enc.encode_ordinary_batch(texts, num_threads=1)], True
    if not name.endswith(".json"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)], False
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)], tok.normalizer is None and "ByteLevel" in str(tok.pre_tokenizer)


def balanced(sizes: list[int], call_bytes: int = CALL_BYTES) -> list[tuple[int, int]]:
    """Ranges of parts for one call each: as many calls as the bytes need, cut where the running sum passes each call's equal share."""
    total = sum(sizes)
    calls = max(1, -(-total // call_bytes))
    out, start, run = [], 0, 0
    for i, n in enumerate(sizes):
        run += n
        if run * calls >= total * (len(out) + 1):
            out.append((start, i + 1))
            start = i + 1
    return out if start == len(sizes) else [*out, (start, len(sizes))]


class Encoder:
    def __init__(self, name: str):
        self.encode, self.cuts = library(name)

    def lengths(self, texts: list[str | None], sizes: list[int] | None = None) -> list[int]:
        """Tokens of each text; ``sizes``: their UTF-8 bytes, where they are known."""
        owner: list[int] = []
        parts: list[str] = []
        weights: list[int] = []
        for k, text in enumerate(texts):
            if not text:
                continue
            own = parts_of(text) if self.cuts and len(text) > PIECE else [text]
            owner += [k] * len(own)
            parts += own
            weights += [sizes[k]] if sizes and len(own) == 1 else [len(p.encode("utf-8", "surrogatepass")) for p in own]
        out = [0] * len(texts)
        for a, b in balanced(weights):
            for k, n in zip(owner[a:b], self.encode(parts[a:b]), strict=True):
                out[k] += n
        return out


@functools.lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """One for each worker process, however many tasks it serves."""
    return Encoder(name)


def parts_of(text: str, piece: int = PIECE) -> list[str]:
    out, at = [], 0
    while len(text) - at > piece:
        m = SAFE.search(text, at + piece - 1)
        if m is None or m.start() <= at:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", limit: int = OVER) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit): one row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            n = pa.array(enc.lengths(b.column(2).to_pylist(), b.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
