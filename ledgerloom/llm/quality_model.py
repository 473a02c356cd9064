"""Quality classifier: a byte-level convolutional network, trained and applied in numpy.

Layers: learned byte embeddings; ``filters`` convolution filters over ``width`` bytes with ReLU; mean over
overlapping chunks of ``chunk`` windows that hop by half a chunk and cover the whole document; a dense ReLU layer for each
chunk; max-pool over all chunks; logistic output. For scoring, embedding and filters are folded into one table of
256 x filters values for each position, so a text costs ``width`` gathers a window.

Training takes at most ``SAMPLE_PER_CLASS`` labelled rows of either class, the first by a hash of doc_id (a
bound that doesn't grow with the corpus). Their whole texts come to the driver, long ones too, as long as those of a class stay within half of
``MAX_TRAIN_BYTES``: in the order of the hash, a text that doesn't fit is left out and the next ones are tried. The bias is set for the class shares
of all training labels. Scoring reads every whole text where it lies, in Arrow batches.

Defined results: null and empty texts are scored as a text of one zero byte; labels, lang, source and ids are no
inputs; a table without usable labels gives the score of the untrained prior 0.5; repeated label rows of a doc_id count once (the smallest label).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound on the labelled rows that are fitted: so many of each class, of at most half of MAX_TRAIN_BYTES for each.
SAMPLE_PER_CLASS = 1000
MAX_TRAIN_BYTES = 16_000_000
EMBED, WIDTH, FILTERS, HIDDEN = 6, 6, 16, 16
STRIDE, CHUNK = 2, 64
THRESHOLD = 0.7
_SLAB = 1 << 12


@dataclass
class Model:
    emb: np.ndarray  # 256 x E
    conv: np.ndarray  # width x E x F
    cb: np.ndarray  # F
    dense: np.ndarray  # 2F x H
    db: np.ndarray  # H
    out: np.ndarray  # H
    ob: np.ndarray  # 1

    def params(self) -> dict[str, np.ndarray]:
        return self.__dict__

    def tables(self) -> np.ndarray:
        """width x 256 x F: what each byte adds to each filter at each position."""
        return np.einsum("ve,kef->kvf", self.emb, self.conv).astype(np.float32)


def new_model(seed: int = 7) -> Model:
    r = np.random.default_rng(seed)
    n = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
    return Model(n(256, EMBED, s=0.7), n(WIDTH, EMBED, FILTERS, s=(1 / (WIDTH * EMBED)) ** 0.5 * 1.4), np.zeros(FILTERS, np.float32), n(2 * FILTERS, HIDDEN, s=(1 / FILTERS) ** 0.5), np.zeros(HIDDEN, np.float32), n(HIDDEN, s=HIDDEN**-0.5), np.zeros(1, np.float32))


def to_bytes(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass") or b"\0"
    need = WIDTH + (-(len(raw) - WIDTH)) % STRIDE if len(raw) > WIDTH else WIDTH
    return np.frombuffer(raw.ljust(WIDTH, b"\0") if len(raw) <= WIDTH else raw + b"\0" * ((-(len(raw) - WIDTH)) % STRIDE), np.uint8) if need else None


def windows_of(x: np.ndarray) -> int:
    return (len(x) - WIDTH) // STRIDE + 1


def activations(tables: np.ndarray, cb: np.ndarray, x: np.ndarray) -> np.ndarray:
    """windows x F after ReLU."""
    n = windows_of(x)
    a = np.take(tables[0], x[: STRIDE * n : STRIDE], axis=0)
    b = np.empty_like(a)
    for k in range(1, WIDTH):
        a += np.take(tables[k], x[k : k + STRIDE * (n - 1) + 1 : STRIDE], axis=0, out=b, mode="clip")
    a += cb
    return np.maximum(a, 0, out=a)


def chunk_bounds(n: int) -> np.ndarray:
    """Starts of overlapping chunks that cover n windows; the last one ends with the text."""
    if n <= CHUNK:
        return np.zeros(1, int)
    starts = np.arange(0, n - CHUNK + 1, CHUNK // 2)
    return starts if starts[-1] == n - CHUNK else np.append(starts, n - CHUNK)


def chunk_features(a: np.ndarray) -> np.ndarray:
    """chunks x 2F: mean and root mean square of each filter in each chunk."""
    n, starts = len(a), chunk_bounds(len(a))
    if n <= CHUNK:
        return np.concatenate([a.mean(0), np.sqrt((a * a).mean(0) + 1e-6)])[None]
    half = CHUNK // 2
    m = n // half
    blocks = a[: m * half].reshape(m, half, -1)
    s, q = blocks.sum(1), (blocks * blocks).sum(1)
    mean, sq = (s[:-1] + s[1:]) / CHUNK, (q[:-1] + q[1:]) / CHUNK
    if len(starts) > len(mean):
        tail = a[n - CHUNK :]
        mean, sq = np.vstack([mean, tail.mean(0)]), np.vstack([sq, (tail * tail).mean(0)])
    return np.concatenate([mean, np.sqrt(sq + 1e-6)], axis=1)


def pooled(model: Model, tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Max over all chunks of the dense layer. Long texts go by slabs that overlap by a chunk, in bounded memory."""
    n, best, step = windows_of(x), None, _SLAB - _SLAB % (CHUNK // 2)
    for i in range(0, n, step):
        part = x[STRIDE * i : STRIDE * (min(n, i + step + CHUNK) - 1) + WIDTH]
        if i and windows_of(part) <= CHUNK:
            part = x[STRIDE * (n - CHUNK) :]
        h = np.maximum(chunk_features(activations(tables, model.cb, part)) @ model.dense + model.db, 0).max(0)
        best = h if best is None else np.maximum(best, h)
    return best


def score_text(model: Model, tables: np.ndarray, text: str | None) -> float:
    z = float(pooled(model, tables, to_bytes(text)) @ model.out + model.ob[0])
    return 1.0 / (1.0 + float(np.exp(-np.clip(z, -30, 30))))


def _step(model: Model, tables: np.ndarray, x: np.ndarray, y: float, weight: float, grads: dict[str, np.ndarray]) -> float:
    """Add the gradient of one text's loss; only the chunks that won the max-pool are revisited."""
    a = activations(tables, model.cb, x)
    c = chunk_features(a)
    h = np.maximum(c @ model.dense + model.db, 0)
    win = h.argmax(0)
    p = h[win, np.arange(HIDDEN)]
    z = float(p @ model.out + model.ob[0])
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    dz = weight * (s - y)
    grads["out"] += dz * p
    grads["ob"] += dz
    dh = dz * model.out * (p > 0)
    grads["db"] += dh
    rows = c[win]  # H x 2F
    grads["dense"] += (rows * dh[:, None]).T
    dc = dh[:, None] * model.dense.T  # H x 2F
    starts = chunk_bounds(len(a))
    n = min(CHUNK, len(a))
    for g in np.unique(win):
        d = dc[win == g].sum(0)
        part = a[starts[g] : starts[g] + n]
        da = (d[:FILTERS] / n + d[FILTERS:] * part / (n * c[g, FILTERS:])) * (part > 0)
        grads["cb"] += da.sum(0)
        at = STRIDE * starts[g]
        for k in range(WIDTH):
            b = x[at + k : at + k + STRIDE * (n - 1) + 1 : STRIDE]
            grads["conv"][k] += model.emb[b].T @ da
            np.add.at(grads["emb"], b, da @ model.conv[k].T)
    return -weight * (np.log(s + 1e-9) if y else np.log(1 - s + 1e-9))


def train(texts: list[str | None], labels: list[int], shares: tuple[float, float] | None = None, epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Model:
    """Fit by Adam. ``shares``: class shares of the population, for which the sampled rows are weighted."""
    model = new_model(seed)
    if len(set(labels)) < 2:
        model.out[:] = 0
        return model
    xs, ys = [to_bytes(t) for t in texts], np.array(labels, float)
    have = np.array([(ys == 0).mean(), (ys == 1).mean()])
    w = np.array(shares or have) / have
    # between even and true shares while the filters form, true shares at the end
    r, m, v, t = np.random.default_rng(seed), {}, {}, 0
    for k, p in model.params().items():
        m[k], v[k] = np.zeros_like(p), np.zeros_like(p)
    for e in range(epochs):
        order = r.permutation(len(xs))
        lr = rate * (1 - e / epochs) ** 0.7
        mix = np.ones(2) if e < epochs // 2 else w
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            grads = {k: np.zeros_like(p) for k, p in model.params().items()}
            tables = model.tables()
            for j in part:
                _step(model, tables, xs[j], ys[j], mix[int(ys[j])], grads)
            t += 1
            for k, p in model.params().items():
                g = grads[k] / len(part) + 1e-5 * p
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p -= lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return model


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def within_bytes(rows: list[tuple], most: int | None = None) -> list:
    """Ids of the (class, hash, id, bytes) that are fitted: in hash order within each class, for which half of ``most`` is free; only a text that
    doesn't fit is left out."""
    half = (MAX_TRAIN_BYTES if most is None else most) // 2
    used, out = {}, []
    for y, _, i, n in sorted(rows):
        if used.get(y, 0) + n <= half:
            used[y] = used.get(y, 0) + n
            out.append(i)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Model:
    lab = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_y"))
    counts = dict(lab.groupBy("_y").count().collect())  # two rows
    order = F.xxhash64("_id")
    ids = lab.where("_y = 0").orderBy(order, "_id").limit(per_class).unionByName(lab.where("_y = 1").orderBy(order, "_id").limit(per_class))
    text = docs.select(F.col(id_col).alias("_id"), F.col("text").cast("string").alias("_t"))
    # 2 * per_class ids at most: a proven bound for the broadcast and for what comes to the driver
    rows = text.join(F.broadcast(ids), "_id").groupBy("_id", "_y").agg(F.min("_t").alias("_t"))
    sizes = rows.select("_y", order.alias("_h"), "_id", F.coalesce(F.octet_length("_t"), F.lit(0)).alias("_n")).collect()
    chosen = within_bytes([tuple(r) for r in sizes])
    fitted = rows.where(F.col("_id").isin(chosen)) if chosen else rows.limit(0)
    sample = sorted(((r["_id"], r["_y"], r["_t"]) for r in fitted.toLocalIterator()), key=lambda r: r[0])
    total = sum(counts.values()) or 1
    return train([r[2] for r in sample], [r[1] for r in sample], (counts.get(0, 0) / total, counts.get(1, 0) / total))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, held_out, score, predicted): one row for each input row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 60 kB whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables()
        for b in batches:
            s = pa.array([score_text(net, tables, t) for t in b.column(2).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), s], ["id", "held_out", "score"])

    src = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = dict(src.dtypes)["id"]
    out = src.mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
