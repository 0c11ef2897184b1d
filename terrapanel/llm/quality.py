"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes, whole, are cut into overlapping chunks. Learned filters of six
bytes, moved by two, see each byte's embedding and whether its four bytes
repeat bytes up to 16 places before. Each filter is max-pooled over a chunk; the
mean and the maximum over all chunks of a text are combined into a probability
by a logistic unit. Filters over pairs of bytes become tables, so that scoring
is three table reads for two bytes. Training (Adam, by hand-written gradients,
which pass only through the places that won the pooling) uses a bounded sample.

Defined cases: null and empty texts are one chunk of zero bytes and get that
chunk's score; without labelled rows all scores are 0.5. Long texts are read in
parts of whole chunks. Repeated rows are scored alike, rows without doc_id, too;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, bounded_batches, row_chunks, text_buffer, tidy
from .langid import held_out

FILTERS, EMBED, PAIRS = 16, 8, 3
#: A chunk has CHUNK steps of two bytes; the next begins STRIDE steps later.
CHUNK, STRIDE = 256, 192
#: Bytes back that the repeat channel looks at.
REPEAT = 16
#: At most so many labelled rows are learned from (those of smallest hash, of at most SAMPLE_BYTES each); epochs; rows a step.
SAMPLE, SAMPLE_BYTES, EPOCHS, BATCH = 400, 1 << 18, 16, 32
THRESHOLD = 0.7


def encode(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of bytes (with the repeat bit) of all texts one after another, and each chunk's start, end and text."""
    size = np.diff(offsets)
    useful = np.maximum(-(-size // 2), 1)
    steps = useful + PAIRS - 1 + REPEAT // 2  # zero steps part the texts, so that none looks into another
    at = np.concatenate([[0], np.cumsum(steps)])
    b = np.zeros(2 * at[-1] + 4, np.uint8)
    b[np.arange(len(buf)) + np.repeat(2 * at[:-1] - offsets[:-1], size)] = buf
    four = b[:-3].astype(np.uint32) | b[1:-2].astype(np.uint32) << 8 | b[2:-1].astype(np.uint32) << 16 | b[3:].astype(np.uint32) << 24
    again = np.zeros(len(four), bool)
    for d in range(2, REPEAT + 1):
        again[d:] |= four[d:] == four[:-d]
    again &= four != 0
    n = at[-1]
    pairs = b[: 2 * n : 2].astype(np.int32) | b[1 : 2 * n : 2].astype(np.int32) << 8 | again[: 2 * n : 2].astype(np.int32) << 16
    chunks = np.maximum(-(-(useful - (CHUNK - STRIDE)) // STRIDE), 1)
    rows = np.repeat(np.arange(len(size)), chunks)
    k = np.arange(len(rows)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    start = at[rows] + k * STRIDE
    end = np.minimum(start + CHUNK, at[rows] + useful[rows])
    return pairs, start, end, rows


def tables(p: dict) -> np.ndarray:
    """What a pair of bytes adds to each filter, by place in the filter: (PAIRS, 2**17, FILTERS)."""
    out = np.zeros((PAIRS, 2, 256, 256, FILTERS), np.float32)  # repeat, second byte, first byte
    for j in range(PAIRS):
        out[j] = (p["emb"] @ p["w"][j, 0])[None, None, :, :] + (p["emb"] @ p["w"][j, 1])[None, :, None, :]
        out[j, 1] += p["rep"][j]
    return out.reshape(PAIRS, 2 * 65536, FILTERS)


def pooled(t: np.ndarray, bias: np.ndarray, pairs: np.ndarray, start: np.ndarray, end: np.ndarray, places: bool = False):
    """Each chunk's maximum of each filter (at least 0), and where it was."""
    n = len(pairs) - PAIRS + 1
    act = t[0][pairs[:n]]
    for j in range(1, PAIRS):
        act += t[j][pairs[j : n + j]]
    # chunks overlap: maxima of segments between all chunk borders, then of the few segments in a chunk
    edges = np.unique(np.concatenate([start, end]))
    edges = edges[edges < n]
    seg = np.maximum.reduceat(act, edges, axis=0)
    a, b = np.searchsorted(edges, start), np.searchsorted(edges, end)
    out = seg[a].copy()
    for k in range(1, int((b - a).max(initial=1))):
        more = a + k < b
        out[more] = np.maximum(out[more], seg[a[more] + k])
    if not places:
        return np.maximum(out + bias, 0), None
    where = np.stack([s + act[s:e].argmax(0) for s, e in zip(start, end, strict=True)])
    return np.maximum(out + bias, 0), where


def combine(p: dict, m: np.ndarray, rows: np.ndarray, n: int):
    """Each text's mean and maximum over its chunks, and its probability."""
    first = np.searchsorted(rows, np.arange(n))
    mean = np.add.reduceat(m, first, axis=0) / np.bincount(rows, minlength=n)[:, None]
    high = np.maximum.reduceat(m, first, axis=0)
    z = mean @ p["u"] + high @ p["v"] + p["b"]
    return mean, high, 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> dict | None:
    if not texts:
        return None
    rng = np.random.default_rng(7)
    p = {"emb": rng.normal(0, 0.5, (256, EMBED)), "w": rng.normal(0, 0.4, (PAIRS, 2, EMBED, FILTERS)), "rep": rng.normal(0, 0.4, (PAIRS, FILTERS)), "bias": np.zeros(FILTERS), "u": rng.normal(0, 0.3, FILTERS), "v": rng.normal(0, 0.3, FILTERS), "b": np.zeros(())}
    moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in p.items()}
    y, step = np.array(labels, float), 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for s in range(0, len(order), BATCH):
            take = order[s : s + BATCH]
            buf, offsets = text_buffer(pa.array([texts[i] for i in take], pa.string()))
            pairs, start, end, rows = encode(buf, offsets)
            m, where = _train_pool(p, pairs, start, end)
            mean, high, prob = combine(p, m, rows, len(take))
            g = _gradients(p, pairs, rows, m, where, mean, high, (prob - y[take]) / len(take))
            step += 1
            for k in p:
                a, b = moments[k]
                a += 0.1 * (g[k] - a)
                b += 0.001 * (g[k] ** 2 - b)
                p[k] = p[k] - 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return {k: x.astype(np.float32) for k, x in p.items()}


def _train_pool(p: dict, pairs: np.ndarray, start: np.ndarray, end: np.ndarray):
    """As pooled, with only the distinct pairs' entries of the tables made."""
    seen, small = np.unique(pairs, return_inverse=True)
    t = np.empty((PAIRS, len(seen), FILTERS), np.float32)
    lo, hi, rep = seen & 255, (seen >> 8) & 255, (seen >> 16)[:, None]
    for j in range(PAIRS):
        t[j] = (p["emb"] @ p["w"][j, 0])[lo] + (p["emb"] @ p["w"][j, 1])[hi] + rep * p["rep"][j]
    return pooled(t, p["bias"].astype(np.float32), small.astype(np.int32), start, end, True)


def _gradients(p, pairs, rows, m, where, mean, high, dz) -> dict:
    g = {k: np.zeros_like(x) for k, x in p.items()}
    g["b"], g["u"], g["v"] = np.asarray(dz.sum()), mean.T @ dz, high.T @ dz
    count = np.bincount(rows, minlength=len(dz))
    dm = dz[rows, None] * (p["u"] / count[rows, None] + p["v"] * (m == high[rows]))
    dm = dm * (m > 0)
    g["bias"] = dm.sum(0)
    c, f = np.nonzero(dm)
    d, at = dm[c, f], where[c, f]
    for j in range(PAIRS):
        x = pairs[at + j]
        np.add.at(g["rep"][j], f, d * (x >> 16))
        for h in (0, 1):
            byte = (x >> 8 * h) & 255
            np.add.at(g["w"][j, h].T, f, d[:, None] * p["emb"][byte])
            np.add.at(g["emb"], byte, d[:, None] * p["w"][j, h].T[f])
    return g


def score_texts(p: dict | None, t: np.ndarray | None, col: pa.Array) -> np.ndarray:
    if p is None:
        return np.full(len(col), 0.5)
    buf, offsets = text_buffer(col)
    out = np.zeros(len(col))
    for a, b in row_chunks(offsets):
        if offsets[b] - offsets[a] > CHUNK_BYTES:  # one long text
            out[a] = _score_long(p, t, buf[offsets[a] : offsets[b]])
            continue
        pairs, start, end, rows = encode(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        m, _ = pooled(t, p["bias"], pairs, start, end)
        out[a:b] = combine(p, m, rows, b - a)[2]
    return out


def _score_long(p: dict, t: np.ndarray, data: np.ndarray) -> float:
    """One text's score, by parts of whole chunks; each part sees the bytes around it that its filters reach."""
    useful = -(-len(data) // 2)
    chunks = max(-(-(useful - (CHUNK - STRIDE)) // STRIDE), 1)
    total, high, per = np.zeros(FILTERS), np.zeros(FILTERS), max(1, CHUNK_BYTES // (2 * STRIDE))
    for c in range(0, chunks, per):
        k = np.arange(min(per, chunks - c))
        lo = 2 * c * STRIDE
        back = min(lo, REPEAT)
        part = data[lo - back : lo + 2 * (int(k[-1]) * STRIDE + CHUNK + PAIRS) + 4]
        start = back // 2 + k * STRIDE
        end = np.minimum(start + CHUNK, back // 2 + useful - c * STRIDE)
        m, _ = pooled(t, p["bias"], encode(part, np.array([0, len(part)]))[0], start, end)
        total += m.sum(0, dtype=np.float64)
        high = np.maximum(high, m.max(0))
    z = float(total / chunks @ p["u"] + high @ p["v"] + p["b"])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[int]]:
    """At most sample labelled texts that aren't held out, the share of each label as it is; of a doc_id's texts the least by hash."""
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).orderBy("doc_id").collect()
    return [r.text for r in rows], [int(r.quality) for r in rows]


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs (doc_id, text) scored: doc_id, score."""
    bounded_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    @tidy
    def run(batches):
        p = known.value
        t = tables(p) if p is not None else None
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(p, t, batch.column(1)).astype(float))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(*labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
