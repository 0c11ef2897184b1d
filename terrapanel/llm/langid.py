"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary
(pieces of every length, and every single byte). A word's probability is
the sum over all ways to cut it into pieces, by the forward algorithm; a text's
is the product over its words. Pieces' probabilities are fitted by expectation
maximisation (forward and backward sums) on a bounded sample of labelled rows.
Distinct words of a batch are computed once, all of a length at a time.

A word is a run of bytes other than ASCII white space, A-Z lower-cased, with a
blank put before it; a longer one than MAX_WORD - 1 bytes is read in parts of so
many, each ended before a character that it would cut. Sums are kept in units of
SCALE to the power of the bytes read, within a double's range for such words.

Defined cases: a text that is null or has no letter is "und" with score 0; so is
every text when nothing labelled can be learned from. The score is the best
language's share of the probabilities per word (all languages alike beforehand),
so it doesn't saturate on long texts. Ties go to the first language in order.
Repeated rows are judged alike, rows without doc_id, too. Long texts are read in
parts of two megabytes. Extra columns are kept, but for lang_pred and score,
which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import LOWER, bounded_batches, mix64, powers, release, row_chunks, split_rows, text_buffer, tidy, words

VOCABULARY = "piece_bpe_32k.model"
MAX_WORD, SCALE = 48, 4096.0
#: Numbers that one forward pass may hold (words by positions by languages or pieces).
PASS_NUMBERS = 1 << 22
#: At most so many labelled rows of a language are learned from (those of smallest hash, of at most SAMPLE_BYTES each), in so many rounds.
SAMPLE, SAMPLE_BYTES, ROUNDS = 300, 1 << 17, 3
#: At most so many languages are learned, those of most labelled rows.
LANGUAGES = 256
_LETTER = regex.compile(r"\p{L}")
_TABLE_BITS = 18


def read_pieces() -> list[bytes]:
    """The vocabulary's pieces as lower-cased bytes (a blank for its word mark), and all single bytes."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(VOCABULARY))
    found = {bytes([i]) for i in range(256)}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            piece = bytes(LOWER[np.frombuffer(sp.id_to_piece(i).replace("▁", " ").encode(), np.uint8)])
            if b" " not in piece[1:]:
                found.add(piece)
    return sorted(found)


class PieceTable:
    """Finds pieces by the hash of their bytes."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.longest = max(map(len, pieces))
        self.sizes = np.array([len(x) for x in pieces])
        p, _ = powers(self.longest + 1)
        keys = np.array([sum((b + 1) * int(p[i]) for i, b in enumerate(x)) % (1 << 64) for x in pieces], np.uint64)
        self.keys = mix64(keys + self.sizes.astype(np.uint64))
        self.order = np.argsort(self.keys)
        self.sorted = self.keys[self.order]
        # most substrings are no piece: a table of the hashes' top bits answers those
        self.maybe = np.zeros(1 << _TABLE_BITS, bool)
        self.maybe[self.sorted >> np.uint64(64 - _TABLE_BITS)] = True

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of the piece with each key, else -1."""
        out = np.full(keys.shape, -1, np.int32)
        some = self.maybe[keys >> np.uint64(64 - _TABLE_BITS)]
        k = keys[some]
        at = np.minimum(np.searchsorted(self.sorted, k), len(self.sorted) - 1)
        out[some] = np.where(self.sorted[at] == k, self.order[at], -1)
        return out


def word_pieces(table: PieceTable, chars: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of words of one length (rows of bytes): (start, end, words that have a piece there, the pieces) by end, then start."""
    n = chars.shape[1]
    p, q = powers(n + 1)
    total = np.zeros((chars.shape[0], n + 1), np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * p[:n], axis=1, out=total[:, 1:])
    out = []
    for b in range(1, n + 1):
        for a in range(max(0, b - table.longest), b):
            idx = table.find(mix64((total[:, b] - total[:, a]) * q[a] + np.uint64(b - a)))
            has = np.flatnonzero(idx >= 0)
            if len(has):
                out.append((a, b, has, idx[has]))
    return out


def forward(probs: np.ndarray, pieces: list, n: int, rows: int) -> np.ndarray:
    """Sums over the segmentations of each prefix: (n + 1, words, languages)."""
    alpha = np.zeros((n + 1, rows, probs.shape[1]))
    alpha[0] = 1
    for a, b, has, idx in pieces:
        alpha[b][has] += alpha[a][has] * probs[idx]
    return alpha


def next_cut(buf: np.ndarray, at: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where the parts of words that begin at those places end: before whole at a character's first byte."""
    cut = np.minimum(at + MAX_WORD - 1, whole)
    for _ in range(3):  # UTF-8 has at most three bytes after a character's first
        inside = cut < whole
        inside[inside] = (buf[cut[inside]] & 0xC0) == 0x80
        cut = cut - inside
    return cut


def distinct_words(buf: np.ndarray, offsets: np.ndarray):
    """(rows of bytes by length, index of a row's words): each text's words as indices of distinct words."""
    starts, ends, rows, h = words(buf, offsets)
    long = ends - starts > MAX_WORD - 1
    if long.any():  # cut into parts of at most MAX_WORD - 1 bytes
        found = []
        left = starts[long], ends[long], rows[long]
        while len(left[0]):
            at, whole, row = left
            cut = next_cut(buf, at, whole)
            found.append((at, cut, row))
            left = tuple(x[cut < whole] for x in (cut, whole, row))
        starts, ends, rows = (np.concatenate([old[~long], *new]) for old, new in zip((starts, ends, rows), zip(*found, strict=True), strict=True))
        p, q = powers(len(buf) + 1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((LOWER[buf].astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=total[1:])
        h = mix64((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    return starts[first], ends[first], rows, inverse


def by_length(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, languages: int):
    """(indices, bytes with a leading blank) of words of each length, at most PASS_NUMBERS numbers at a time."""
    size = ends - starts
    for n in np.unique(size):
        same, step = np.flatnonzero(size == n), max(1, PASS_NUMBERS // int((n + 2) * max(languages, 8)))
        for at in (same[k : k + step] for k in range(0, len(same), step)):
            yield at, word_bytes(buf, starts[at], n)


def word_bytes(buf: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    chars = np.full((len(starts), n + 1), 32, np.uint8)
    chars[:, 1:] = LOWER[buf[starts[:, None] + np.arange(n)[None, :]]]
    return chars


def word_scores(table: PieceTable, probs: np.ndarray, buf, starts, ends) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.zeros((len(starts), probs.shape[1]))
    scaled = probs * SCALE ** table.sizes[:, None]
    for at, chars in by_length(buf, starts, ends, probs.shape[1]):
        n = chars.shape[1]
        out[at] = np.log(forward(scaled, word_pieces(table, chars), n, len(at))[-1]) - n * np.log(SCALE)
    return out


def fit(texts: list[str], langs: list[str], rounds: int = ROUNDS) -> dict:
    """Pieces' probabilities by language, by expectation maximisation on the texts' distinct words."""
    names = sorted(set(langs))
    if not names:
        return {"langs": [], "probs": np.zeros((0, 0))}
    pieces = read_pieces()
    table = PieceTable(pieces)
    probs = np.full((len(pieces), len(names)), 1.0 / len(pieces))
    buf, offsets = text_buffer(pa.array(texts, pa.string()))
    starts, ends, rows, inverse = distinct_words(buf, offsets)
    counts = np.zeros((len(starts), len(names)))
    np.add.at(counts, (inverse, np.array([names.index(x) for x in langs])[rows]), 1)
    groups = [(at, chars.shape[1], word_pieces(table, chars)) for at, chars in by_length(buf, starts, ends, len(names))]
    for _ in range(rounds):
        expected, scaled = np.zeros_like(probs), probs * SCALE ** table.sizes[:, None]
        for at, n, found in groups:
            alpha, beta = forward(scaled, found, n, len(at)), np.zeros((n + 1, len(at), len(names)))
            beta[n] = 1
            for a, b, has, idx in sorted(found, key=lambda x: -x[0]):
                beta[a][has] += beta[b][has] * scaled[idx]
            share = counts[at] / alpha[n]
            for a, b, has, idx in found:
                np.add.at(expected, idx, alpha[a][has] * scaled[idx] * beta[b][has] * share[has])
        expected += 0.02
        probs = expected / expected.sum(0)
    return {"langs": names, "probs": probs}


def predict(model: dict, table: PieceTable, col: pa.Array) -> tuple[list[str], list[float]]:
    names, out, scores = model["langs"], [], []
    buf, offsets = text_buffer(col)
    parts, owner = split_rows(buf, offsets, 1 << 21, MAX_WORD - 1)
    total, count = np.zeros((len(col), len(names))), np.zeros(len(col), np.int64)
    for a, b in row_chunks(parts, 1 << 21) if names else ():
        part, at = buf[parts[a] : parts[b]], parts[a : b + 1] - parts[a]
        if len(part):
            starts, ends, rows, inverse = distinct_words(part, at)
            each, first = word_scores(table, model["probs"], part, starts, ends), owner[a]
            rows = owner[a:b][rows] - first
            many = np.bincount(rows)
            count[first : first + len(many)] += many
            for k in range(len(names)):
                total[first : first + len(many), k] += np.bincount(rows, weights=each[inverse, k])
    for i, text in enumerate(col):
        text = text.as_py()
        if not names or not text or not _LETTER.search(text):
            out.append("und")
            scores.append(0.0)
            continue
        mean = total[i] / max(1, count[i])
        share = np.exp(mean - mean.max())
        best = int(total[i].argmax())
        out.append(names[best])
        scores.append(float(share[best] / share.sum()))
    return out, scores


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[str]]:
    """Texts and languages of at most sample rows of each language that isn't held out; rows that repeat doc_id, text and language count once."""
    rows = docs.where(F.col("lang").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES) & ~held_out()).withColumn("key", F.xxhash64("text"))
    ids = rows.select("doc_id", "lang", "key").distinct()
    langs = ids.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang")
    # counts by the hash's first byte tell how far the smallest hashes reach: 256 rows a language at most
    ids = ids.join(F.broadcast(langs), "lang", "left_semi").withColumn("slot", F.shiftright(F.xxhash64("doc_id"), 56))
    before = F.sum("n").over(W.partitionBy("lang").orderBy("slot").rowsBetween(W.unboundedPreceding, -1))
    slots = ids.groupBy("lang", "slot").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    ids = ids.join(F.broadcast(slots.where(F.col("before") < sample).select("lang", "slot")), ["lang", "slot"])
    w = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "key")
    ids = ids.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= sample).select("doc_id", "key", "lang")
    ids = ids.withColumnsRenamed({"doc_id": "i", "key": "k", "lang": "l"})
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")) & (F.col("lang") == F.col("l"))
    found = rows.join(F.broadcast(ids), same, "left_semi").groupBy("doc_id", "key", "lang").agg(F.min("text").alias("text")).orderBy("doc_id", "key", "lang").collect()
    return [r.text for r in found], [r.lang for r in found]


def learned(docs: DataFrame) -> dict:
    """The model of docs' labelled sample; the driver gives back what learning took beside it (some 150 MB)."""
    try:
        return fit(*labelled_sample(docs))
    finally:
        release()


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """docs with lang_pred and score."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    at = names.index("text")
    schema = StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double")
    known = docs.sparkSession.sparkContext.broadcast(model)  # pieces by languages: bounded by the vocabulary

    @tidy
    def run(batches):
        model = known.value
        table = PieceTable(read_pieces())
        for batch in batches:
            pred, score = predict(model, table, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text", "lang")
    model = learned(docs)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
