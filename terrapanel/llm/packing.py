"""Best-fit packing of token sequences by a configuration linear program.

Documents become ids of a public tokenizer with an end id; only those longer
than a sequence are cut. The histogram of lengths (at most `capacity` numbers,
whatever the input) is all that the driver sees. On it the configuration linear
program - fewest sequences whose contents cover every length's count - is solved
by multiplicative weights: each round a knapsack by dynamic programming prices
the best fillings under the lengths' weights, some that share no length are
taken, and the weights of what they cover fall, until all lengths are covered to
the same share within TOLERANCE. The solution is rounded to whole sequences.
What rounding leaves is priced once more, around the longest piece left each
time, by a knapsack that knows how many pieces there are. This is done at each
of RATES, and the plan of fewest sequences is kept. Pieces then look up their
places by their rank among pieces of their length; ranks come from counts by
bucket and length, so nothing is sorted in one task.

Defined cases: null and empty texts are the end id alone; repeated rows are
packed each (ties of doc_id get a number of their own), rows without doc_id,
too; a long text is encoded whole and cut by its ids; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bpe import coder
from .common import bounded_batches, materialize, shuffle_partitions, tidy

CAPACITY, END = 1024, 2
#: Shares of the lengths' needs agree within TOLERANCE of the largest; a filling adds STEP to a share at most.
TOLERANCE, STEP = 0.3, 0.25
#: A share's weight falls by exp(-rate) for each need covered, to none from AHEAD of the least share on.
RATES, AHEAD = (0.1, 0.3), 0.5
#: Fillings worth this much less than the best one are taken with it.
SLACK = 0.001
#: In the rest, a piece that fills a sequence is worth this much more than one of no length, by its size.
LARGE_FIRST = 0.2


def knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """By room, the greatest total value of lengths (with repeats) that fit, and a length to take first (0: leave one free); value[l] is a length's, 0 where there is none."""
    best = np.zeros(capacity + 1)
    back = np.zeros(capacity + 1)  # best in reverse
    choice = [0] * (capacity + 1)
    for c in range(1, capacity + 1):
        gains = value[1 : c + 1] + back[capacity - c + 1 :]
        pick = int(gains.argmax())
        if gains[pick] > best[c - 1]:
            best[c], choice[c] = gains[pick], pick + 1
        else:
            best[c] = best[c - 1]
        back[capacity - c] = best[c]
    return best, choice


def cover(need: np.ndarray, capacity: int, rate: float = RATES[-1]) -> tuple[dict[tuple[int, ...], float], np.ndarray, float]:
    """Fillings with amounts, by length the share of its need that they cover (shares agree within TOLERANCE), and a lower bound on the sequences.

    A round prices one knapsack and takes of its best fillings, around each
    length, those that share no length. None adds more than STEP to a share and
    one share at least gains STEP, and lengths AHEAD of the least covered one
    have no price: shares differ by AHEAD + 2 STEP at most while the least one
    grows, so the rounds end, after a number in proportion to the lengths.
    Any weights bound the program from below: all needs' worth over a filling's.
    """
    there = np.flatnonzero(need > 0)
    share = np.zeros(capacity + 1)
    taken: dict[tuple[int, ...], float] = {}
    want, bound = need.tolist(), 0.0
    while len(there):
        now = share[there]
        low = now.min()
        if low > 0 and low >= (1 - TOLERANCE) * now.max():
            break
        weight = np.zeros(capacity + 1)
        weight[there] = np.where(now <= low + AHEAD, there / capacity * np.exp(-rate * (now - low)), 0.0)
        best, choice = knapsack(weight, capacity)
        bound = max(bound, float(need @ weight) / best[capacity])
        used: set[int] = set()
        for length in [0, *there[np.argsort(now, kind="stable")].tolist()]:  # 0: the best filling of all
            if length and (length in used or weight[length] + best[capacity - length] < (1 - SLACK) * best[capacity]):
                continue
            many = {length: 1} if length else {}
            room = capacity - length
            while room > 0:
                k = choice[room]
                if k in used:
                    break
                if k:
                    many[k] = many.get(k, 0) + 1
                room -= k or 1
            if room > 0:
                continue
            used.update(many)
            amount = min(want[k] / n for k, n in many.items()) * STEP
            fill = tuple(sorted((k for k, n in many.items() for _ in range(n)), reverse=True))
            taken[fill] = taken.get(fill, 0.0) + amount
            for k, n in many.items():
                share[k] += amount * n / want[k]
    return taken, share, bound


def rounded(taken: dict[tuple[int, ...], float], share: np.ndarray, left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole sequences of the fillings; what they hold is taken off left. Fractions add up from filling to filling."""
    out, due = [], 0.0
    scale = 1.0 / share[share > 0].min() if taken else 0.0
    for fill, x in sorted(taken.items(), key=lambda t: (-t[1] * sum(t[0]), t[0])):
        kinds, many = np.unique(fill, return_counts=True)
        due += x * scale
        n = min(int(due + 1e-9), int((left[kinds] // many).min()))
        if n > 0:
            out.append((fill, n))
            left[kinds] -= n * many
        due = min(due - n, 1.0)
    return out


def _among(value: np.ndarray, left: np.ndarray, room: int) -> dict[int, int]:
    """Of left[l] pieces of each length l those of greatest value that fit the room: {length: how many}."""
    best = np.zeros(room + 1)
    taken = []
    for l in np.flatnonzero(left[: room + 1] > 0)[::-1].tolist():
        rest, m = min(int(left[l]), room // l), 1
        while rest:  # 1, 2, 4, ... pieces of the length make up any number
            m = min(m, rest)
            gain = best[: room + 1 - l * m] + value[l] * m
            better = gain > best[l * m :]
            if better.any():
                best[l * m :] = np.where(better, gain, best[l * m :])
                taken.append((l, m, better))
            rest, m = rest - m, 2 * m
    at, out = int(best.argmax()), {}
    for l, m, better in reversed(taken):
        if at >= l * m and better[at - l * m]:
            out[l] = out.get(l, 0) + m
            at -= l * m
    return out


def _rest(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings of all pieces left, each around the longest one left and as often as there are pieces for it."""
    out = []
    value = np.arange(capacity + 1) / capacity
    value *= 1 + LARGE_FIRST * value
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        many = _among(value, left, capacity - longest)
        many[longest] = many.get(longest, 0) + 1
        left[longest] += 1
        n = min(int(left[k]) // m for k, m in many.items())
        for k, m in many.items():
            left[k] -= m * n
        out.append((tuple(sorted((k for k, m in many.items() for _ in range(m)), reverse=True)), n))
    return out


def solve(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], dict[str, float]]:
    """As plan, and figures: sequences, their lower bound, and of the sequences that aren't one whole piece those that the rounded program gave."""
    whole, need = int(counts[capacity]), counts.astype(np.int64).copy()
    need[[0, capacity]] = 0
    best, low = None, 0.0
    for rate in RATES if need.any() else ():
        left = need.copy()
        taken, share, bound = cover(need.astype(float), capacity, rate)
        out = rounded(taken, share, left)
        by_program = sum(n for _, n in out)
        out += _rest(left, capacity)
        total, low = sum(n for _, n in out), max(low, bound)
        if best is None or total < best[0]:
            best = total, by_program, out
    total, by_program, out = best or (0, 0, [])
    figures = {"sequences": whole + total, "bound": whole + low, "mixed": total, "by_program": by_program}
    return [((capacity,), whole)] * (whole > 0) + out, figures


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(filling, how many sequences) covering counts[l] pieces of each length l exactly."""
    return solve(counts, capacity)[0]


def places(fillings: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """By length, rows (first rank, pieces a sequence, first sequence, offset) in order of rank."""
    rank = np.zeros(capacity + 1, np.int64)
    out: dict[int, list] = {}
    sequence = 0
    for fill, many in fillings:
        offset = 0
        kinds, copies = np.unique(fill, return_counts=True)
        for length, n in zip(kinds.tolist()[::-1], copies.tolist()[::-1], strict=True):
            out.setdefault(length, []).append((rank[length], n, sequence, offset))
            rank[length] += n * many
            offset += n * length
        sequence += many
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all pieces of docs (doc_id, text), and the ids if asked for by keep."""
    with_ids = "ids" in keep

    @tidy
    def run(batches):
        c = coder()
        for batch in batches:
            rows, ids_out = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(c.encode(text.as_py(), by_chunks=False), np.uint32(END)).astype("<u4")
                first = len(ids) % capacity or min(capacity, len(ids))
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                    if with_ids:
                        ids_out.append(ids[a:b].astype(np.int32))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(x, t) for x, t in zip(cols, types, strict=True)] + ([pa.array(ids_out, pa.list_(pa.int32()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, keep: tuple[str, ...] = ()) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = docs.sparkSession
    bounded_batches(spark)
    buckets = shuffle_partitions(spark)
    cut = pieces_of(docs, capacity, keep)
    cut = materialize(cut.withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int")), "pieces")
    by = cut.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[r.length] = r.n
    known = spark.sparkContext.broadcast(places(plan(counts, capacity), capacity))
    # ranks begin where the buckets before end: a window over as many small rows as buckets, for each length
    base = by.withColumn("base", F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    base = base.select("bucket", "length", F.coalesce("base", F.lit(0)).alias("base"))
    nth = F.row_number().over(W.partitionBy("bucket", "length").orderBy("doc_id", "piece", "start"))
    ranked = cut.withColumn("nth", nth).join(base, ["bucket", "length"]).withColumn("rank", (F.col("base") + F.col("nth") - 1).cast("long"))
    names = [c for c in cut.columns if c != "bucket"]

    @tidy
    def place(batches):
        runs = known.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                r = runs[int(k)]
                i = np.searchsorted(r[:, 0], rank[at], "right") - 1
                inside = rank[at] - r[i, 0]
                seq[at] = r[i, 2] + inside // r[i, 1]
                off[at] = r[i, 3] + inside % r[i, 1] * k
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    schema = StructType(list(ranked.select(*names).schema.fields)).add("sequence_id", "long").add("offset", "long")
    return ranked.select(*names, "rank").mapInArrow(place, schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
