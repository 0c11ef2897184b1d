"""Shared helpers: scratch tables, Arrow text access, vectorised word hashing, components."""

from __future__ import annotations

import contextlib
import contextvars
import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised kernels take at once.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch: the JVM and a Python worker both hold each batch, outside the heap.
BATCH_BYTES = 8 << 20
#: Rows of a table that lookup broadcasts whole.
SMALL = 200_000
#: Odd multiplier of the polynomial hashes (mod 2**64).
BASE = 0x9E3779B97F4A7C15
_INV = pow(BASE, -1, 1 << 64)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker (models, tokenizers)."""
    return sys.modules.setdefault("_terrapanel_worker", types.ModuleType("_terrapanel_worker")).__dict__


def release() -> None:
    """Give memory that this worker no longer uses back to the system: idle workers stay, and share their executor's limit."""
    import ctypes

    worker_cache().pop("powers", None)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to trim


def tidy(stage):
    """Wraps a function over Arrow batches so that memory is released after its last batch."""

    def run(batches):
        try:
            yield from stage(batches)
        finally:
            release()

    return run


def bounded_batches(spark: SparkSession) -> None:
    """This session's Arrow batches end at BATCH_BYTES, not only at a number of rows of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder spark.checkpoint.dir; a local folder only where that is unset and Spark itself is local."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.gettempdir()}/terrapanel-checkpoint"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("terrapanel_scope", default=None)


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Deletes at its end the tables that were materialized inside it; what is kept must be written after it or elsewhere."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in paths:
            p, fs = _folder(spark, path)
            fs.delete(p, True)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it again: lineage ends there.

    Inside a scratch_scope the table goes at the scope's end, unless keep is
    set; all others go when the application ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    p, fs = _folder(spark, path)
    fs.deleteOnExit(p)
    if _scope.get() is not None and not keep:
        _scope.get().append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 2_000_000) -> DataFrame:
    """Hint a broadcast only where the counted rows are under the limit."""
    return F.broadcast(df) if rows <= limit else df


def lookup(rows: DataFrame, table: DataFrame, key: str, often: DataFrame | None = None) -> DataFrame:
    """rows left-joined with table, whose keys are unique, by the column key; no key's rows all go to one task.

    A table of at most SMALL rows is broadcast. Else keys that hold over one
    in 8 x shuffle partitions of all rows (so at most as many keys; often, if it
    is known) meet their entries by a broadcast, other keys by a shuffle, and
    rows without a key meet nothing.
    """
    spark = rows.sparkSession
    if table.limit(SMALL + 1).count() <= SMALL:
        return rows.join(F.broadcast(table), key, "left")
    if often is None:
        by = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_c"))
        often = by.where(F.col("_c") > rows.count() / (8 * shuffle_partitions(spark))).select(key)
    hot = F.broadcast(materialize(often.join(table, key, "left"), "hot"))
    out = rows.join(hot, key).unionByName(rows.where(F.col(key).isNotNull()).join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key, "left"))
    none = rows.where(F.col(key).isNull())
    return out.unionByName(none.select("*", *[F.lit(None).cast(t).alias(c) for c, t in table.dtypes if c != key]))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges [a, b) of rows of about limit bytes each, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def split_rows(buf: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES, step: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, row) with rows of more than limit bytes cut after ASCII white space, about limit bytes each.

    A longer run without white space stays whole; with step it is cut, too, after
    some parts of step bytes, each ended before a character that it would cut.
    """
    long = np.flatnonzero(np.diff(offsets) > limit)
    if not len(long):
        return offsets, np.arange(len(offsets) - 1)
    cuts = [offsets]
    for r in long.tolist():
        at, end, found = int(offsets[r]), int(offsets[r + 1]), []
        while end - at > limit:
            near = np.flatnonzero(SPACE[buf[at : at + limit]])
            if len(near):
                at += int(near[-1]) + 1
            elif step:
                first = at
                while at < end and (at == first or at + step <= first + limit):
                    at = min(at + step, end)
                    while at < end and buf[at] & 0xC0 == 0x80:
                        at -= 1
            else:
                x = at + limit
                while x < end and not SPACE[buf[x]]:
                    part = np.flatnonzero(SPACE[buf[x : min(x + limit, end)]])
                    x = x + int(part[0]) if len(part) else min(x + limit, end)
                at = x
            if at < end:
                found.append(at)
        cuts.append(np.array(found, np.int64))
    new = np.sort(np.concatenate(cuts), kind="stable")
    return new, np.searchsorted(offsets, new[:-1], "right") - 1 if len(new) > 1 else np.zeros(0, np.int64)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse mod 2**64, for i below n at least."""
    cache = worker_cache()
    if len(cache.get("powers", ((),))[0]) < n:
        m = max(n, CHUNK_BYTES + 1024)
        p, q = np.full(m, BASE, np.uint64), np.full(m, _INV, np.uint64)
        p[0] = q[0] = 1
        cache["powers"] = np.cumprod(p), np.cumprod(q)
    return cache["powers"]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than ASCII white space) of rows: start, end, row, 64-bit hash of the lower-cased bytes."""
    n = len(buf)
    inside = ~SPACE[buf]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    edge = np.ones(n + 1, bool)
    edge[1:n] = ~inside[:-1]
    edge |= first
    starts = np.flatnonzero(inside & edge[:n])
    after = np.ones(n, bool)
    after[: n - 1] = ~inside[1:] | first[1:n]
    ends = np.flatnonzero(inside & after) + 1
    p, q = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[buf].astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
    h = mix64((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows, h


def _joined(edges: pa.Table) -> pa.Table:
    """(node, comp) of edges (a, b): union by the smaller root."""
    ends = np.concatenate([edges.column(c).to_numpy() for c in "ab"])
    nodes, at = np.unique(ends, return_inverse=True)
    roots = list(range(len(nodes)))
    for x, y in at.reshape(2, -1).T.tolist():
        while roots[x] != x:
            roots[x] = x = roots[roots[x]]
        while roots[y] != y:
            roots[y] = y = roots[roots[y]]
        roots[max(x, y)] = min(x, y)
    comp = np.array(roots, np.int64)
    while len(comp) and (comp[comp] != comp).any():
        comp = comp[comp]
    return pa.table({"node": pa.array(nodes, pa.int64()), "comp": pa.array(nodes[comp] if len(comp) else nodes, pa.int64())})


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over edges (a, b), for each node that has an edge.

    Contraction: each round every node points to its smallest neighbour, also
    the least of its own neighbourhood; such pointers can only circle between
    two nodes, of which the smaller is made a root. Pointers are jumped until
    they end in roots, and the edges between trees go on to the next round. A
    tree has two nodes at least, so the rounds end after a logarithm of the nodes.
    At most SMALL edges are joined on the driver, without these rounds.
    """
    rest = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    if rest.limit(SMALL + 1).count() <= SMALL:
        return materialize(edges.sparkSession.createDataFrame(_joined(rest.toArrow()), "node long, comp long"), "labels")
    labels = None
    while labels is None or not rest.isEmpty():
        both = rest.union(rest.select("b", "a"))
        first = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("next")), "labels")
        back = first.select(F.col("node").alias("next"), F.col("next").alias("back"))
        points = first.join(back, "next").select("node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("next")), F.col("node")).otherwise(F.col("next")).alias("comp"))
        while True:  # a chain of pointers halves in each turn
            to = points.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
            points = materialize(points.join(to, "comp").select("node", F.col("comp").alias("old"), F.col("root").alias("comp")), "labels")
            settled = points.where("old <> comp").isEmpty()
            points = points.select("node", "comp")
            if settled:
                break
        least = points.groupBy("comp").agg(F.min("node").alias("least"))
        points = materialize(points.join(least, "comp").select("node", F.col("least").alias("comp")), "labels")
        if labels is None:
            labels = points
        else:
            low = points.select(F.col("node").alias("comp"), F.col("comp").alias("low"))
            labels = materialize(labels.join(low, "comp", "left").select("node", F.coalesce("low", "comp").alias("comp")), "labels")
        ends = [points.select(F.col("node").alias(c), F.col("comp").alias(f"r{c}")) for c in "ab"]
        roots = rest.join(ends[0], "a").join(ends[1], "b").where("ra <> rb")
        rest = materialize(roots.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return labels
