"""Removal of repeated passages by a hash-compared suffix sort.

A byte goes if it is covered by a string of `span` bytes that also starts in a
document with a smaller doc_id. The work is a sparse suffix sort:

1. Of documents with equal texts only the one of smallest doc_id goes on.
2. Every window of `span` bytes has an anchor: its SEED-byte string of smallest
   hash. Equal windows have equal anchors at equal places, so only anchors whose
   hash occurs in two documents or more matter. Each block of documents deals
   its hashes, each once with its first and last document, into buckets as
   packed arrays; there the shared ones are found and told to the blocks.
3. The suffixes at those anchors, and the reversed prefixes before them, as far
   as a window can reach, meet in buckets of the anchor's hash. Equal
   surroundings inside a block of documents are merged before, so a passage in a
   third of all documents gives a bucket one entry a block.
4. In a bucket the suffixes are sorted by merging. Two are compared by the
   length of their common extension, found by binary search over polynomial
   hashes of their prefixes. Neighbours' common extensions are then verified by
   their bytes (after a collision the bucket is sorted by bytes). Runs of
   neighbours that agree far enough on both sides of the anchor are the equal
   windows; the smallest doc_id of a run keeps its own.
5. Marked windows go back to the documents' blocks and are cut out there.

Defined cases: null and empty texts have nothing to remove; so have texts
shorter than `span`. Matches never cross documents; rows of one doc_id don't
count against each other; rows that repeat doc_id and text are worked once and
told the result. Long texts are searched in parts of REACH bytes. Extra columns
are ignored (or carried, if asked for, whatever their names), an empty table
gives no rows, a null doc_id counts as the smallest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import BASE, bounded_batches, broadcast_if_small, lookup, materialize, mix64, release, row_chunks, shuffle_partitions, text_buffer, tidy

SPAN, SEED = 50, 24
#: Bytes of text in a block of documents; buckets for each shuffle partition at least, and bytes of text for a bucket at most.
BLOCK_BYTES, BUCKETS, BUCKET_BYTES = 4 << 20, 4, 64 << 20
#: Text that anchors are searched in at once, so that one long document stays within memory.
REACH = 1 << 18
_NULL_ID = -(1 << 63)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; each knows its type and length."""
    import zstandard

    head = ";".join(f"{a.dtype.str},{a.size}" for a in arrays).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for part in raw[4:at].decode().split(";"):
        kind, n = part.split(",")
        out.append(np.frombuffer(raw, np.dtype(kind), int(n), at))
        at += out[-1].nbytes
    return out


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every window of so many entries."""
    k = 1
    while 2 * k <= width:
        x = f(x[:-k], x[k:])
        k *= 2
    return f(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def seed_hashes(b: np.ndarray) -> np.ndarray:
    """Hashes of all SEED-byte strings: polynomial hashes of 8 and 16 bytes, doubled up and joined."""
    h = b.astype(np.uint64) + np.uint64(1)
    for m in (1, 2, 4):
        h = h[:-m] * np.uint64(pow(BASE, m, 1 << 64)) + h[m:]
    step = np.uint64(pow(BASE, 8, 1 << 64))
    return mix64((h[:-16] * step + h[8:-8]) * step + h[16:])


def anchors(buf: np.ndarray, offsets: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of rows of bytes (a window's smallest seed hashes, all of them at ties)."""
    width = span - SEED + 1
    places, hashes = [], []
    for a, b in row_chunks(offsets, REACH):
        for lo in range(int(offsets[a]), max(int(offsets[b]) - span + 1, int(offsets[a])), REACH):
            # windows that begin in [lo, lo + REACH): a long row is read in parts that overlap by a window
            hi = min(lo + REACH + span - 1, int(offsets[b]))
            if hi - lo < span:
                continue
            g = seed_hashes(buf[lo:hi])
            low = _slide(g, width, np.minimum)
            # windows over a border between rows aren't windows
            begins = np.arange(lo, lo + len(low))
            row = np.searchsorted(offsets, begins, "right") - 1 if b - a > 1 else None
            whole = begins + span <= (offsets[row + 1] if row is not None else offsets[b])
            low = np.where(whole, low, np.uint64(0))
            edge = np.zeros(width - 1, np.uint64)
            at = np.flatnonzero((g == _slide(np.concatenate([edge, low, edge]), width, np.maximum)) & (g > 0))
            places.append(at + lo)
            hashes.append(g[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _anchor_rows(span: int, buckets: int):
    """Of one block: a row for each bucket with its anchors' hashes, each once with its first and last document."""

    def run(docs: pa.Table) -> pa.Table:
        docs, ids, buf, offsets = _block_rows(docs)
        place, h = anchors(buf, offsets, span)
        row = np.searchsorted(offsets, place, "right") - 1
        to, h = bucket_of(h, buckets), h.astype(np.uint32)
        order = np.lexsort((row, h, to))  # rows are in order of doc_id
        key = to[order].astype(np.uint64) << np.uint64(32) | h[order]
        begin = _runs(key)
        low, high = row[order][begin], row[order][np.append(begin[1:], len(key))[: len(begin)] - 1]
        h, to = h[order][begin], to[order][begin]
        cuts = [*_runs(to).tolist(), len(to)]
        out = []
        for x, y in zip(cuts, cuts[1:], strict=False):
            rows, index = np.unique(np.concatenate([low[x:y], high[x:y]]), return_inverse=True)
            first, last = index[: y - x].astype(np.uint32), index[y - x :].astype(np.uint32)
            out.append(pack(np.diff(h[x:y], prepend=np.uint32(0)), first, last - first, ids[rows]))
        block = docs.column("block")[0].as_py() if docs.num_rows else 0
        release()
        return pa.table([pa.array(to[cuts[:-1]] if len(to) else np.zeros(0, np.int32)), pa.array(np.full(len(out), block, np.int32)), pa.array(out, pa.binary())], names=["bucket", "block", "payload"])

    return run


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Of one bucket: the hashes that two documents have, for each block those that occur in it."""
    parts = [unpack(x.as_py()) for x in table.column("payload")]
    h = np.concatenate([np.cumsum(p[0], dtype=np.uint32) for p in parts])
    first, last = (np.concatenate([p[3][f(p)] for p in parts]) for f in (lambda p: p[1], lambda p: p[1] + p[2]))
    order = np.argsort(h, kind="stable")
    begin = _runs(h[order])
    low, high = np.minimum.reduceat(first[order], begin), np.maximum.reduceat(last[order], begin)
    shared = np.zeros(len(h), bool)
    shared[order] = np.repeat(low < high, np.diff(np.append(begin, len(h))))
    bucket = np.array([table.column("bucket")[0].as_py()], np.uint32)
    ends = np.cumsum([len(p[0]) for p in parts])[:-1]
    out = [pack(bucket, x[y]) for x, y in zip(np.split(h, ends), np.split(shared, ends), strict=True)]
    return pa.table([table.column("block"), pa.array(out, pa.binary())], names=["block", "payload"])


def _block_rows(docs: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A block's rows in an order that depends on them only, with their doc_ids, bytes and offsets."""
    docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    buf, offsets = text_buffer(docs.column("text").combine_chunks() if docs.num_rows else pa.array([], pa.string()))
    return docs, docs.column("doc_id").to_numpy(), buf, offsets


def _surroundings(span: int, buckets: int):
    left = span - SEED
    width = left + span

    def run(docs: pa.Table, hints: pa.Table) -> pa.Table:
        docs, ids, buf, offsets = _block_rows(docs)
        shared = [(bucket.astype(np.uint64) << np.uint64(32)) | h for bucket, h in (unpack(x.as_py()) for x in hints.column("payload"))]
        at, seed = anchors(buf, offsets, span)
        key = bucket_of(seed, buckets).astype(np.uint64) << np.uint64(32) | seed.astype(np.uint32)
        on = np.isin(key, np.concatenate(shared)) if shared else np.zeros(len(at), bool)
        at, seed = at[on], seed[on]
        row = np.searchsorted(offsets, at, "right") - 1
        pos = at - offsets[row]
        before = np.minimum(pos, left).astype(np.uint8)
        after = np.minimum(offsets[row + 1] - at, span).astype(np.uint8)
        m = np.zeros((len(at), width), np.uint8)
        for k in range(width):
            inside = (k >= left - before) & (k < left + after)
            m[inside, k] = buf[at[inside] + (k - left)]
        whole = seed.copy()
        for k in range(width):
            whole = whole * np.uint64(BASE) + m[:, k]
        whole = mix64(whole + before * np.uint64(977) + after.astype(np.uint64) * np.uint64(65537))
        # equal surroundings: the first row by doc_id leads, the others follow it
        order = np.lexsort((row, whole))
        begin = _runs(whole[order])
        size = np.diff(np.append(begin, len(order)))
        leader = np.repeat(order[begin], size) if len(order) else order
        same = (m[order] == m[leader]).all(1) & (before[order] == before[leader]) & (after[order] == after[leader])
        leader = np.where(same, leader, order)
        follows = leader != order
        lead, follow, of = order[~follows], order[follows], leader[follows]
        lead = lead[np.argsort(bucket_of(seed[lead], buckets), kind="stable")]
        to = bucket_of(seed[lead], buckets)
        nth = np.zeros(len(at), np.int64)
        begin = _runs(to)
        nth[lead] = np.arange(len(lead)) - np.repeat(begin, np.diff(np.append(begin, len(lead))))
        order = np.argsort(bucket_of(seed[follow], buckets), kind="stable")
        follow, of = follow[order], of[order]
        to_follow = bucket_of(seed[follow], buckets)
        out, cuts = [], [*begin.tolist(), len(lead)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            o = lead[x:y]
            u, v = np.searchsorted(to_follow, to[x], "left"), np.searchsorted(to_follow, to[x], "right")
            f, g = follow[u:v], of[u:v]
            out.append(pack(seed[o].astype(np.uint32), ids[row[o]], row[o].astype(np.uint32), pos[o].astype(np.uint32), before[o], after[o], m[o].ravel(), nth[g].astype(np.uint32), row[f].astype(np.uint32), pos[f].astype(np.uint32), ids[row[f]] == ids[row[g]]))
        block = docs.column("block")[0].as_py() if docs.num_rows else 0
        release()
        return pa.table([pa.array(to[cuts[:-1]] if len(lead) else np.zeros(0, np.int32)), pa.array(np.full(len(out), block, np.int32)), pa.array(out, pa.binary())], names=["bucket", "block", "payload"])

    return run


def common_extension(h: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common prefix of strings a and b, by binary search over the hashes of their prefixes."""
    low, high = np.zeros(len(a), np.int64), np.minimum(size[a], size[b]).astype(np.int64)
    for _ in range(int(h.shape[1]).bit_length()):
        mid = (low + high + 1) >> 1
        same = h[a, mid] == h[b, mid]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        high = np.maximum(low, high)
    return low


def merge_sort(group: np.ndarray, m: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order of the strings (rows of m, of given sizes) inside groups of equal neighbours, by merging runs.

    All merges of a round are done together: an element's place is its place in
    its own run plus the number of the other run's elements before it, found by
    binary search with hash-compared strings.
    """
    h = np.zeros((len(m), m.shape[1] + 1), np.uint64)
    for k in range(m.shape[1]):
        h[:, k + 1] = h[:, k] * np.uint64(BASE) + m[:, k] + np.uint64(1)
    order = np.arange(len(m))
    begin = _runs(group)
    count = np.diff(np.append(begin, len(group)))
    first, total = np.repeat(begin, count), np.repeat(count, count)
    width = 1
    while width < int(count.max(initial=0)):
        i = np.flatnonzero(total > width)
        f, r = first[i], i - first[i]
        run = r // width
        other = run ^ 1
        start = f + other * width
        low, high = np.zeros(len(i), np.int64), np.clip(total[i] - other * width, 0, width)
        mine, right = order[i], (run & 1).astype(bool)
        for _ in range(width.bit_length()):
            mid = (low + high) >> 1
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            x, y = mine[open_], order[start[open_] + mid[open_]]
            e = common_extension(h, size, x, y)
            ended = e == np.minimum(size[x], size[y])
            col = np.minimum(e, m.shape[1] - 1)
            bx, by = m[x, col], m[y, col]
            less = np.where(ended, size[y] < size[x], by < bx)  # the other one comes first
            tie = ended & (size[x] == size[y])
            before = less | (tie & right[open_])
            low[open_] = np.where(before, mid[open_] + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid[open_])
        new = order.copy()
        new[f + (run & ~1) * width + (r - run * width) + low] = mine
        order, width = new, 2 * width
    return order


def sorted_with_extensions(group: np.ndarray, m: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order inside groups and each one's common extension with the one before, verified by bytes."""
    order = merge_sort(group, m, size)

    def extensions(o):
        a, b = o[:-1], o[1:]
        differ = m[a] != m[b]
        e = np.where(differ.any(1), differ.argmax(1), m.shape[1])
        e = np.minimum(e, np.minimum(size[a], size[b]))
        e = np.where(group[a] == group[b], e, 0)
        col = np.minimum(e, m.shape[1] - 1)
        rising = (group[a] != group[b]) | np.where(e == np.minimum(size[a], size[b]), size[a] <= size[b], m[a, col] < m[b, col])
        return np.concatenate([[0], e]), bool(rising.all())

    e, sound = extensions(order)
    if not sound:  # two different prefixes had one hash: sort by the bytes themselves
        order = np.lexsort((*(m[:, k] for k in range(m.shape[1] - 1, -1, -1)), group))
        e, _ = extensions(order)
    return order, e


def _marks(span: int):
    left = span - SEED
    width = left + span

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py()) for x in table.column("payload")]
        h, doc = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        before, after = np.concatenate([p[4] for p in parts]), np.concatenate([p[5] for p in parts])
        m = np.concatenate([p[6] for p in parts]).reshape(-1, width)
        mask = np.zeros(len(h), np.uint32)
        order = np.argsort(h, kind="stable")
        begin = _runs(h[order])
        low, high = (f.reduceat(doc[order], begin) for f in (np.minimum, np.maximum))
        o = order[np.repeat(low < high, np.diff(np.append(begin, len(h))))]
        if len(o):
            group, docs = h[o], doc[o]
            right_order, right = sorted_with_extensions(group, m[o, left:], after[o].astype(np.int64))
            left_order, back = sorted_with_extensions(group, np.ascontiguousarray(m[o, :left][:, ::-1]), before[o].astype(np.int64))
            for k in range(left + 1):  # windows that begin k bytes before the anchor
                key = np.zeros(len(o), np.int64)
                key[right_order] = np.cumsum(right < span - k) * (len(o) + 1)
                if k:
                    key[left_order] += np.cumsum(back < k)
                by = np.argsort(key)
                runs = _runs(key[by])
                least = np.minimum.reduceat(docs[by], runs)
                repeated = np.zeros(len(o), bool)
                repeated[by] = np.repeat(least, np.diff(np.append(runs, len(by)))) < docs[by]
                repeated &= (before[o] >= k) & (after[o] >= span - k)
                mask[o] |= repeated.astype(np.uint32) << np.uint32(k)
        out, at = [], 0
        for p in parts:
            n = len(p[0])
            own = mask[at : at + n]
            at += n
            k = np.arange(left + 1)
            # a follower has all its windows in the leader, or, in the same document, the leader's marks
            valid = (((p[4][:, None] >= k) & (p[5][:, None] >= span - k)).astype(np.uint32) << k.astype(np.uint32)).sum(1, dtype=np.uint32)
            lead = p[7].astype(np.int64)
            both = np.concatenate([own, np.where(p[10], own[lead], valid[lead])])
            has = both > 0
            out.append(pack(np.concatenate([p[2], p[8]])[has], np.concatenate([p[3], p[9]])[has], both[has]))
        release()
        return pa.table([table.column("block").combine_chunks(), pa.array(out, pa.binary())], names=["block", "payload"])

    return run


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(span: int, with_text: bool, carried: str):
    left = span - SEED
    kind = to_arrow_type(DataType.fromDDL(carried))  # as the result's type: every field may be null

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        docs, ids, buf, offsets = _block_rows(docs)
        begins = np.zeros(len(buf) + span + 1, bool)
        for x in marks.column("payload"):
            row, pos, mask = unpack(x.as_py())
            at = offsets[row] + pos
            for k in range(left + 1):
                begins[at[(mask >> np.uint32(k)) & 1 > 0] - k] = True
        total = np.zeros(len(buf) + span, np.int32 if len(buf) < 1 << 31 else np.int64)
        np.cumsum(begins[: len(buf)], out=total[span:])
        gone = total[span:] > total[: len(buf)]  # a window began in the last span bytes
        del total, begins
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        starts = offsets[:-1][offsets[:-1] < len(buf)]
        edge[starts] = gone[starts]
        rows = []
        for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
            kept = buf[a:b][~gone[a:b]].tobytes()
            rows.append((b - a, b - a - len(kept), int(edge[a:b].sum()), hashlib.sha256(kept).hexdigest(), *((kept.decode("utf-8", "ignore"),) if with_text else ())))
        cols = list(zip(*rows, strict=True)) or [()] * (4 + with_text)
        types = [pa.int64()] * 3 + [pa.string()] * (1 + with_text)
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []), "carried"]
        shown = pa.array(np.where(ids == _NULL_ID, 0, ids), pa.int64(), mask=ids == _NULL_ID)
        return pa.table([shown, *(pa.array(c, t) for c, t in zip(cols, types, strict=True)), docs.column("carried").cast(kind)], names=names)

    return run


def remove_repeats(docs: DataFrame, span: int = SPAN, carry: tuple[str, ...] | None = None) -> DataFrame:
    """docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    carry, if given (it may be empty), adds kept, the remaining text, and the
    named columns of docs. Where a cut splits a character, kept leaves its
    remaining bytes out; the digest has them.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID).cast("long"))
    text, with_text = F.coalesce("text", F.lit("")), carry is not None
    if clash := set(carry or ()) & {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"}:
        raise ValueError(f"the result has columns of its own named {sorted(clash)}")
    # what is carried goes in one column, so that its names meet none of those here
    rows = docs.select(ids.alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("same"), F.struct(F.lit(0).alias("_"), *[F.col(c) for c in carry or ()]).alias("carried"))
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets, blocks = max(shuffle_partitions(spark) * BUCKETS, -(-size // BUCKET_BYTES)), max(1, -(-size // BLOCK_BYTES))
    groups = rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("c")).where("c > 1")
    copies = groups.where("first < last").select("same", "first")
    n = copies.count()
    rows = rows.join(broadcast_if_small(copies, n, 500_000), "same", "left") if n else rows.withColumn("first", F.lit(None).cast("long"))
    is_copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)) & (F.octet_length("text") >= span)
    originals = rows.where(~is_copy).where("first is null or doc_id = first")
    twins = rows.select("doc_id", "same").groupBy("doc_id", "same").agg(F.count("*").alias("c")).where("c > 1").select("doc_id", "same")
    twins = None if groups.isEmpty() or twins.isEmpty() else materialize(twins, "twins")
    if twins is not None:  # of rows that repeat doc_id and text one is worked
        n_twins = twins.count()
        repeated = originals.join(broadcast_if_small(twins, n_twins, 500_000), ["doc_id", "same"], "left_semi")
        one = repeated.select("doc_id", "same", "text", "first").dropDuplicates(["doc_id", "same"]).join(repeated.limit(0).select("carried"), F.lit(False), "left")
        originals = originals.join(broadcast_if_small(twins, n_twins, 500_000), ["doc_id", "same"], "left_anti").unionByName(one.select(*originals.columns))
    originals = originals.withColumn("block", F.pmod(F.xxhash64("doc_id", "same"), F.lit(blocks)).cast("int")).select("doc_id", "text", "block", F.struct("same", F.col("carried").alias("own")).alias("carried"))

    # the same columns each time, so that one shuffle serves all three steps
    found = originals.groupBy("block").applyInArrow(_anchor_rows(span, buckets), "bucket int, block int, payload binary")
    hints = found.groupBy("bucket").applyInArrow(_shared_anchors, "block int, payload binary")
    entries = originals.groupBy("block").cogroup(hints.groupBy("block")).applyInArrow(_surroundings(span, buckets), "bucket int, block int, payload binary")
    marks = entries.groupBy("bucket").applyInArrow(_marks(span), "block int, payload binary")
    carried = originals.schema["carried"].dataType.simpleString()
    schema = f"{_RESULT}{', kept string' * with_text}, carried {carried}"
    cut = originals.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_cut(span, with_text, carried), schema)
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
    cut = cut.select("doc_id", *results, F.col("carried.own").alias("carried"), F.col("carried.same").alias("same"))
    shown = F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")).alias("doc_id")
    if twins is not None:
        key = F.struct(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc_id"), F.col("same")).alias("key")
        cut = materialize(cut, "cut")
        worked = cut.join(broadcast_if_small(twins.select("same").distinct(), n_twins, 500_000), "same", "left_semi").select(key, *results)
        told = lookup(repeated.select("doc_id", key, "carried"), worked, "key").select(shown, *results, "carried")
        once = cut.select("*", key).join(broadcast_if_small(twins.select(key), n_twins, 500_000), "key", "left_anti")
        cut = once.select("doc_id", *results, "carried").unionByName(told)

    # copies: whole texts repeat the first of their group; those shorter than the span have nothing to remove
    length = F.octet_length("text").cast("long")
    short = rows.where("first is not null and doc_id > first")
    whole = F.when(is_copy, length).otherwise(F.lit(0).cast("long"))
    kept = F.when(is_copy, F.lit("")).otherwise(F.col("text"))
    rest = short.select(shown, length.alias("n_bytes"), whole.alias("n_removed"), is_copy.cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"), *[kept.alias("kept")] * with_text, "carried")
    return cut.select("doc_id", *results, "carried").unionByName(rest).select("doc_id", *results, *[F.col("carried").getField(c).alias(c) for c in carry or ()])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
