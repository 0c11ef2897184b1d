"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

A document's set holds the 64-bit hashes of its distinct word shingles. Two
documents of similarity t or more share a hash among their prefixes: the first
n - ceil(t n) + 1 hashes in one global order (hashes that many documents hold
come last, then by value). Documents that share a prefix hash meet in tiles of
that hash and a size band; a band spans a factor 1 / t, so that partners lie in
the same band or the next. Inside a tile, the bit count of the difference of two
parity bitmaps bounds the set difference from below, hence the overlap from
above; pairs that pass have their sorted arrays intersected exactly.

No step gives all pairs of a group of copies. Equal sets are one class, which is
one node; cheap keys (pairs of minima) link a class with the first holder of the
key after exact verification. Tiles compare classes that these links have not
put into one tree yet, and a cell (a tile, or a pair of parts of a large one, so
that no task holds a whole one) gives only a forest of the pairs that its bit
counts leave possible: fewer rows than it read. All links lie inside the
components of these forests. There all pairs are intersected exactly, a block in
a task, which gives each class's number of links and a forest of the links.

Defined cases: null, empty and white-space texts have an empty set and link with
nothing; a text of fewer words than a shingle has its whole sequence as one;
rows that repeat a doc_id, with one text or several, are each judged by their
own text; rows without doc_id are judged, too, but never name a component: its
id is the smallest doc_id that is known, null if none is. Long texts are read in
parts of about a megabyte, cut at white space. Extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SMALL, bounded_batches, broadcast_if_small, connected_components, lookup, materialize, mix64, row_chunks, scratch_scope, shuffle_partitions, split_rows, text_buffer, tidy, words

#: A hash is common from this share of the documents on; common hashes come last in the order.
COMMON = 0.001
#: Bits of the signatures of sets of at most as many hashes, and of larger ones.
BITS, WIDE = 1024, 4096
#: Cheap keys, and minima in each.
CHEAP, MINIMA = 4, 2
#: Rows of a tile that one cell compares.
TILE = 4096
#: Common hashes that come last in the order, at most; others keep the order of their values.
MOST_COMMON = 1 << 20
#: Hashes in a block of a component's sets, when links are counted; each set counts 256 more, so a block has about 1,024 at most.
BLOCK = 1 << 18
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def shingle_sets(col: pa.Array, size: int):
    """For each row of a string column its set: sorted distinct 64-bit hashes of its shingles of size words."""
    buf, offsets = text_buffer(col)
    parts, owner = split_rows(buf, offsets)
    waiting: list[np.ndarray] = []  # hashes of a long row's parts so far
    done = 0
    for a, b in row_chunks(parts):
        _, _, rows, h = words(buf[parts[a] : parts[b]], parts[a : b + 1] - parts[a])
        at = np.searchsorted(rows, np.arange(b - a + 1))
        rolled = _rolled(h, size)
        for i in range(b - a):
            last = int(parts[a + i + 1]) == int(offsets[done + 1]) if len(parts) > len(offsets) else True
            x, y = int(at[i]), int(at[i + 1])
            if not last or waiting:
                waiting.append(h[x:y])
                if last:
                    whole = np.concatenate(waiting)
                    yield _set_of(whole, _rolled(whole, size), 0, len(whole), size)
                    waiting = []
            else:
                yield _set_of(h, rolled, x, y, size)
            done += last


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    n = len(h) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        out = mix64(out * np.uint64(3) + h[k : k + n] + np.uint64(k + 1))
    return out


def _set_of(h: np.ndarray, rolled: np.ndarray, x: int, y: int, size: int) -> np.ndarray:
    """The set of the words x to y."""
    if y - x >= size:
        return np.unique(rolled[x : y - size + 1])
    whole = np.array([y - x] if y > x else [], np.uint64)
    for k in range(x, y):
        whole = mix64(whole * np.uint64(5) + h[k : k + 1] + np.uint64(77))
    return whole


def signature(s: np.ndarray) -> bytes:
    """Parity bitmap: each hash flips one bit. Halves of a wider one folded together (xor) are the narrower one."""
    bits = BITS if len(s) <= BITS else WIDE
    return np.packbits((np.bincount((s >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def may_link(n: np.ndarray, m: np.ndarray, a: list[bytes], b: list[bytes], percent: int) -> np.ndarray:
    """Whether sets of n and m hashes with signatures a and b can be similar enough."""
    total = n + m
    keep = (percent * np.maximum(n, m) <= 100 * np.minimum(n, m))
    for wide in (False, True):
        at = np.flatnonzero(keep & (np.minimum(n, m) > BITS)) if wide else np.flatnonzero(keep)
        if len(at):
            x, y = (_bitmaps([z[i] for i in at], wide) for z in (a, b))
            most = (total[at] - np.bitwise_count(x ^ y).sum(1, dtype=np.int64)) // 2
            keep[at] = 100 * most >= percent * (total[at] - most)
    return keep


def _bitmaps(sigs: list[bytes], wide: bool) -> np.ndarray:
    """Signatures as rows of 64-bit words; of WIDE bits each, or folded to BITS."""
    if wide:
        return np.frombuffer(b"".join(sigs), np.uint64).reshape(-1, WIDE // 64)
    out = np.zeros((len(sigs), BITS // 64), np.uint64)
    for i, x in enumerate(sigs):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, BITS // 64), axis=0)
    return out


def cheap_keys(s: np.ndarray) -> list[int]:
    out = []
    for k in range(CHEAP):
        key = 0
        for m in range(MINIMA):
            nth = k * MINIMA + m
            salt = np.uint64(int(_MIX[nth % 4]) * (2 * nth + 1) & (1 << 64) - 1)
            key = (key * 31 + int(mix64(s ^ salt).min())) & ((1 << 64) - 1)
        out.append((key ^ k) - (1 << 63))
    return out


def common_hashes(docs: DataFrame, size: int, n_docs: int) -> np.ndarray:
    """Hashes in COMMON of all documents or more, rarest first, the MOST_COMMON most frequent at most.

    Each batch passes on only what is common in it. The order is a matter of
    speed, any gives the same links: so a hash that is left out here only keeps
    its place by value.
    """

    @tidy
    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(0), size))
            h, n = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
            often = n >= max(4, COMMON * len(sets))
            yield pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["h", "n"])

    found = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") >= max(4, COMMON * n_docs)).orderBy(F.desc("n"), "h").select("h").limit(MOST_COMMON).toPandas()
    return rows["h"].to_numpy(np.int64)[::-1].view(np.uint64)


_SHAPE = "n long, class_key binary, sig binary, cheap array<long>, prefix array<long>"


def profiles(docs: DataFrame, size: int, percent: int, common: np.ndarray) -> DataFrame:
    """docs (doc_id, text_key, text): doc_id, text_key, n, class_key (of equal sets), sig, cheap (keys), prefix (hashes)."""
    known = docs.sparkSession.sparkContext.broadcast((np.sort(common), np.argsort(common)))

    @tidy
    def run(batches):
        import xxhash

        often, place = known.value
        for batch in batches:
            rows = []
            for s in shingle_sets(batch.column(2), size):
                n = len(s)
                if not n:
                    rows.append((0, None, None, [], []))
                    continue
                keep = n - (percent * n + 99) // 100 + 1
                order = s
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    last = often[at] == s
                    order = np.concatenate([s[~last], s[last][np.argsort(place[at[last]])]]) if last.any() else s
                rows.append((n, xxhash.xxh3_128_digest(s.tobytes()), signature(s), cheap_keys(s), order[:keep].view(np.int64)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), t) for c, t in zip(cols, types, strict=True))], ["doc_id", "text_key", "n", "class_key", "sig", "cheap", "prefix"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, f"doc_id long, text_key binary, {_SHAPE}")


class Source:
    """The documents (doc_id, text_key, text) that sets are made of again; repeats says whether rows are there twice."""

    def __init__(self, docs: DataFrame, size: int, percent: int, repeats: bool) -> None:
        self.docs, self.size, self.percent, self.repeats = docs.withColumn("at", _at()), size, percent, repeats

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, s): the sets, as bytes, of nodes (node, at, class_key)."""
        n, size = nodes.count(), self.size
        some = self.docs.join(broadcast_if_small(nodes.select("at"), n), "at", "left_semi")
        some = some.dropDuplicates(["at"]) if self.repeats else some

        @tidy
        def as_sets(batches):
            import xxhash

            for batch in batches:
                sets = [s.tobytes() for s in shingle_sets(batch.column(0), size)]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["class_key", "s"])

        # the class itself tells a node's own text from another of the same hash
        named = broadcast_if_small(nodes.select("node", "class_key"), n, SMALL)  # sets are shuffled once, by node
        return some.select("text").mapInArrow(as_sets, "class_key binary, s binary").join(named, "class_key").select("node", "s")


def _at():
    """A hash by which a row is found again."""
    return F.xxhash64("doc_id", "text_key")


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the bit counts of sets' (node, n, sig) leave possible."""
    sides = [sets.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}")) for c in "ab"]

    @tidy
    def test(batches):
        for batch in batches:
            mask = pa.array(may_link(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), percent))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    joined = pairs.distinct().join(sides[0], "a").join(sides[1], "b")
    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(test, "a long, b long")


def verified(pairs: DataFrame, reps: DataFrame, source: Source) -> DataFrame:
    """The pairs (a, b) of nodes whose sets' similarity is percent / 100 or more, by intersecting their sorted arrays."""
    pairs, percent = materialize(pairs.distinct(), "pairs"), source.percent
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = source.sets(reps.select("node", "at", "class_key").join(ends, "node", "left_semi"))
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")

    @tidy
    def test(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return joined.select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long").distinct()


def _root(roots: list[int], x: int) -> int:
    while roots[x] != x:
        roots[x] = x = roots[roots[x]]
    return x


def _tile_forest(percent: int):
    """Kernel over rows sorted by cell (key, band, x, y) and size: a forest of each cell's candidate pairs between different components.

    Rows of a cell are of part x or y of a tile; pairs are of different parts, or of any two rows where x is y.
    Candidates inside one tree of the forest add nothing to its components and are neither tested nor given.
    """

    def pairs_of(cell, apart, part, home, n, comp, node, sig):
        found = []
        narrow = _bitmaps(sig, False)
        i = np.arange(len(cell))
        _, tree = np.unique(comp, return_inverse=True)
        _, tree = np.unique(cell * (tree.max() + 1) + tree, return_inverse=True)
        roots = list(range(int(tree.max()) + 1))
        for o in range(1, len(cell)):
            i = i[i + o < len(cell)]
            i = i[(cell[i] == cell[i + o]) & (percent * n[i + o] <= 100 * n[i])]  # by size: what is too far apart stays so
            if not len(i):
                break
            k = i[(home[i] | home[i + o]) & (tree[i] != tree[i + o]) & (~apart[i] | (part[i] != part[i + o]))]
            total = n[k] + n[k + o]
            most = (total - np.bitwise_count(narrow[k] ^ narrow[k + o]).sum(1, dtype=np.int64)) // 2  # overlap's upper bound
            k = k[100 * most >= percent * (total - most)]
            if len(k):
                k = k[may_link(n[k], n[k + o], [sig[x] for x in k], [sig[x + o] for x in k], percent)]
            before = len(found)
            for x in k.tolist():
                u, v = _root(roots, int(tree[x])), _root(roots, int(tree[x + o]))
                if u != v:
                    roots[max(u, v)] = min(u, v)
                    found.append(x if node[x] < node[x + o] else x + o)
                    found.append(x + o if node[x] < node[x + o] else x)
            if len(found) > before:
                tree = np.array([_root(roots, x) for x in range(len(roots))])[tree]
        return node[np.array(found, np.int64)].reshape(-1, 2)

    @tidy
    def run(batches):
        kept: list[pa.RecordBatch] = []

        def flush(rows: pa.Table):
            key, band, x, y, part, home, n, comp, node = (rows.column(c).to_numpy() for c in ("key", "band", "x", "y", "part", "home", "n", "comp", "node"))
            changes = (key[1:] != key[:-1]) | (band[1:] != band[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            p = pairs_of(np.cumsum(np.concatenate([[0], changes])), x != y, part, home.astype(bool), n, comp, node, rows.column("sig").to_pylist())
            return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

        for batch in batches:  # the last cell of a batch may go on in the next
            if not batch.num_rows:
                continue
            kept.append(batch)
            cols = [batch.column(c).to_numpy() for c in ("key", "band", "x", "y")]
            other = np.flatnonzero(np.any([c != c[-1] for c in cols], axis=0))
            if len(other):
                cut = int(other[-1]) + 1
                yield flush(pa.Table.from_batches([*kept[:-1], batch.slice(0, cut)]))
                kept = [batch.slice(cut)]
        if kept:
            yield flush(pa.Table.from_batches(kept))

    return run


def _band(percent: int):
    """Sizes by factors of 100 / percent: sets that link lie in one band or in two that follow each other."""
    return F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")


def _cells(share: str, parts: str):
    """The cells (x, y) of a row in part `share` of `parts`: with each other part, and its own."""
    return F.transform(F.sequence(F.lit(0), F.col(parts) - 1), lambda o: F.struct(F.least(F.col(share), o).alias("x"), F.greatest(F.col(share), o).alias("y")))


def _share_of(parts):
    """A node's part, by its hash."""
    return F.pmod(F.xxhash64(F.col("node"), F.lit("part")), parts).cast("int")


def tile_candidates(named: DataFrame, percent: int) -> DataFrame:
    """Of named (node, comp, n, sig, prefix), pairs (a, b) of different components that meet in a tile and pass the bit counts: a forest of each cell's.

    The prefixes are dealt by key once, without their signatures; what meets no
    other component in its key, then in its key and band, goes no further. Nor
    does what has no possible partner there: of a pair that links, the first hash
    that both hold leaves enough hashes behind it only if, in the smaller set
    (of equal sizes: in both), it is among the first n - ceil(2 t n / (1 + t)) + 1.
    """
    w = W.partitionBy("key")
    rows = named.select("node", "comp", "n", F.posexplode("prefix").alias("pos", "key"))
    early = F.col("pos") <= F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / F.lit(100 + percent) - F.lit(1e-9))
    rows = rows.select("node", "comp", "n", "key", early.alias("early"))
    rows = rows.withColumn("low", F.min("comp").over(w)).withColumn("high", F.max("comp").over(w)).where("low < high")
    rows = rows.withColumn("own", _band(percent)).withColumn("band", F.explode(F.array(F.col("own"), F.col("own") + 1))).withColumn("home", (F.col("own") == F.col("band")).cast("int"))
    w = W.partitionBy("key", "band")
    rows = rows.withColumn("low", F.min("comp").over(w)).withColumn("high", F.max("comp").over(w)).withColumn("homes", F.max("home").over(w)).withColumn("c", F.count("*").over(w))
    by_size = w.orderBy("n", "node")
    before = F.max(F.when(F.col("early"), F.col("n"))).over(by_size.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("before", before).withColumn("after", F.lead("n").over(by_size)).where("low < high and homes = 1")
    rows = rows.where((100 * F.col("before") >= percent * F.col("n")) | F.col("early") & (percent * F.col("after") <= 100 * F.col("n")))
    meet = rows.withColumn("parts", F.ceil(F.col("c") / TILE).cast("int")).withColumn("part", _share_of(F.col("parts"))).withColumn("cell", F.explode(_cells("part", "parts")))
    meet = meet.select("key", "band", "cell.x", "cell.y", "part", "home", "n", "comp", "node").join(named.select("node", "sig"), "node")
    tiles = meet.repartition(shuffle_partitions(named.sparkSession), "key", "band", "x", "y").sortWithinPartitions("key", "band", "x", "y", "n", "node")
    return tiles.mapInArrow(_tile_forest(percent), "a long, b long")


def _links_inside(percent: int, counted: bool):
    """Of one unit, its components one after another: a forest of the links between its trees; if counted, each node's links, too.

    Links are those from the left side to the right one, or inside one side.
    """

    def links(k, right, flat, n, starts, ends, code, mark):
        own = code[ends[k] - n[k] : ends[k]]
        mark[own] = 1
        both = np.add.reduceat(mark[flat], starts)
        mark[own] = 0
        return (100 * both >= percent * (n[k] + n[right] - both)) & (right != k)

    def run(table: pa.Table) -> pa.Table:
        comp, left_side, node, trees = table.column("comp").to_numpy(), table.column("left").to_numpy(), table.column("node").to_numpy(), table.column("tree").to_numpy()
        right_side, bands = table.column("right").to_numpy(), table.column("s").combine_chunks()
        found, forest = np.zeros(len(node), np.int64), []
        order = np.argsort(comp, kind="stable")
        cuts = [*np.flatnonzero(np.append(True, comp[order][1:] != comp[order][:-1])).tolist(), len(order)]
        for u, v in zip(cuts, cuts[1:], strict=False):
            at = order[u:v]
            each = [np.frombuffer(bands[int(z)].as_buffer(), np.uint64) for z in at]
            _, code = np.unique(np.concatenate(each), return_inverse=True)
            n = np.array([len(z) for z in each])
            ends = np.cumsum(n)
            left, right = np.flatnonzero(left_side[at]), np.flatnonzero(right_side[at])
            if not len(left) or not len(right):
                continue
            own, mark, tree = np.zeros(len(at), np.int64), np.zeros(code.max() + 1, np.int64), trees[at].copy()
            inside = bool((left_side[at] & right_side[at]).any())
            with_, flat, starts = right[:0], None, None
            for k in left:
                to = right if counted else right[tree[right] != tree[k]]
                if not len(to):
                    continue
                if len(to) != len(with_) or (to != with_).any():
                    with_, flat, starts = to, np.concatenate([code[ends[r] - n[r] : ends[r]] for r in to]), np.cumsum(n[to]) - n[to]
                link = links(k, to, flat, n, starts, ends, code, mark)
                own[k] += link.sum()
                if not inside:
                    own[to] += link
                other = to[link & (tree[to] != tree[k])]
                if len(other):
                    joined, first = np.unique(tree[other], return_index=True)
                    forest += zip([k] * len(first), other[first].tolist(), [u] * len(first), strict=True)
                    tree[np.isin(tree, joined)] = tree[k]
            found[at] += own
        a, b = (node[order[np.array([x[j] + x[2] for x in forest], np.int64)]] for j in (0, 1))
        return pa.table({"node": np.concatenate([node, a]), "n_links": np.concatenate([found, np.zeros(len(a), np.int64)]), "other": pa.concat_arrays([pa.nulls(len(node), pa.int64()), pa.array(b, pa.int64())])})

    return run


def exact_links(members: DataFrame, source: Source, counted: bool) -> DataFrame:
    """(node, n_links, other) of members (node, at, class_key, n, comp, tree), by intersecting their sets inside each comp.

    Rows with other are links between different trees, a forest of them from each
    task. If counted, the n_links of a node sum up to its links to all others of its comp.
    Components of up to BLOCK hashes are dealt whole, many to a task. The members of
    a larger one go by bands of size into parts of about BLOCK hashes, and pairs of
    parts of one band or two that follow each other are compared in a task each:
    pairs of documents are never rows.
    """
    percent = source.percent
    members = members.withColumn("w", F.col("n") + 256).withColumn("band", _band(percent))
    sizes = members.groupBy("comp").agg(F.count("*").alias("c"), F.sum("w").alias("total")).where("c > 1")
    by_band = members.groupBy("comp", "band").agg(F.ceil(F.sum("w") / BLOCK).cast("int").alias("parts"))
    w = W.partitionBy("comp").orderBy("band")
    beside = lambda f, d: F.when(f("band").over(w) == F.col("band") + d, f("parts").over(w))
    by_band = by_band.select("comp", "band", "parts", F.coalesce(beside(F.lead, 1), F.lit(0)).alias("above"), F.coalesce(beside(F.lag, -1), F.lit(0)).alias("below"))
    wide = sizes.where(F.col("total") > BLOCK).select("comp", F.lit(True).alias("wide"))
    groups = materialize(by_band.join(sizes.select("comp"), "comp", "left_semi").join(wide, "comp", "left").select(F.struct("comp", "band").alias("at_band"), F.coalesce("wide", F.lit(False)).alias("wide"), "parts", "above", "below"), "groups")
    small = sizes.where(F.col("total") <= BLOCK).agg(F.sum("total")).head()[0] or 0
    placed = lookup(members.withColumn("at_band", F.struct("comp", "band")), groups, "at_band").where("wide is not null")
    placed = placed.withColumn("part", _share_of(F.col("parts")))
    unit = lambda a, i, b, j: F.struct(F.col("comp").alias("of"), a.alias("a"), i.alias("i"), b.alias("b"), j.alias("j"), (a == F.col("band")) & (i == F.col("part")), (b == F.col("band")) & (j == F.col("part")))
    band, part = F.col("band"), F.col("part")
    same = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: unit(band, F.least(part, o), band, F.greatest(part, o)))
    above = F.when(F.col("above") > 0, F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda o: unit(band, part, band + 1, o)))
    below = F.when(F.col("below") > 0, F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda o: unit(band - 1, o, band, part)))
    names = ["of", "a", "i", "b", "j", "left", "right"]
    shape = "array<struct<of: long, a: int, i: int, b: int, j: int, left: boolean, right: boolean>>"
    whole = F.array(F.struct(F.pmod(F.xxhash64("comp"), F.lit(1 + int(small) // BLOCK)), F.lit(-1), F.lit(-1), F.lit(-1), F.lit(-1), F.lit(True), F.lit(True)))
    every = [x.cast(shape) for x in (whole, same, above, below)]
    empty = F.array().cast(shape)
    units = F.when(F.col("wide"), F.concat(every[1], F.coalesce(every[2], empty), F.coalesce(every[3], empty))).otherwise(every[0])
    placed = materialize(placed.select("node", "at", "class_key", "comp", "tree", units.alias("units")), "placed")
    rows = placed.select("node", "comp", "tree", F.explode("units").alias("u")).join(source.sets(placed.select("node", "at", "class_key")), "node")
    rows = rows.select("node", "comp", "tree", "s", *[F.col(f"u.{c}").alias(c) for c in names])
    return rows.groupBy(*names[:5]).applyInArrow(_links_inside(percent, counted), "node long, n_links long, other long")


def similar_groups(docs: DataFrame, size: int = 5, percent: int = 80, links_too: bool = True) -> DataFrame:
    """docs (doc_id, text): doc_id, n_shingles, class_id, n_links, component_id of every row.

    class_id is the smallest doc_id with an equal set, n_links counts all links
    from the class to other classes; links_too = False leaves n_links out.
    text_key is the MD5 of the row's text; keeper (doc_id, text_key) names the
    row of its component that stays when duplicates go: that of smallest doc_id.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text").withColumn("text_key", F.unhex(F.md5("text"))).select("doc_id", "text_key", "text")
    parts, n_docs = shuffle_partitions(spark), docs.count()
    every = materialize(profiles(docs, size, percent, common_hashes(docs, size, n_docs)), "profiles")
    source = Source(docs, size, percent, not every.groupBy("doc_id", "text_key").agg(F.count("*").alias("c")).where("c > 1").isEmpty())

    # copies are folded into their class before the shuffle; a row without doc_id leads only where no other is
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.col("text_key"))
    one = F.min_by(F.struct("n", "sig", "cheap", "prefix"), rank)
    reps = every.where("n > 0").groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.min(rank).alias("keeper"), one.alias("one"))
    reps = reps.select("class_key", "class_id", "copies", "keeper", "one.*", F.xxhash64("keeper.doc_id", "keeper.text_key").alias("at"))
    reps = materialize(reps.withColumn("node", F.monotonically_increasing_id()), "reps")  # numbered once, as written

    keys = reps.select("node", "n", F.explode("cheap").alias("key"))
    first = keys.groupBy("key").agg(F.min(F.struct("node", "n")).alias("f"), F.count("*").alias("c")).where("c > 1")
    first = materialize(first, "first")
    n_keys = CHEAP * n_docs
    star = lookup(keys, first.select("key", "f"), "key", first.where(F.col("c") > n_keys / (8 * parts)).select("key"))
    star = star.where("f.node <> node").where((percent * F.col("n") <= 100 * F.col("f.n")) & (percent * F.col("f.n") <= 100 * F.col("n")))
    star = possible(star.select(F.col("f.node").alias("a"), F.col("node").alias("b")), reps.select("node", "n", "sig"), percent)
    links = materialize(verified(star, reps, source), "links")
    comps = connected_components(links)

    named = reps.select("node", "n", "sig", "prefix").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    maybe = connected_components(materialize(tile_candidates(named, percent), "maybe").union(links))
    members = reps.select("node", "at", "class_key", "n").join(maybe, "node").join(comps.withColumnRenamed("comp", "tree"), "node", "left").withColumn("tree", F.coalesce("tree", "node"))
    if not links_too:  # what cheap keys have linked already needs no other link
        members = members.join(members.groupBy("comp").agg(F.min("tree").alias("low"), F.max("tree").alias("high")).where("low < high").select("comp"), "comp", "left_semi")
    inside = materialize(exact_links(materialize(members, "members"), source, links_too), "inside")

    final = connected_components(links.union(inside.where("other is not null").select("node", "other")))
    linked = reps.select("node", "class_key", "class_id", "keeper").join(final, "node")
    comp_of = linked.groupBy("comp").agg(F.min("class_id").alias("component_id"), F.min("keeper").alias("keeper"))
    linked = lookup(linked.drop("keeper"), materialize(comp_of, "components"), "comp")
    if links_too:
        linked = linked.join(inside.groupBy("node").agg(F.sum("n_links").alias("n_links")), "node", "left")
    several = reps.where("copies > 1").join(final, "node", "left_anti").select("class_key", "class_id", F.col("class_id").alias("component_id"), "keeper", *[F.lit(0).cast("long").alias("n_links")] * links_too)
    classes = materialize(linked.select(*several.columns).union(several), "classes")
    often = reps.where(F.col("copies") > n_docs / (8 * parts)).select("class_key")
    out = lookup(every.select("doc_id", "text_key", "n", "class_key"), classes, "class_key", often)
    known = F.col("keeper").isNotNull()
    pick = lambda c: F.when(known, F.col(c)).otherwise(F.col("doc_id")).alias(c)
    keeper = F.when(known, F.struct("keeper.doc_id", "keeper.text_key")).otherwise(F.struct("doc_id", "text_key")).alias("keeper")
    counted = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if links_too else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), pick("class_id"), *counted, pick("component_id"), "text_key", keeper)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch_scope(spark):
        found = similar_groups(docs, size=4, percent=85).select("doc_id", "n_shingles", "n_links", "component_id")
        return materialize(found, "op4", keep=True)
