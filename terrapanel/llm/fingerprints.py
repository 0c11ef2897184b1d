"""Document fingerprints: a canonical exact digest, by DataFrame functions only.

Canonical form: NFKC, Spark's upper and then lower case, NFKC again, runs of
Unicode white space as one blank, none at the ends. The digest is two xxhash64 values of
it (128 bits). Buckets of equal digests are compared by their bytes: a bucket
holding two different canonical texts gets the SHA-256 of the text appended, for
documents and edited texts alike, so that equal fingerprints mean equal
canonical texts.

Defined cases: a null text counts as empty; an empty text has a fingerprint like
any other. Repeated rows and ties of doc_id are ordered by the text's hash, so
"next" is defined. A null doc_id sorts first. An only document is its own next.
Long texts are handled whole; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, lookup, materialize, scratch_scope, shuffle_partitions

#: ICU's static normaliser, which Spark itself carries for its collations.
NORMALIZER = "com.ibm.icu.text.Normalizer"
#: Colliding digests that are resolved, at most.
LIMIT = 1000


def nfkc(text: Column) -> Column:
    full = F.call_function("reflect", F.lit(NORMALIZER), F.lit("compose"), text, F.lit(True))
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(full)  # ASCII is normal


def with_canonical(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the canonical form of a text column, each step a column of its own so that none is evaluated twice."""
    steps = rows.withColumn(name, nfkc(F.coalesce(F.col(text), F.lit(""))))
    steps = steps.withColumn(name, nfkc(F.lower(F.upper(F.col(name)))))
    return steps.withColumn(name, F.trim(F.regexp_replace(name, r"(?U)\s+", " ")))


def with_digest(rows: DataFrame, text: str, name: str, bad: list[str] = ()) -> DataFrame:
    """Adds the digest of a text column's canonical form; to those in bad its SHA-256 is appended."""
    canon = with_canonical(rows, text, "canon")
    if bad:
        canon = canon.withColumn("wide", digest(F.col("canon")))
        return canon.withColumn(name, F.when(F.col("wide").isin(bad), F.concat_ws("-", "wide", F.sha2("canon", 256))).otherwise(F.col("wide"))).drop("canon", "wide")
    return canon.withColumn(name, digest(F.col("canon"))).drop("canon")


def digest(canon: Column) -> Column:
    wide = [F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(canon), F.xxhash64(F.lit("wide"), canon, F.length(canon)))]
    return F.lower(F.concat(*wide))


def collisions(rows: DataFrame, docs: DataFrame) -> list[str]:
    """Digests (fp) of rows (doc_id, fp) that stand for different canonical texts in docs (doc_id, text).

    Only buckets of two rows or more are read again; a bucket's least and
    greatest canonical text, combined before the shuffle, are the same bytes or
    it is a collision. Of 128-bit digests there are none but by design of the
    texts; over LIMIT of them is an error.
    """
    again = rows.groupBy("fp").agg(F.count("*").alias("copies")).where("copies > 1").select("fp", F.lit(True).alias("again"))
    again = materialize(again, "again")
    if again.isEmpty():
        return []
    place = F.coalesce("doc_id", F.lit(0)).alias("place")  # a row without doc_id is looked up as 0: some more rows are read
    ids = lookup(rows, again, "fp").where("again").select(place).distinct()
    some = docs.select("text", place).join(broadcast_if_small(ids, ids.count()), "place", "left_semi")
    some = with_canonical(some, "text", "canon").withColumn("fp", digest(F.col("canon")))
    found = some.groupBy("fp").agg(F.min("canon").alias("low"), F.max("canon").alias("high")).where("low <> high").select("fp").limit(LIMIT + 1).collect()
    if len(found) > LIMIT:
        raise ValueError(f"more than {LIMIT} digests collide")
    return [r.fp for r in found]


def exact_groups(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, fingerprint, copies and keeper (smallest doc_id of the group)."""
    docs = docs.select("doc_id", "text")
    rows = materialize(with_digest(docs, "text", "fp").select("doc_id", "fp"), "digests")
    bad = collisions(rows, docs)
    rows = materialize(with_digest(docs, "text", "fp", bad).select("doc_id", "fp"), "digests") if bad else rows
    groups = rows.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("keeper"))
    return lookup(rows, materialize(groups, "groups"), "fp").withColumnRenamed("fp", "fingerprint")


def _bucket(column: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at or below the value: a tree of comparisons."""

    def tree(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(column >= F.lit(bounds[m]), tree(m + 1, b)).otherwise(tree(a, m))

    return F.when(column.isNull(), 0).otherwise(tree(0, len(bounds)))


def with_next(rows: DataFrame, bad: list[str] = ()) -> DataFrame:
    """rows (doc_id, text) with fp, and text and fp of the next row by doc_id; after the last comes the first.

    Rows are dealt to ranges of doc_id, four for each shuffle partition; each
    range also gets the first row of the range after it, so no task sees more.
    """
    spark = rows.sparkSession
    n = 4 * shuffle_partitions(spark)
    shares = [(i + 1) / n for i in range(n - 1)]
    bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, 10 * n)).head()[0] or []))
    placed = rows.withColumn("range", _bucket(F.col("doc_id"), bounds)).withColumn("order", F.xxhash64("text"))
    firsts = placed.groupBy("range").agg(F.min(F.struct("doc_id", "order")).alias("f")).orderBy("range").collect()
    # one row for each range (four for each shuffle partition): the first of the next range belongs to this one, too
    guests = [(a.range, b.f.doc_id, b.f.order) for a, b in zip(firsts, [*firsts[1:], *firsts[:1]], strict=True)]
    guests = spark.createDataFrame(guests, "to int, gid long, gorder long")
    copied = placed.join(F.broadcast(guests), placed["doc_id"].eqNullSafe(guests["gid"]) & (placed["order"] == guests["gorder"]))
    copied = copied.dropDuplicates(["to"]).select("doc_id", "text", F.col("to").alias("range"), "order", F.lit(1).alias("guest"))
    both = with_digest(placed.withColumn("guest", F.lit(0)).unionByName(copied), "text", "fp", bad)
    w = W.partitionBy("range").orderBy("guest", "doc_id", "order")
    out = both.select("doc_id", "text", "fp", "guest", F.lead("text").over(w).alias("next_text"), F.lead("fp").over(w).alias("next_fp"))
    return out.where("guest = 0").drop("guest")


def with_edited(docs: DataFrame, bad: list[str] = ()) -> DataFrame:
    """docs (doc_id, text): doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next."""
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    rows = with_next(docs, bad).withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half))})
    rows = with_digest(rows.drop("text", "next_text").withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_fp", bad).drop("edited")
    like = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", like("fp", "edited_fp").alias("near_edited"), like("fp", "next_fp").alias("near_next"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = materialize(with_edited(docs), "op10")
    with scratch_scope(spark):
        bad = collisions(rows.select("doc_id", "fp"), docs)
    rows = materialize(with_edited(docs, bad), "op10") if bad else rows
    return rows.withColumnsRenamed({"fp": "fingerprint", "edited_fp": "edited_fingerprint"})
