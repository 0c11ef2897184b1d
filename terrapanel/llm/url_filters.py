"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

All steps are DataFrame functions. The Bloom filter is a table of blocks of 256
bits (four longs); its number of blocks follows the counted list. Rows whose
bits are all set are possible hits; only these go into a join on the canonical
URL itself, which removes the false positives. Blocks and listed URLs that many
pages share are met by a broadcast (lookup), so no task gets a hot one whole.

Defined cases: a null URL, or one without "://", has empty host and path, no
canonical form and no rule, and is allowed. Repeated rows stay. An empty list
lists nothing, an empty table gives no rows. Long URLs are compared whole. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, materialize

#: (host, path, verdict): a rule fits its host and subdomains where the path starts with the rule's; the longest fits first.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Bits per listed URL and bits set by each, of the filter's 256-bit blocks.
BITS_PER_URL, PROBES = 16, 6
#: The query's list: canonical URLs of hosts with one of these labels, and those whose MD5 begins with LISTED_DIGIT (one in 16).
LISTED_LABELS = ("cheap-pills", "free-bets", "casino-win", "hot-singles")
LISTED_DIGIT = "0"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_of(url: Column) -> Column:
    """Host without www. or m., path without a trailing slash, query without tracking parameters; null without a host."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: ~x.rlike("^(utm_[a-z]+|ref)=") & (x != "")))
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    out = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(host != "", out)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as a string, and its verdict; both null without one."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _bits(key: str) -> list[Column]:
    """Four longs with the bits that a key sets in its block."""
    h = F.xxhash64(F.lit("bits"), F.col(key))
    at = [F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(255)) for i in range(PROBES)]
    words = []
    for w in range(4):
        word = F.lit(0).cast("long")
        for a in at:
            bit = F.expr("shiftleft(1L, 0)")
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), a.bitwiseAND(F.lit(63)).cast("int"))
            word = word.bitwiseOR(F.when(F.shiftright(a, 6) == w, bit).otherwise(F.lit(0).cast("long")))
        words.append(word)
    return words


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter over column canonical: a row (block, w0..w3) for each block with bits."""
    keyed = listed.select(F.pmod(F.xxhash64("canonical"), F.lit(blocks)).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits("canonical"))])
    return keyed.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def url_filter(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """pages (page_id, url) judged by rules and by listed (url): page_id, host, path, rule, verdict, canonical, listed."""
    u = F.col("url")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host_of(u).alias("host"), path_of(u).alias("path"), canonical_of(u).alias("canonical"))
    rows = rows.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    urls = materialize(listed.select(canonical_of(u).alias("canonical")).where("canonical is not null").distinct(), "listed")
    blocks = max(1, -(-urls.count() * BITS_PER_URL // 256))
    key = F.when(F.col("canonical").isNotNull(), F.pmod(F.xxhash64("canonical"), F.lit(blocks)))
    probe = lookup(rows.withColumn("block", key), bloom_blocks(urls, blocks), "block").withColumns({f"b{i}": b for i, b in enumerate(_bits("canonical"))})
    hit = F.col("canonical").isNotNull()
    for i in range(4):
        hit = hit & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(F.col(f"b{i}")) == F.col(f"b{i}"))
    probe = probe.withColumn("possible", hit).select("page_id", "host", "path", "rule", "by_rule", "canonical", "possible")
    found = lookup(probe.where("possible"), urls.withColumn("listed", F.lit(True)), "canonical").unionByName(probe.where("not possible").withColumn("listed", F.lit(False)))
    listed_ = F.coalesce("listed", F.lit(False))
    return found.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(listed_, "block").otherwise("allow")).alias("verdict"), "canonical", listed_.alias("listed"), "possible")


def listed_urls(pages: DataFrame) -> DataFrame:
    """The query's list, taken from the pages' own URLs, so that variants of one URL, hits and others all occur."""
    labels = "|".join(LISTED_LABELS)
    u = F.col("url")
    return pages.where(host_of(u).rlike(rf"(^|\.)({labels})\.") | F.md5(canonical_of(u)).startswith(LISTED_DIGIT)).select("url")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         list_sort(list_filter(string_split(coalesce(regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's'), ''), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)='))) AS query
  FROM pages
), forms AS (
  SELECT page_id, host, path, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS canonical
  FROM parts
), listed AS (
  SELECT DISTINCT canonical FROM forms WHERE canonical IS NOT NULL AND (regexp_matches(host, '(^|\.)(cheap-pills|free-bets|casino-win|hot-singles)\.') OR starts_with(md5(canonical), '0'))
), rules AS (
  SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(h, p, v)
), fits AS (
  SELECT page_id, host, path, canonical, (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1) AS rule
  FROM forms
)
SELECT page_id, host, path, rule,
       coalesce((SELECT v FROM rules WHERE h || p = rule), CASE WHEN f.canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM fits f
"""
