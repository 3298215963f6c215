"""URL rules behind a blocked Bloom filter.

A rule is a canonical ``host/path``; it fits its host and all subdomains when
the URL's path starts with the rule's. For every URL the possible rules are
each dot-suffix of the host with each path prefix of a length that some rule
has. A blocked Bloom filter (one 512-bit block of eight words for each key,
one bit in each word) lets possible hits pass to an exact hash join, which
removes false positives; the longest rule left decides. DataFrame functions
only; the filter reaches the scan as a scalar subquery of ``blocks * 8``
numbers, a size fixed by the parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, written

WORDS = 8
SENT = 100_000  # rules that may be broadcast


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (``A-Z`` lower-cased) and path; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    head = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(head), path


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(word + 1)), F.lit(64)).cast("int")


def bloom_words(keys: DataFrame, blocks: int) -> DataFrame:
    """One row ``words``: an array of ``blocks * 8`` 64-bit words, set for every ``key``."""
    key = F.col("key")
    bits = keys.select(_block(key, blocks).alias("b"), *[F.call_function("shiftleft", F.lit(1).cast("long"), _bit(key, w)).alias(f"w{w}") for w in range(WORDS)])
    made = bits.groupBy("b").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)])
    found = made.agg(F.map_from_entries(F.collect_list(F.struct("b", F.array(*[f"w{w}" for w in range(WORDS)])))).alias("m"))
    empty = F.array_repeat(F.lit(0).cast("long"), WORDS)
    return found.select(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.coalesce(F.try_element_at("m", i), empty))).alias("words"))


def apply_rules(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", bits_per_rule: int = 64, max_blocks: int = 4096, default: str = "allow") -> DataFrame:
    """Verdict of every page.

    ``rules`` has ``host``, ``path`` and ``verdict`` ("allow" or "block"), a
    rule repeated with two verdicts blocks. Returns ``<id_col>, host, path,
    rule, verdict``; a URL that no rule fits has a null rule and ``default``.
    A null or malformed URL has an empty host and path, which no rule fits.
    Repeated rows stay repeated, extra columns are ignored, empty pages or
    rules are no special case. The filter has at most ``max_blocks`` blocks of
    512 bits; a longer list only makes it pass more URLs to the exact join.
    """
    rules = rules.select(lower_ascii("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict")).where("r_host is not null and r_path is not null")
    rules = rules.groupBy("r_host", "r_path").agg(F.max("verdict").alias("r_verdict"))
    rules = rules.select(F.concat("r_host", "r_path").alias("key"), F.length("r_host").alias("h_len"), F.length("r_path").alias("p_len"), "r_verdict")
    facts = rules.agg(F.count(F.lit(1)).alias("n"), F.collect_set("p_len").alias("lens")).first()  # one row; lengths are few
    blocks = int(min(max_blocks, max(1, facts["n"] * bits_per_rule // 512 + 1)))
    lens = sorted(facts["lens"])
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if not lens:
        return urls.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(F.array(*[F.lit(n) for n in lens]), lambda n: F.struct(F.concat(s, F.substring(F.col("path"), F.lit(1), n)).alias("key"), F.length(s).alias("h_len"), n.alias("p_len")))))
    words = bloom_words(rules.select("key"), blocks).scalar()
    urls = urls.withColumn("keys", keys).withColumn("bloom", words)

    def passes(k: Column) -> Column:
        at = _block(k["key"], blocks) * WORDS
        test = F.lit(True)
        for w in range(WORDS):
            test = test & (F.call_function("shiftrightunsigned", F.get("bloom", at + w), _bit(k["key"], w)).bitwiseAND(F.lit(1)) == 1)
        return (F.length("path") >= k["p_len"]) & test

    # written, so that both reads see the same row numbers
    urls = written(urls.withColumn("keys", F.filter("keys", passes)).drop("bloom").withColumn("row", F.monotonically_increasing_id()))
    side = F.broadcast(rules) if facts["n"] <= SENT else rules
    hits = urls.select("row", F.inline("keys")).join(side, ["key", "h_len", "p_len"])
    best = hits.groupBy("row").agg(F.max_by(F.struct("key", "r_verdict"), F.struct(F.length("key"), F.col("h_len"))).alias("best"))
    return urls.join(best, "row", "left").select(id_col, "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))


#: host, path, verdict
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return apply_rules(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP2_SQL = r"""
with u as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (
  select page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r(rh, rp, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m as (
  select page_id, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(v, length(rh || rp)) as verdict
  from h join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id)
select h.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from h left join m using (page_id)
"""
