"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: The filter's size is fixed by these two, whatever the list holds: at most MAX_BLOCKS rows of one 64-bit word each
#: (8 MB of words) may be broadcast. A longer list only lets more rows through to the exact join.
MAX_BLOCKS = 1 << 20
BITS = 5
#: Rules of the report, (host, path, verdict): fixed values.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://`` or for a null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One form for the many spellings of an address: no scheme, no ``www.`` or ``m.``, no query, fragment, ``.html`` or end slash."""
    host, path = host_path(url)
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), r"/+$", ""))


def _bits(key: Column) -> Column:
    """The BITS bits of a key in its block's word."""
    h = F.xxhash64(key, F.lit(7))
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", h, F.lit(6 * i)).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as a table (block, word): one row per block that has bits."""
    return keys.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), _bits(F.col(key)).alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("word"))


def listed(pages: DataFrame, listing: DataFrame, key: str = "canonical") -> DataFrame:
    """``pages`` with ``listed``: whether their ``key`` is in ``listing``. Null and empty keys are never listed.

    ``listing`` may repeat keys. The filter's blocks grow with the list (about 16 bits a key) up to MAX_BLOCKS. Pages
    that the filter rules out never reach the join; of the rest, the hash join on the whole key removes the false hits.
    Both kinds are read apart (two narrow scans): in one join the pages ruled out would be shuffled with the others.
    """
    keys = listing.select(F.col(key)).where(F.col(key).isNotNull() & (F.col(key) != "")).distinct()
    blocks = 64
    many = keys.count()
    while blocks * 4 < many and blocks < MAX_BLOCKS:
        blocks *= 2
    table = bloom(keys, key, blocks)
    probe = pages.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks))).withColumn("_bits", _bits(F.col(key)))
    probe = probe.join(F.broadcast(table), F.col("_block") == F.col("block"), "left")
    maybe = F.coalesce(F.col("word").bitwiseAND(F.col("_bits")) == F.col("_bits"), F.lit(False)) & F.coalesce(F.col(key) != "", F.lit(False))
    probe = probe.withColumn("_maybe", maybe).drop("block", "word", "_block", "_bits")
    exact = keys.select(F.col(key).alias("_key"), F.lit(True).alias("_hit"))
    hits = probe.where("_maybe").join(exact, F.col(key) == F.col("_key"), "left").withColumn("listed", F.coalesce("_hit", F.lit(False))).drop("_key", "_hit", "_maybe")
    return probe.where(~F.col("_maybe")).withColumn("listed", F.lit(False)).drop("_maybe").unionByName(hits)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host plus path, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return rule, verdict


def filter_urls(pages: DataFrame, listing: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, canonical, listed) of every page.

    ``listing`` has a column ``canonical``. A rule decides where one fits; elsewhere a listed page is blocked and any
    other is allowed. Null or odd urls have an empty host and path and are allowed; repeated pages come back repeated.
    """
    host, path = host_path(F.col("url"))
    narrow = pages.select("page_id", host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("canonical"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = listed(narrow, listing)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "canonical", "listed")
