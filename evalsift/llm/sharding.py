"""K-d tree partitioning: split at distributed weighted medians along the widest metadata dimension."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import prefix_before, written

#: Bits of a tie value below each coordinate, and bins of one pass of a median search (two passes are made).
TIE, BINS = 28, 4096
#: Places of an axis.
SCALE = 1 << 16
#: A group of equal texts above this share of a shard may be split; smaller ones stay in one shard.
SPLIT_SHARE = 1 / 8
ROWS_PER_BUCKET = 512


def _axis(narrow: DataFrame, c: str) -> DataFrame:
    """(category, place): categories in order of their rows' mean size, each in the middle of its share of all bytes, in
    [0, SCALE): neighbours hold alike documents, and a large category takes a wide part of the axis. One row a category."""
    name = f"_{c}"
    cats = narrow.groupBy(F.col(c).alias(name)).agg(F.sum("size").alias("_w"), F.avg("size").alias("_m"))
    order = W.orderBy("_m", F.col(name).asc_nulls_first())
    run = F.sum("_w").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return cats.select(name, F.floor((run - F.col("_w") / 2) / F.sum("_w").over(W.partitionBy()) * (SCALE - 1)).cast("long").alias(f"_place_{c}"))


def points(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, weight, d0, d1, d2, _tie): a point for each row.

    Dimensions: source and language (least of a group of equal texts) by share of bytes, and the logarithm of the size
    between the table's least and greatest; all three run over [0, SCALE). Each coordinate ends in TIE bits that order
    the points of one place: a hash of the text, so that equal texts share all coordinates; for groups too large to stay
    whole (at most ``shards / SPLIT_SHARE`` exist), a hash of the id.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", "lang", "source", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    narrow = written(narrow)
    groups = narrow.groupBy("h", "text_crc32").agg(F.min("lang").alias("glang"), F.min("source").alias("gsource"), F.sum("size").alias("gsize"), F.count(F.lit(1)).alias("gcount"))
    total, least, most = narrow.agg(F.sum("size"), F.min("size"), F.max("size")).first()
    large = math.ceil((total or 0) / shards * SPLIT_SHARE)
    shared = groups.where("gcount > 1").select(F.col("h").alias("gh"), F.col("text_crc32").alias("gcrc"), "glang", "gsource", "gsize")
    joined = narrow.join(shared, (F.col("h") == F.col("gh")) & (F.col("text_crc32") == F.col("gcrc")), "left")
    joined = joined.withColumns({"lang": F.when(F.col("gh").isNotNull(), F.col("glang")).otherwise(F.col("lang")), "source": F.when(F.col("gh").isNotNull(), F.col("gsource")).otherwise(F.col("source"))})
    for c in ("source", "lang"):
        joined = joined.join(_axis(narrow, c), F.col(c).eqNullSafe(F.col(f"_{c}")), "left")
    tie = F.when(F.coalesce(F.col("gsize"), F.lit(0)) > large, F.xxhash64("doc_id", F.lit(3))).otherwise(F.xxhash64("h", F.lit(5)))
    tie = F.pmod(tie, F.lit(1 << TIE))
    low, span = math.log2(least or 8), max(1e-9, math.log2(most or 8) - math.log2(least or 8))
    place = {"d0": F.col("_place_source"), "d1": F.col("_place_lang"), "d2": ((F.log2("size") - low) / span * (SCALE - 1)).cast("long")}
    return joined.select("doc_id", "size", "text_crc32", tie.alias("_tie"), *[(v * F.lit(1 << TIE) + tie).alias(k) for k, v in place.items()])


def _bin(value: Column, lo: Column, hi: Column) -> Column:
    """Which of BINS equal bins of [lo, hi] holds the value."""
    return F.least(F.floor((value - lo) / F.greatest((hi - lo + 1) / F.lit(BINS), F.lit(1.0))), F.lit(BINS - 1)).cast("long")


def kd_tree(pts: DataFrame, leaves: int, dims: list[str], weight: str) -> list[dict]:
    """The tree's inner nodes, breadth first: node, dim, cut, leaves on the low side and in all.

    A node with k leaves is cut where its low side holds floor(k/2)/k of its weight: the bin with that quantile among
    BINS, then the quantile among BINS within it. Only bin sums leave the executors' map side; what returns to the
    driver is BINS rows a node at most, of ``leaves / 2`` nodes at most.
    """
    frontier, tree = [{"node": 1, "leaves": leaves}], []
    at = F.lit(1).cast("long")
    while frontier := [n for n in frontier if n["leaves"] > 1]:
        here = pts.withColumn("_n", at).where(F.col("_n").isin([n["node"] for n in frontier]))
        spans = {r["_n"]: r for r in here.groupBy("_n").agg(*[f(d).alias(f"{p}{d}") for d in dims for p, f in (("lo_", F.min), ("hi_", F.max))], F.sum(weight).alias("w")).collect()}
        cuts = []
        for n in frontier:
            s = spans.get(n["node"])
            if s is not None:
                n["dim"] = max(dims, key=lambda d: (s[f"hi_{d}"] - s[f"lo_{d}"], d))
                n["low"] = n["leaves"] // 2
                n["lo"], n["hi"], n["below"], n["goal"] = s[f"lo_{n['dim']}"], s[f"hi_{n['dim']}"], 0, float(s["w"]) * n["low"] / n["leaves"]
                cuts.append(n)
        for _ in range(2):
            if not cuts:
                break
            pick = lambda field: F.coalesce(*[F.when(F.col("_n") == n["node"], F.col(n["dim"]) if field == "dim" else F.lit(n[field])) for n in cuts])  # noqa: E731, B023
            hist = here.select("_n", F.col(weight), pick("dim").alias("_x"), pick("lo").alias("lo"), pick("hi").alias("hi")).where("_x between lo and hi")
            hist = hist.groupBy("_n", _bin(F.col("_x"), F.col("lo"), F.col("hi")).alias("bin")).agg(F.sum(weight).alias("w"), F.min("_x").alias("least"), F.max("_x").alias("most"))
            for n in cuts:
                n["rest"] = n["goal"] - n["below"]
            bins: dict[int, list] = {}
            for r in sorted(hist.collect(), key=lambda r: r["bin"]):
                bins.setdefault(r["_n"], []).append(r)
            for n in cuts:
                run = 0
                for s in bins.get(n["node"], []):
                    if run + s["w"] >= n["rest"]:
                        n["last"], n["lo"], n["hi"] = s, s["least"], s["most"]
                        n["below"] += run
                        break
                    run += s["w"]
        nxt = []
        for n in cuts:
            s = n["last"]
            # the last bin goes to the side that leaves the lesser error
            n["cut"] = s["most"] if n["below"] + s["w"] - n["goal"] <= n["goal"] - n["below"] else s["least"] - 1
            tree.append({k: n[k] for k in ("node", "dim", "cut", "low", "leaves")})
            at = F.when(at == n["node"], F.when(F.col(n["dim"]) <= n["cut"], n["node"] * 2).otherwise(n["node"] * 2 + 1)).otherwise(at)
            nxt += [{"node": n["node"] * 2, "leaves": n["low"]}, {"node": n["node"] * 2 + 1, "leaves": n["leaves"] - n["low"]}]
        at = leaf_of(tree, numbered=False)
        frontier = nxt
    return tree


def leaf_of(tree: list[dict], numbered: bool = True) -> Column:
    """The node a point falls into, or its leaf number from 0, left to right."""
    inner = {n["node"]: n for n in tree}

    def walk(node: int, first: int) -> Column:
        n = inner.get(node)
        if n is None:
            return F.lit(first if numbered else node).cast("long")
        return F.when(F.col(n["dim"]) <= F.lit(n["cut"]), walk(node * 2, first)).otherwise(walk(node * 2 + 1, first + n["low"]))

    return walk(1, 0)


def shards(docs: DataFrame, count: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, in shards of near equal bytes.

    Equal texts share a shard unless their group exceeds SPLIT_SHARE of one. ``slot`` numbers each shard's rows from 0
    by (hash of id, checksum and size, id); rows alike in all columns take any of their slots. Null texts have size 8; null ids,
    sources and languages are values like others; extra columns are ignored; an empty table gives no rows.
    """
    pts = written(points(docs, count))
    tree = kd_tree(pts, count, ["d0", "d1", "d2"], "size")
    rows = pts.count()
    step = max(1, (1 << 32) // max(1, math.ceil(rows / count / ROWS_PER_BUCKET)))
    placed = pts.select("doc_id", "size", "text_crc32", leaf_of(tree).cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(1 << 32)).alias("_o"))
    order = [F.col("_o"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    out = prefix_before(placed, ["shard"], order, F.floor(F.col("_o") / F.lit(step)), F.lit(1).cast("long"), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
