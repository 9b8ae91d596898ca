"""The best partner of each set by overlap, |A and B| / min(|A|, |B|): a prefix- and size-filtered join with verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources import io

#: Buckets of shares in each halving: kinds meet where one can still raise the other's best share, to within a bucket.
STEPS = 8
#: Bits of a digit of a passage's weight, and digits: sets of up to 2^33 elements.
DIGIT, PLACES = 11, 3
#: Passages of the kinds that stand in one block, 32 kB.
BLOCK = 4096
#: Orders by min-hash in which each kind is verified against the next.
ORDERS = 8
#: Whether Spark deletes the shuffle files of an action when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table of its own, without the shuffle files that it took: else they lie on disk beside those of the next
    steps until the driver's JVM collects what refers to them."""
    conf = df.sparkSession.conf
    was = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return io.stored(df)
    finally:
        conf.set(CLEANUP, was)


def best_overlap(sets: DataFrame) -> DataFrame:
    """(grp, id, size, best), a row an id, of rows (grp, id, elements: an array of distinct longs).

    * Equal sets are one class, which has 1 if it has several members. Elements of one class alone count for size only.
      Classes with the same shared elements are one kind: since c / min(a, b) is the greater of c / a and c / b, a kind
      needs two numbers, its greatest c and its greatest c / b, for all its classes whatever their sizes.
    * Elements that the same kinds have are one passage, whatever their number; passages are ordered from rare to frequent.
      Seeds: each kind is verified against the smallest kind of each of its passages; that settles partners that share one
      passage, and gives each kind a share that it is sure of. In a family of near copies that share is low, so each kind is
      verified against its neighbours in a few min-hash orders too.
    * Of two kinds, the first passage in common bounds what they share: what either has from there on. A passage is
      joined for a kind only where that bound beats what it or its partner is sure of, so that the prefix ends at the best
      share found. What a passage in all sets can give, the seeds have found: it is not joined with itself.
    """
    # every element moves once, with its set's id; the first of each set has its size with it. An empty set has one row, which counts nowhere
    rows = sets.select("grp", "id", F.coalesce(F.size("elements"), F.lit(0)).alias("size"), F.posexplode_outer("elements").alias("i", "h"))
    rows = rows.select("grp", F.coalesce("h", F.xxhash64("id")).alias("h"), "id", F.when(F.coalesce("i", F.lit(0)) == 0, F.col("size")).alias("size"))
    real = F.coalesce("size", F.lit(1)) > 0
    rows = rows.withColumn("df", F.count_if(real).over(W.partitionBy("h", "grp"))).where("df > 1 or size is not null")
    rows = rows.select("grp", "id", "size", F.when((F.col("df") > 1) & real, F.col("h")).alias("h"))
    # an id that comes several times has the elements of all its rows
    s = rows.groupBy("grp", "id").agg(F.sum("size").alias("all"), F.sort_array(F.collect_list("h")).alias("hs"))
    s = s.select("grp", "id", F.array_distinct("hs").alias("e"), "all", F.size("hs").alias("met"))
    s = s.select("grp", "id", (F.col("all") - F.col("met") + F.size("e")).cast("int").alias("size"), "e")
    # sets that others have all elements of are told by these; of any other there is one
    one = F.when(F.size("e") < F.col("size"), F.col("id"))
    s = stored(s.select("*", F.xxhash64("e", one).alias("fp"), F.xxhash64("e", one, F.lit(1)).alias("fq")))
    same = ["grp", "size", "fp", "fq"]
    classes = s.where("size > 0").groupBy(*same).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members"))
    reps = s.where("size > 0").join(classes.select("grp", F.col("rep").alias("id")), ["grp", "id"], "left_semi").select("grp", F.col("id").alias("rep"), "size", F.explode("e").alias("h"))
    # classes that share something, with their shared elements from rare to frequent
    shared = reps.withColumn("df", F.count(F.lit(1)).over(W.partitionBy("h", "grp"))).where("df > 1")
    shared = shared.groupBy("grp", "rep", "size").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("e")).select("grp", "rep", "size", F.col("e.h").alias("e"))
    shared = stored(shared.select("*", F.xxhash64("e").alias("ep"), F.xxhash64("e", F.lit(1)).alias("eq")))
    kind = ["grp", "ep", "eq"]
    kinds = shared.groupBy(*kind).agg(F.min(F.struct("size", "rep")).alias("least"), F.max("size").alias("most"), F.count(F.lit(1)).alias("n"))
    kinds = kinds.select(*kind, F.col("least.rep").alias("rep"), F.col("least.size").alias("least"), "most", "n")
    kinds = stored(shared.select("grp", "rep", "e").join(kinds, ["grp", "rep"]).select(*kind, F.col("rep").alias("kind"), "least", "most", "n", "e", F.size("e").alias("m")))
    # elements that the same kinds have count as one, a passage: ordered from rare to frequent, and how much is left from each on
    each = kinds.select("grp", "kind", "least", F.explode("e").alias("x"))
    where = each.groupBy("grp", "x").agg(F.count(F.lit(1)).alias("d"), F.bit_xor(F.xxhash64("kind")).alias("p"), F.bit_xor(F.xxhash64("kind", F.lit(1))).alias("q")).where("d > 1")
    passages = each.join(where.select("grp", "x", "d", F.xxhash64("p", "q").alias("h")), ["grp", "x"]).groupBy("grp", "kind", "least", "d", "h").agg(F.count(F.lit(1)).alias("w"))
    back = W.partitionBy("grp", "kind").orderBy(F.desc("d"), F.desc("h"))
    entries = stored(passages.select("grp", "kind", "least", "h", "w", F.sum("w").over(back.rowsBetween(W.unboundedPreceding, 0)).alias("left"), (F.row_number().over(back) > 1).alias("more")))
    # kinds with the same most frequent passage stand together, in blocks of some BLOCK passages
    weighed = entries.groupBy("grp", "kind", "least").agg(F.max(F.when(~F.col("more"), F.col("h"))).alias("top"), F.flatten(F.collect_list(packed(F.col("h"), F.col("w")))).alias("ps"))
    parts = F.ceil(F.sum(F.size("ps")).over(W.partitionBy("grp", "top")) / BLOCK)
    weighed = stored(weighed.select("grp", "kind", "least", F.xxhash64("top", F.pmod(F.xxhash64("kind"), parts)).alias("block"), "ps"))

    first = entries.groupBy("grp", "h").agg(F.min(F.struct("least", "kind")).alias("f"))
    seeds = entries.join(first, ["grp", "h"]).where("kind <> f.kind").select("grp", F.col("f.kind").alias("a"), F.col("kind").alias("b"))
    first_found = stored(verified(seeds.union(neighbours(weighed)).distinct(), weighed))
    e = entries.where("more").join(best_of(kinds, [first_found]).select("grp", "kind", "sure"), ["grp", "kind"])
    e = stored(e.select("grp", "h", "kind", "least", "left", "sure", (F.col("left") / F.col("least")).alias("most")))
    # the smaller kind (a) probes: for itself where its own bound beats its share, for a larger one where it beats the other's
    a, b = (e.select("grp", "h", *[F.col(c).alias(f"{c}_{x}") for c in ("kind", "least", "left", "sure", "most")]) for x in "ab")
    apart = (F.col("kind_a") != F.col("kind_b")) & (F.col("least_a") <= F.col("least_b"))
    bound = F.least("left_a", "left_b") / F.col("least_a")
    for_a = a.where("most_a > sure_a").join(b, ["grp", "h"]).where(apart & (bound > F.col("sure_a")))
    bucket = lambda x: F.floor(F.log2(x) * STEPS).cast("int")
    of_b = b.withColumn("k", bucket("sure_b"))
    wanted = of_b.groupBy("grp", "h").agg(F.collect_set("k").alias("ks"))
    of_a = a.join(wanted, ["grp", "h"]).withColumn("k", F.explode(F.filter("ks", lambda k: k <= bucket("most_a")))).drop("ks")
    for_b = of_a.join(of_b, ["grp", "h", "k"]).where(apart & (bound > F.col("sure_b")))
    pairs = for_a.select("grp", "kind_a", "kind_b").union(for_b.select("grp", "kind_a", "kind_b"))
    pairs = pairs.select("grp", F.least("kind_a", "kind_b").alias("a"), F.greatest("kind_a", "kind_b").alias("b")).distinct()
    found = [first_found, stored(verified(pairs, weighed))]

    best = best_of(kinds, found).select(*kind, "count", "share")
    of_class = shared.select("grp", "rep", *kind[1:], "size").join(best, kind).select("grp", "rep", F.greatest(F.col("count") / F.col("size"), "share").alias("b"))
    of_set = classes.join(of_class, ["grp", "rep"], "left").select(*same, F.when(F.col("members") > 1, 1.0).otherwise(F.coalesce("b", F.lit(0.0))).alias("best"))
    return s.select("id", *same).join(of_set, same, "left").select("grp", "id", "size", F.coalesce("best", F.lit(0.0)).alias("best"))


def neighbours(weighed: DataFrame) -> DataFrame:
    """(grp, a, b): each kind with the next one in ORDERS orders by three min-hashes of its passages, in which like kinds stand
    together. Which pairs these are is no matter to the result; a pair costs what any other does, and there are ORDERS a kind."""
    least = lambda r, j: F.array_min(F.transform("ps", lambda x: F.xxhash64(x, F.lit(3 * r + j))))
    orders = F.array(*[F.struct(F.lit(r).alias("r"), *[least(r, j).alias(f"m{j}") for j in range(3)]) for r in range(ORDERS)])
    after = F.lead("kind").over(W.partitionBy("grp", "r", "m0").orderBy("m1", "m2", "kind"))
    return weighed.select("grp", "kind", F.inline(orders)).select("grp", F.col("kind").alias("a"), after.alias("b")).where("b is not null")


def packed(h: Column, w: Column) -> Column:
    """A passage of ``w`` elements as longs: a digit of ``w`` to the base of 2048, its place, and 51 bits of the hash. Nearly
    every passage is one long; two kinds that have it have the same ones."""
    digits = [F.shiftrightunsigned(w, DIGIT * i).bitwiseAND((1 << DIGIT) - 1) for i in range(PLACES)]
    longs = [F.when(d > 0, F.shiftleft(h, DIGIT + 2).bitwiseOR(F.lit(i << DIGIT).cast("long")).bitwiseOR(d)) for i, d in enumerate(digits)]
    return F.array_compact(F.array(*longs))


def weight(passages: Column) -> Column:
    """How many elements packed passages have together."""
    digit = lambda x: x.bitwiseAND((1 << DIGIT) - 1)
    place = lambda x: F.shiftrightunsigned(x, DIGIT).bitwiseAND(3)
    one = lambda x: reduce(lambda out, i: out.when(place(x) == i, digit(x) * (1 << DIGIT * i)), range(1, PLACES), F.when(place(x) == 0, digit(x)))
    return F.aggregate(passages, F.lit(0).cast("long"), lambda sum_, x: sum_ + one(x))


def verified(pairs: DataFrame, weighed: DataFrame) -> DataFrame:
    """(grp, kind, c, share): both ends of each pair, with the elements in common and their share of the other's size.
    Passages with their weights, not elements, are compared, and a kind's move once to each block that it has partners in,
    not once a pair: of a family whose members all meet, pairs cost their ids alone."""
    blocks = weighed.groupBy("grp", "block").agg(F.collect_list(F.struct("kind", "least", "ps")).alias("members"))
    lists = pairs.join(weighed.select("grp", F.col("kind").alias("b"), "block"), ["grp", "b"]).groupBy("grp", "a", "block").agg(F.collect_list("b").alias("bs"))
    lists = lists.join(weighed.select("grp", F.col("kind").alias("a"), F.col("least").alias("n_a"), F.col("ps").alias("ps_a")), ["grp", "a"])
    both = lists.join(blocks, ["grp", "block"]).select("grp", "a", "n_a", "ps_a", F.explode(F.filter("members", lambda m: F.array_contains("bs", m["kind"]))).alias("b"))
    both = both.withColumn("c", weight(F.array_intersect("ps_a", "b.ps")))
    ends = F.array(F.struct(F.col("a").alias("kind"), (F.col("c") / F.col("b.least")).alias("share")), F.struct(F.col("b.kind").alias("kind"), (F.col("c") / F.col("n_a")).alias("share")))
    return both.select("grp", "c", F.inline(ends)).groupBy("grp", "kind").agg(F.max("c").alias("c"), F.max("share").alias("share"))


def best_of(kinds: DataFrame, found: list[DataFrame]) -> DataFrame:
    """Kinds with their greatest ``count`` in common, greatest ``share`` of a partner, and what their largest class has for
    ``sure``. Classes of one kind are partners of each other."""
    top = reduce(DataFrame.unionByName, found).groupBy("grp", "kind").agg(F.max("c").alias("c"), F.max("share").alias("s"))
    own: Column = F.when(F.col("n") > 1, F.col("m")).otherwise(0)
    out = kinds.drop("e").join(top, ["grp", "kind"], "left").withColumns({"count": F.greatest(F.coalesce("c", F.lit(0)), own), "share": F.greatest(F.coalesce("s", F.lit(0.0)), own / F.col("least"))})
    return out.withColumn("sure", F.greatest("share", F.col("count") / F.col("most")))
