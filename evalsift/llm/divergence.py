"""Source divergence audit: how far the word use of each source lies from that of the others and of its whole language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import ship, written

#: Documents of a language that a term must occur in, the count added to each, and the whole that shares are told in.
LEAST_DOCS, ADDED, WHOLE = 30, 5, 1_000_000_000
#: Ranks of terms that a group reports.
TERMS = 50
#: Copies of a text above which it is counted before texts move, and how many texts can be above that in any corpus.
HOT, HOT_TEXTS = 1000, 1 << 18
#: Terms and sums of pairs that a task holds before it passes them on.
HELD_TERMS, HELD_PAIRS = 1 << 19, 1 << 20
#: A task holds documents and occurrences of a term as one number: documents times DOC, plus occurrences.
DOC = 1 << 48
#: Terms are runs of ASCII letters, lower-cased, and all other characters from U+0080 on, whose bytes are all above 0x7F.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split(b" ")


def collapsed(docs: DataFrame) -> DataFrame:
    """(lang, text, source, copies): equal texts are one row for each source that has them; rows of the same text of a
    language stand one after another in one partition.

    Texts move once. Those of more rows than HOT, and than one in HOT_TEXTS of all (so at most HOT_TEXTS texts), are
    counted by source before that, so that no partition gets a row for each of their copies.
    """
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    each = docs.select(blank("lang"), blank("text"), blank("source")).withColumn("h", F.xxhash64("lang", "text"))
    often = max(HOT, docs.count() // HOT_TEXTS)
    hot = F.broadcast(written(each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > often).select("h")))
    before = each.join(hot, "h", "left_semi").groupBy("lang", "text", "source").agg(F.count(F.lit(1)).alias("copies"))
    rest = each.join(hot, "h", "left_anti").select("lang", "text", "source", F.lit(1).cast("long").alias("copies"))
    met = rest.unionByName(before).repartition("lang", "text").groupBy("lang", "text", "source").agg(F.sum("copies").alias("copies"))
    return met.sortWithinPartitions("lang", F.xxhash64("text"), "text")


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group and documents that hold it, in parts that tasks
    have summed up, dealt by language and term.

    Each distinct text of a language is cut into terms once; its counts enter each of its sources by the number of copies.
    """
    ship(docs.sparkSession)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size, last, found = 0, None, {}

        def told() -> pa.RecordBatch:
            rows = [(*group, term, v & (DOC - 1), v // DOC) for group, counts in held.items() for term, v in counts.items()]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary()).cast(pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], NAMES)

        for batch in it:
            for lang, text, source, copies in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (lang, text) != last:
                    last, found = (lang, text), Counter(terms_of(text))
                    del found[b""]
                counts = held.setdefault((lang, source), {})
                size -= len(counts)
                get = counts.get
                for term, n in found.items():
                    counts[term] = get(term, 0) + (n + DOC) * copies
                size += len(counts)
                if size > HELD_TERMS:
                    yield told()
                    held, size = {}, 0
        yield told()

    return collapsed(docs).mapInArrow(count, "lang string, source string, term string, n long, docs long").repartition("lang", "term")


NAMES = ["lang", "source", "term", "n", "docs"]


def share(n: str, of: str, terms: str) -> Column:
    """1 + floor(WHOLE * (n + ADDED) / (of + ADDED * terms)), exact for any counts."""
    return 1 + F.expr(f"(cast({WHOLE} as decimal(10,0)) * cast({n} + {ADDED} as decimal(20,0))) div cast({of} + {ADDED} * {terms} as decimal(20,0))")


def pair_sums(postings: DataFrame) -> DataFrame:
    """(lang, a, b, extra), a < b: over the terms that both groups have, what |p - q| differs from the sum of what either
    would have against a group without the term, less what two such groups would have.

    A term's groups stand in one row (at most one entry a source); sums of pairs are added up within a task.
    """

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def summed() -> int:
            for lang, parts in held.items():
                key, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, place, np.concatenate([v for _, v in parts]))
                held[lang] = [(key, total)]
            return sum(len(parts[0][0]) for parts in held.values())

        def told() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                for key, value in parts:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key >> 32), pa.array(key & 0xFFFFFFFF), pa.array(value)], ["lang", "a", "b", "extra"])
            held.clear()

        for batch in it:
            langs = np.array(batch.column(0).to_pylist(), object)
            lists = batch.column(1)
            offs, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
            at, p, z = (flat.field(i).to_numpy().astype(np.int64) for i in range(3))
            for lang in dict.fromkeys(langs.tolist()):
                for part in expanded(np.flatnonzero(langs == lang), offs - offs[0], at, p, z):
                    held.setdefault(lang, []).append(part)
                    size += len(part[0])
                    if size > HELD_PAIRS:
                        size = summed()
                        if size > HELD_PAIRS // 2:
                            yield from told()
                            size = 0
        summed()
        yield from told()

    return postings.mapInArrow(add, "lang string, a long, b long, extra long").groupBy("lang", "a", "b").agg(F.sum("extra").alias("extra"))


def expanded(rows: np.ndarray, offs: np.ndarray, at: np.ndarray, p: np.ndarray, z: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a * 2**32 + b, what the term adds to that pair): pairs of the groups in which a term of ``rows`` occurs, in blocks."""
    for first in range(0, len(rows), 1024):
        block = rows[first : first + 1024]
        sizes = offs[block + 1] - offs[block]
        for step in range(1, int(sizes.max(initial=0))):  # entry i with entry i + step of the same term
            n = np.maximum(sizes - step, 0)
            i = np.arange(n.sum()) + np.repeat(offs[block] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            j = i + step
            key, value = (at[i] << 32) | at[j], np.abs(p[i] - p[j]) - np.abs(p[i] - z[j]) - np.abs(p[j] - z[i]) + np.abs(z[i] - z[j])
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            yield key[new], np.add.reduceat(value, new)


def one_sided(histogram: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, own): the sum over the terms of group a of |p - z| for the share z that b gives a term it lacks.

    ``histogram`` (lang, a, p, terms) has a row for each distinct share of a group, far fewer than terms.
    """
    others = groups.select(F.col("lang"), F.col("at").alias("b"), F.col("zero").alias("z"))
    wanted = groups.select("lang", F.col("at").alias("a")).join(others, "lang").where("a <> b")

    def sums(key, have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        have = have.sort_values("p")
        p, n = have["p"].to_numpy(np.int64), have["terms"].to_numpy(np.int64)
        z = want["z"].to_numpy(np.int64)
        upto_n, upto_p = (np.concatenate([np.zeros(1, np.int64), np.cumsum(x)]) for x in (n, n * p))
        k = np.searchsorted(p, z)
        own = (z * upto_n[k] - upto_p[k]) + (upto_p[-1] - upto_p[k] - z * (upto_n[-1] - upto_n[k]))
        return pd.DataFrame({"lang": want["lang"], "a": want["a"], "b": want["b"], "own": own})

    return histogram.groupBy("lang", "a").cogroup(wanted.groupBy("lang", "a")).applyInPandas(sums, "lang string, a long, b long, own long")


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) over all rows of ``docs``.

    Null text, lang and source count as ''. Part ``pair``: a group's distance to each other source of its language; part
    ``term``: the terms that a group uses more than its language does, to rank TERMS. A language without kept terms has
    pairs of distance 0. Whole numbers throughout.
    """
    each = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_lang = W.partitionBy("lang", "term")  # a row a source; both sums stand on the one exchange by language and term
    each = each.withColumns({"all_n": F.sum("n").over(of_lang), "docs": F.sum("docs").over(of_lang)})
    kept = written(each.where(F.col("docs") >= LEAST_DOCS).drop("docs"))
    langs = kept.select("lang", "term", "all_n").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count(F.lit(1)).alias("group_v"))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    every = docs.select(blank("lang"), blank("source")).distinct()
    groups = every.join(langs, "lang", "left").join(own, ["lang", "source"], "left").select("lang", "source", zero("v"), zero("lang_n"), zero("group_n"), zero("group_v"))
    at = (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("at")
    groups = written(groups.withColumn("none", F.lit(0)).select("*", at, F.when(F.col("v") > 0, share("none", "group_n", "v")).otherwise(0).alias("zero")))
    shares = written(kept.join(groups, ["lang", "source"]).select("lang", "source", "term", F.col("at"), F.col("zero"), share("n", "group_n", "v").alias("p"), share("all_n", "lang_n", "v").alias("q")))

    postings = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("at", "p", "zero"))).alias("groups")).where(F.size("groups") > 1).select("lang", "groups")
    both = pair_sums(postings)
    both = both.select("lang", F.inline(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b"), "extra"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "extra"))))
    single = one_sided(shares.groupBy("lang", F.col("at").alias("a"), "p").agg(F.count(F.lit(1)).alias("terms")), groups)
    single = single.groupBy("lang", F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y")).agg(F.sum("own").alias("own")).select("lang", F.inline(F.array(F.struct(F.col("_x").alias("a"), F.col("_y").alias("b"), "own"), F.struct(F.col("_y").alias("a"), F.col("_x").alias("b"), "own"))))
    one, other = groups.withColumnRenamed("at", "a"), groups.select("lang", F.col("source").alias("item"), F.col("at").alias("b"), F.col("zero").alias("_zero"), F.col("group_v").alias("_v"))
    pairs = one.join(other, "lang").where("a <> b").join(single, ["lang", "a", "b"], "left").join(both, ["lang", "a", "b"], "left")
    neither = (F.col("v") - F.col("group_v") - F.col("_v")) * F.abs(F.col("zero") - F.col("_zero"))
    value = neither + F.coalesce("own", F.lit(0)) + F.coalesce("extra", F.lit(0))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= TERMS))
