"""Order MinHash: minimal occurrence-numbered k-mers, kept in text order, hashed as tuples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import let, words, written

#: Words of a k-mer; sketches of a fingerprint (one bin of the hash space each, a power of two). Tuples have two k-mers.
K, SKETCHES = 2, 64
#: A packed k-mer: 33 bits of its hash, then the place of its first word (a text of 2 GB, Spark's most, has under 2**30).
POS = 30
_LOW, _SKETCH_SHIFT = (1 << POS) - 1, 63 - 6
#: Cuts of the id range, and rows of a bin in a large table and in a small one (of at most SMALL bins).
CUTS, BIN, FEW, SMALL = 255, 16384, 2048, 4096
#: Rows up to this many (about 50 MB as a hash table) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _shr(x: Column, n: int) -> Column:
    return F.call_function("shiftright", x, F.lit(n))


def _packed(h: Column, pos: Column) -> Column:
    """A non-negative long with the high 63 - POS bits of the hash, then the position."""
    return h.bitwiseAND(F.lit(((1 << 63) - 1) ^ _LOW)).bitwiseOR(pos.cast("long"))


def _kmers(w: Column, k: int) -> Column:
    """Packed k-mers of a word array; a text of fewer words is one k-mer, one without words has none."""
    n = F.size(w)
    every = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: _packed(F.xxhash64(*[F.get(w, i + (j - 1)) for j in range(k)]), i))
    return F.when(n >= k, every).when(n > 0, F.array(_packed(F.xxhash64(w), F.lit(1)))).otherwise(F.array().cast("array<bigint>"))


def _numbered(s: Column) -> Column:
    """From sorted packed k-mers: hashes of (k-mer, occurrence number), packed with the same positions. Equal k-mers stand
    together, so the places where runs start give all numbers in one sweep."""
    opens = lambda i: (i == 0) | (_shr(F.get(s, i - 1), POS) != _shr(F.get(s, i), POS))
    starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), opens)

    def numbers(starts: Column) -> Column:
        runs = F.transform(starts, lambda at, j: F.sequence(F.lit(0), F.coalesce(F.get(starts, j + 1), F.size(s)) - at - 1))
        return F.flatten(runs)

    hashed = lambda x, n: _packed(F.xxhash64(_shr(x, POS), n), x.bitwiseAND(F.lit(_LOW)))
    first = F.transform(s, lambda x: hashed(x, F.lit(0)))
    return let(starts, lambda at: F.when(F.size(at) == F.size(s), first).otherwise(F.zip_with(s, numbers(at), hashed)))


def _tuples(g: Column) -> Column:
    """From sorted numbered k-mers: (bin, tuple hash) of each bin that has any: its least k-mer and the one after it (of a
    later bin, or the first of all, where the bin has no second), in text order."""

    def bin_of(x: Column) -> Column:
        return _shr(x, _SKETCH_SHIFT).cast("int")

    def pair(x: Column, i: Column) -> Column:
        y = F.coalesce(F.get(g, i + 1), F.get(g, F.lit(0)))
        hx, hy = _shr(x, POS), _shr(y, POS)
        ahead = x.bitwiseAND(F.lit(_LOW)) <= y.bitwiseAND(F.lit(_LOW))
        both = F.when(ahead, F.xxhash64(hx, hy)).otherwise(F.xxhash64(hy, hx))
        return F.struct(bin_of(x).alias("b"), F.pmod(both, F.lit(65536)).cast("int").alias("t"))

    opens = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: (i == 0) | (bin_of(F.get(g, i - 1)) != bin_of(F.get(g, i))))
    return F.transform(opens, lambda i: pair(F.get(g, i), i))


def fingerprint(text: Column, k: int = K) -> Column:
    """SKETCHES integers (0 to 65535; -1 where a sketch has no k-mer) of a text; equal texts have equal ones."""

    def fill(t: Column) -> Column:
        return let(F.map_from_entries(t), lambda m: F.transform(F.sequence(F.lit(0), F.lit(SKETCHES - 1)), lambda j: F.coalesce(F.element_at(m, j), F.lit(-1))))

    numbered = lambda s: let(F.sort_array(_numbered(s)), lambda g: fill(_tuples(g)))
    none = F.array_repeat(F.lit(-1), SKETCHES)
    return let(words(text), lambda w: let(F.sort_array(_kmers(w, k)), lambda s: F.when(F.size(s) > 0, numbered(s)).otherwise(none)))


def as_text(fp: Column) -> Column:
    """A fingerprint as one string of four characters a sketch."""
    return F.array_join(F.transform(fp, lambda x: F.when(x < 0, F.lit("----")).otherwise(F.lpad(F.lower(F.hex(x)), 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of sketches that agree among those that either text fills; 1 for two texts without words."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: ((x == y) & (x >= 0)).cast("int")), F.lit(0), lambda s, x: s + x)
    used = F.aggregate(F.zip_with(a, b, lambda x, y: ((x >= 0) | (y >= 0)).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(used == 0, F.lit(1.0)).otherwise(same / used)


def _search(key: Column, cuts: list[int], lo: int = 0, hi: int | None = None) -> Column:
    """How many of the sorted ``cuts`` are at most ``key``: a balanced tree of comparisons."""
    hi = len(cuts) if hi is None else hi
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(key < F.lit(cuts[mid]), _search(key, cuts, lo, mid)).otherwise(_search(key, cuts, mid + 1, hi))


def _bins(ids: DataFrame) -> tuple[Column, Column]:
    """(range, bin within it) of a row (doc_id, _h), both rising in the order of (doc_id, _h), null ids first.

    Ranges lie between at most CUTS quantiles of the ids; one is cut into bins of equal width, as many as the table's
    size asks for. A range of a single id (one that many rows share), and the rows without id, are cut by hash instead.
    """
    rows, low, high, cuts = ids.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [i / (CUTS + 1) for i in range(1, CUTS + 1)], 10_000)).first()
    bins = max(-(-rows // BIN), min(SMALL, -(-rows // FEW)))
    each = -(-bins // (CUTS + 1))
    cuts = cuts or []
    shared = {c for c, d in zip(cuts, cuts[1:], strict=False) if c == d}
    edges = sorted({*cuts, *(c + 1 for c in shared)}) if bins > 1 else []
    at = _search(F.col("doc_id"), edges)
    by_hash = F.col("_h").cast("double") / float(1 << 64) + 0.5
    starts, ends = [low, *edges], [*edges, (high or 0) + 1]
    pick = lambda xs: F.element_at(F.array(*[F.lit(float(x or 0)) for x in xs]), at + 1)
    share = (F.col("doc_id").cast("double") - pick(starts)) / F.greatest(pick(ends) - pick(starts), F.lit(1.0))
    alone = F.col("doc_id").isin([int(c) for c in shared]) if shared else F.lit(False)
    within = F.floor(F.when(alone, by_hash * bins).otherwise(share * each))
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(at), F.when(F.col("doc_id").isNull(), F.floor(by_hash * bins)).otherwise(within).cast("long")


def with_next(docs: DataFrame, k: int) -> DataFrame:
    """``docs`` (doc_id, text) with the fingerprint ``fp`` and with ``next``, a struct of text and fp of the row that
    follows in the order of (doc_id, hash of the text), null ids first (after the last: the first).

    Rows meet only in bins of that order; the first row of each bin goes, as a guest, to the end of the bin before as well.
    """
    hashed = docs.withColumn("_h", F.xxhash64("text"))
    span, within = _bins(hashed.select("doc_id", "_h"))
    least = F.min(F.struct("doc_id", "_h"))
    firsts = written(hashed.groupBy(span.alias("_i"), within.alias("_j")).agg(least.alias("f")))
    # the bin before: within a range by a window, at its start by the last bins of the ranges, CUTS + 2 or so
    ends = {r["_i"]: r["last"] for r in firsts.groupBy("_i").agg(F.max("_j").alias("last")).collect()}
    order = sorted(ends)
    first_of = {i: order[k - 1] for k, i in enumerate(order)}
    over = W.partitionBy("_i").orderBy("_j")
    case = lambda f: F.coalesce(*[F.when(F.col("_i") == i, F.lit(f(i))) for i in order], F.lit(None)) if order else F.lit(None)
    back = F.lag("_j").over(over)
    guests = firsts.select("f", F.when(back.isNull(), case(lambda i: first_of[i])).otherwise(F.col("_i")).cast("int").alias("_i"), F.coalesce(back, case(lambda i: ends[first_of[i]]).cast("long")).alias("_j"))
    guests = guests.select(F.col("f.doc_id").alias("_fd"), F.col("f._h").alias("_fh"), "_i", "_j")
    guests = F.broadcast(guests) if firsts.count() <= BROADCAST_ROWS else guests
    # rows alike in id and text may all be the first: one stands for them
    come = hashed.join(guests, F.col("doc_id").eqNullSafe(F.col("_fd")) & (F.col("_h") == F.col("_fh"))).drop("_fd", "_fh").dropDuplicates(["_i", "_j"])
    homes = hashed.withColumns({"_i": span.cast("int"), "_j": within, "_guest": F.lit(False)})
    both = homes.unionByName(come.withColumn("_guest", F.lit(True))).withColumn("fp", fingerprint(F.col("text"), k))
    lead = F.lead(F.struct("text", "fp")).over(W.partitionBy("_i", "_j").orderBy("_guest", F.col("doc_id").asc_nulls_first(), "_h", "text"))
    return both.withColumn("next", lead).where("not _guest").drop("_i", "_j", "_guest", "_h")


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text replaces the last half of the code points by as many of the next text's first. Null texts count as
    empty; null ids come first; rows of one id, or of none, stand in order of a hash of their text; extra columns are
    ignored; an empty table gives none. A text of one k-mer has it as its only tuple, twice; one without words has none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    paired = with_next(docs.select("doc_id", text.alias("text")), k)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next")["text"], F.lit(1), half))
    out = paired.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", F.col("next")["fp"].alias("next_fp"))
    out = out.withColumn("efp", fingerprint(F.col("edited"), k))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
