"""N-gram Jaccard join by signature trees: nodes hold OR-combined token bitmaps and size ranges.

Documents with equal shingle sets are one class. Classes meet in the trees of their min-hash bands (BANDS bands of ROWS
min-hashes: two sets of similarity 0.75 miss each other in all of them with chance (1 - 0.75**3)**40 = 3e-10). A tree's
first level is a star: every member against one pivot, which joins a family of near copies in as many pairs as it has
members. Where components remain apart, its second level is made of two nodes: the largest component and all members
outside of it. Members of the largest go on only if the bitmap and the size range of the node outside leave them a chance,
and never meet each other. A dual traversal of the tree, whose bitmaps are as wide as its sets need, compares node pairs,
drops those whose greatest possible overlap cannot reach the threshold or that lie in one component already, and so comes
down to pairs of classes, which are verified on whole shingle sets within the tree: what leaves it are links between
components, fewer than it has members. Components follow from the links found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mix, row_key, ship, text_chunks, word_hashes, written

SHINGLE, BANDS, ROWS = 5, 40, 3
#: Similarity threshold as a fraction.
NUM, DEN = 75, 100
#: Bits of the bitmaps of the upper two levels, in 64-bit words; members of a leaf block of a large tree, and their
#: shingles; children of a node; bits for each shingle of a mean set in the bitmaps below.
WORDS, BLOCK, BLOCK_SHINGLES, FAN, SPREAD = 8, 1024, 1 << 19, 8, 4
#: Trees are walked in turn, by their keys modulo BANDS; what one round joins, the next need not compare.
ROUNDS = [(0, 1), (2, 9), (10, BANDS - 1)]
#: Ids up to this many (about 50 MB as a hash table) are broadcast, and rows of that many keys; more are joined by shuffle.
BROADCAST_ROWS, BROADCAST_KEYS = 1_000_000, 200_000
BITMAP = [f"b{i}" for i in range(WORDS)]
_rng = np.random.default_rng(75)
_PLACE = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)
_ODD = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_JOIN = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; of fewer than five words, one for all of them."""
    for _, data, offs in text_chunks(texts):
        h, first, _ = word_hashes(data, offs)
        n = len(h)
        five = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
        for i in range(SHINGLE):
            five += h[i : n - SHINGLE + 1 + i] * _PLACE[i] if n >= SHINGLE else np.zeros(0, np.uint64)
        five = mix(five)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= SHINGLE:
                yield np.unique(five[a : b - SHINGLE + 1])
            elif b > a:
                yield mix(np.array([(h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def fingerprint(s: np.ndarray) -> int:
    """One number for a set, as a signed long."""
    two = np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64)], np.uint64)
    return int(mix(mix(two[:1]) + two[1:]).view(np.int64)[0])


def bands(s: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        low = np.minimum(low, ((s[i : i + 1024, None] ^ _SALT) * _ODD).min(0))
    low = mix(low).reshape(BANDS, ROWS)
    return mix((low * _JOIN).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def bitmap(s: np.ndarray, words: int = WORDS) -> np.ndarray:
    out = np.zeros(words * 64, bool)
    out[(s >> np.uint64(20)) % np.uint64(words * 64)] = True
    return np.packbits(out, bitorder="little").view(np.int64)


def bitmaps(sets: np.ndarray) -> np.ndarray:
    """A row of bits for each set, SPREAD bits for each shingle of the mean set: as much memory as the sets take, a 16th."""
    mean = sum(map(len, sets)) / len(sets)
    words = max(WORDS, 1 << int(np.ceil(np.log2(max(1, SPREAD * mean / 64)))))
    return np.stack([bitmap(s, words) for s in sets])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n, fp, bands, b0...): one row a document; without shingles fp and bands are null."""
    ship(docs.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n, fps, keys, maps = [], [], [], []
            for s in shingle_sets(batch.column(2)):
                n.append(len(s))
                fps.append(fingerprint(s) if len(s) else None)
                keys.append(bands(s) if len(s) else None)
                maps.append(bitmap(s))
            m = np.array(maps, np.int64).reshape(len(n), WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64())), *[pa.array(m[:, i]) for i in range(WORDS)]], ["doc_id", "row", "n", "fp", "bands", *BITMAP])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", row_key().alias("row"), "text").mapInArrow(batches, f"doc_id {kind}, row long, n long, fp long, bands array<long>, " + ", ".join(f"{b} long" for b in BITMAP))


def whole_sets(docs: DataFrame, picks: DataFrame) -> DataFrame:
    """(fp, set) of the documents whose row key is in ``picks`` (pick), one row a class."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sets = list(shingle_sets(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["fp", "set"])

    small = F.broadcast(picks) if picks.count() <= BROADCAST_ROWS else picks
    picked = docs.select("text", row_key().alias("pick")).join(small, "pick", "left_semi")
    return picked.select("text").mapInArrow(batches, "fp long, set array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold."""
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("fp").alias("b"), F.col("set").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(F.lit(DEN) * shared >= F.lit(NUM) * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(fp, comp) of every class in ``links`` (a, b): the least fp reachable. Alternating large and small stars; the
    neighbours of a hub meet in an aggregate and a join, never in one array."""
    edges = last = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small)
        discard(last)
        last = edges
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("fp"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("fp"), F.col("v").alias("comp"))).groupBy("fp").agg(F.min("comp").alias("comp"))


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (fp, comp) after further links (a, b) of classes, stored; itself where there are none.

    The links are taken between components, whose id is their least fp: what is walked again is as large as the new links,
    not as all that were found before.
    """
    if links.isEmpty():
        return comps
    of = lambda x: comps.select(F.col("fp").alias(x), F.col("comp").alias(f"c{x}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    over = written(components(between))
    ends = links.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(comps, "fp", "left_anti").withColumn("comp", F.col("fp"))
    out = written(comps.unionByName(ends).join(over.select(F.col("fp").alias("comp"), F.col("comp").alias("least")), "comp", "left").select("fp", F.coalesce("least", "comp").alias("comp")))
    discard(over)
    return out


def _pop(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64)).sum(-1).astype(np.int64)


def _possible(n_a, n_b, least, held_a, held_b, shared) -> np.ndarray:
    """Whether an overlap can reach the threshold: no set has more elements in common than it has outside the bits that
    the other side lacks. Sizes are upper bounds, ``least`` bounds the sum of sizes below, ``held`` own bits below."""
    top = np.minimum(n_a - np.maximum(held_a - shared, 0), n_b - np.maximum(held_b - shared, 0))
    return (NUM + DEN) * top >= NUM * least


def traverse(n: np.ndarray, bits: np.ndarray, comp: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs (indices) of one tree: members sorted by size, FAN children a node, walked in pairs from the root.

    ``side``: 0 and 1 for members of two blocks of a large tree (pairs run across), or all 0 (pairs within).
    """
    order = np.lexsort((comp, n, side))
    n, bits, comp, side = n[order], bits[order], comp[order], side[order]
    held = _pop(bits)
    levels = [(np.arange(len(n)), np.arange(1, len(n) + 1), n, n, bits, held, comp, comp)]
    while len(levels[-1][0]) > FAN:
        lo, hi, small, large, ored, least, c0, c1 = levels[-1]
        at = np.arange(0, len(lo), FAN)
        levels.append((lo[at], hi[np.minimum(at + FAN, len(lo)) - 1], np.minimum.reduceat(small, at), np.maximum.reduceat(large, at), np.bitwise_or.reduceat(ored, at, 0), np.minimum.reduceat(least, at), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)))
    top = len(levels[-1][0])
    a, b = (x.ravel() for x in np.triu_indices(top))
    across = bool(side.any())
    for depth in range(len(levels) - 1, -1, -1):
        lo, hi, small, large, ored, least, c0, c1 = levels[depth]
        step = 1 << 15
        kept = []
        for i in range(0, len(a), step):
            x, y = a[i : i + step], b[i : i + step]
            ok = _possible(large[x], large[y], small[x] + small[y], least[x], least[y], _pop(ored[x] & ored[y]))
            ok &= ~((c0[x] == c1[x]) & (c0[x] == c0[y]) & (c0[y] == c1[y]))
            if across:
                ok &= (side[lo[x]] == 0) & (side[hi[y] - 1] == 1)
            if depth == 0:
                ok &= x != y
            kept.append(np.stack([x[ok], y[ok]]))
        a, b = np.concatenate(kept, 1) if kept else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if depth == 0:
            yield order[a], order[b]
            return
        below = len(levels[depth - 1][0])
        ca = (a[:, None] * FAN + np.arange(FAN))[:, :, None] + np.zeros((1, 1, FAN), np.int64)
        cb = (b[:, None] * FAN + np.arange(FAN))[:, None, :] + np.zeros((1, FAN, 1), np.int64)
        ca, cb = ca.ravel(), cb.ravel()
        ok = (ca < below) & (cb < below) & (ca <= cb)
        a, b = ca[ok], cb[ok]


def _shared(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with others."""
    flat = np.concatenate(many)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    return np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum([0, *map(len, many[:-1])]))


def tree_links(fp: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, sets: np.ndarray) -> list[tuple[int, int]]:
    """Links (a, b) of one tree that join components: at most one fewer than it has members.

    The pairs that the traversal leaves are verified on whole sets, member by member, those just linked first; a pair
    whose ends have come together meanwhile needs no look. No pair is left out otherwise.
    """
    found = list(traverse(n, bitmaps(sets), comp, side))
    a, b = found[0] if found else (np.zeros(0, np.int64),) * 2
    if not len(a):
        return []
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(src, kind="stable")
    dst, edge = dst[order], np.searchsorted(src[order], np.arange(len(n) + 1))
    label, done, links = np.unique(comp, return_inverse=True)[1], np.zeros(len(n), bool), []
    for seed in np.argsort(-np.diff(edge), kind="stable"):
        stack = [seed]
        while stack:
            u = stack.pop()
            if done[u]:
                continue
            done[u] = True
            near = dst[edge[u] : edge[u + 1]]
            near = near[~done[near] & (label[near] != label[u])]
            if not len(near):
                continue
            both = _shared(sets[u], list(sets[near]))
            for v in near[DEN * both >= NUM * (n[u] + n[near] - both)]:
                if label[v] != label[u]:
                    label[label == label[v]] = label[u]
                    links.append((min(fp[u], fp[v]), max(fp[u], fp[v])))
                stack.append(v)
    return links


def forest_links(members: DataFrame) -> DataFrame:
    """Links (a, b) of all trees. ``members``: key, i, j, side, fp, n, comp, set; the rows of a (key, i, j) are
    one block or two, each of BLOCK members and BLOCK_SHINGLES shingles (4 MB) on average, and come together in one task,
    one after another."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def done(t: dict, upto: int) -> Iterator[pa.RecordBatch]:
            g = np.flatnonzero(np.any(t["g"][1:upto] != t["g"][: upto - 1], 1)) + 1
            out = []
            for lo, hi in zip(np.append(0, g), np.append(g, upto), strict=True):
                # of two blocks one may be empty: nobody there can be reached
                if hi - lo > 1 and (t["g"][lo, 1] == t["g"][lo, 2] or len(np.unique(t["side"][lo:hi])) == 2):
                    out += tree_links(*(t[k][lo:hi] for k in ("fp", "n", "comp", "side", "set")))
            if out:
                u = np.unique(np.array(out, np.int64), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1])], ["a", "b"])

        for batch in it:
            c = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
            flat, offs = c["set"].values.to_numpy().view(np.uint64), c["set"].offsets.to_numpy()
            sets = np.empty(len(batch), object)
            sets[:] = [flat[x:y] for x, y in zip(offs[:-1], offs[1:], strict=True)]
            c = {k: v.to_numpy() for k, v in c.items() if k != "set"}
            t = {"g": np.stack([c["key"], c["i"], c["j"]], 1), "n": c["n"], "comp": c["comp"], "fp": c["fp"], "side": c["side"], "set": sets}
            if rest is not None:
                t = {k: np.concatenate([rest[k], t[k]]) for k in t}
            same = np.flatnonzero(np.any(t["g"] != t["g"][-1], 1))
            upto = same[-1] + 1 if len(same) else 0
            rest = {k: v[upto:] for k, v in t.items()}
            if upto:
                yield from done(t, upto)
        if rest is not None:
            yield from done(rest, len(rest["n"]))

    cols = ["key", "i", "j", "side", "fp", "n", "comp", "set"]
    sorted_ = members.select(*cols).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return sorted_.mapInArrow(batches, "a long, b long").distinct()


def few(df: DataFrame) -> DataFrame:
    """A stored table of keys, to be broadcast where its rows are counted and few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def dealt(placed: DataFrame, known: DataFrame) -> tuple[DataFrame | None, list[DataFrame]]:
    """(key, i, j, side, fp, n, comp) of the members of trees that hold several components, in pairs of blocks (i, j), and
    the tables that this reads. None where each tree is one component.

    ``placed``: key, fp, n, comp; ``known``: fp and bitmaps. Members outside the largest component of their tree meet all
    others; those of the largest meet only them, so that m members of which k stand apart make about m rows for each
    BLOCK of the k, and those that the node of the k cannot reach make none.
    """
    parts = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    trees = parts.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("c", "comp", "s")).alias("main"), F.sum("c").alias("c"), F.sum("s").alias("s")).where("k > 1")
    count = lambda c, s: F.ceil(F.greatest(c / F.lit(BLOCK), s / F.lit(BLOCK_SHINGLES))).cast("long")
    trees = written(trees.select("key", F.col("main.comp").alias("largest"), count(F.col("main.c"), F.col("main.s")).alias("inner"), count(F.col("c") - F.col("main.c"), F.col("s") - F.col("main.s")).alias("outer")))
    if trees.isEmpty():
        return None, [trees]
    there = written(placed.join(few(trees), "key").join(known.select("fp", *BITMAP), "fp"))
    apart, main = there.where("comp <> largest"), there.where("comp = largest")
    node = written(apart.groupBy("key").agg(F.min("n").alias("_least"), F.max("n").alias("_most"), *[F.bit_or(b).alias(f"_{b}") for b in BITMAP]))
    outside = sum((F.bit_count(F.col(b).bitwiseAND(F.bitwise_not(F.col(f"_{b}")))) for b in BITMAP), F.lit(0))
    main = main.join(few(node), "key").where(F.lit(NUM + DEN) * F.least(F.col("n") - outside, F.col("_most")) >= F.lit(NUM) * (F.col("n") + F.col("_least")))
    # blocks 0 to outer - 1 are of members apart, the rest of the largest component
    zero, spread = F.lit(0).cast("long"), F.xxhash64("fp")
    cols = ["key", "fp", "n", "comp", "_block", "_other"]
    apart = apart.withColumn("_block", F.pmod(spread, F.col("outer"))).withColumn("_other", F.explode(F.sequence(zero, F.col("outer") + F.col("inner") - 1))).select(cols)
    main = main.withColumn("_block", F.col("outer") + F.pmod(spread, F.col("inner"))).withColumn("_other", F.explode(F.sequence(zero, F.col("outer") - 1))).select(cols)
    rows = apart.unionByName(main).withColumns({"i": F.least("_block", "_other"), "j": F.greatest("_block", "_other"), "side": F.when(F.col("_block") > F.col("_other"), 1).otherwise(0)})
    return rows.drop("_block", "_other"), [trees, there, node]


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signatures of all rows, (fp, rep, comp) of every class): its smallest id, which may be null, and its component."""
    sig = written(signatures(docs))
    rows = sig.where("fp is not null")
    # band members: equal sets collapse before anything meets; lone members of a band leave here
    entries = rows.select("fp", "n", F.explode("bands").alias("key")).distinct()
    shared = written(entries.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("fp").alias("pivot")).where("c > 1").drop("c"))
    classes = rows.groupBy("fp").agg(F.max("n").alias("n"), F.min("doc_id").alias("rep"), F.min("row").alias("pick"), *[F.max(b).alias(b) for b in BITMAP])
    members = written(entries.join(few(shared), "key"))
    wanted = members.select("fp").distinct()
    known = written(classes.join(wanted, "fp", "left_semi"))
    sets = written(whole_sets(docs, known.select("pick")).join(wanted, "fp", "left_semi").dropDuplicates(["fp"]))
    bits = ["n", *BITMAP]
    side = lambda p: known.select(F.col("fp").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in bits])
    star = members.where("fp <> pivot").select(F.col("pivot").alias("a"), F.col("fp").alias("b")).distinct()
    star = star.join(side("a"), "a").join(side("b"), "b")
    common = sum((F.bit_count(F.col(f"a_{b}").bitwiseAND(F.col(f"b_{b}"))) for b in BITMAP), F.lit(0))
    own = lambda p: sum((F.bit_count(F.col(f"{p}_{b}")) for b in BITMAP), F.lit(0))
    top = F.least(F.col("a_n") - (own("a") - common), F.col("b_n") - (own("b") - common))
    star = written(star.where(F.lit(NUM + DEN) * top >= F.lit(NUM) * (F.col("a_n") + F.col("b_n"))).select("a", "b"))
    links = written(verified(star, sets))
    comps = written(components(links))
    for first, last in ROUNDS:
        placed = members.where(F.pmod("key", F.lit(BANDS)).between(first, last)).join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp")).drop("pivot")
        placed = written(placed)
        rows, used = dealt(placed, known)
        if rows is not None:
            more = written(forest_links(rows.join(sets, "fp")))
            again = merged(comps, more)
            discard(more, *[comps] * (again is not comps))
            comps = again
        discard(placed, *used)
    discard(links, members, known, sets, star, shared)
    return sig, classes.select("fp", "rep").join(comps, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: similarity self-join on distinct five-word shingles.

    Null and blank texts have no shingles and are their own component. Rows of one id stand each for their own text.
    A null id counts for no component's smallest id (a component of null ids alone has a null), but its text links
    like any other. Extra columns are ignored; an empty table gives no rows.
    """
    sig, label = linked(docs)
    least = label.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_class = label.join(least, "comp").select("fp", "component_id")
    real = sig.where("fp is not null").select("doc_id", "n", "fp").join(of_class, "fp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return real.unionByName(sig.where("fp is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: of its smallest id (a row without id only where none has one), the row of
    least key where several are left.

    Rows without shingles all stay.
    """
    sig, label = linked(docs)
    rows = sig.where("fp is not null").join(label.select("fp", "comp"), "fp")
    best = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))).alias("best"))
    kept = written(best.select(F.col("best.row").alias("_evs_row")))
    small = F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept
    blank = F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n\u000b\f\r", "     ")) == ""
    real = docs.where(~blank).withColumn("_evs_row", row_key()).join(small, "_evs_row", "left_semi")
    twice = written(real.groupBy("_evs_row").agg(F.count(F.lit(1)).alias("_evs_c")).where("_evs_c > 1").select("_evs_row"))
    if not twice.isEmpty():
        one = real.join(twice, "_evs_row", "left_semi").dropDuplicates(["_evs_row"])
        real = real.join(twice, "_evs_row", "left_anti").unionByName(one)
    return real.select(*docs.columns).unionByName(docs.where(blank))
