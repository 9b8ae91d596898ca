"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy; thresholds by language."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, discard, ship, text_chunks, word_hashes, written

#: All labelled rows train. They lie in shards of about SHARD_ROWS rows and SHARD_BYTES of text (one shard, if they are few).
#: Each network goes over all shards at once, each shard from the weights that all had together before; the mean of what
#: they come to, of an embedding by how often each has moved it, is where the next pass begins. Thresholds come from the
#: scores of all rows, each by a network fitted to the other FOLDS - 1 parts; the network that is kept is fitted to all.
#: A text longer than TRAIN_WORDS words enters training as the windows of that many words, so that no part is left out.
SHARD_ROWS, SHARD_BYTES, FOLDS, TRAIN_WORDS = 8192, 32 << 20, 5, 512
#: Embeddings that are averaged in one piece; labelled ids that are broadcast at most, more are joined by a shuffle; scores
#: are counted by this part of their log odds.
BLOCK, BROADCAST_ROWS, ODDS = 1024, 1_000_000, 256
#: Recall's weight in a threshold's F-measure: a clean text lost counts more than a toxic one kept. Clean rows that may lie
#: above a threshold, as a share of all clean ones and one more. A language's threshold counts as many rows as it has toxic
#: ones, that of all languages PULL.
BETA, ALARMS, PULL = 0.5, 0.03, 20
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 8
#: Lengths in bytes of the word beginnings that have embeddings of their own.
PREFIXES = (4, 5, 6, 7, 8)
#: Few rows are gone through more often, until as many steps are made; many, EPOCHS times up to VISITS rows in all, and
#: PASSES times at least.
STEPS, VISITS, PASSES = 250, 36000, 2
#: The part of the first pass after which shards first meet: from there on all of them are near the same network.
START = 1 / 8
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 32, 0.02, 1e-5, 11
#: Bytes that belong to words here: ASCII letters and digits, and all bytes of other letters.
APART = np.ones(256, bool)
APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def buckets(hashes: np.ndarray) -> np.ndarray:
    """Embedding rows of each word, summed up: of the whole word and of its first bytes, so that unseen words of a
    known stem find something."""
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.uint16)


def documents_of(texts: pa.Array) -> list[np.ndarray]:
    out = []
    for _, data, offs in text_chunks(texts):
        h, first, _ = word_hashes(data, offs, APART, PREFIXES)
        out += [buckets(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def new_model(rng: np.random.Generator) -> dict:
    m = {"E": rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32), "b": np.zeros(1, np.float32), "w": rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)}
    for k in WIDTHS:
        m[f"W{k}"] = rng.normal(0, 0.4 / np.sqrt(k), (k * DIM, FILTERS)).astype(np.float32)
        m[f"c{k}"] = np.zeros(FILTERS, np.float32)
    return m


#: Adds up the embeddings of a word's rows where they lie side by side.
ADD = np.tile(np.eye(DIM, dtype=np.float32), (len(PREFIXES) + 1, 1))
#: Words that are multiplied out at once: of larger products BLAS makes threads, which cost more CPU than they save.
AT_ONCE = 512


def embedded(doc: np.ndarray, e: np.ndarray) -> np.ndarray:
    out = np.empty((len(doc), DIM), np.float32)
    for i in range(0, len(doc), AT_ONCE):
        some = doc[i : i + AT_ONCE]
        out[i : i + AT_ONCE] = e.take(some, 0).reshape(len(some), len(ADD)) @ ADD
    return out


def filters(m: dict) -> np.ndarray:
    """All filters' weights at all their offsets, a row each: widths in order, within a width offsets, then filters."""
    return np.concatenate([m[f"W{k}"][i * DIM : (i + 1) * DIM].T for k in WIDTHS for i in range(k)])


def responses(x: np.ndarray, wide: np.ndarray, m: dict) -> Iterator[np.ndarray]:
    """Of each width, what its filters give at the positions where they begin."""
    shares, r = np.empty((len(wide), len(x)), np.float32), 0
    for i in range(0, len(x), AT_ONCE):
        shares[:, i : i + AT_ONCE] = wide @ x[i : i + AT_ONCE].T
    for k in WIDTHS:
        z = m[f"c{k}"][:, None] + shares[r : r + FILTERS]
        for i in range(1, k):
            z[:, :-i] += shares[r + i * FILTERS : r + (i + 1) * FILTERS, i:]
        r += k * FILTERS
        yield z


def _pooled(x: np.ndarray, wide: np.ndarray, m: dict) -> tuple[np.ndarray, list]:
    """Max over positions of each filter, rectified; texts shorter than a filter are padded with zeros."""
    n, each = len(x), np.arange(FILTERS)
    y = x if n >= WIDTHS[-1] else np.concatenate([x, np.zeros((WIDTHS[-1] - n, DIM), np.float32)])
    outs, marks = [], []
    for k, z in zip(WIDTHS, responses(y, wide, m), strict=True):
        best = z[:, : max(n - k, 0) + 1].argmax(1)
        outs.append(np.maximum(z[each, best], 0))
        marks.append((y[best[:, None] + np.arange(k)].reshape(FILTERS, -1), best))
    return np.concatenate(outs), marks


def logit(doc: np.ndarray, m: dict) -> float:
    return float(_pooled(embedded(doc, m["E"]), filters(m), m)[0] @ m["w"] + m["b"][0])


def epochs_of(rows: int) -> int:
    """How often training goes over so many labelled rows."""
    return max(PASSES, min(EPOCHS, -(-VISITS // max(1, rows))), -(-STEPS // max(1, rows // BATCH)))


def train(m: dict, docs: list[np.ndarray], labels: np.ndarray, owner: np.ndarray, weight: np.ndarray, rng: np.random.Generator, done: float, epochs: int, total: int) -> np.ndarray:
    """Adam over windows, on ``m`` itself; a window of a toxic text counts once the text's windows are max-pooled (by its
    best window). ``done`` of ``total`` epochs lie behind. Returns how often each embedding was moved."""
    moved = np.zeros(BUCKETS)
    first = {k: np.zeros_like(v) for k, v in m.items()}
    second = {k: np.zeros_like(v) for k, v in m.items()}
    starts = np.searchsorted(owner, np.arange(len(labels) + 1))
    step, batches = 0, max(1, len(labels) // BATCH)
    for epoch in range(epochs):
        for batch in np.array_split(rng.permutation(len(labels)), batches):
            wide, seen = filters(m), []
            for i in batch:
                tried = ((*_pooled(embedded(docs[j], m["E"]), wide, m), docs[j]) for j in range(starts[i], starts[i + 1]))
                seen.append(next(tried) if starts[i + 1] - starts[i] == 1 else max(tried, key=lambda t: t[0] @ m["w"]))
            p = np.array([t[0] for t in seen])
            err = weight[labels[batch]] * (1 / (1 + np.exp(-np.clip(p @ m["w"] + m["b"][0], -30, 30))) - labels[batch]) / len(batch)
            dp = (err[:, None] * m["w"] * (p > 0)).astype(np.float32)
            g = {"w": err @ p, "b": err.sum(keepdims=True)}
            touched: list[np.ndarray] = []
            grads: list[np.ndarray] = []
            for n, k in enumerate(WIDTHS):
                d = dp[:, n * FILTERS : (n + 1) * FILTERS]
                g[f"c{k}"] = d.sum(0)
                g[f"W{k}"] = (np.array([t[1][n][0] for t in seen]) * d[:, :, None]).sum(0).T
                back = d[:, :, None, None] * m[f"W{k}"].T.reshape(FILTERS, k, DIM)
                at = np.array([t[1][n][1] for t in seen])[:, :, None] + np.arange(k)
                ok = (at < np.array([len(t[2]) for t in seen])[:, None, None]) & (d != 0)[:, :, None]
                touched += [t[2][x[y]].ravel() for t, x, y in zip(seen, at, ok, strict=True)]
                grads.append(np.repeat(back[ok], len(PREFIXES) + 1, 0))
            step += 1
            rows = np.concatenate(touched)
            order = np.argsort(rows, kind="stable")
            uniq, place = np.unique(rows[order], return_index=True)
            ge = np.add.reduceat(np.concatenate(grads)[order], place, 0) if len(rows) else np.zeros((0, DIM), np.float32)
            moved[uniq] += 1
            rate = RATE * (1 - (done + epoch) / total) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, v in g.items():
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                m[k] -= rate * (first[k] / (np.sqrt(second[k]) + 1e-8) + DECAY * m[k])
            first["E"][uniq] = 0.9 * first["E"][uniq] + 0.1 * ge
            second["E"][uniq] = 0.999 * second["E"][uniq] + 0.001 * ge * ge
            m["E"][uniq] -= rate * first["E"][uniq] / (np.sqrt(second["E"][uniq]) + 1e-8)
    return moved


def tables(m: dict) -> dict:
    """For scoring: the network with its filters side by side."""
    return m | {"wide": filters(m)}


def scores(texts: pa.Array, t: dict) -> np.ndarray:
    """Probabilities of whole texts; long ones need no more memory than their words' shares."""
    out = np.zeros(len(texts))
    for lo, data, offs in text_chunks(texts, 1 << 18):
        h, first, _ = word_hashes(data, offs, APART, PREFIXES)
        n, docs = np.diff(first), len(offs) - 1
        pooled = np.concatenate([np.tile(np.maximum(t[f"c{k}"], 0), (docs, 1)) for k in WIDTHS], 1)  # of texts without words
        full = np.flatnonzero(n >= WIDTHS[-1])
        if len(h) >= WIDTHS[-1] and len(full):
            x = embedded(buckets(h), t["E"])
            short = np.repeat(n < WIDTHS[-1], n)
            for j, (k, z) in enumerate(zip(WIDTHS, responses(x, t["wide"], t), strict=True)):
                for i in range(1, k):  # positions that reach beyond their text
                    z[:, first[1:][n >= i] - i] = -np.inf
                z[:, short] = -np.inf
                pooled[full, j * FILTERS : (j + 1) * FILTERS] = np.maximum(np.maximum.reduceat(z, first[:-1][full], 1).T, 0)
        for d in np.flatnonzero((n > 0) & (n < WIDTHS[-1])):
            pooled[d] = _pooled(embedded(buckets(h[first[d] : first[d + 1]]), t["E"]), t["wide"], t)[0]
        out[lo : lo + docs] = 1 / (1 + np.exp(-np.clip(pooled @ t["w"] + t["b"][0], -30, 30)))
    return out


def thresholds(p: np.ndarray, y: np.ndarray, langs: list[str | None], rows: np.ndarray | None = None) -> dict:
    """Thresholds by language (None: of all), from scores of rows that their network has not seen; ``rows`` says how many
    rows each score stands for.

    Of all rows, the score of the best F-measure, midway to the next one below; of a language, the mean of its own and that
    of all on the scale of log odds, weighed by toxic rows; either as high as the clean rows above it demand.
    """
    odds = lambda x: np.log(x / (1 - x))
    found: dict = {}
    rows = np.ones(len(p), np.int64) if rows is None else rows
    for lang in [None, *sorted({x for x in langs if x is not None})]:
        at = np.array([lang is None or x == lang for x in langs], bool)
        order = np.argsort(-p[at], kind="stable")
        s, v, c = np.clip(p[at][order], 1e-12, 1 - 1e-12), y[at][order], rows[at][order]
        between = (s + np.append(s[1:], 0)) / 2
        cut = found.get(None, 0.5)
        if n := (v * c).sum():
            hits = np.cumsum(v * c)
            f = (1 + BETA**2) * hits / (np.cumsum(c) + BETA**2 * n)
            own = between[int(np.argmax(np.where(np.append(s[:-1] != s[1:], True), f, -1)))]
            cut = own if lang is None else 1 / (1 + np.exp(-(n * odds(own) + PULL * odds(cut)) / (n + PULL)))
        clean, upto = s[v == 0], np.cumsum(c[v == 0])
        if len(clean):
            nth = min(upto[-1], max(1, int(ALARMS * (upto[-1] + 1))))  # the first that must stay below
            top = clean[int(np.searchsorted(upto, nth))]
            above = s[s > top]
            cut = max(cut, (top + (above[-1] if len(above) else 1)) / 2)
        found[lang] = float(cut)
    return found


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """(shard, doc_id, part, text, lang, toxic) of every labelled row whose crc32 of the id modulo 5 is not 0, in the shared
    folder, a shard's rows side by side, of several shards in the order of a hash; and the number of shards."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(crc_mod(F.col("doc_id"), 5) != 0)
    known = known.withColumnRenamed("doc_id", "_id")
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang")).join(known, F.col("doc_id") == F.col("_id")).drop("_id")
    rows, size = got.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(1, -(-rows // SHARD_ROWS), -(-size // SHARD_BYTES))
    dealt = got.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).repartition(shards, "shard")
    # one row an id, if its text repeats or differs: the least
    row = F.struct("text", "lang", "toxic")
    one = dealt.groupBy("shard", "doc_id").agg(F.min_by(row, row).alias("r")).select("shard", "doc_id", "r.*")
    part = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 5) % FOLDS
    order = ["shard", *[F.xxhash64("doc_id", F.lit(SEED))] * (shards > 1), "doc_id"]
    return written(one.withColumn("part", part.cast("int")).sortWithinPartitions(*order)), shards


#: What a shard's pass over the rows sends: a piece of a network, and how much each of its rows counts.
PIECE = "fold int, name string, block int, weight binary, data binary"


def learnt(sample: DataFrame, models: dict, weight: dict, stretch: tuple[float, float], done: float, epochs: int, total: int) -> dict:
    """The networks of all folds after so many further epochs over a stretch of every shard, each fold's without the rows of
    its part.

    A task has one fold and the shards of its files; embeddings of a shard and their weights travel in pieces of BLOCK rows,
    and are added up where they meet. The driver gets one network a fold.
    """
    shared = sample.sparkSession.sparkContext.broadcast(models)  # 2 MB each, FOLDS + 1 at most

    def learn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, fold, docs, labels = None, None, [], []
        for batch in it:
            at = np.flatnonzero(np.diff(np.array(batch.column("shard")), prepend=-1, append=-1))
            for a, b in zip(at[:-1], at[1:], strict=True):
                now = batch.slice(a, b - a)
                if now.column("shard")[0].as_py() != shard:
                    yield from passed(shard, fold, docs, labels)
                    shard, fold, docs, labels = now.column("shard")[0].as_py(), now.column("fold")[0].as_py(), [], []
                docs += documents_of(now.column("text"))
                labels += now.column("toxic").to_pylist()
        yield from passed(shard, fold, docs, labels)

    def passed(shard: int | None, fold: int | None, docs: list, labels: list) -> Iterator[pa.RecordBatch]:
        a, b = (int(len(docs) * x) for x in stretch)
        docs, labels = docs[a:b], labels[a:b]
        if not docs:
            return
        cuts = [(d[a : a + TRAIN_WORDS], i) for i, d in enumerate(docs) for a in range(0, max(1, len(d)), TRAIN_WORDS)]
        m = {k: v.copy() for k, v in shared.value[fold].items()}
        rng = np.random.default_rng([SEED, shard] if shard else SEED)
        new_model(rng)  # the first shard's orders are drawn after the network
        moved = train(m, [d for d, _ in cuts], np.array(labels), np.array([i for _, i in cuts]), np.array(weight[fold]), rng, done, epochs, total)
        out = [(k, 0, np.full(1, float(len(docs))), v.ravel()) for k, v in m.items() if k != "E"]
        out += [("E", a, moved[a : a + BLOCK], (m["E"] - shared.value[fold]["E"])[a : a + BLOCK].ravel()) for a in range(0, BUCKETS, BLOCK)]
        name, block, share, data = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([fold] * len(out), pa.int32()), pa.array(name), pa.array(block, pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in share], pa.binary()), pa.array([x.astype(np.float32).tobytes() for x in data], pa.binary())], names)

    def added(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in it:
            for *key, share, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = np.frombuffer(share, np.float32).astype(float)
                x = np.frombuffer(data, np.float32).reshape(len(w), -1) * w[:, None]
                has = sums.setdefault(tuple(key), [np.zeros_like(w), np.zeros_like(x)])
                has[0] += w
                has[1] += x
        for (fold, name, block), (w, x) in sums.items():
            mean = (x / np.maximum(w, 1e-9)[:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([name]), pa.array([block], pa.int32()), pa.array([b""], pa.binary()), pa.array([mean.tobytes()], pa.binary())], names)

    names = [c.split()[0] for c in PIECE.split(", ")]
    each = [sample.where(F.col("part") != f).select("shard", F.lit(f).alias("fold"), "text", "toxic") for f in models]
    sent = reduce(DataFrame.union, each).mapInArrow(learn, PIECE)
    out = {f: {k: v.copy() for k, v in m.items()} for f, m in models.items()}
    for r in sent.repartition("fold", "name", "block").mapInArrow(added, PIECE).toLocalIterator():  # a partition at a time
        x, m = np.frombuffer(r["data"], np.float32), out[r["fold"]]
        if r["name"] == "E":
            m["E"][r["block"] : r["block"] + BLOCK] += x.reshape(-1, DIM)
        else:
            m[r["name"]] = x.reshape(m[r["name"]].shape).copy()
    shared.destroy()  # else the driver keeps the networks of every pass until it happens to collect its garbage
    return out


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict, dict]:
    """(weights, thresholds by language) from all labelled rows whose crc32 of the id modulo 5 is not 0.

    FOLDS + 1 networks are trained: each of the first without its part, whose rows it then scores; the last on all. The
    driver gets the weights (2 MB each) and, of each language, how many rows have which log odds.
    """
    sample, shards = labelled(docs, labels)
    parts = {r["part"]: (r["n"], r["t"]) for r in sample.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).collect()}
    models, weight = {}, {}
    for f in range(FOLDS + 1):
        n, t = (sum(x[i] for k, x in parts.items() if k != f) for i in (0, 1))
        if t and (f == FOLDS or f in parts):
            models[f], weight[f] = new_model(np.random.default_rng(SEED)), [n * 0.5 / max(1, n - t), n * 0.5 / t]
    if FOLDS not in models:
        m = new_model(np.random.default_rng(SEED))
        m["w"][:], m["b"][:] = 0, -5
        discard(sample)
        return m, {None: 0.5}
    total = epochs_of(sum(n for n, _ in parts.values()))
    # a single shard has no others to meet: it goes through all its epochs at once
    passes = [(0, 1)] if shards == 1 else [(0, START), (START, 1), *[(0, 1)] * (total - 1)]
    done = 0
    for a, b in passes:
        models = learnt(sample, models, weight, (a, b), done, total if shards == 1 else 1, total)
        done += b - a
    final = models.pop(FOLDS)
    if not models:  # all toxic rows are in one part
        discard(sample)
        return final, {None: 0.5}
    shared = sample.sparkSession.sparkContext.broadcast(models)

    def aside(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = {f: tables(m) for f, m in shared.value.items()}
        for batch in it:
            part = np.array(batch.column("part"))
            for f in np.unique(part):
                if f in t:
                    rows = batch.filter(pa.array(part == f))
                    p = np.clip(scores(rows.column("text"), t[f]), 1e-12, 1 - 1e-12)
                    odds = np.round(np.log(p / (1 - p)) * ODDS).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([rows.column("lang"), rows.column("toxic"), pa.array(odds)], ["lang", "toxic", "odds"])

    held = sample.select("part", "text", "lang", "toxic").mapInArrow(aside, "lang string, toxic int, odds int").groupBy("lang", "toxic", "odds").count().collect()
    shared.destroy()
    held.sort()
    discard(sample)
    p = 1 / (1 + np.exp(-np.array([r["odds"] for r in held]) / ODDS))
    return final, thresholds(p, np.array([r["toxic"] for r in held]), [r["lang"] or None for r in held], np.array([r["count"] for r in held]))


def score_documents(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(columns of ``keep``, held_out, score, predicted, rejected) of every row.

    ``predicted`` marks scores of 0.5 or more; ``rejected`` compares the score with its language's threshold, or with that
    of all languages where its own has none. Null texts count as empty and get the score of no words; without labelled
    toxic rows nothing is rejected. The score depends on the text alone.
    """
    ship(docs.sparkSession)
    keep = keep or ["doc_id"]
    m, cut = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(m)  # size fixed by BUCKETS, DIM, WIDTHS and FILTERS: 2 MB
    types = dict(docs.dtypes)
    cols = list(dict.fromkeys([*keep, "text", "lang"]))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables(shared.value)
        for batch in it:
            p = scores(batch.column(cols.index("text")), t)
            yield pa.RecordBatch.from_arrays([*[batch.column(cols.index(c)) for c in carried], pa.array(p, pa.float64())], [*carried, "score"])

    carried = [c for c in cols if c in keep or c == "lang"]
    out = docs.select(*cols).mapInArrow(batches, ", ".join(f"`{c}` {types[c]}" for c in carried) + ", score double")
    limit = F.lit(cut.get(None, 0.5))
    for lang, v in cut.items():
        if lang is not None:
            limit = F.when(F.col("lang") == lang, F.lit(v)).otherwise(limit)
    flags = {"held_out": crc_mod(F.col("doc_id"), 5) == 0, "predicted": (F.col("score") >= 0.5).cast("int"), "rejected": F.col("score") >= limit}
    return out.select(*keep, "score", *[v.alias(k) for k, v in flags.items()])
