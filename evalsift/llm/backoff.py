"""LM scoring: a weighted backoff automaton over words.

States are the words of the training texts (and the end token, which also stands before a text's first word), and a root.
State v has an arc to w for each pair v w of the training texts, of weight (c(v w) + PRIOR * p(w)) / (c(v) + PRIOR), and a
failure arc to the root of weight PRIOR / (c(v) + PRIOR); the root's arcs weigh p(w), the smoothed frequency. A text is
walked once, left to right: the state is the token before, each step adds the logarithms of the arcs that it takes.

No task holds the automaton. A step's weight needs the counts of its pair and its word, and a token's own count as the
state it leads to, so the steps of a word meet: the walk takes the arcs between hot words from a broadcast table of bounded
size, and sends each other step to the bucket of its word (of a hot word: of the pair), where the arcs that the training
texts hold are counted and every step gets its weight. Steps travel in blocks, as arrays; their sums return by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, mix, ship, text_chunks, word_hashes, written

#: Words with 1/HOT of the training tokens or more are hot: HOT words at most. Arcs between them with this share of the
#: tokens or more are broadcast, at most 1/SHARE of them (16 MB).
HOT, SHARE = 4096, 1e-6
#: Mass of the failure arc in counts, the same for every state.
PRIOR = 100.0
#: Tokens of a block, which one task walks at a time; its rows at most; tokens that meet in a bucket on average.
BLOCK, ROWS, BUCKET = 1 << 21, 1 << 16, 1 << 21
#: Distinct keys that one task gathers before it passes them on.
GATHER = 1 << 20
END = np.uint64(0x656E6420746F6B65)
#: Bytes of a word before, as a step carries it: 40 bits beside the 64 of its word.
LEAST = 5
FIELDS = "bucket int, kind int, block long, a binary, b binary, c binary, d binary, e binary, ids array<{}>"
TRAIN, HELD, TEXTS = 0, 1, 2


NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def _record(bucket: int, kind: int, block: int, parts: list, ids: pa.Array) -> pa.RecordBatch:
    """One row: up to five arrays as bytes, and the ids of a block's texts (else none of their type)."""
    raw = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts]
    raw += [pa.nulls(1, pa.binary())] * (5 - len(raw))
    head = [pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([block], pa.int64())]
    return pa.RecordBatch.from_arrays([*head, *raw, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], NAMES)


def tokens_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens: each text's words, then its end; index of each text's first, the total last)."""
    hashes, first, _ = word_hashes(data, offs)
    begin = first + np.arange(len(offs))
    out = np.full(begin[-1], END)
    inner = np.ones(begin[-1], bool)
    inner[begin[1:] - 1] = False
    out[inner] = hashes
    return out, begin


def _before(tokens: np.ndarray) -> np.ndarray:
    """The state at each token: the token before, which is an end at a text's start too."""
    return np.concatenate([[END], tokens[:-1]]).astype(np.uint64)


class Tally:
    """Counts by key, passed on as Arrow batches whenever GATHER distinct keys have come together."""

    def __init__(self):
        self.keys, self.sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        new, count = np.unique(keys, return_counts=True)
        both, place = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
        sums = np.zeros(len(both), np.int64)
        sums[place[: len(self.keys)]] = self.sums
        sums[place[len(self.keys) :]] += count
        self.keys, self.sums = both, sums
        if len(both) >= GATHER:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if len(self.keys):
            yield pa.RecordBatch.from_arrays([pa.array(self.keys.view(np.int64)), pa.array(self.sums)], ["key", "n"])
        self.keys, self.sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _at(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The place of each key in the sorted table, -1 where it has none."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _counted(train: DataFrame, keys) -> DataFrame:
    """(key, n): how often each of ``keys(tokens)`` occurs in the texts of ``train``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in it:
            for _, data, offs in text_chunks(batch.column(0), 1 << 22):
                yield from tally.add(keys(tokens_of(data, offs)[0]))
        yield from tally.flush()

    return train.select("text").mapInArrow(batches, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> dict:
    """Totals, hot words and the arcs between them, from the training texts: what the driver and each task may hold."""
    train = docs.where(crc_mod(F.col("doc_id"), 5) != 1)
    words = written(_counted(train, lambda t: t))
    n, v = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    n, v = int(n or 0), int(v)
    often = sorted((r["key"] % (1 << 64), r["n"]) for r in words.where(F.col("n") * HOT >= max(1, n)).collect())
    hot, counts = np.array([k for k, _ in often], np.uint64), np.array([c for _, c in often], np.float64)

    def pairs(tokens: np.ndarray) -> np.ndarray:
        at = _at(tokens, hot)
        state = np.concatenate([_at(np.array([END]), hot), at[:-1]])
        both = (at >= 0) & (state >= 0)
        return (state[both] * HOT + at[both]).astype(np.uint64)

    arcs = sorted((r["key"], r["n"]) for r in _counted(train, pairs).where(F.col("n") >= max(1.0, SHARE * n)).collect()) if len(hot) else []
    return {"n": n, "v": v, "big": n + 0.5 * (v + 1), "hot": hot, "counts": counts, "arcs": np.array([k for k, _ in arcs], np.int64), "arc_counts": np.array([c for _, c in arcs], np.float64)}


def _step(pair: np.ndarray, word: np.ndarray, big: float) -> np.ndarray:
    """log10 of an arc's weight before its state's share is divided out: the arc itself, or failure and the root's arc."""
    return np.log10(pair + PRIOR * (word + 0.5) / big)


def _state(word: np.ndarray) -> np.ndarray:
    """log10 of what divides all arcs of the state that a token leads to."""
    return -np.log10(word + PRIOR)


def _walk(texts: list[pa.Array], ids: list[pa.Array], train: np.ndarray, model: dict, buckets: int, block: int) -> Iterator[pa.RecordBatch]:
    """One block: sums of the steps that the broadcast tables settle, and the other steps by bucket."""
    parts = [tokens_of(data, offs) for t in texts for _, data, offs in text_chunks(t, 1 << 22)]
    tokens = np.concatenate([t for t, _ in parts])
    lengths = np.concatenate([np.diff(b) for _, b in parts])
    state, row = _before(tokens), np.repeat(np.arange(len(lengths)), lengths)
    at = _at(tokens, model["hot"])
    known = at >= 0
    add = lambda v, r: np.bincount(r, v, len(lengths))
    c = model["counts"][at[known]]
    base, score = add(np.log10((c + 0.5) / model["big"]), row[known]), add(_state(c), row[known])
    seen = np.bincount(row[known], minlength=len(lengths))
    before = np.concatenate([_at(np.array([END]), model["hot"]), at[:-1]])
    arc = np.where(known & (before >= 0), _at(before * HOT + at, model["arcs"]), -1)
    took = arc >= 0
    score += add(_step(model["arc_counts"][arc[took]], model["counts"][at[took]], model["big"]), row[took])
    kept = pa.concat_arrays(ids)
    yield _record(block % buckets, TEXTS, block, [lengths.astype(np.int64), seen.astype(np.int64), base, score], kept)
    left = np.flatnonzero(~took)
    w, v, r = tokens[left], state[left], row[left]
    to = mix(np.where(at[left] >= 0, w ^ mix(v), w)) % np.uint64(buckets)
    for kind, of in ((TRAIN, train[r]), (HELD, ~train[r])):
        pick = np.flatnonzero(of)
        pick = pick[np.lexsort((r[pick], w[pick], to[pick]))]
        edges = np.searchsorted(to[pick], np.arange(buckets + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(edges)):
            x = pick[edges[k] : edges[k + 1]]
            yield _record(int(k), kind, block, [w[x], mix(v[x]).view(np.uint8).reshape(-1, 8)[:, :LEAST], r[x].astype(np.uint16)], kept[:0])


def _settle(steps: list[dict], model: dict, none: pa.Array) -> Iterator[pa.RecordBatch]:
    """One bucket: the weights of its steps, summed by block and row. Of each record that came, one goes: rows and their
    scores, rows with rare words and what these add to base and known tokens."""
    w = np.concatenate([_array(r["a"], np.uint64) for r in steps])
    before = np.zeros((len(w), 8), np.uint8)
    before[:, :LEAST] = np.concatenate([_array(r["b"], np.uint8).reshape(-1, LEAST) for r in steps])
    rows = [_array(r["c"], np.uint16).astype(np.int64) for r in steps]
    train = np.repeat([r["kind"].as_py() == TRAIN for r in steps], [len(x) for x in rows])
    uniq, back = np.unique(w, return_inverse=True)
    count = np.bincount(back, train)
    at = _at(uniq, model["hot"])
    count[at >= 0] = model["counts"][at[at >= 0]]
    count, rare = count[back], (at < 0)[back]
    _, back = np.unique(mix(w ^ mix(before.view(np.uint64).ravel())), return_inverse=True)
    weight = _step(np.bincount(back, train)[back], count, model["big"]) + np.where(rare, _state(count), 0)
    base = np.log10((count + 0.5) / model["big"])
    lo = 0
    for r, row in zip(steps, rows, strict=True):
        mine = slice(lo, lo := lo + len(row))
        seldom = row[rare[mine]]
        total = lambda at, values: np.bincount(at, values, ROWS)
        here, there = np.flatnonzero(total(row, None)), np.flatnonzero(total(seldom, None))
        new, known = base[mine][rare[mine]], (count[mine] > 0)[rare[mine]]
        parts = [here.astype(np.uint16), total(row, weight[mine])[here].astype(np.float32), there.astype(np.uint16), total(seldom, new)[there], total(seldom, known)[there].astype(np.uint32)]
        yield _record(0, TRAIN, r["block"].as_py(), parts, none)


def _array(value: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _groups(it: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Runs of rows with the same key, in the order in which they come."""
    run: list[dict] = []
    for batch in it:
        for row in (dict(zip(batch.schema.names, (c[i] for c in batch.columns), strict=True)) for i in range(len(batch))):
            if run and run[-1][key] != row[key]:
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Training rows are those whose crc32 of the id modulo 5 is not 1; only they make states and arcs, all of them, however
    rare. Null texts count as empty (their end is a token); null ids hash as the empty text; repeated rows count each
    time; without training rows every score is 0, as the base formula has it. Words are held by 64-bit hashes, the state
    of a step by 40 further bits. Extra columns are ignored; an empty table gives no rows. The largest group that meets
    in one task is a word below 1/HOT of all tokens, or a pair of hot words below SHARE of them.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    fields = FIELDS.format(kind)
    model = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    buckets = max(1, -(-int(model["n"] * 1.25) // BUCKET))

    def walk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, train, size, n, part = [], [], [], 0, 0, TaskContext.get().partitionId() << 32
        for batch in it:
            ids.append(batch.column(0))
            texts.append(batch.column(1))
            train.append(batch.column(2).to_numpy(zero_copy_only=False))
            size += batch.column(1).nbytes
            n += len(batch)
            if size >= 6 * BLOCK or n >= ROWS // 2:
                yield from blocks(ids, texts, train, part)
                part += 1 + n // ROWS
                ids, texts, train, size, n = [], [], [], 0, 0
        if n:
            yield from blocks(ids, texts, train, part)

    def blocks(ids: list, texts: list, train: list, first: int) -> Iterator[pa.RecordBatch]:
        if sum(map(len, ids)) <= ROWS:
            yield from _walk(texts, ids, np.concatenate(train), shared.value, buckets, first)
            return
        every, whole, flags = pa.concat_arrays(ids), pa.concat_arrays(texts), np.concatenate(train)
        for k, lo in enumerate(range(0, len(every), ROWS)):
            yield from _walk([whole.slice(lo, ROWS)], [every.slice(lo, ROWS)], flags[lo : lo + ROWS], shared.value, buckets, first + k)

    def settle(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _groups(it, "bucket"):
            steps = [r for r in run if r["kind"].as_py() != TEXTS]
            for r in run:
                if r["kind"].as_py() == TEXTS:
                    yield _record(0, TEXTS, r["block"].as_py(), [_array(r[x], np.uint8) for x in "abcd"], r["ids"].values)
            if steps:
                yield from _settle(steps, shared.value, run[0]["ids"].values[:0])

    def combine(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _groups(it, "block"):
            (own,) = [r for r in run if r["kind"].as_py() == TEXTS]
            n, known, base, score = (_array(own[x], t).copy() for x, t in zip("abcd", (np.int64, np.int64, np.float64, np.float64), strict=True))
            for r in run:
                if r is not own:
                    score[_array(r["a"], np.uint16)] += _array(r["b"], np.float32)
                    rare = _array(r["c"], np.uint16)
                    base[rare] += _array(r["d"], np.float64)
                    known[rare] += _array(r["e"], np.uint32)
            yield pa.RecordBatch.from_arrays([own["ids"].values, pa.array(n), pa.array(known), pa.array(base), pa.array(score)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    each = docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), 5) != 1).alias("train"))
    steps = each.mapInArrow(walk, fields).repartition(max(buckets, 1), "bucket").sortWithinPartitions("bucket")
    sums = steps.mapInArrow(settle, fields).repartition("block").sortWithinPartitions("block")
    out = sums.mapInArrow(combine, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model["n"]).cast("long").alias("train_tokens"), "base_score", "score")
