"""Cross-tokenizer alignment: token incidence matrices in compressed rows, multiplied row by row.

Both tokenizers cut the same bytes into tokens. A matrix has a row for each token and a column for each byte, each token's
last byte or each group; the product of one tokenizer's matrix with the other's transpose has an entry for each pair of
tokens that share a byte (overlap links), end together (end links) or stand in one group (shared-group links).

Neither tokenizer has a token across the single space between two words, so a text's matrices are block-diagonal with a
block for each word. Equal blocks have equal products: each distinct word is multiplied out once, and a text's counts are
the product of its word counts with the words' own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: How byte-level BPE of this family cuts a text before merging (a fixed value of the public vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space that both tokenizers begin a token with, whatever stands around it: one alone between other characters.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Characters of texts that are aligned at once (a longer text alone), terms of a product that stand in memory at once, and
#: the words and their characters above which a worker's table of words starts anew.
CHUNK, TERMS, WORDS, LETTERS = 1 << 19, 1 << 20, 1 << 17, 1 << 23
#: Words that sentencepiece, whose time grows faster than a text, gets in one text.
RUN = 16
#: Pairs of ids whose counts are broadcast at most (40 bytes each); rarer pairs meet their counts in a shuffle.
HOT_PAIRS = 1 << 19


class Csr(NamedTuple):
    """A matrix in compressed rows: row i has ``values[starts[i]:starts[i + 1]]`` (all ones if None) in those ``cols``."""

    starts: np.ndarray
    cols: np.ndarray
    width: int
    values: np.ndarray | None = None


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def tiling(ends: np.ndarray) -> Csr:
    """Token-byte incidence of tokens that follow each other: each holds the bytes from the end before to its own."""
    n = int(ends[-1]) if len(ends) else 0
    return Csr(np.concatenate([[0], ends]).astype(np.int64), np.arange(n), n)


def one_each(cols: np.ndarray, width: int) -> Csr:
    return Csr(np.arange(len(cols) + 1), cols, width)


def transposed(m: Csr) -> Csr:
    """The transpose of a 0/1 matrix."""
    rows = np.repeat(np.arange(len(m.starts) - 1), np.diff(m.starts))
    if len(m.cols) > 1 and (m.cols[1:] < m.cols[:-1]).any():
        rows = rows[np.argsort(m.cols, kind="stable")]
    return Csr(starts_of(np.bincount(m.cols, minlength=m.width)), rows, len(m.starts) - 1)


def products(a: Csr, b: Csr, most: int = TERMS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, values) of the entries of a times b, in blocks of rows that expand to about ``most`` terms.

    Gustavson's way: each entry (i, k) of a adds its multiple of row k of b to row i; equal columns of a row add up.
    """
    taken = np.diff(b.starts)[a.cols]
    upto = starts_of(taken)
    bound = upto[a.starts]
    wide, lo, n = np.int64(max(1, b.width)), 0, len(a.starts) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(bound, bound[lo] + most, "right")) - 1))
        first, last = a.starts[lo], a.starts[hi]
        size = taken[first:last]
        at = np.arange(upto[first], upto[last]) + np.repeat(b.starts[a.cols[first:last]] - upto[first:last], size)
        key = np.repeat(np.arange(lo, hi), np.diff(bound[lo : hi + 1])) * wide + b.cols[at]
        value = np.ones(len(key), np.int64) if b.values is None else b.values[at]
        if a.values is not None:
            value = value * np.repeat(a.values[first:last], size)
        if len(key) > 1 and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        rows, cols = np.divmod(key[new], wide)
        yield rows, cols, np.add.reduceat(value, new) if len(new) else value
        lo = hi


class Tokens(NamedTuple):
    """Tokens one after another: their ids, and the byte offsets where they end."""

    ids: np.ndarray
    ends: np.ndarray


class Aligned(NamedTuple):
    """Two tokenizations of the same bytes. ``ends``: positions in a and in b of the tokens that end together;
    ``group_a`` and ``group_b``: the number of each token's group."""

    a: Tokens
    b: Tokens
    ends: tuple[np.ndarray, np.ndarray]
    group_a: np.ndarray
    group_b: np.ndarray
    n_groups: int


def align(a: Tokens, b: Tokens) -> Aligned:
    """End links and groups: a group ends where both have a token's end."""
    n = int(a.ends[-1]) if len(a.ends) else 0
    blocks = list(products(one_each(a.ends - 1, n), transposed(one_each(b.ends - 1, n))))
    i, j = (np.concatenate([x[k] for x in blocks]) if blocks else np.zeros(0, np.int64) for k in (0, 1))
    cuts = a.ends[i]
    return Aligned(a, b, (i, j), np.searchsorted(cuts, a.ends), np.searchsorted(cuts, b.ends), len(cuts))


def overlap_links(x: Aligned) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions in a, in b, bytes shared) of tokens that share bytes."""
    return products(tiling(x.a.ends), transposed(tiling(x.b.ends)))


def group_links(x: Aligned) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions in a, in b, 1) of tokens in the same group."""
    return products(one_each(x.group_a, x.n_groups), transposed(one_each(x.group_b, x.n_groups)))


def group_link_counts(x: Aligned) -> np.ndarray:
    """How many shared-group links each token of a has: the sizes of the product's rows, without the product."""
    g = transposed(one_each(x.group_b, x.n_groups))
    return np.diff(g.starts)[x.group_a]


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a letter: printable Latin-1 as itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(shown)]
    return {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(rest)}


def open_ended(word: str) -> bool:
    return word[0].isspace() or word[-1].isspace()


class Encoders:
    """The two tokenizers and their tokens' bytes. Special tokens of a text are plain text to both."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        import tiktoken

        letters = byte_letters()
        with open(a_file, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items()}  # ids rise in the order of merges
        self.one = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.two = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a[i] = token
        piece = self.two.id_to_piece
        pieces = [piece(i) for i in range(self.two.get_piece_size())]
        self.b = [bytes([int(p[3:-1], 16)]) if self.two.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(t) for t in x]) for x in (self.a, self.b))
        # ids in decimal with what follows them: of a within and at the end of its part of a group, then of b
        self.said = [b"%d%c" % (i, c) for n, ends in ((len(self.a), b",|"), (len(self.b), b",;")) for c in ends for i in range(n)]
        self.said_size = np.array([len(t) for t in self.said])
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)

    def words(self, text: str) -> list[str]:
        """Parts between which neither tokenizer has a token; each follows a space, the first the one put before the text."""
        return BETWEEN.split(text) if self.by_word else [text]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of a, ids of b, how many of each word of both, whether a word is not given back byte by byte). A text's
        first and last word may begin or end in white space, which would join a neighbour's: such a word goes alone."""
        parts, lo = [], 0
        for hi, w in enumerate([*words, " "]):
            if open_ended(w):
                if lo < hi:
                    parts.append(self._encode(words[lo:hi]))
                if hi < len(words):
                    parts.append(self._encode([w]))
                lo = hi + 1
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words as one text, which both cut at each of them; if it is not given back, each half, down to single words."""
        said = " " + " ".join(words)
        runs = self.two.encode([" ".join(words[k : k + RUN]) for k in range(0, len(words), RUN)], num_threads=1)
        a, b = np.array(self.one.encode_ordinary(said), np.int64), np.array([i for r in runs for i in r], np.int64)
        if b"".join([self.a[i] for i in a.tolist()]) == said.encode() == b"".join([self.b[i] for i in b.tolist()]):
            bounds = np.cumsum([len(w.encode()) + 1 for w in words])
            upto = [np.searchsorted(np.cumsum(size[ids]), bounds, "right") for size, ids in ((self.a_size, a), (self.b_size, b))]
            return a, b, np.diff(upto[0], prepend=0), np.diff(upto[1], prepend=0), np.zeros(len(words), np.int64)
        if len(words) == 1:
            none, zero = np.zeros(0, np.int64), np.zeros(1, np.int64)
            return none, none, zero, zero, np.ones(1, np.int64)
        half = len(words) // 2
        return tuple(np.concatenate(x) for x in zip(self._encode(words[:half]), self._encode(words[half:]), strict=True))

    def groups_as_text(self, x: Aligned, sizes: np.ndarray) -> list[bytes]:
        """Each word's groups in decimal: ids of a, a bar, ids of b, a semicolon between groups."""
        before_a, before_b = (starts_of(np.bincount(g, minlength=x.n_groups)) for g in (x.group_a, x.group_b))
        ends_a, ends_b = np.diff(x.group_a, append=-1) != 0, np.diff(x.group_b, append=-1) != 0
        out = np.zeros(len(x.a.ids) + len(x.b.ids), np.int64)
        out[np.arange(len(x.a.ids)) + before_b[x.group_a]] = x.a.ids + np.where(ends_a, len(self.a), 0)
        out[np.arange(len(x.b.ids)) + before_a[x.group_b + 1]] = x.b.ids + np.where(ends_b, len(self.b), 0) + 2 * len(self.a)
        said = b"".join([self.said[i] for i in out.tolist()])
        upto = starts_of(self.said_size[out])[starts_of(sizes)].tolist()
        return [said[p : q - 1] for p, q in zip(upto, upto[1:], strict=False)]


class Table:
    """Distinct words, each with its counts, its groups as text, and a row of a words-by-id-pairs matrix."""

    #: Columns of ``counts``: whether the word is not given back, then what ``align_documents`` returns.
    BAD, N_A, N_B, N_GROUPS, N_LINKS, N_OVERLAP, N_SHARED = range(7)

    def __init__(self, e: Encoders):
        self.e = e
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.said: list[bytes] = []
        self.letters = 0
        self.counts = np.zeros((0, 7), np.int64)
        self.pairs = Csr(np.zeros(1, np.int64), np.zeros(0, np.int64), len(self.e.a) * len(self.e.b), np.zeros(0, np.int64))

    def add(self, words: list[str]) -> None:
        e, n = self.e, len(words)
        if not n:
            return
        ids_a, ids_b, n_a, n_b, bad = e.encode(words)
        x = align(Tokens(ids_a, np.cumsum(e.a_size[ids_a])), Tokens(ids_b, np.cumsum(e.b_size[ids_b])))
        of_a = np.repeat(np.arange(n), n_a)
        count = lambda owner, weights=None: np.bincount(owner, weights, n).astype(np.int64)
        overlap = np.zeros(n, np.int64)
        for rows, _, _ in overlap_links(x):
            overlap += count(of_a[rows])
        i, j = x.ends
        links = count(of_a[i])
        last = np.flatnonzero(np.diff(x.group_a, append=-1))
        counts = np.stack([bad, n_a, n_b, count(of_a[last]), links, overlap, count(of_a, group_link_counts(x))], 1)
        pair = ids_a[i] * np.int64(len(e.b)) + ids_b[j]
        old = self.pairs
        self.pairs = Csr(np.concatenate([old.starts, old.starts[-1] + np.cumsum(links)]), np.concatenate([old.cols, pair]), old.width, np.ones(len(old.cols) + len(pair), np.int64))
        self.counts = np.concatenate([self.counts, counts])
        self.said += e.groups_as_text(x, n_a + n_b)
        self.code |= {w: len(self.code) + k for k, w in enumerate(words)}
        self.letters += sum(map(len, words))

    def describe(self, texts: list[str | None]) -> dict[str, list | np.ndarray | pa.Array]:
        """Columns over ``texts``: counts, the digest, and each text's distinct id pairs with how often it links them."""
        if len(self.code) > WORDS or self.letters > LETTERS:
            self.clear()
        parts, docs = [self.e.words(t) if t else [] for t in texts], len(texts)
        code, said = self.code, self.said
        self.add(sorted(dict.fromkeys(w for p in parts for w in p if w not in code), key=open_ended))
        codes = [[code[w] for w in p] for p in parts]
        sizes = np.array([len(c) for c in codes], np.int64)
        flat = np.array([c for x in codes for c in x], np.int64)
        bad = np.bincount(np.repeat(np.arange(docs), sizes), self.counts[flat, self.BAD], docs) > 0
        ones = Csr(starts_of(sizes), flat, len(code))
        rows, cols, values = (np.concatenate(z) for z in zip(*products(ones, one_each(np.arange(len(code)), len(code))), strict=True))
        ok = ~bad[rows]
        rows, cols, values = rows[ok], cols[ok], values[ok]
        texts_words = Csr(starts_of(np.bincount(rows, minlength=docs)), cols, len(code), values)
        total = starts_of(values)  # of whole numbers: exact
        sums = np.concatenate([np.zeros((1, 7), np.int64), np.cumsum(self.counts[cols] * values[:, None], 0)])[texts_words.starts]
        got = np.diff(sums, axis=0) if len(total) else sums
        of, pair, often = (np.concatenate(z) for z in zip(*products(texts_words, self.pairs), strict=True))
        offs = pa.array(np.searchsorted(of, np.arange(docs + 1)), pa.int32())
        digest = [hashlib.sha256(b";".join([said[k] for k in c])).hexdigest() if c and not b else "" for c, b in zip(codes, bad.tolist(), strict=True)]
        named = {"n_a": self.N_A, "n_b": self.N_B, "n_groups": self.N_GROUPS, "n_links": self.N_LINKS, "n_overlap": self.N_OVERLAP, "n_shared": self.N_SHARED}
        return {k: got[:, c] for k, c in named.items()} | {"groups_sha256": digest, "pairs": pa.ListArray.from_arrays(offs, pa.array(pair)), "counts": pa.ListArray.from_arrays(offs, pa.array(often))}


@lru_cache(maxsize=1)
def table_of(a_file: str, b_file: str) -> Table:
    return Table(Encoders(a_file, b_file))


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t or "") > CHUNK:
            yield lo, i
            lo, size = i, 0
        size += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


def align_documents(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlap, n_shared) of every row of ``docs``.

    Texts that are null, empty, or not given back byte by byte by both tokenizers have no tokens: zeros and ''. Repeated
    rows and null or repeated ids stand for themselves. Texts are encoded once; their id pairs stay in a table in the
    shared folder, from which the pairs are counted and to which the counts come back: those of at most HOT_PAIRS most
    frequent pairs by broadcast, those of rarer ones, of which none is frequent, by a shuffle.
    """
    ship(docs.sparkSession)
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_overlap", "n_shared", "pairs", "counts"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(a_file, b_file)
        for batch in it:
            texts = batch.column(1).to_pylist()
            for lo, hi in chunks(texts):
                got = table.describe(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[c if isinstance(c, pa.Array) else pa.array(c) for c in (got[k] for k in names)]], ["doc_id", *names])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_overlap long, n_shared long, pairs array<long>, counts array<long>"
    aligned = written(docs.select("doc_id", "text").mapInArrow(batches, schema).withColumn("row", F.monotonically_increasing_id()))
    each = aligned.select("row", F.inline(F.arrays_zip("pairs", "counts"))).withColumnsRenamed({"pairs": "pair", "counts": "c"})
    pairs = written(each.groupBy("pair").agg(F.sum("c").alias("n")))
    b_id = F.pmod(F.col("pair"), F.lit(len(table_of(a_file, b_file).e.b)))
    top = pairs.groupBy(b_id.alias("_b")).agg(F.max("n").alias("_top"))
    judged = pairs.join(top, b_id == F.col("_b")).select(F.col("pair").alias("_pair"), "n", (F.col("n") == F.col("_top")).cast("long").alias("best"))
    # by powers of two (64 rows at most): the count from which on the pairs are few enough
    held, least = 0, 0
    for r in sorted(pairs.groupBy((F.length(F.bin("n")) - 1).alias("power")).agg(F.count(F.lit(1)).alias("pairs")).collect(), reverse=True):
        if held + r["pairs"] > HOT_PAIRS:
            least = 2 << r["power"]
            break
        held += r["pairs"]
    hot = F.broadcast(judged.where(F.col("n") >= least))
    sums = [F.sum(F.col("c") * F.col("n")).alias("count_sum"), F.sum(F.col("c") * F.col("best")).alias("n_best")]
    on = F.col("pair") == F.col("_pair")
    found = each.join(hot, on).groupBy("row").agg(*sums)
    if least:
        rare = each.join(hot, on, "left_anti").join(judged.where(F.col("n") < least), on).groupBy("row").agg(*sums)
        found = found.unionByName(rare).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return aligned.join(found, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", "n_overlap", "n_shared")
