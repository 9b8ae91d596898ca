"""Secret scans: marginal bytes under zstandard, primed with the surrounding code and an identifier dictionary."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

KINDS = ("assign", "access", "hex")
#: Base patterns and least lengths (of group 2, of the match, of the match).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}")
#: A candidate beyond the base: a long run of key characters; and words that make its surroundings sensitive.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
LEAST = 16
#: A name and its sign of assignment at the start of a run: the candidate is what follows, the name belongs to its context.
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*=(?!=*$)")
CONTEXT = re.compile(r"passw|secret|token|key|auth|bearer|credential|private|signature|session|cookie|cert", re.IGNORECASE | re.ASCII)
#: How far before a candidate its context may stand; how much text on both sides primes the dictionary.
REACH, PRIME = 64, 512
#: A candidate is novel if its marginal bytes are at least NOVEL of its length, and at least UNKNOWN of what it takes
#: without dictionary: of random letters, digits or hex digits neither its surroundings nor any identifier save a byte;
#: compounds of four words of the dictionary pass in one case of fifty, of three in one of ten.
NOVEL, UNKNOWN = 0.6, 0.9
#: Identifiers: names with an underscore or an inner capital, or before an opening bracket or a sign of assignment; and
#: the words that they are made of. The dictionary holds that many words, those that most documents' identifiers use.
IDENTIFIER = r"\b[A-Za-z][A-Za-z0-9]*+_[A-Za-z0-9_]++|\b[a-z]++[A-Z][A-Za-z0-9]*+|\b[A-Za-z][A-Za-z0-9_]++(?=[ ]?[=({\[])"
PART, DICTIONARY = r"[A-Z]?[a-z]{2,15}", 2000
#: Words that code repeats anywhere: fixed values.
IDENTIFIERS = (
    "public private static final class interface import package return function const let var def self this None null true false "
    "string integer boolean double float void async await export default module require include define struct namespace template "
    "config configuration settings environment database connection username password secret token api_key access_key client_id "
    "authorization bearer content-type application/json http https localhost example.com request response header body error exception"
).encode()


def identifiers(docs: DataFrame) -> bytes:
    """The words of the corpus's own identifiers, the commonest last: at most DICTIONARY of 16 letters each. A secret's
    letters do not get in: its runs are short and few documents share them."""
    parts = F.flatten(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(IDENTIFIER), F.lit(0)), lambda t: F.regexp_extract_all(t, F.lit(PART), F.lit(0))))
    counts = docs.select(F.explode(F.array_distinct(F.transform(parts, F.lower))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    top = counts.orderBy(F.col("n").desc(), "w").limit(DICTIONARY).collect()
    return " ".join(r["w"] for r in reversed(top)).encode()


def _marginal(piece: bytes, known: bytes | None) -> int:
    """Bytes that the piece adds to an empty frame, whose window holds what is ``known``."""
    import zstandard as zstd

    primed = zstd.ZstdCompressionDict(known, dict_type=zstd.DICT_TYPE_RAWCONTENT) if known else None
    make = lambda: zstd.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, dict_data=primed)
    return len(make().compress(piece)) - len(make().compress(b""))


def novel(piece: str, around: str, shared: dict) -> bool:
    """Whether neither its surroundings nor the identifier dictionary (``words`` of ``shared``) explain the piece."""
    raw = piece.encode()
    primed = _marginal(raw, IDENTIFIERS + b" " + shared.get("words", b"") + b" " + around.encode("utf-8", "replace"))
    return primed >= NOVEL * len(raw) and primed >= UNKNOWN * _marginal(raw, None)


def scan(text: str, shared: dict | None = None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, further spans that the novelty measure reports): (start, kind index, end) each. ``shared`` has the
    corpus's identifiers as ``words``."""
    shared = shared or {}
    base, extra = [], []
    fold = text.lower()
    if "passw" in fold or "secret" in fold or "token" in fold or "api" in fold:
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if CONTEXT.search(fold):
        taken, at = _merged(base), 0
        for m in CANDIDATE.finditer(text):
            s, e = m.start(), m.end()
            name = NAME.match(m[0])
            s += name.end() if name else 0
            piece = text[s:e]
            if len(piece) < LEAST or not CONTEXT.search(text, max(0, s - REACH), s):
                continue
            while at < len(taken) and taken[at][1] <= s:
                at += 1
            if at < len(taken) and taken[at][0] < e:
                continue
            # what follows may repeat the piece, which makes the later one known, not this one
            if novel(piece, text[max(0, s - PRIME) : s] + text[e : e + PRIME].replace(piece, ""), shared):
                extra.append((s, 3, e))
    return sorted(base), extra


def _merged(spans: list[tuple[int, int, int]]) -> list[list[int]]:
    """The stretches that spans cover, in order, none touching another."""
    out: list[list[int]] = []
    for s, _, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel) of every row.

    Further spans have the kind ``novel``: incompressible strings close after sensitive words, outside all base spans.
    The dictionary that primes all measurements comes from all documents' identifiers, before the scan. Texts are
    scanned whole and one at a time, on the executors; null texts count as empty; repeated rows come back
    repeated; extra columns are ignored.
    """

    ship(docs.sparkSession)
    known = identifiers(docs)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = {"words": known}
        for batch in it:
            ids, texts = batch.column(0), batch.column(1)
            out: list[list] = [[] for _ in range(6)]
            for i in range(len(batch)):
                base, extra = scan(texts[i].as_py() or "", shared)
                names = (*KINDS, "novel")
                say = lambda spans: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)  # noqa: E731, B023
                for c, k in zip(out, range(3), strict=False):
                    c.append(sum(x[1] == k for x in base))
                out[3].append(hashlib.sha256(say(base).encode()).hexdigest())
                out[4].append(say(sorted(base + extra)))
                out[5].append(len(extra))
            cols = [ids, *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string()), pa.array(out[4], pa.string()), pa.array(out[5], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    id_type = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
