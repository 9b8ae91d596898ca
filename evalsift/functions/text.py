"""Text as columns: tokens, n-grams, hashes, paragraphs, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode word characters; ``\w`` alone is ASCII on the JVM.
WORDS = r"[\p{L}\p{N}_]+"


def tokenize_words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, in order; a null text has none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0)), lambda w: F.lower(w))


def tokenize_ws(text: Column) -> Column:
    """Lower-cased pieces between white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, whatever expression it is."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Contiguous n-grams joined by one blank; none for fewer than n tokens."""

    def grams(t: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.concat_ws(" ", F.slice(t, i, n)))
        return F.when(F.size(t) >= n, every).otherwise(F.array().cast("array<string>"))

    return let(tokens, grams)


def ngram_hashes(tokens: Column, n: int) -> Column:
    """64-bit hashes of the n-grams: each token is hashed once, each n-gram from its tokens' hashes."""

    def grams(h: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(F.slice(h, i, n)))
        return F.when(F.size(h) >= n, every).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), grams)


def first_paragraph(text: Column, least: int = 80, most: int = 1500) -> Column:
    """The first piece between blank lines whose length lies in the range, else null."""
    return F.get(F.filter(F.split(text, r"\n\n"), lambda p: F.length(p).between(least, most)), F.lit(0))


def truncate_text(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def distinct_ratio(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.size(F.array_distinct(tokens)) / F.size(tokens))


def step_count(answer: Column) -> Column:
    """How many ``<<...>>`` steps a rationale marks."""
    return F.regexp_count(answer, F.lit("<<[^>]*>>"))


def step_bin(steps: Column) -> Column:
    return F.when(steps <= 2, "<=2").when(steps <= 4, "3-4").when(steps <= 6, "5-6").otherwise("7+")


def norm_level(level: Column) -> Column:
    """A level given as a number or as text: its first digit, else 0."""
    return F.coalesce(level.try_cast("int"), F.regexp_extract(level, r"\d", 0).try_cast("int"), F.lit(0))


def family_of(model: Column, strict: bool = False) -> Column:
    """The family of a model by the first name that it contains; the strict form splits generations."""
    names = [("qwen3", "qwen3"), ("qwen2.5", "qwen2.5")] if strict else []
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for part, family in [*names, *((x, x) for x in ("qwen", "llama", "gemma", "phi", "mistral", "olmo", "pythia"))]:
        out = out.when(F.contains(F.lower(model), F.lit(part)), family)
    return out.otherwise("other")


def slug_of(model: Column) -> Column:
    return F.replace(model, F.lit("/"), F.lit("__"))


def model_of(slug: Column) -> Column:
    return F.replace(slug, F.lit("__"), F.lit("/"))


def perturb_numbers(text: Column, key: Column, most: int = 5, pattern: str = r"[0-9]+") -> tuple[Column, Column]:
    """(text with its first ``most`` numbers replaced by others in 2..100, number of changes); the draw hangs on ``key``."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def other(x: Column, i: Column) -> Column:
        draw = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("bigint"), F.lit(99)) + 2
        draw = F.when(draw.cast("string") == x, F.when(draw == 100, F.lit(2)).otherwise(draw + 1)).otherwise(draw)
        return F.when(i < most, draw.cast("string")).otherwise(x)

    new = F.concat(F.transform(found, other), F.array(F.lit("")))
    return F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), new.alias("r")), lambda z: F.concat(z["g"], z["r"])), ""), F.least(F.size(found), F.lit(most))
