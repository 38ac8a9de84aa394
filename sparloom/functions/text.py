"""String functions with the semantics of Unicode-aware strip, split and lower."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
NGRAM = 5


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, rf"(?U){SPACE}+", -1), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def repetition_counts(text: Column, n: int = NGRAM) -> Column:
    """(n_ngrams, n_dup): n-grams of the lower-case words without the last one, and how many of them repeat an earlier one.

    Both are 0 for fewer than 2n words. N-grams are compared by 64-bit hashes, within one text.
    """

    def of(w: Column) -> Column:
        last = F.greatest(F.size(w) - n - 1, F.lit(0))
        grams = bind(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)])))
        none = F.struct(F.lit(0).alias("n_ngrams"), F.lit(0).alias("n_dup"))
        full = bind(grams, lambda g: F.struct(F.size(g).alias("n_ngrams"), (F.size(g) - F.size(F.array_distinct(g))).alias("n_dup")))
        return F.when(F.size(w) < 2 * n, none).otherwise(full)

    return bind(words(F.lower(text)), of)


def repetition_ratio(text: Column, n: int = NGRAM) -> Column:
    return bind(repetition_counts(text, n), lambda c: c["n_dup"] / F.greatest(F.lit(1), c["n_ngrams"]))


def normalized_label(value: Column) -> Column:
    """Lower case, runs of other signs than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(value)), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")


def contains_any(text: Column, cues) -> Column:
    """Plain substring search."""
    out = F.lit(False)
    for c in cues:
        out = out | F.contains(text, F.lit(c))
    return out


def first_match(text: Column, markers) -> Column:
    """0-based place of the first listed marker that occurs, in any case; null if none does."""
    low = F.lower(text)
    return F.coalesce(*[F.nullif(F.locate(m.lower(), low), F.lit(0)) - 1 for m in markers])


def earliest_match(text: Column, markers) -> Column:
    low = F.lower(text)
    return F.least(*[F.nullif(F.locate(m.lower(), low), F.lit(0)) - 1 for m in markers])


def py_json_success(value: Column) -> Column:
    """Success from a string: true, false or null."""
    low = F.lower(strip(value))
    return F.when(low.isin("1", "true", "success", "passed", "pass"), True).when(low.isin("0", "false", "failure", "failed", "fail"), False)
