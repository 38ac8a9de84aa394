"""Filters and scores over canonical samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.functions import turns as X
from sparloom.functions.text import repetition_ratio, token_estimate


def measured(samples: DataFrame) -> DataFrame:
    """samples with joined_text, tokens and repetition, each computed once for all later uses."""
    return samples.withColumn("joined_text", X.joined_text(F.col("messages"))).withColumns({"tokens": token_estimate(F.col("joined_text")), "repetition": repetition_ratio(F.col("joined_text"))})


def scored(samples: DataFrame) -> DataFrame:
    """samples with quality_score; measures are added where they are missing."""
    rows = samples if "repetition" in samples.columns else measured(samples)
    return rows.withColumn("quality_score", X.quality_score(F.col("messages"), F.col("success"), F.col("capabilities"), F.col("tokens"), F.col("repetition")))


def basic_filter(min_tokens: int = 64, max_tokens: int = 32768, max_repetition: float = 0.20, require_success: bool = False) -> Column:
    """Over measured samples; cheap tests first. Null success does not count as success."""
    ok = ~X.malformed(F.col("messages"))
    if require_success:
        ok = ok & F.col("success").eqNullSafe(F.lit(True))
    return ok & F.col("tokens").between(min_tokens, max_tokens) & (F.col("repetition") <= max_repetition)


def filtered(samples: DataFrame, min_quality: float | None = None, **limits) -> DataFrame:
    rows = samples if "repetition" in samples.columns else measured(samples)
    rows = rows if min_quality is None else rows.where(F.col("quality_score") >= min_quality)
    return rows.where(basic_filter(**limits))


def matches_target(capabilities: list[str], domains: list[str]) -> Column:
    """All of the capabilities and any of the domains; an empty list is no condition."""
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    all_caps = F.size(F.array_except(arr(capabilities), F.col("capabilities"))) == 0 if capabilities else F.lit(True)
    return all_caps & (F.arrays_overlap(arr(domains), F.col("domains")) if domains else F.lit(True))


def matches_eval(sample_types: list[str], required: list[str], excluded: list[str]) -> Column:
    from sparloom.functions.text import contains_any

    low = F.lower("joined_text")
    required, excluded = [c.lower() for c in required if c], [c.lower() for c in excluded if c]
    ok = F.col("sample_type").isin(sample_types) if sample_types else F.lit(True)
    if required:
        ok = ok & contains_any(low, required)
    return ok & ~contains_any(low, excluded) if excluded else ok
