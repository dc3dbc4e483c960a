"""Numeric column expressions used by the perplexity operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value of the back-off: an unknown word gets 0.99 / corpus_size.
OOV_MASS = 0.99


def word_entropy(p: Column) -> Column:
    """``-log2 p`` (F1); infinite for p = 0 (a null there would be left out of averages)."""
    return F.when(p == 0, F.lit(float("inf"))).otherwise(-F.log2(p))


def word_perplexity(p: Column) -> Column:
    """``2 ** (-log2 p)``, the per-word perplexity averaged by ppl0 (F2)."""
    return F.pow(F.lit(2.0), word_entropy(p))


def weighted_entropy(p: Column) -> Column:
    """``-p log2 p``, the term averaged by ppl2 (F4); not a number for p = 0, as 0 times infinity."""
    return p * word_entropy(p)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def nan_to_null(c: Column) -> Column:
    return F.when(finite(c), c)
