"""Similarity functions as Column expressions; anything with these members can be used."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ConstantSimilarity:
    """Similarity 0 everywhere: distortion replaces a value without regard to likeness."""

    is_constant = True
    threshold = 0.0
    max_similarity = 0.0
    min_similarity = 0.0

    def column(self, a: Column, b: Column) -> Column:
        return F.lit(0.0)

    def __str__(self) -> str:
        return "ConstantSimilarityFn"


@dataclass(frozen=True)
class LevenshteinSimilarity:
    """Normalised edit similarity u = 1 - 2d / (|a| + |b| + d), cut at the threshold and stretched to [0, max]."""

    threshold: float = 7.0
    max_similarity: float = 10.0
    is_constant = False
    min_similarity = 0.0

    def __post_init__(self) -> None:
        if not self.max_similarity > 0:
            raise ValueError("max_similarity must be positive")
        if not 0 <= self.threshold < self.max_similarity:
            raise ValueError("threshold must be in [0, max_similarity)")

    @staticmethod
    def unit(a: Column, b: Column) -> Column:
        d, n = F.levenshtein(a, b).cast("double"), (F.length(a) + F.length(b)).cast("double")
        return F.when(n == 0, F.lit(1.0)).otherwise(1.0 - 2.0 * d / (n + d))

    def column(self, a: Column, b: Column) -> Column:
        m, t = float(self.max_similarity), float(self.threshold)
        return F.greatest(F.lit(0.0), F.lit(m / (m - t)) * (F.lit(m) * self.unit(a, b) - F.lit(t)))

    def reach(self, total: Column) -> Column:
        """Most edits between strings of that total length whose similarity may be positive."""
        u = float(self.threshold) / float(self.max_similarity)
        return F.floor(total * F.lit((1 - u) / (1 + u)) + F.lit(1e-9)).cast("int")

    def __str__(self) -> str:
        return f"LevenshteinSimilarityFn(threshold={self.threshold}, maxSimilarity={self.max_similarity})"


REGISTRY = {"ConstantSimilarityFn": ConstantSimilarity, "LevenshteinSimilarityFn": LevenshteinSimilarity}


def register(name: str, factory) -> None:
    """Makes a similarity function known to configurations."""
    REGISTRY[name] = factory
