"""N-gram statistics on Spark: all, closed or maximal n-grams with their collection frequency."""

from .plans.api import ngram_statistics
from .types import NGramType, Params

__all__ = ["NGramType", "Params", "ngram_statistics"]
