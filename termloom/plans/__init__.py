"""Whole computations: from lines to n-gram statistics."""
