"""Training-data operators.

Self-contained: nothing else in the library imports this subpackage, and the
subpackage works without the n-gram engine.
"""
