"""Operators for building training corpora from text and web pages.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
when the package is present.
"""
