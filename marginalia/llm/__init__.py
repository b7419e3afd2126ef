"""Operators for large training corpora, kept apart from the rest of the library."""
