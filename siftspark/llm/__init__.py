"""Operators for building training data from an index of texts, pages, scans, vectors and bookmarks.

Nothing outside this folder imports it.
"""
