"""Operators for preparing training corpora.

Nothing outside this subpackage imports it.  Every operator module keeps a
general interface; ``queries`` derives the registered query results.
"""
