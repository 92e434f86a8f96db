"""Training-data operators.

Nothing outside this subpackage imports it, so the rest of the library works
without it.  ``queries.py`` holds the thin contract queries, every other module
one operator with its own general interface.
"""
