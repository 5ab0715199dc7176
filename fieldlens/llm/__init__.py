"""Training-data operators: dedup, formatting, scoring, mixing, packing, search.

Nothing else in the library imports this subpackage.  ``queries.py`` binds the
operators to the tables of a data directory.
"""
