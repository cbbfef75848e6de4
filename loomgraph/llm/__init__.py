"""Training-data operators: the corpus operators and their queries.

Nothing outside this package imports it; the package can be deleted whole.
"""
