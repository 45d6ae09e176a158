"""Training-data operators: one module per operator, plus their registered queries.

Nothing outside this package imports it, so it can be removed without touching the rest.
"""
