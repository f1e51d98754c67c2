"""Training-data operations over document tables: one module per operator, plus their registered queries.

Nothing outside this subpackage imports it; the driver entry adds it only when it is present.
"""
