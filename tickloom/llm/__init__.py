"""Training-data operators: one module per operator, all Spark jobs over `documents`-like tables.

Nothing else in the library imports this subpackage.
"""
