"""Operators for large training-data pipelines.

Nothing outside this folder imports it.  Each module holds one operator, its
query and, where SQL can say the same, the SQL; ``queries`` gathers them.
"""
