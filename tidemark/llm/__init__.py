"""Operators for preparing training text: each is a Spark job over a whole table.

Nothing else in the library imports this subpackage.
"""
