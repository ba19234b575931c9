"""Operators for preparing training data at corpus scale.

Nothing else in ``dagstore`` imports this subpackage.  Each module holds one
operator with its own general interface; ``queries`` holds the thin registered
queries that apply them to the driver tables.
"""
