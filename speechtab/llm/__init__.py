"""Operators for preparing training text.

Nothing else in the package imports this subpackage.  Each module holds one
operator; ``queries`` lists the contract queries built on them.
"""
