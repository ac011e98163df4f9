"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it.  ``queries`` lists the registered
queries and their SQL; every other module holds one operator with its own
general interface.
"""
