"""Operators for preparing training text.

Nothing outside this folder imports it; ``queries`` lists the registered
queries.  Each module holds one operator with its general interface, and the
query of an operator derives its result columns from that interface.
"""
