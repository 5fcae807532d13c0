"""Training-data operators, each in a module of its own.

Nothing outside this folder imports it.  Modules are imported one by one so
that a query pays only for what it uses.
"""
