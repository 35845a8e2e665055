"""Training-data operators: one module per operator, thin queries in ``queries``.

Nothing outside this subpackage imports it.
"""
