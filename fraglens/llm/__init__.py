"""Training-data operators.

Nothing outside this subpackage imports it; the repository works without it.
"""
