"""Operators for preparing large training corpora, one module each.

Nothing outside this subpackage imports it, so it can be removed as a whole.
Every operator selects the columns it needs by parameter before it does anything
else: extra columns of the input, whatever their names, cannot clash with its own.
"""
