"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; deleting the folder leaves the rest of
the library whole.
"""
