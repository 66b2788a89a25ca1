"""Operators for preparing training corpora: dedup, language, licence, mixing, token and LM statistics.

Nothing else in the package imports this subpackage; it can be removed whole.
"""
