"""Operators for preparing training corpora: one module per operator, queries and their SQL in ``queries``."""
