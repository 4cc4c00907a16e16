"""Operators for large text corpora: deduplication, filters, decontamination, tokens.

Each module holds one operator with its general interface; ``queries`` registers one query per
operator and ``oracle`` its SQL. Nothing outside this subpackage imports it.
"""
