"""Operators for preparing training text: extraction, filters, scores, duplicates, tokens.

Each operator takes and returns DataFrames and lives in a module of its own;
``queries`` registers one query per operator. Nothing outside this subpackage imports it.
"""
