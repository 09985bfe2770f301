"""Operators of a training-data pipeline: deduplication, extraction, scoring, mixing, tokens, search and chat.

Each module holds one operator with its own general interface; ``queries`` holds
the thin registered queries.  Nothing outside this package imports it.
"""
