"""Operators for large text corpora: deduplication, filtering, extraction, tokenising.

Each module holds one operator and its query (registered in ``tidepool.llm.suite``). Nothing
outside this package imports it.
"""
