"""Operators of a training-data pipeline: duplicates, language, quality,
language-model scores, packing, mixing, token counts, link trust, fingerprints.

Each module holds one operator with a general interface; ``queries`` derives
the registered queries from them. Nothing outside this package imports it.
"""
