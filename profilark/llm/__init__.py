"""Operators for large text corpora: media columns, deduplication, scans, language ID, mixing.

Nothing outside this folder imports it.  Operators keep general interfaces; the
thin ``opN_*`` queries live in :mod:`profilark.llm.queries`.
"""
