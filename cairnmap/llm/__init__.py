"""Operators for preparing training data for language models.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()``
in :mod:`cairnmap.llm.registry` are what the entry module adds.
"""
