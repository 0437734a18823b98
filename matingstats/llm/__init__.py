"""Operators of a training-data pipeline: decontamination, deduplication, scoring,
scanning, formatting and tokenising of text tables.

Nothing outside this subpackage imports it. ``queries.py`` holds the thin queries
``opN_<name>`` and ``sql.py`` their DuckDB counterparts.
"""
