"""Operators for large training corpora.

Nothing else in the library imports this subpackage.  ``queries()`` and
``oracle_sql()`` gather what each module registers.
"""

from __future__ import annotations

from importlib import import_module

_MODULES = ("bestfit", "simhash", "decontam", "substring", "toxicity", "warc", "hmm", "quality", "media", "token_matrix", "bpe", "resample", "trie")


def _collect(name: str) -> dict:
    found: dict = {}
    for module in _MODULES:
        found.update(getattr(import_module(f"{__name__}.{module}"), name))
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE_SQL")
