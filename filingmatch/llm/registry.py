"""All queries of the corpus operators and their check SQL."""

from __future__ import annotations

from . import queries as Q


def queries() -> dict:
    return dict(Q.QUERIES)


def checks() -> dict:
    return dict(Q.CHECKS)
