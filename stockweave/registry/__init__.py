"""Named queries over the driver tables, each with its check SQL where SQL can say it."""

from stockweave.registry import base, documents, gating, integrity, listings, people, reports, scans  # noqa: F401


def all_queries():
    return dict(base.QUERIES)


def all_checks():
    return dict(base.CHECKS)
