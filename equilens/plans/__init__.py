"""Queries over the driver tables, each with an SQL oracle where SQL can express it."""

from . import audit, design, fairness, meta, report, streams, tables, temporal, uncertainty  # noqa: F401

QUERIES, ORACLES = audit.QUERIES, audit.ORACLES
