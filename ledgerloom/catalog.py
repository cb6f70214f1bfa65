"""All ledger queries, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from ledgerloom.plans import analytics, classify, commands, display, extraction, mail, matching, relational, rules, statements, streams  # noqa: F401
from ledgerloom.plans.registry import ORACLES, QUERIES  # noqa: F401
