"""Where queries and the SQL that checks them are listed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.views import NOW, PRELUDE, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``build(views)`` under ``name``.

    ``sql`` is what follows the views' WITH list: a SELECT, or a comma and further parts. ``$now`` stands for the fixed
    time.
    """

    def register(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        if sql:
            body = sql.strip().replace("$now", f"TIMESTAMP '{NOW}'")
            ORACLES[name] = PRELUDE + ("\n" if not body.startswith(",") else "") + body
        return build

    return register
