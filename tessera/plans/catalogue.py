"""All registered queries of the core library, with their DuckDB oracles."""

from __future__ import annotations

from tessera.plans import benchmark_queries, catalog_queries, evaluation_queries, matching_queries, review_queries, rules_queries, text_queries, voting_queries  # noqa: F401
from tessera.plans.registry import ENTRIES
from tessera.session import ship_package


def _ready(run):
    def call(spark, sf_dir):
        ship_package(spark)
        return run(spark, sf_dir)

    return call


def queries():
    return {name: _ready(e.run) for name, e in ENTRIES.items()}


def oracle_sql():
    return {name: e.sql for name, e in ENTRIES.items() if e.sql}
