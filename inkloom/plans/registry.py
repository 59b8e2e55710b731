"""All queries of the reference's operators, with their SQL where SQL can state them."""

from __future__ import annotations

from inkloom.plans import extra, pairs, sql  # noqa: F401


def _same(name: str):
    def run(spark, sf_dir):
        return sql.run(spark, sf_dir, sql.SAME[name])

    run.__name__ = name
    return run


def queries() -> dict:
    return {name: _same(name) for name in sql.SAME} | pairs.QUERIES


def oracle_sql() -> dict[str, str]:
    return sql.SAME | pairs.SQL
