"""Where plans register themselves, each with the SQL that gives the same rows."""

from __future__ import annotations

from tesserae.runtime import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The input tables as attributes: ``t.orders``."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str):
        return table(self.spark, self.sf_dir, name)


def plan(sql: str | None = None):
    """Registers ``f(t)`` under its name, with the DuckDB SQL of its result."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register
