"""Registration and the shared rounding rule: every double is compared at six decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from .views import Views, sql_views

QUERIES: dict = {}
ORACLES: dict = {}


def round6(df: DataFrame) -> DataFrame:
    """Round doubles to six decimals; adding zero turns a negative zero into zero."""
    return df.select(*[
        (F.round(F.col(f.name), 6) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def r(expr: str) -> str:
    return f"(round(({expr})::DOUBLE, 6) + 0)"


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(views) -> DataFrame``; ``views`` names the SQL views the twin reads."""

    def register(fn):
        def run(spark, sf_dir):
            return round6(fn(Views(spark, sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql_views(*views.split()) + sql
        return fn

    return register
