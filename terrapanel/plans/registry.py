"""Registry of the panel queries and of their SQL counterparts.

Every query module registers a callable ``(spark, sf_dir) -> DataFrame`` under
its inventory id, with the SQL that gives the same rows where SQL can.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.functions.numeric import exact_mean

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: add a query under ``name``, with its SQL if there is one."""

    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = query
        if sql is not None:
            _ORACLE[name] = sql
        return query

    return add


def oracle_of(name: str) -> str:
    """The SQL of a query that is registered already."""
    return _ORACLE[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a small file, which one task would scan and work on alone, dealt to all tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


PANEL_SQL = """panel AS (
  SELECT o_custkey AS unit_id, CAST(year(o_orderdate) AS INT) AS year, avg(o_totalprice) AS value, CAST(count(*) AS BIGINT) AS n
  FROM orders GROUP BY 1, 2)"""


def two_sided_p_sql(z: str) -> str:
    """P(|N| > |z|) in SQL: the series of the error function that has positive terms only."""
    x = f"(abs({z}) / sqrt(2.0))"
    term = f"exp(2 * k * ln(2.0) + (2 * k + 1) * ln({x}) + lgamma(k + 1.0) - lgamma(2 * k + 2.0) - {x} * {x})"
    return f"CASE WHEN {z} = 0 THEN 1.0 WHEN abs({z}) > 10 THEN 0.0 ELSE greatest(0.0, 1 - 2 / sqrt(pi()) * list_sum([{term} FOR k IN range(0, 400)])) END"


def student_two_sided_p_sql(t: str, df: str) -> str:
    """P(|T| > |t|) in SQL: Simpson's rule over the angle whose tangent is t / sqrt(df)."""

    def simpson(low: str) -> str:
        return f"list_sum([CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos({low} + (pi() / 2 - {low}) * i / 1000), {df} - 1) FOR i IN range(0, 1001)]) * (pi() / 2 - {low})"

    angle = f"atan(abs({t}) / sqrt({df}))"
    return f"({simpson(angle)}) / ({simpson('0.0')})"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units (customers) by years: mean order value and number of orders."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_custkey").alias("unit_id"), F.year("o_orderdate").alias("year")).agg(exact_mean(F.col("o_totalprice")).alias("value"), F.count("*").alias("n"))


def _load() -> None:
    from terrapanel.plans import aggregates, columns, inout, joins, sampling, spatial, statistics, windows  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
