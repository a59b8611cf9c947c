"""Query registry and the derived input tables, given once as SQL for both engines."""

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from floodframe.session import configure

TABLES = ("orders", "customer", "part", "lineitem", "events", "embeddings", "labels", "supplier", "nation")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# A fixture is one SELECT valid in Spark and DuckDB, or a (Spark, DuckDB) pair. {names} are tables or fixtures.
FIXTURES: dict[str, str | tuple[str, str]] = {}

_NAME = re.compile(r"\{(\w+)\}")
# DuckDB's date parts are BIGINT, Spark's INT
_DATE_PART = re.compile(r"\b(year|month|day|dayofyear)\(([^()]*(?:\([^()]*\)[^()]*)*)\)")


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that yields the same rows; ``fx_`` names in it resolve to fixtures."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(Inputs(spark, sf_dir))
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = _DATE_PART.sub(r"CAST(\1(\2) AS INT)", with_fixtures(sql))
        return fn
    return add


class Inputs:
    """Tables and fixtures of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir.rstrip("/"), {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = FIXTURES[name]
                text = text if isinstance(text, str) else text[0]
                self._made[name] = self.sql(text)
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        used = set(_NAME.findall(text))
        return self.spark.sql(text, **{n: getattr(self, n) for n in used})


def with_fixtures(sql: str) -> str:
    """Prefix the common table expressions a statement's ``fx_`` names need."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order or name not in FIXTURES:
            return
        text = FIXTURES[name]
        text = text if isinstance(text, str) else text[1]
        for inner in _NAME.findall(text):
            visit(inner)
        order.append(name)

    for name in re.findall(r"\bfx_\w+", sql):
        visit(name)
    if not order:
        return sql.strip()
    made = []
    for name in order:
        text = FIXTURES[name]
        text = text if isinstance(text, str) else text[1]
        made.append(f"{name} AS (\n{_NAME.sub(lambda m: m.group(1), text).strip()}\n)")
    body = sql.strip()
    recursive = "RECURSIVE " if re.match(r"WITH RECURSIVE\b", body, re.I) else ""
    body = re.sub(r"^WITH (RECURSIVE )?", ", ", body, count=1, flags=re.I) if body[:4].upper() == "WITH" else "\n" + body
    return f"WITH {recursive}" + ",\n".join(made) + body


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating-point columns, so results compare across engines; -0 becomes 0."""
    from pyspark.sql import functions as F, types as T

    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def r(expression: str, digits: int = 6) -> str:
    """SQL counterpart of :func:`rounded`."""
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"
