"""All queries of the engine by name, with the SQL that each must equal."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from cladelake.plans import operator_queries, relational
from cladelake.plans.fixtures import duck, run


def _run_text(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return run(spark, sf_dir, sql)


QUERIES = {k: partial(_run_text, sql=v) for k, v in relational.TEXTS.items()} | operator_queries.QUERIES
ORACLE_SQL = {k: duck(relational.DUCK.get(k, v)) for k, v in relational.TEXTS.items()} | {k: duck(v) for k, v in operator_queries.SQL.items()}
FLAGSHIP = "slice_shares"
