"""All registered queries outside of the optional subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import index_queries, problems, search_queries

QUERIES = {**problems.QUERIES, **index_queries.QUERIES, **search_queries.QUERIES}
ORACLES: dict[str, str] = {**index_queries.ORACLES, **search_queries.ORACLES}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return search_queries.QUERIES["o70_results"](spark, folder)
