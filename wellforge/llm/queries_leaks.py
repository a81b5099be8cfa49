"""Registered query on leaked evaluation texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wellforge.llm.leaks import leaked_passages
from wellforge.session import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "test_items")).filter("kind = 'leak'").select("doc_id", "item_id")


QUERIES = {"p6_found": p6_found}
ORACLES: dict[str, str] = {}
