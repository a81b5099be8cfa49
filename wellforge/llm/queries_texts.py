"""Registered queries on mixing sources and on sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wellforge.llm.mixing import counted_once, mix, shares
from wellforge.llm.sentences import sentences
from wellforge.session import table


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(counted_once(table(spark, sf_dir, "documents")), table(spark, sf_dir, "source_weights"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(p7_mix(spark, sf_dir), table(spark, sf_dir, "source_weights"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"))


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found}
ORACLES: dict[str, str] = {}
