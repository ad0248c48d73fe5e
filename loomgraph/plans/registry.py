"""All queries over the data folder, by name, and the SQL that checks them."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

MODULES = ("q_text", "q_records", "q_graph", "q_relations", "q_retrieval", "q_more", "q_extra", "q_texts", "q_routing", "q_whole", "q_rows")


def _modules():
    return [importlib.import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.SQL.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return queries()["cmp4_documents_per_concept"](spark, folder)
