"""Data-model documents: YAML files listing each task's target models and columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

COLUMNS_SCHEMA = "task_id string, model string, column_name string, description string"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    for pdf in batches:
        rows = []
        for text in pdf["value"]:
            for doc in yaml.safe_load_all(text or ""):
                if not isinstance(doc, dict):
                    continue
                task = doc.get("task_id")
                for model in doc.get("models") or []:
                    for col in model.get("columns") or [{"name": None, "description": None}]:
                        rows.append((task, model.get("name"), col.get("name"), col.get("description")))
        yield pd.DataFrame(rows, columns=["task_id", "model", "column_name", "description"])


def read_data_models(spark: SparkSession, path: str) -> DataFrame:
    """``(task_id, model, column_name, description)`` from every YAML file under ``path``.

    Files are read whole (one row each) and parsed in Python inside the tasks; many
    files spread over many tasks.
    """
    return spark.read.text(path, wholetext=True).mapInPandas(_parse, COLUMNS_SCHEMA)
