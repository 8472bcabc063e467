"""Lazy access to the input tables and their model views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import adapters
from ..session import cut_lineage


# Tables with long texts and their keys.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give text work to every core when a table comes in fewer files than there are cores.

    Large tables have many splits and pass through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


# Rows of a table that one task orders by key, on average.
TASK_ROWS = 1 << 19


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a table over tasks by key, before a window over that key.

    The number of tasks follows the number of rows: narrow rows compress well, and partitions that are joined up by
    their compressed size would bring a task many times that size.
    """
    return df.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS)), key)


class Tables:
    """``tables.part`` reads a Parquet table, ``tables.symbols`` the model view ``m_symbols``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            if name in adapters.BASE:
                df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
                self._seen[name] = spread(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df
            elif f"m_{name}" in adapters.MODELS:
                self._seen[name] = self._model(f"m_{name}")
            else:
                raise AttributeError(name)
        return self._seen[name]

    def kept(self, name: str) -> DataFrame:
        """A model view that a query reads several times, written once to the shared folder."""
        if f"{name}#" not in self._seen:
            self._seen[f"{name}#"] = cut_lineage(getattr(self, name))
        return self._seen[f"{name}#"]

    def _model(self, model: str) -> DataFrame:
        sql = adapters.MODELS[model](adapters.SPARK)
        inputs = {}
        for name in adapters.referenced(sql, adapters.BASE) + adapters.referenced(sql, adapters.MODELS):
            if not re.search(rf"(?i)\b(from|join)\s+{name}\b", sql):
                continue
            sql = re.sub(rf"(?i)\b(from|join)\s+{name}\b", rf"\1 {{{name}}}", sql)
            inputs[name] = getattr(self, name[2:] if name.startswith("m_") else name)
            if name == "lineitem" and re.search(r"(?i)partition by l_orderkey\b", sql):
                if "lineitem#" not in self._seen:
                    self._seen["lineitem#"] = dealt(inputs[name], "l_orderkey")
                inputs[name] = self._seen["lineitem#"]
        return self.spark.sql(sql, **inputs)
