"""How a query and its DuckDB equivalent start from the same rows: relations are SQL text over {table} names."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables(NamedTuple):
    """The given tables and relations derived from them by SQL that both engines read alike."""

    spark: SparkSession
    sf_dir: str

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        names = set(re.findall(r"\{(\w+)\}", text))
        text = re.sub(r"\{\{(\w+)\}\}", r"{\1}", text.replace("{", "{{").replace("}", "}}"))
        return self.spark.sql(text, **{n: self[n] for n in names}) if names else self.spark.sql(text.replace("{{", "{").replace("}}", "}"))


def duck(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


def query(oracle: str | None = None):
    """Registers a function of Tables under its name, with its SQL (tables in braces)."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if oracle:
            ORACLES[f.__name__] = duck(oracle)
        return f

    return register


def folder(t: Tables) -> str:
    """A new folder below spark.checkpoint.dir; without that setting only one machine (a local master) has a place for it."""
    root = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.sparkContext.getCheckpointDir()
    if not root:
        if not t.spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/store-{uuid.uuid4().hex}"
