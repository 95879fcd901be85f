"""The shared folder for tables that the library writes on its own account."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL = ""


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local master gets a temporary one; a cluster has to name one that all executors share."""
    global _LOCAL
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = _LOCAL = _LOCAL or tempfile.mkdtemp(prefix="shotloom-")
    return root


def fresh(df, stem: str) -> str:
    """A column name beginning with stem that df doesn't have, whatever the case."""
    held = {c.lower() for c in df.columns}
    while stem.lower() in held:
        stem += "_"
    return stem


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/shotloom-{name}/{uuid.uuid4().hex}"


def written(df, name: str):
    """Writes df to a new folder of the shared one and reads it back, so a lost executor never means computing it again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
