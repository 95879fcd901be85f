"""Numbered log entries, each made by one writer alone, in any file system that Spark reaches."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class CommitLog:
    """Entries are files <path>/<version>, one line of JSON. The file system refuses to create a file that is there, so two writers never share a version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def files(self, path: str):
        """(file system, path) of the JVM."""
        own = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return own.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), own

    def entries(self) -> list[dict]:
        fs, log = self.files(self.path)
        if not fs.exists(log):
            return []
        return sorted((json.loads(r[0]) for r in self.spark.read.text(self.path, wholetext=True).collect()), key=lambda e: e["version"])

    def append(self, entry: dict) -> int:
        version = max((e["version"] for e in self.entries()), default=0)
        while True:
            version += 1
            fs, to = self.files(f"{self.path}/{version:020d}")
            try:
                out = fs.create(to, False)
            except Exception:
                if not fs.exists(to):
                    raise
                continue  # the number is taken
            out.write(bytearray(json.dumps({"version": version} | entry).encode()))
            out.close()
            return version
