"""A message queue as a streaming source: numbered messages in partitions, bounded prefetch, acknowledged after the handler.

publish() writes messages as text files and then one log entry with the files and their rows, so a
message's number in its partition never changes. The source "message_queue" reads numbers: a batch
ends at most `prefetch` messages after the last one in each partition, and Spark writes these
ends to its checkpoint before it reads. A handler that dies gets the same messages again when the query starts anew; the
ends of a finished batch are stored below ack/<group>, from where a new start goes on.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.commit_log import CommitLog

MESSAGE = "partition int, offset long, value string"
PARTITIONS = 8


def publish(messages: DataFrame, path: str, key: str = "key", value: str = "value", partitions: int = PARTITIONS) -> int:
    """Appends messages (key, value) to the queue and returns the log version. Messages of one key go to one partition; a null value is an empty message."""
    spark, at = messages.sparkSession, f"data/{uuid.uuid4().hex}"
    line = F.to_json(F.struct(F.coalesce(F.col(value), F.lit("")).alias("value")))
    rows = messages.select(F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int").alias("queue"), line.alias("line"))
    rows.hint("rebalance", "queue").write.partitionBy("queue").text(f"{path}/{at}")
    names = spark.read.text(f"{path}/{at}").select(F.col("_metadata.file_path").alias("file"))
    written = names.groupBy(F.regexp_extract("file", r"queue=(\d+)/", 1).cast("int").alias("queue"), "file").count().collect()  # one row a file
    files = sorted([r["queue"], f"{at}/queue={r['queue']}/{r['file'].rsplit('/', 1)[1]}", r["count"]] for r in written)
    return CommitLog(spark, f"{path}/log").append({"partitions": partitions, "files": files})


def _open(path: str):
    """(file system, path) for a path with or without a scheme, in Python."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _names(path: str) -> list[str]:
    from pyarrow import fs

    files, own = _open(path)
    return sorted(x.path for x in files.get_file_info(fs.FileSelector(own, allow_not_found=True)) if x.is_file and not x.base_name.startswith((".", "_")))


def _text(path: str, name: str) -> str:
    return _open(path)[0].open_input_stream(name).read().decode()


class Piece(InputPartition):
    def __init__(self, partition: int, first: int, end: int, files: list[tuple[str, int, int]]):
        self.partition, self.first, self.end, self.files = partition, first, end, files


class QueueReader(DataSourceStreamReader):
    def __init__(self, path: str, prefetch: int, group: str):
        if prefetch < 1:
            raise ValueError("prefetch must be at least 1")
        self.path, self.prefetch, self.group = path, prefetch, group
        self.at: dict[str, int] = self._acknowledged()

    def _files(self) -> dict[str, list[tuple[str, int]]]:
        """Files and rows of each partition in the order of the log."""
        found: dict[str, list[tuple[str, int]]] = {}
        for entry in sorted((json.loads(_text(self.path, n)) for n in _names(f"{self.path}/log")), key=lambda e: e["version"]):
            for p in range(entry["partitions"]):
                found.setdefault(str(p), [])
            for p, name, rows in entry["files"]:
                found[str(p)].append((name, rows))
        return found

    def _acknowledged(self) -> dict[str, int]:
        names = _names(f"{self.path}/ack/{self.group}")
        return json.loads(_text(self.path, names[-1])) if names else {}

    def initialOffset(self) -> dict:
        return {p: 0 for p in self._files()}

    def latestOffset(self) -> dict:
        ends = {p: sum(n for _, n in own) for p, own in self._files().items()}
        return {p: max(self.at.get(p, 0), min(n, self.at.get(p, 0) + self.prefetch)) for p, n in ends.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = {p: max(n, self.at.get(p, 0)) for p, n in end.items()}
        pieces = []
        for p, own in self._files().items():
            first, last, at, held = start.get(p, 0), end.get(p, 0), 0, []
            for name, rows in own:
                if at < last and at + rows > first:
                    held.append((name, max(0, first - at), min(rows, last - at)))
                at += rows
            if held:
                pieces.append(Piece(int(p), first, last, held))
        return pieces

    def read(self, partition: Piece) -> Iterator[tuple]:
        number = partition.first
        for name, first, end in partition.files:
            files, _ = _open(self.path)
            root = _open(f"{self.path}/{name}")[1]
            with files.open_input_stream(root) as stream:
                import io

                for i, line in enumerate(io.TextIOWrapper(stream, "utf-8", newline="\n")):
                    if i >= end:
                        break
                    if i >= first:
                        yield partition.partition, number, json.loads(line)["value"]
                        number += 1

    def commit(self, end: dict) -> None:
        files, own = _open(f"{self.path}/ack/{self.group}")
        files.create_dir(own, recursive=True)
        done = sum(end.values())
        with files.open_output_stream(f"{own}/{done:020d}") as out:
            out.write(json.dumps(end).encode())


class MessageQueue(DataSource):
    """Options: path, prefetch (messages of a partition in a batch), group (whose acknowledgements count)."""

    @classmethod
    def name(cls) -> str:
        return "message_queue"

    def schema(self) -> str:
        return MESSAGE

    def streamReader(self, schema) -> QueueReader:
        return QueueReader(self.options["path"], int(self.options.get("prefetch", "1")), self.options.get("group", "default"))


def consume(spark: SparkSession, path: str, prefetch: int = 1, group: str = "default") -> DataFrame:
    """A stream of (partition, offset, value)."""
    spark.dataSource.register(MessageQueue)
    return spark.readStream.format("message_queue").option("path", path).option("prefetch", prefetch).option("group", group).load()
