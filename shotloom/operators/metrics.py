"""Metric rollups: counters, cumulative histograms, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the payload size histogram, in bytes. Fixed values.
BOUNDS = (64, 256, 1024, 4096, 16384, 65536, 262144, 1048576)


def counters(samples: DataFrame, *labels: str) -> DataFrame:
    return samples.groupBy(*labels).agg(F.count("*").alias("n"))


def histogram(samples: DataFrame, label: str, value: Column, bounds=BOUNDS) -> DataFrame:
    """(label, le, n): cumulative counts; the last bound is infinity. One aggregate a bound, no explode before the shuffle."""
    sums = samples.groupBy(label).agg(*(F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)), F.count("*").alias("all"))
    rows = F.array(*(F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    return sums.select(label, F.explode(rows).alias("x")).select(label, "x.*")


def exposition(name: str, kind: str, samples: DataFrame, help_text: str = "") -> DataFrame:
    """(place, line): the text form of a metric from samples (labels as columns, n). A histogram's samples have le, and sum and count lines come from its column total.

    Lines are ordered by place; labels are escaped and sorted by name. Counters end in _total.
    """
    full = f"{name}_total" if kind == "counter" and not name.endswith("_total") else name
    labels = sorted(c for c in samples.columns if c not in ("n", "total"))
    escaped = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    tags = lambda names: F.array_join(F.array(*(F.concat(F.lit(f'{c}="'), F.coalesce(escaped(c), F.lit("")), F.lit('"')) for c in names)), ",") if names else F.lit("")
    line = lambda suffix, names, v: F.concat(F.lit(full + suffix), F.when(F.lit(bool(names)), F.concat(F.lit("{"), tags(names), F.lit("}"))).otherwise(""), F.lit(" "), v.cast("string"))
    spark = samples.sparkSession
    head = spark.createDataFrame([("0", f"# HELP {full} {help_text or name}"), ("1", f"# TYPE {full} {kind}")], "place string, line string")
    bucket = F.lpad(F.coalesce(F.col("le").try_cast("double").cast("long").cast("string"), F.lit("~")), 20, "0") if "le" in labels else F.lit("")
    rest = [c for c in labels if c != "le"]
    key = F.concat(F.lit("2"), tags(rest), F.lit("\x01"))
    own = samples.select(F.concat(key, F.when(F.lit("le" in labels) & (F.col("le") == "+Inf") if "le" in labels else F.lit(False), "~").otherwise(bucket)).alias("place"), line("_bucket" if kind == "histogram" else "", labels, F.col("n")).alias("line"))
    out = head.unionByName(own)
    if kind == "histogram" and "total" in samples.columns:
        ends = samples.where("le = '+Inf'")
        out = out.unionByName(ends.select(F.concat(key, F.lit("~~1")).alias("place"), line("_sum", rest, F.col("total")).alias("line"))).unionByName(ends.select(F.concat(key, F.lit("~~2")).alias("place"), line("_count", rest, F.col("n")).alias("line")))
    return out


def exposed(*parts: DataFrame) -> str:
    """The whole text of some metrics' lines, for a scrape; their number is that of the label values."""
    return "".join(f"{r.line}\n" for p in parts for r in p.orderBy("place").collect())


def health(checks: DataFrame, group: str) -> DataFrame:
    """A required check that fails makes the group unhealthy, another one degraded."""
    return checks.groupBy(group).agg(F.when(F.bool_or(F.col("required") & ~F.col("healthy")), "unhealthy").when(F.bool_or(~F.col("healthy")), "degraded").otherwise("healthy").alias("status"))
