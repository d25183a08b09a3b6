"""Sources and sinks beside Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkthrift.operators.requests import dialect_of


def load_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, name, dialect, path, body) of evaluation samples, one JSON object a line.

    Blank lines count as lines but are no samples; a line that is no JSON
    object, or has no body, raises.  ``name`` defaults to sample-<line>.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_at"))
    lines = lines.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("_at"))).where(F.trim("value") != "")
    whole = F.parse_json("value")
    field = lambda n: F.try_variant_get(whole, f"$.{n}", "string")
    body = F.coalesce(F.to_json(F.try_variant_get(whole, "$.body", "variant")), F.raise_error(F.concat(F.lit("no body in line "), F.col("line"))).cast("string"))
    return lines.select("file", "line", F.coalesce(field("name"), F.concat(F.lit("sample-"), F.col("line"))).alias("name"), dialect_of(field("dialect"), field("path")).alias("dialect"), field("path").alias("path"), body.alias("body"))


def assert_joined(cases: DataFrame, verdicts: DataFrame, key: str = "id") -> DataFrame:
    """Every case with its verdict; a case without one raises."""
    rows = cases.join(verdicts.withColumn("_judged", F.lit(True)), key, "left")
    check = F.when(F.col("_judged"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no verdict for "), F.col(key).cast("string"))).cast(cases.schema[key].dataType))
    return rows.withColumn(key, check).drop("_judged")


def read_vectors(blobs: Column) -> Column:
    """array<double> of a little-endian float64 BLOB; null where it is none.

    Each value is rebuilt from its bits by arithmetic, so no Python runs.
    """
    count = F.floor(F.octet_length(blobs) / 8).cast("int")

    def value(i: Column) -> Column:
        hexed = F.hex(F.substring(blobs, i * 8 + 1, F.lit(8)))
        byte = lambda k: F.conv(F.substring(hexed, 15 - 2 * k, 2), 16, 10).cast("int")
        sign = F.when(byte(0) >= 128, -1.0).otherwise(1.0)
        exponent = (byte(0) % 128) * 16 + F.floor(byte(1) / 16)
        fraction = (byte(1) % 16).cast("double")
        for k in range(2, 8):
            fraction = fraction * 256 + byte(k)
        part = fraction / F.lit(float(1 << 52))
        plain = (part + 1) * F.pow(F.lit(2.0), exponent - 1023)
        tiny = part * F.pow(F.lit(2.0), F.lit(-1022.0))
        special = F.when(fraction == 0, float("inf")).otherwise(float("nan"))
        return sign * F.when(exponent == 2047, special).when(exponent == 0, tiny).otherwise(plain)

    return F.when((F.octet_length(blobs) % 8 == 0) & (count > 0), F.transform(F.sequence(F.lit(0), count - 1), value))


def append_events(events: DataFrame, path: str) -> None:
    """Savings events, their stages nested; all columns are kept.  Rows are sorted by tenant inside files, not dealt to a folder each: there may be very many."""
    events.withColumn("tenant", F.coalesce("tenant", F.lit(""))).sortWithinPartitions("tenant").write.mode("append").parquet(path)


def append_evals(verdicts: DataFrame, path: str) -> None:
    """Verdicts of gates (id, kind, score, passed) as ``metrics.evals_recorded`` makes them."""
    verdicts.select("id", "kind", "score", "passed").write.mode("append").parquet(path)


def read_evals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, kind string, score double, passed boolean").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of all versions of the table: columns that older files lack are null, tenant is ''."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    return rows.withColumn("tenant", F.coalesce("tenant", F.lit(""))) if "tenant" in rows.columns else rows.withColumn("tenant", F.lit(""))
