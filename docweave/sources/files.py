"""File readers and writers: manifests, verified artefacts, texts, reports and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import safe_csv


def read_manifest(spark: SparkSession, path: str, columns: list[str], key: str, domains: dict[str, list[str]] | None = None) -> DataFrame:
    """A CSV manifest with exactly ``columns``; its key must be filled and unique, ``domains`` closed, and it must not be empty."""
    rows = spark.read.csv(path, header=True, enforceSchema=False)
    if rows.columns != columns:
        raise ValueError(f"columns are {rows.columns}, not {columns}")
    odd = [F.count_if(~F.coalesce(F.col(c).isin(values), F.lit(False))).alias(f"odd {c}") for c, values in (domains or {}).items()]
    checks = rows.agg(F.count("*").alias("n"), F.count_distinct(key).alias("different"), *odd).first().asDict()
    if not checks.pop("n") or rows.count() != checks.pop("different") or any(checks.values()):
        raise ValueError(f"the manifest is empty, has repeated keys, or values outside their domains: {checks}")
    return rows


def verify_artifacts(manifest: DataFrame, root: str) -> DataFrame:
    """``manifest`` (``path``, ``sha256``) with ``status``: OK, HASH, MISSING, or ESCAPES for paths out of the root."""
    spark = manifest.sparkSession
    safe = ~F.rlike("path", F.lit(r"(^|/)\.\.(/|$)|^/"))
    base = _qualified(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inside = files.where(F.startswith("path", F.lit(f"{base}/")))
    named = inside.select(F.substring("path", len(base) + 2, 1 << 20).alias("path"), F.sha2("content", 256).alias("actual"))
    joined = manifest.join(named, "path", "left")
    return joined.withColumn("status", F.when(~safe, "ESCAPES").when(F.col("actual").isNull(), "MISSING").when(F.col("actual") == F.lower("sha256"), "OK").otherwise("HASH"))


def _qualified(spark: SparkSession, path: str) -> str:
    """A folder's full name on its file system, as the file sources write it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``id`` (file name without suffix) and ``text`` of plain-text files."""
    rows = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return rows.select(F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("id"), "text")


def scan_images(spark: SparkSession, folder: str, most: int = 10 * 1024 * 1024) -> DataFrame:
    """``path``, ``length``, ``kind`` of files: the kind from their first bytes, null if unknown or over ``most`` bytes.

    Files over ``most`` are listed and not read.
    """
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rows = every.where(F.col("length") <= most)
    head = F.hex(F.substring("content", 1, 8))
    kind = F.when(F.startswith(head, F.lit("FFD8FF")), "image/jpeg").when(F.startswith(head, F.lit("89504E470D0A1A0A")), "image/png").when(F.startswith(head, F.lit("25504446")), "application/pdf")
    large = every.where(F.col("length") > most).select("path", "length", F.lit(None).cast("string").alias("kind"))
    return rows.select("path", "length", kind.alias("kind")).unionByName(large)


def write_once(df: DataFrame, path: str, *partition: str) -> None:
    """Parquet that is never overwritten: a second write fails."""
    df.write.mode("errorifexists").partitionBy(*partition).parquet(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """A report as JSON lines with sorted keys, in one file; reports are small aggregates and hold no NaN."""
    numbers = [f.name for f in metrics.schema.fields if f.dataType.typeName() in ("double", "float")]
    odd = metrics.where(" or ".join(f"isnan(`{c}`)" for c in numbers)).isEmpty() if numbers else True
    if not odd:
        raise ValueError("a report holds NaN")
    metrics.select(F.to_json(F.struct(*sorted(metrics.columns))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_tables(tables: dict[str, DataFrame], path: str, form: str = "csv") -> None:
    """Linked tables side by side as CSV (formulas made harmless) or JSON lines."""
    for name, df in tables.items():
        if form == "csv":
            plain = df.select(*[safe_csv(F.col(c).cast("string")).alias(c) for c in df.columns])
            plain.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/{name}")
        else:
            df.write.mode("overwrite").json(f"{path}/{name}")
