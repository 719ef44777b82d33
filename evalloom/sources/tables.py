"""Scans. Paths go to Spark's readers only, so any store that Spark reads will do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def subsets(spark: SparkSession, path: str, names: Sequence[str] | None = None, column: str = "task") -> DataFrame:
    """A Parquet table, stored by task or not, of the wanted tasks; the filter reaches the scan."""
    out = spark.read.parquet(path)
    return out.where(F.col(column).isin(*names)) if names else out


def splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Several tables stacked by name, each with its split."""
    frames = [spark.read.parquet(p).withColumn("split", F.lit(s)) for s, p in paths.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_split(spark: SparkSession, paths: dict[str, str], preferred: str = "train") -> DataFrame:
    """The preferred split if it is there, else the first that is."""
    there = [s for s in ([preferred] if preferred in paths else []) + [s for s in paths if s != preferred] if exists(spark, paths[s])]
    if not there:
        raise FileNotFoundError(f"none of {sorted(paths.values())} exists")
    return spark.read.parquet(paths[there[0]])


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object per line under a declared schema."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.schema(schema).json(path)


def lines_or_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines where the path says so, else Parquet; names with 1m are of a million tokens."""
    out = json_lines(spark, path, schema) if path.endswith(".jsonl") else spark.read.schema(schema).parquet(path)
    if "context_length" in out.columns:
        return out
    return out.withColumn("context_length", F.lit(1_000_000 if "1m" in path.lower() else None).cast("int"))


def categories(df: DataFrame, length: str, tasks: Sequence[str], column: str = "category") -> DataFrame:
    """Rows whose category ends in the length and names a wanted task."""
    task = F.regexp_replace(column, f"_{length}$", "")
    return df.where(F.col(column).endswith(f"_{length}") & task.isin(*tasks)).withColumn("task", task)


def values(spark: SparkSession) -> DataFrame:
    """Two literal rows for smoke runs."""
    rows = [(0, "Paris is the capital of France.", "What is the capital of France?", ["Paris"], "smoke", "", 16), (1, "Two and two make four.", "What do two and two make?", ["four", "4"], "smoke", "", 16)]
    return spark.createDataFrame(rows, "ord int, context string, question string, answer array<string>, task string, answer_prefix string, max_new_tokens int")


def metrics_files(spark: SparkSession, path: str) -> DataFrame:
    """task_scores of JSON metrics files with their path; unreadable files are skipped."""
    raw = spark.read.schema("task_scores map<string, double>, _corrupt_record string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    rows = raw.withColumn("path", F.input_file_name()).where("_corrupt_record is null and task_scores is not null")
    return rows.select("path", F.explode("task_scores").alias("task", "score"))


def newest_files(spark: SparkSession, path: str, name: str = "metrics.json") -> DataFrame:
    """(folder, path): the newest file of a name in each folder below path,
    numbered runs counting as their folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(path).select("path", "modificationTime")
    folder = F.regexp_replace("path", r"(/[0-9]+)?/[^/]*$", "")
    return files.groupBy(folder.alias("folder")).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def pattern_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, column, value) of a tab-separated matrix, values clipped to [0, 1]. The file is one small
    matrix; its lines are numbered inside one task."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: x != "")).alias("row", "line"))
    cells = lines.select("row", F.posexplode(F.split("line", "\t")).alias("column", "v"))
    return cells.select("row", "column", F.least(F.greatest(F.col("v").cast("double"), F.lit(0.0)), F.lit(1.0)).alias("value"))
