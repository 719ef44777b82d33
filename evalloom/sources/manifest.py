"""The manifest of a sweep: a row for each finished cell, the whole document, and its join with metrics files.

Cells are kept in a table partitioned by ``cell_id``; recording a cell again replaces its partition and no other, so parallel
writers of different cells do not meet. The whole document is rebuilt from the table into a staged file, which then takes the
place of the old one in one step: a reader finds the old document or the new one. A grid is small, as its cells are runs.

Cells are (cell_id, label, ratio, metrics, and what else a writer adds), where metrics is the path of a metrics file. A cell
without a path, or whose file is missing or torn, is kept with its state, and counts as not finished.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col
SCHEMA = "label string, ratio double, metrics string, score double, seconds double, cell_id string"
DOCUMENT = "task_scores map<string, string>, _corrupt_record string"


def record(cells: DataFrame, path: str) -> None:
    """Adds cells to the table at a path, in place of those with the same ids."""
    known = [f.name for f in cells.sparkSession.createDataFrame([], SCHEMA).schema]
    kinds = dict(cells.sparkSession.createDataFrame([], SCHEMA).dtypes)
    full = cells.select(*[(C(c) if c in cells.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in known])
    full.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell_id").parquet(f"{path}/cells")


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """All recorded cells; none where nothing has been recorded."""
    if not _exists(spark, f"{path}/cells"):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(f"{path}/cells")


def rebuild(spark: SparkSession, path: str) -> str:
    """Writes ``manifest.json`` with all cells, by a staged file and a rename, and gives its path."""
    rows = [json.loads(r.cell) for r in recorded(spark, path).orderBy("cell_id").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("cell")).collect()]
    jvm = spark._jvm
    conf, hadoop = spark._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs
    target, staged = hadoop.Path(f"{path}/manifest.json"), hadoop.Path(f"{path}/.manifest-{uuid.uuid4().hex}")
    out = target.getFileSystem(conf).create(staged, True)
    out.write(bytearray(json.dumps({"cells": rows}, indent=2).encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else hadoop.FileSystem.getDefaultUri(conf), conf).rename(staged, target, how)
    return f"{path}/manifest.json"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _folder(path: Column) -> Column:
    """The folder of a file without the scheme of its path, for a comparison."""
    return F.regexp_replace(F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/*", "/"), "/[^/]*$", "")


def results(cells: DataFrame, root: str, name: str = "metrics.json") -> DataFrame:
    """(cell_id, label, ratio, state, task, score): the scores in the metrics file of each cell, read from all files of a name
    (or pattern) below a root. state is ``read``, or ``missing`` or ``unreadable``; a cell without scores has one row without a task."""
    spark = cells.sparkSession
    reader = spark.read.schema(DOCUMENT).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    files = reader.option("pathGlobFilter", name).option("recursiveFileLookup", "true").json(root)
    files = files.select(_folder(F.input_file_name()).alias("_folder"), F.when(C("_corrupt_record").isNull(), C("task_scores")).alias("_scores"), C("_corrupt_record").isNull().alias("_reads"))
    both = cells.select("cell_id", "label", "ratio", _folder(C("metrics")).alias("_folder")).join(files, "_folder", "left")
    state = F.when(C("_reads").isNull(), "missing").when(C("_reads"), "read").otherwise("unreadable")
    listed = both.select("cell_id", "label", "ratio", state.alias("state"), F.explode_outer("_scores").alias("task", "_text"))
    # A score is a number, or an object that holds it.
    score = F.coalesce(C("_text").try_cast("double"), F.get_json_object("_text", "$.score").try_cast("double"))
    return listed.select("cell_id", "label", "ratio", "state", "task", score.alias("score"))


def finished(cells: DataFrame, root: str) -> DataFrame:
    """The cells whose metrics file can be read."""
    return cells.join(results(cells, root).where("state = 'read'").select("cell_id").distinct(), "cell_id", "left_semi")
