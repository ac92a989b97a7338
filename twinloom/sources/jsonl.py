"""JSON lines: strict scan and reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("human_src", "llm_src", "label")
RECORD = "human_src string, llm_src string, label int, paraphrased_by string, file_name string, human_file_name string, llm_file_name string"


def line_status(line: Column) -> Column:
    """blank, not json, not an object, missing field or record; null counts as blank."""
    parsed = F.try_parse_json(line)
    missing = F.lit(False)
    for k in REQUIRED:
        missing = missing | F.isnull(F.try_variant_get(parsed, f"$.{k}", "string"))
    return (
        F.when(F.coalesce(F.trim(line), F.lit("")) == "", "blank")
        .when(parsed.isNull(), "not json")
        .when(~F.schema_of_variant(parsed).startswith("OBJECT"), "not an object")
        .when(missing, "missing field")
        .otherwise("record")
    )


def scan_lines(lines: DataFrame) -> DataFrame:
    """Adds ``status`` to ``lines(..., line)``."""
    return lines.withColumn("status", line_status(F.col("line")))


def source_id(task: str = "task1") -> Column:
    """Human source: human_file_name for label 0 of task1, else file_name."""
    if task not in ("task1", "task2"):
        raise ValueError(f"unknown task: {task!r}")
    own = F.col("file_name")
    return F.when(F.col("label") == 0, F.col("human_file_name")).otherwise(own) if task == "task1" else own


def read_pairs(spark: SparkSession, path: str, task: str = "task1") -> DataFrame:
    """Pair records of a JSON-lines file with ``human_source_id`` and ``row_sha256`` of the line; any line that is no record is an error that names it."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    flagged = scan_lines(lines)
    bad = flagged.where("status <> 'record'").select("status", F.substring("line", 1, 60).alias("head")).limit(3).collect()  # for the message
    if bad:
        raise ValueError("; ".join(f"{r.status}: {r['head']!r}" for r in bad))
    parsed = lines.select(F.from_json("line", RECORD).alias("r"), F.sha2("line", 256).alias("row_sha256")).select("r.*", "row_sha256")
    return parsed.withColumn("human_source_id", source_id(task))
