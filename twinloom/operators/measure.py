"""Measurements and transforms of code, once per distinct snippet, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.functions import transforms
from twinloom.functions.codestyle import LANGUAGES, style_vector
from twinloom.functions.lexical import analyze


def distinct_code(records: DataFrame, columns: list[str]) -> DataFrame:
    """``(language, sha, code)``: each snippet of ``columns`` once per language; null code or language is left out."""
    snippets = records.select("language", F.explode(F.array(*columns)).alias("code")).where("code is not null and language is not null")
    return snippets.withColumn("sha", F.sha2("code", 256)).dropDuplicates(["language", "sha"]).select("language", "sha", "code")


def measured(snippets: DataFrame) -> DataFrame:
    """``(language, sha, style, enhanced, parse_ok, backend, fallback_reason)`` of ``snippets(language, sha, code)`` in a known language."""
    schema = "language string, sha string, style array<double>, enhanced array<double>, parse_ok boolean, backend string, fallback_reason string"

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for lang, sha, code in zip(*(c.to_pylist() for c in b.columns), strict=True):
                a = analyze(code, lang)
                rows.append((lang, sha, style_vector(code, lang), a.values, a.parse_ok, a.backend, a.fallback_reason))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.string(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.bool_(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["language", "sha", "style", "enhanced", "parse_ok", "backend", "fallback_reason"])

    return snippets.where(F.col("language").isin(*LANGUAGES)).select("language", "sha", "code").mapInArrow(run, schema)


def cached(snippets: DataFrame, path: str) -> DataFrame:
    """``measured`` kept in a Parquet cache at path: only snippets that the cache doesn't hold are measured and added.

    The key is (language, sha), so equal code is measured once over all runs.
    """
    spark = snippets.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    wanted = snippets.select("language", "sha")
    new = snippets.join(spark.read.parquet(path).select("language", "sha"), ["language", "sha"], "left_anti") if there else snippets
    measured(new).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(wanted, ["language", "sha"], "left_semi")


def attacked(snippets: DataFrame, attacks: tuple[str, ...] = transforms.ATTACKS) -> DataFrame:
    """One row per snippet and transform with its audit (long form of the attack axis)."""
    names = transforms.Applied._fields
    kinds = {"changed": "boolean", "transform_count": "int", "parse_ok_before": "boolean", "parse_ok_after": "boolean"}
    arrow = {"boolean": pa.bool_(), "int": pa.int32(), "string": pa.string()}
    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [transforms.apply(code, lang, a) for lang, code in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for a in attacks]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, arrow[kinds.get(n, "string")]) for n, c in zip(names, cols, strict=True)], list(names))

    return snippets.where(F.col("language").isin(*LANGUAGES)).select("language", "code").mapInArrow(run, schema)


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts; 0 for none."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.aggregate(counts, F.lit(0.0), lambda a, x: a - (x / total) * F.log2(x / total)), F.lit(0.0))


def representation(human: Column, candidate: Column, kind: str, eps: float = 1e-8) -> Column:
    """concat (2k), delta (k), concat_delta (3k) or full (4k, with the delta relative to |human| + eps)."""
    if eps <= 0 or eps != eps or eps == float("inf"):
        raise ValueError("eps must be positive and finite")
    delta = F.zip_with(candidate, human, lambda c, h: c - h)
    relative = F.zip_with(delta, human, lambda d, h: d / (F.abs(h) + F.lit(eps)))
    parts = {"concat": [human, candidate], "delta": [delta], "concat_delta": [human, candidate, delta], "full": [human, candidate, delta, relative]}
    return F.concat(*parts[kind])


#: Ablation variants: measurements used and representation.
VARIANTS = {"A0": (10, "concat"), "A1": (10, "concat_delta"), "A2": (28, "concat"), "A3": (28, "delta"), "A4": (28, "concat_delta"), "A5": (28, "full")}


def variant(human: Column, candidate: Column, name: str) -> Column:
    k, kind = VARIANTS[name]
    return representation(F.slice(human, 1, k), F.slice(candidate, 1, k), kind)
