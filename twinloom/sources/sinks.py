"""Sinks: keyed ledgers, CSV, text tables, manifests and frozen configurations."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.runtime import stash


def duplicate_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with the number of rows."""
    return rows.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def write_ledger(rows: DataFrame, path: str, key: Sequence[str], partition: Sequence[str] = ()) -> None:
    """Replace a Parquet ledger as a whole; a repeated key is an error.  The commit protocol makes the write all or nothing."""
    held = stash(rows, "ledger")  # the source may be the ledger itself
    if repeated := duplicate_keys(held, key).limit(3).collect():
        raise ValueError(f"repeated keys: {[tuple(r)[:-1] for r in repeated]}")
    held.sortWithinPartitions(*key).write.mode("overwrite").partitionBy(*partition).parquet(path)


def resume(wanted: DataFrame, ledger: DataFrame, key: Sequence[str]) -> DataFrame:
    """The wanted cells that the ledger doesn't hold yet."""
    return wanted.join(ledger.select(*key).distinct(), list(key), "left_anti")


def read_ledger(spark: SparkSession, path: str, key: Sequence[str], columns: Iterable[str]) -> DataFrame:
    """A ledger with exactly the given columns and no repeated key, else an error."""
    rows = spark.read.parquet(path)
    if set(rows.columns) != set(columns):
        raise ValueError(f"columns differ: {sorted(set(rows.columns) ^ set(columns))}")
    if duplicate_keys(rows, key).limit(1).count():
        raise ValueError("repeated key")
    return rows


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def _cell(v: object) -> str:
    return "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)


def markdown_table(rows: DataFrame, limit: int = 1_000) -> str:
    """A report table as Markdown; more than ``limit`` rows is an error, as reports are small."""
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} rows")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(_cell(v).replace("|", "\\|") for v in r) + " |" for r in got]) + "\n"


_TEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$", "{": r"\{", "}": r"\}"}


def latex_table(rows: DataFrame, limit: int = 1_000) -> str:
    """A report table as LaTeX."""
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} rows")
    line = lambda vs: " & ".join("".join(_TEX.get(c, c) for c in _cell(v)) for v in vs) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(rows.columns)}}}", line(rows.columns), r"\hline", *map(line, got), r"\end{tabular}"]) + "\n"


def read_markdown_table(spark: SparkSession, path: str, first: str) -> DataFrame:
    """The first Markdown table whose header begins with ``first``; repeated rows or ragged lines are an error."""
    header, rows = None, []
    for line in (r.value.strip() for r in spark.read.text(path, wholetext=False).toLocalIterator()):
        cells = [c.strip() for c in line.strip("|").split("|")] if line.startswith("|") else None
        if header is None:
            header = cells if cells and cells[0] == first else None
        elif cells is None:
            break
        elif not all(set(c) <= set("-: ") for c in cells):
            rows.append(tuple(cells))
    if header is None:
        raise ValueError(f"no table begins with {first!r}")
    if len(set(rows)) < len(rows) or any(len(r) != len(header) for r in rows):
        raise ValueError("repeated or ragged rows")
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in header))


def manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, bytes, sha256)`` of files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, paths: str | list[str], expected: DataFrame) -> DataFrame:
    """``(path, problem)`` for each file that is missing, unregistered or changed against ``expected(path, sha256)``."""
    both = manifest(spark, paths).select("path", F.col("sha256").alias("found")).join(expected.select("path", "sha256"), "path", "full")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unregistered").when(F.col("found") != F.col("sha256"), "changed")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def freeze_config(path: str, config: dict) -> bool:
    """Create a configuration file, or check that it holds just this; True if created."""
    text = json.dumps(config, sort_keys=True, ensure_ascii=False, allow_nan=False) + "\n"
    file = Path(path)
    try:
        with file.open("x", encoding="utf-8") as f:
            f.write(text)
        return True
    except FileExistsError:
        if file.read_text(encoding="utf-8") != text:
            raise ValueError(f"another configuration is frozen at {path}") from None
        return False


def reserve_run(root: str, name: str) -> str:
    """Make and return a run directory that did not exist, with a number where the name is taken."""
    for n in range(1, 10_000):
        path = Path(root) / (name if n == 1 else f"{name}-{n:03d}")
        try:
            path.mkdir(parents=True)
            return str(path)
        except FileExistsError:
            continue
    raise ValueError(f"no free name for {name} under {root}")


def writable(path: str, protected: Iterable[str]) -> str:
    """The path, unless it lies in a protected tree."""
    p = Path(path).resolve()
    if any(p.is_relative_to(Path(x).resolve()) for x in protected):
        raise ValueError(f"{path} is protected")
    return path
