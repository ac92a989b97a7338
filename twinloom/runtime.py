"""Session-level helpers: durable intermediate tables and function shipping.

Long or iterative plans cut their lineage by writing a table into the folder
that ``spark.checkpoint.dir`` names (shared by all executors), so a lost
executor never loses an intermediate result.  Nothing here keeps data on one
machine: where the setting is absent (tests), a folder is made and set.
"""

from __future__ import annotations

import atexit
import re
import shutil
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules["twinloom"])  # executors need no copy of the package


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, as set in the session or on the context.

    Where neither is set, a fresh one is made and set if the master is local; on a
    cluster that is an error, as a folder of one machine would lose data.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_twinloom_dir", None)
    if not folder:
        there = sc._jsc.sc().getCheckpointDir()
        folder = there.get() if there.isDefined() else None
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="twinloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = "file://" + own
        sc.setCheckpointDir(folder)
        sc._twinloom_dir = folder
    return folder.rstrip("/")


def _stash_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stash-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = f"{_stash_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that no later plan reads."""
    for t in tables:
        if path := getattr(t, "_stash_path", None):
            _delete(t.sparkSession, path)


def discard_all(spark: SparkSession) -> None:
    """Delete all stashed tables of this application, once no result of it is read any more."""
    _delete(spark, _stash_root(spark))


def shuffle_width(spark: SparkSession) -> int:
    """Configured number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_BLANKS = " \t\n\x0b\f\r"


def _stripped(c: Column) -> Column:
    return F.btrim(F.lower(c), F.lit(_BLANKS))


def norm_digest(c: Column) -> Column:
    """Digest without notation: letter case, a leading ``sha256:`` and blanks don't count; empty is null."""
    bare = _stripped(c)
    bare = F.when(bare.startswith("sha256:"), F.ltrim(F.substring(bare, 8, 1 << 30), F.lit(_BLANKS))).otherwise(bare)
    return F.when(F.length(bare) > 0, bare)


def norm_origin(c: Column) -> Column:
    """Relative path without notation: case, slash kind, doubled slashes, leading ``./`` and blanks don't count."""
    path = F.translate(_stripped(c), "\\", "/")
    path = F.when(F.contains(path, F.lit("//")), F.regexp_replace(path, "/+", "/")).otherwise(path)  # rare, so no pattern is run on the rest
    path = F.when(path.startswith("./"), F.regexp_replace(path, r"^(\./)+", "")).otherwise(path)
    return F.when(F.length(path) > 0, path)
