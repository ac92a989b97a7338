"""Plain forms of code texts, made in Arrow batches."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_DROP = bytes(set(range(256)) - set(b"abcdefghijklmnopqrstuvwxyz0123456789"))
KEYS = "record_id bigint, hk binary, lk binary"


def plain(s: str | None) -> bytes:
    """Lower-case text with everything but a-z and 0-9 removed; empty for null."""
    return s.lower().encode("utf-8", "surrogatepass").translate(None, _DROP) if s else b""


def parse_line(line: str | None) -> tuple[str, str] | None:
    """(human_src, llm_src) of a JSON object line; None for blank lines, no JSON, no object, or texts missing or not strings."""
    try:
        x = json.loads(line or "")
    except (ValueError, RecursionError):
        return None
    if not isinstance(x, dict):
        return None
    h, m = x.get("human_src"), x.get("llm_src")
    return (h, m) if isinstance(h, str) and isinstance(m, str) else None


def key(p: bytes) -> bytes:
    return hashlib.blake2b(p, digest_size=16).digest()


def _pairs(batch: pa.RecordBatch) -> Iterator[tuple[int, str | None, str | None]]:
    if batch.num_columns == 2:
        for i, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield i, *(parse_line(line) or (None, None))
    else:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def record_keys(df: DataFrame) -> DataFrame:
    """``(record_id, hk, lk)``: 128-bit keys of both plain forms, for records where neither is empty.

    ``df`` has record_id and either human_src and llm_src, or one JSON line.
    """

    def run(batches):
        for b in batches:
            rows = [(i, key(h), key(m)) for i, hs, ms in _pairs(b) if i is not None and (h := plain(hs)) and (m := plain(ms))]
            i, h, m = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(h, pa.binary()), pa.array(m, pa.binary())], ["record_id", "hk", "lk"])

    return df.mapInArrow(run, KEYS)


