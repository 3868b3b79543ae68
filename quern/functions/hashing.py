"""Stable hashing: SQL forms (default) and byte-exact BLAKE2b forms as Arrow functions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def seeded(*parts: Column | str | int) -> Column:
    """A uniform 60-bit number from its parts: the first 15 hex digits of the md5 of their '|'-joined text."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(c.cast("string") for c in cols))), 1, 15), 16, 10).cast("long")


def seeded_md5(*parts: Column | str | int) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *(c.cast("string") for c in cols)))


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def unit_seed(seed: int, profile: str, unit: str) -> int:
    return int.from_bytes(hashlib.blake2b(canonical_json([seed, profile, unit]).encode(), digest_size=8).digest(), "big")


def normal_path(path: str) -> str:
    """A relative path with slashes; absolute and empty paths, and those with a .. in them, are errors."""
    out = path.replace("\\", "/")
    if not out or out.startswith("/") or ".." in out.split("/"):
        raise ValueError(f"bad path {path!r}")
    return out


def row_id(release: str, path: str, row: int, person: bytes) -> bytes:
    """16 bytes that name a physical row: BLAKE2b, personalised, of release and normal path, each after its length in 4 bytes,
    and the row in 8, all big-endian. person is that of the dataset whose ids are wanted."""
    parts = [x.encode() for x in (release, normal_path(path))]
    framed = b"".join(len(x).to_bytes(4, "big") + x for x in parts)
    return hashlib.blake2b(framed + row.to_bytes(8, "big"), digest_size=16, person=person).digest()


def shard_id(path: str, person: bytes) -> bytes:
    """8 bytes that name a shard: personalised BLAKE2b of its path as the catalogue has it."""
    return hashlib.blake2b(path.encode(), digest_size=8, person=person).digest()


def document_id(text: str, person: bytes) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16, person=person).digest()


def with_digest(df: DataFrame, name: str, columns: list[str], digest: Callable[..., bytes]) -> DataFrame:
    """df with a lowercase hex column of digest(*columns) by row; null if any of them is null."""
    at = [df.columns.index(c) for c in columns]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in at))
            out = [None if any(v is None for v in r) else digest(*r).hex() for r in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, name])

    return df.mapInArrow(run, f"{kinds}, `{name}` string")
