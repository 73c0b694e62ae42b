"""Shared helpers: tables, durable intermediate results and connected components."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewater.operators.graph import components, drop_stored, durable, join_hot, shared_dir, stored

__all__ = ["WORD", "components", "crc32_sql", "drop_stored", "durable", "fresh", "join_hot", "shared_dir", "stored", "table", "worker_cache"]

#: ASCII white space; every other character belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


_kept: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What a Python worker keeps between an operator's tasks. A worker lives on through all stages of an application, so what other operators have left in it is dropped first."""
    if owner not in _kept:
        if _kept:
            _kept.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
        _kept[owner] = {}
    return _kept[owner]


def fresh(name: str, columns: list[str]) -> str:
    """The name, with underscores before it as long as a column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_sql(text: str) -> str:
    """DuckDB's expression of the unsigned CRC-32 of a text's bytes; its table follows from the polynomial."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    step = f"(xor(a >> 8, {table}[(xor(a, b) & 255) + 1]))"
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda a, b: {step}), 4294967295::bigint)"
