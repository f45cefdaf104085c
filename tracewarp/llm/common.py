"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_folder, ensure_checkpoint_dir, ship, stored

__all__ = ["SPACES", "WORD", "checkpoint", "doc_bucket", "drop_folder", "ensure_checkpoint_dir", "give_back", "held", "release", "stored", "table", "unit_hash", "vocabulary_path"]

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same separators for Spark's split().
SPACES = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_HELD: dict = {}


def held(key, make):
    """A worker's one large object: made at its first use, let go once another is asked for."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Let go of what :func:`held` keeps, and give free memory back to the machine: idle workers live on."""
    if _HELD:
        _HELD.clear()
        gc.collect()
    give_back()


def give_back() -> None:
    """Give memory that is free already back to the machine; what :func:`held` keeps stays."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def doc_bucket(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: null)."""
    return F.crc32(F.col(key).cast("string")) % F.lit(modulus)


def unit_hash(key: str = "doc_id", salt: int = 17) -> Column:
    """A deterministic number in [0, 1) from an id."""
    return F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def vocabulary_path(name: str) -> str:
    """Place of a public tokenizer file; TOKENIZER_DIR or the installed package names it."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
