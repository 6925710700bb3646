"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder of ``spark.checkpoint.dir``."""
    return cut_lineage(df)


BATCH_ROWS = 1024


def slices(batches, rows: int = BATCH_ROWS):
    """Arrow batches cut into slices of at most ``rows`` whole rows, so that a Python
    worker turns a few megabytes of text into objects at a time, whatever batches the
    session sends."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null for a null id)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def text_chunks(texts: list[str], max_chars: int = 1 << 20, overlap: int = 0):
    """Groups whole texts into chunks of about ``max_chars`` characters, so the
    arrays built from a chunk stay small whatever the batch holds.  Yields lists
    of ``(index, piece, n_own)``: a text longer than a chunk comes in several
    pieces, each followed by up to ``overlap`` characters of the next one;
    ``n_own`` is the piece's length without them."""
    chunk, size = [], 0
    for i, text in enumerate(texts):
        for a in range(0, len(text), max_chars) if len(text) > max_chars else (0,):
            own = min(max_chars, len(text) - a)
            chunk.append((i, text[a:a + own + overlap], own))
            size += own
            if size >= max_chars:
                yield chunk
                chunk, size = [], 0
    if chunk:
        yield chunk


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, elementwise on uint64 (wraps around)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
