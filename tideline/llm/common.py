"""What several corpus operators share: stage tables in the shared folder, texts as Arrow slices, hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tideline.session import shared_folder

#: White space of all contracts: space and U+0009 to U+000D. ``bytes.split()`` cuts at the same six.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"
#: Text bytes that a Python worker holds as arrays at a time; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def arrow_by_bytes(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes: row counts alone say nothing about batches of very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


#: Rows of a file of a slim intermediate table.
FILE_ROWS = 50_000


def saved(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, is computed once, survives lost executors. ``rows``
    is a bound on a slim table's rows; it then goes into as many files as they need, not one a partition."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shielded(docs: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with every column but ``own`` renamed, so that none clashes with an operator's working columns;
    and the way back, which takes the names that the operator adds (they win over carried ones)."""
    columns = docs.columns
    names = {c: c if c in own else f"_x{i}_" for i, c in enumerate(columns)}

    def restore(df: DataFrame, *added: str) -> DataFrame:
        return df.select(*[F.col(f"`{names[c]}`").alias(c) for c in columns if c not in added], *added)

    return docs.select(*[F.col(f"`{c}`").alias(names[c]) for c in columns]), restore


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, cut so that the column's bytes stay below the limit or a slice is one row."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts as Python strings; null is the empty text."""
    return [x if x is not None else "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """Texts as UTF-8; null is the empty text."""
    raw = batch.column(batch.schema.get_field_index(column))
    return [x if x is not None else b"" for x in raw.cast(pa.large_binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hash of a word's bytes, remembered; forgets all when a corpus has more words than fit."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def odd_constants(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_STEPS = odd_constants(11, 64)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every run of ``width`` words, repeats included. With fewer words the whole sequence is
    one shingle; no words, no shingle."""
    n = len(words)
    if n == 0:
        return words
    k = min(width, n)
    total = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        total += mix(words[i : n - k + 1 + i]) * _STEPS[i % 64]
    return mix(total)


def word_hashes(text: bytes, cache: WordHashes) -> np.ndarray:
    words = text.lower().split()  # bytes: only A-Z change, only the six white-space characters cut
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def crc_of_id(column: str | Column = "doc_id") -> Column:
    """CRC-32 of an id written as text; a null id counts as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))
