"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pacegrid.session import checkpoint_dir

U64 = np.uint64
SPACE = " \t\n\x0b\x0c\r"  # the characters \x20 \x09-\x0D


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only: other columns cannot clash with the operators' own; null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/pacegrid-llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a table in the shared checkpoint folder and read it back (cuts the lineage)."""
    return _written(df, f"{_folder(df.sparkSession)}/{name}")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables of one computation, deleted together once its result is stored itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, _folder(spark), 0

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        return _written(df, f"{self.folder}/{self.n}-{name}")

    def drop(self) -> None:
        """Only after everything that reads these tables is written."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does once nothing in the driver refers to them any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def same_id(a: DataFrame, b: DataFrame, col: str = "doc_id"):
    """Null-safe equality of the id columns."""
    return a[col].eqNullSafe(b[col])


def free_names(taken, *names: str) -> list[str]:
    """``names`` with as many underscores in front as it takes not to clash with the columns ``taken`` (in any case)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (wrap-around arithmetic on uint64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(31)
    x *= U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    return x


def crc_fold(n: int):
    """crc32 of the id as text, modulo n (the folds of the contracts)."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def slices(batch: pa.RecordBatch, size: str = "text", most: int = 4_000_000):
    """Slices of a record batch with about ``most`` bytes of the text column each (one row at least)."""
    length = pc.fill_null(pc.binary_length(batch.column(size)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(length) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(length)]
    for lo, hi in zip(edges, edges[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def release() -> None:
    """Give freed memory of this Python worker back to the system; workers are kept for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """``run`` for ``mapInArrow``, with the worker's freed memory given back before and after it."""

    @functools.wraps(run)
    def tidied(batches):
        gc.collect()
        release()
        try:
            yield from run(batches)
        finally:
            gc.collect()
            release()

    return tidied


def tidy_group(run, tables: int = 1):
    """``run`` for ``applyInArrow`` on one table (or two), with the worker's freed memory given back before and after it."""

    def once(*args):
        release()
        try:
            return run(*args)
        finally:
            release()

    # Spark counts the parameters
    return (lambda table: once(table)) if tables == 1 else (lambda left, right: once(left, right))


def split_words(text: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between white space (\\x20 \\x09-\\x0D), A-Z lower-cased if ``lower``.

    (code of each word, offsets of the texts in it, distinct words by code).
    """
    text = text.take(pa.array(np.arange(len(text))))  # own buffers: case kernels misread the offsets of a slice
    text = pc.fill_null(text.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    words = lists.flatten().dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = offsets - offsets[0]
    blank = pc.index(words.dictionary, pa.scalar("", words.dictionary.type)).as_py()
    if blank >= 0:
        keep = codes != blank
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return codes, offsets, words.dictionary


_BYTES = np.random.default_rng(20240229).integers(1, 2 ** 63, 256, dtype=np.uint64) * U64(2) + U64(1)


def hash_strings(words: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of each string (a polynomial over random byte values, finalised), without a Python loop."""
    n = len(words)
    if n == 0:
        return np.zeros(0, U64)
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset:words.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    h = mix64(size.astype(U64) + U64(seed * 2 + 1))
    if len(data):
        pos = np.arange(len(data)) - np.repeat(offsets[:-1], size)
        power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, U64))
        filled = np.flatnonzero(size)
        h[filled] += np.add.reduceat(_BYTES[data] * power[pos], offsets[:-1][filled])
    return mix64(h)
