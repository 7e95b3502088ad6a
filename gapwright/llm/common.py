"""Shared pieces: scratch folders, bounded Arrow slices and vectorised words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker expands into words at once.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a temporary folder serves a local master; on
    a cluster, whose machines would each have their own, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gapwright-")
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not have yet, one for each wanted one."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/gapwright/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there,
    and an executor lost later costs no recomputation.

    ``batch_rows`` bounds the rows of an Arrow batch while it is written, for
    plans that hand whole texts to Python beside a join's own memory.
    """
    spark, path, key = df.sparkSession, scratch(df.sparkSession, name), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if batch_rows:
        spark.conf.set(key, batch_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no later plan reads.  What a returned result
    still reads stays in the shared folder, for its owner to empty."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text is divisible by ``folds``; False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def learnable(doc_id: Column, folds: int = 5) -> Column:
    """True where the id is known and not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds != 0, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that ``column`` holds about ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        if size.sum() <= limit:
            yield batch
            continue
        start, total = 0, 0
        for i, n in enumerate(size.tolist()):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


@dataclass
class Words:
    """Words of many texts: ``codes`` into ``vocab``, cut into texts by ``offsets``."""

    codes: np.ndarray
    offsets: np.ndarray
    vocab: pa.Array

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)


def split_words(texts: pa.Array) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text; a null text has none."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
    empty = np.asarray(pc.equal(flat, ""), dtype=bool) if len(flat) else np.zeros(0, bool)
    if empty.any():
        row = np.repeat(np.arange(len(counts)), counts)
        counts -= np.bincount(row[empty], minlength=len(counts))
        flat = flat.filter(pa.array(~empty))
    coded = flat.dictionary_encode()
    offsets = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=offsets[1:])
    codes = np.asarray(coded.indices, dtype=np.int64) if len(flat) else np.zeros(0, np.int64)
    return Words(codes, offsets, coded.dictionary)


def hash_words(vocab: pa.Array | list[str], seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word."""
    values = vocab if isinstance(vocab, list) else vocab.to_pylist()
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in values), dtype=np.uint64, count=len(values))


def bare_words(vocab: pa.Array) -> pa.Array:
    """Lower case, without punctuation at either end (a word of punctuation alone stays)."""
    lower = pc.utf8_lower(vocab)
    bare = pc.replace_substring_regex(lower, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return pc.if_else(pc.equal(bare, ""), lower, bare)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of a public-domain generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
