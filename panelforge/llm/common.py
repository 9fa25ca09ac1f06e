"""What the operators share: the shared scratch folder, Arrow batches, crc folds, word caches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, which separates words in every contract: [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, a local one if all runs in one process, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="panelforge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Named Parquet tables in the shared folder, each written once and read again.

    Writing cuts the lineage: what is read later does not depend on the executors
    that made it, and row positions fixed at the time of writing never change.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/panelforge/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.release()
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Shuffle files of finished steps go when the driver's JVM collects what stands for them."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Removes tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)


def bounded_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 32) -> None:
    """Texts are long: fewer rows and bytes in each Arrow batch than Spark's defaults keep workers small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


def keep_blocks() -> None:
    """Freed arrays of up to 32 MB are used again by this process, not mapped and cleared anew, until give_back."""
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 27)  # M_TRIM_THRESHOLD


def give_back() -> None:
    """What a finished task leaves free in this process goes back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterable[dict]], schema: str | T.StructType, arrays: bool = False) -> DataFrame:
    """mapInArrow with dictionaries of Python lists in (or of Arrow arrays), of lists or arrays out."""
    from pyspark.sql.pandas.types import to_arrow_schema

    want = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(want)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dicts() -> Iterator[dict[str, list]]:
            for batch in batches:
                if batch.num_rows:
                    yield {n: batch.column(i) if arrays else batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}

        for out in fn(dicts()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)
        give_back()

    return df.mapInArrow(run, want)


def fresh(df: DataFrame, name: str) -> str:
    """A name for a working column that df has none of, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text, null as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def held_out_by(mod: int, hit: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == hit, F.lit(False))


def crc_u32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@lru_cache(maxsize=1)
def _zstd():
    """One compressor and one decompressor for each worker process: making them costs more than a small array does."""
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(a: np.ndarray) -> bytes:
    return _zstd()[0].compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(_zstd()[1].decompress(b), dtype=dtype)


class WordMemo:
    """Values of words, computed for many missing ones at once and kept in two generations.

    At most 2 * limit words are kept; what a full young generation pushes out is computed
    again when it returns, so results never depend on the limit.
    """

    def __init__(self, compute: Callable[[list], list], limit: int = 150_000):
        self.compute, self.limit = compute, limit
        self.young: dict = {}
        self.old: dict = {}

    def table(self, words: Iterable) -> dict:
        """A dictionary that holds every one of these words."""
        need = words if isinstance(words, set) else set(words)
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = []
        for w in need:
            if w in young:
                continue
            v = old.get(w)
            if v is None:
                missing.append(w)
            else:
                young[w] = v
        if missing:
            young.update(zip(missing, self.compute(missing), strict=True))
        return young

    def values(self, words: list) -> list:
        """The value of each of these words, which may repeat."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young = self.young
        out = list(map(young.get, words))
        absent = [i for i, v in enumerate(out) if v is None]
        if absent:
            names = [words[i] for i in absent]
            found = dict(zip(names, map(self.old.get, names), strict=True))
            missing = [w for w, v in found.items() if v is None]
            if missing:
                found.update(zip(missing, self.compute(missing), strict=True))
            young.update(found)
            for i, w in zip(absent, names, strict=True):
                out[i] = found[w]
        return out
