"""Helpers shared by the operators: shared scratch tables and byte-level tokenisation."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definitions: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Settings inside a block: bytes and rows of an Arrow batch, and rows of a batch read from Parquet.
SHORT = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.parquet.columnarReaderBatchSize": "1024"}
#: Row groups are small, since a writer holds one and a reader's batch never spans two; long rows are looked at one by one.
#: On file:// folders no checksum files stand beside them: for each, a JVM without Hadoop's native library starts a process of its own.
WRITTEN = {
    "compression": "zstd", "parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "8", "parquet.page.size.row.check.max": "256",
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
}

#: Seconds between two times that executors give memory back.
TIDY = 4


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only a local session may do without, with a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def hadoop_fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        fs, p = hadoop_fs(spark, path)
        fs.delete(p, True)


def give_back(spark: SparkSession) -> None:
    """Executors collect their garbage: a heap that earlier work has grown shrinks to what is in use, which else it keeps to the end."""
    n = spark.sparkContext.defaultParallelism  # a task for each core, so that idle executors all get some
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Executors give memory back at both ends of the block, and inside it, on this thread, after tables that end ``TIDY`` seconds or more after the last time."""
    before, Scratch.blocks.tidied = getattr(Scratch.blocks, "tidied", None), time.monotonic()
    give_back(spark)
    try:
        yield
    finally:
        Scratch.blocks.tidied = before
    give_back(spark)


class _Short:
    """Settings held while any block of a session is open, and put back when its last one ends, on whatever thread."""

    lock, open = threading.Lock(), {}

    @classmethod
    def enter(cls, spark: SparkSession) -> None:
        with cls.lock:
            depth, before = cls.open.get(spark, (0, None))
            if not depth:
                before = {k: spark.conf.get(k, None) for k in SHORT}
                for k, v in SHORT.items():
                    spark.conf.set(k, v)
            cls.open[spark] = depth + 1, before

    @classmethod
    def leave(cls, spark: SparkSession) -> None:
        with cls.lock:
            depth, before = cls.open.pop(spark)
            if depth > 1:
                cls.open[spark] = depth - 1, before
                return
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive a lost executor.

    ``table`` writes one that goes when the block ends.  ``result`` writes one that the DataFrame handed out still reads:
    it goes when the block around this one ends, on the same thread, and where there is none when the process does.  Inside the block
    batches are short, as their rows hold whole texts.
    """

    blocks = threading.local()  # last: the block that is open; tidied: when executors last gave memory back, inside ``tidy`` alone

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.made, self.around = spark, f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}", [], None

    def __enter__(self) -> "Scratch":
        _Short.enter(self.spark)
        self.around = getattr(self.blocks, "last", None)
        self.blocks.last = self
        return self

    def __exit__(self, *exc) -> None:
        self.blocks.last = self.around
        _Short.leave(self.spark)
        for path in self.made:
            remove(self.spark, path)

    def table(self, df: DataFrame, name: str, **options) -> DataFrame:
        self.made.append(path := f"{self.root}/{name}")
        return self._written(df, path, options)

    def drop(self, name: str) -> None:
        remove(self.spark, f"{self.root}/{name}")

    def few(self, df: DataFrame, rows: int) -> bool:
        """Whether a table has at most so many rows, which then may be broadcast."""
        return df.limit(rows + 1).count() <= rows

    def result(self, df: DataFrame, name: str = "result") -> DataFrame:
        path = f"{self.root}-{name}"
        if self.around is not None:
            self.around.made.append(path)
        else:
            atexit.register(remove, self.spark, path)
        return self._written(df, path, {})

    def _written(self, df: DataFrame, path: str, options: dict) -> DataFrame:
        df.write.mode("overwrite").options(**(WRITTEN | options)).parquet(path)
        self.spark._jvm.System.gc()  # shuffle files go when the driver's JVM finds that their plan is garbage, which may else be never
        if (at := getattr(self.blocks, "tidied", None)) is not None and time.monotonic() - at > TIDY:
            give_back(self.spark)
            self.blocks.tidied = time.monotonic()
        return self.spark.read.schema(df.schema).parquet(path)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end and the offsets of each (nulls are empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def tokens(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of word bytes that stay within one text: their starts, ends (exclusive), and count per text."""
    n = len(raw)
    w = is_word[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, end = w.copy(), w.copy()
    if n:
        start[1:] &= ~(w[:-1] & ~edge[1:n])
        end[:-1] &= ~(w[1:] & ~edge[1:n])
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def chunks_by_bytes(sizes: np.ndarray, limit: int):
    """Ranges of rows of about ``limit`` bytes in all; a longer row stands alone."""
    begin, total = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > begin and total + s > limit:
            yield begin, i
            begin, total = i, 0
        total += s
    if begin < len(sizes):
        yield begin, len(sizes)
