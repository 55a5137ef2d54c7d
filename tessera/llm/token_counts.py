"""Delta-maintained token totals by source, language and tokenizer version.

A batch of signed changes is summed map-side into one row per (source, lang, version), written under a name of its
own and renamed in one step; a batch that is there already is left alone, so a commit may be repeated after any failure
and of two writers of one batch one wins.  Totals are the sum of the committed batches: nothing is ever rewritten but by
``compact``, which folds the batches of one listing into a base that keeps their names.

Changes: ``insert`` adds a document and its tokens, ``delete`` takes both away, ``revise`` replaces old_tokens
by tokens for a document that stays.  Defined results: a null text has no tokens; a very long one is encoded in
pieces cut where no token can span; a null source or language is
a group of its own; repeated rows are counted each; an empty batch commits and changes nothing; groups whose
documents and tokens both come to zero are left out; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WORD, Scratch, hadoop_fs, exists, remove

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public split pattern of the byte-level vocabulary (a fixed value).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
GROUP = ("source", "lang", "version")
#: Characters of a piece of a text.
PIECE = 1 << 18
#: Between a visible character and a space before a letter the split pattern always cuts.
SEAM = re.compile(r"(?<=[!-~]) (?=[A-Za-z])")


@lru_cache(maxsize=2)
def encoder(vocabulary: bytes):
    """From the lines of a vocabulary file."""
    ranks = {base64.b64decode(t): int(r) for t, _, r in (line.partition(b" ") for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def load(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file, from the driver's disk or any store that Spark reads."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first().content)
    with open(path, "rb") as f:
        return f.read()


def n_tokens(encode, text: str | None, size: int = PIECE) -> int:
    n, at = 0, 0
    text = text or ""
    while len(text) - at > size and (seam := SEAM.search(text, at + size)):
        n += len(encode(text[at : seam.start()]))
        at = seam.start()
    return n + len(encode(text[at:]))


def count_tokens(docs: DataFrame, path: str = TOKENIZER, keep: tuple[str, ...] = ("doc_id", "source", "lang"), text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with words, bpe (tokens of the vocabulary at ``path``) and two digests of the text."""

    vocabulary = docs.sparkSession.sparkContext.broadcast(load(docs.sparkSession, path))  # a vocabulary file, as large for any corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary.value).encode_ordinary
        for b in batches:
            n = [n_tokens(encode, x.as_py()) for x in b.column("text")]
            cols = [*b.columns[:-1], pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], "bpe"])

    held = [f"c{i}" for i in range(len(keep))]
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("words")
    rows = docs.select(*[docs[c].alias(h) for c, h in zip(keep, held)], words, F.xxhash64(text_col).alias("digest"), F.hash(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", bpe bigint"
    return rows.mapInArrow(run, fields).toDF(*keep, "words", "digest", "mark", "bpe")


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums per group of changes (op, source, lang, version, tokens, old_tokens)."""
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
    old, new = F.coalesce("old_tokens", F.lit(0)), F.coalesce("tokens", F.lit(0))
    tokens = F.when(F.col("op") == "revise", new - old).otherwise(sign * new)
    rows = changes.where(F.col("op").isin("insert", "delete", "revise"))
    return rows.groupBy(*GROUP).agg(F.sum(sign).cast("bigint").alias("n_docs"), F.sum(tokens).cast("bigint").alias("n_tokens"))


class Rollup:
    """Totals kept under ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _listed(self) -> tuple[str | None, list[str], set[str]]:
        """One listing: the newest base, the batches that it doesn't hold, and the names that it holds."""
        fs, path = hadoop_fs(self.spark, self.root)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        base = max((n for n in names if n.startswith("base-")), default=None)
        folded = {r.name for r in self.spark.read.parquet(f"{self.root}/{base}/names").collect()} if base else set()
        return base, sorted(n for n in names if n.startswith("batch-") and n not in folded), folded

    def _renamed(self, new: str, name: str) -> bool:
        """Gives what was written as ``new`` its name in one step; False, and it goes, if another has taken the name."""
        fs, path = hadoop_fs(self.spark, f"{self.root}/{new}")
        to = hadoop_fs(self.spark, f"{self.root}/{name}")[1]
        won = not fs.exists(to) and fs.rename(path, to) and not exists(self.spark, f"{self.root}/{name}/{new}")  # some stores move it into the other
        if not won:
            remove(self.spark, f"{self.root}/{new}")
            remove(self.spark, f"{self.root}/{name}/{new}")
        return won

    def committed(self, batch: str) -> bool:
        return exists(self.spark, f"{self.root}/batch-{batch}") or f"batch-{batch}" in self._listed()[2]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch once; False when it was there.  What a failed writer leaves has no batch's name and counts for nothing."""
        if self.committed(batch):
            return False
        new = f"_new-{uuid.uuid4().hex}"
        deltas(changes).write.parquet(f"{self.root}/{new}")
        return self._renamed(new, f"batch-{batch}")

    def _totals(self, base: str | None, loose: list[str]) -> DataFrame:
        paths = [f"{self.root}/{n}" for n in loose] + ([f"{self.root}/{base}/totals"] if base else [])
        schema = "source string, lang string, version string, n_docs bigint, n_tokens bigint"
        parts = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return parts.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")

    def totals(self) -> DataFrame:
        """Sums of all that is committed at the time of the call."""
        base, loose, _ = self._listed()
        return self._totals(base, loose)

    def compact(self) -> bool:
        """Folds the committed batches of one listing into a new base, then removes what it replaces; False if another was faster."""
        base, loose, folded = self._listed()
        new, name = f"_new-{uuid.uuid4().hex}", f"base-{int(base[5:]) + 1 if base else 0:08d}"
        self._totals(base, loose).write.parquet(f"{self.root}/{new}/totals")
        self.spark.createDataFrame([(n,) for n in sorted(folded | set(loose))], "name string").coalesce(1).write.parquet(f"{self.root}/{new}/names")
        if not self._renamed(new, name):
            return False
        for old in [*loose, *([base] if base else [])]:
            remove(self.spark, f"{self.root}/{old}")
        return True


def changes(counted: DataFrame, op: str, columns: dict[str, str], old: dict[str, str] | None = None) -> DataFrame:
    """One change per document and version; columns: the count of each version, old: the count that it replaces."""
    each = [F.struct(F.lit(v).alias("version"), F.col(c).cast("bigint").alias("tokens"), (F.col((old or {})[v]) if old else F.lit(None)).cast("bigint").alias("old_tokens")) for v, c in columns.items()]
    return counted.select(F.lit(op).alias("op"), "source", "lang", F.explode(F.array(*each)).alias("x")).select("op", "source", "lang", "x.*")


def totals(docs: DataFrame, path: str = TOKENIZER, whole: bool = False) -> DataFrame:
    """A life of the table: all documents come in, exact copies go, what stays gains an end-of-text token, and the first batch is sent again.

    With ``whole`` the copies then come back and the end-of-text tokens go, so that the totals are those of all rows of the table.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        counted = scratch.table(count_tokens(docs, path), "counted")
        rollup = Rollup(spark, f"{scratch.root}/rollup")
        scratch.made.append(rollup.root)
        versions = {"words-1": "words", "bpe-1": "bpe"}
        rollup.commit("0001-load", changes(counted, "insert", versions))
        # of equal texts the smallest id stays (nulls last); rows that repeat both count as often as they stand
        first = counted.groupBy("digest", "mark").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first"), F.count("*").alias("n")).where("n > 1")
        # written, so that a text of very many copies can be split
        first = scratch.table(first.select("digest", "mark", F.col("first.doc_id").alias("first"), F.lit(True).alias("several")), "first")
        both = counted.join(first, ["digest", "mark"], "left")
        copy = F.col("several").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first"))
        rollup.commit("0002-copies", changes(both.where(copy), "delete", versions))
        rollup.commit("0003-end-of-text", changes(both.where(~copy).withColumn("ended", F.col("bpe") + 1), "revise", {"bpe-1": "ended"}, {"bpe-1": "bpe"}))
        if whole:
            ended = both.where(~copy).withColumn("ended", F.col("bpe") + 1)
            rollup.commit("0004-whole", changes(both.where(copy), "insert", versions).unionAll(changes(ended, "revise", {"bpe-1": "bpe"}, {"bpe-1": "ended"})))
        rollup.commit("0001-load", changes(counted, "insert", versions))
        return scratch.result(rollup.totals())
