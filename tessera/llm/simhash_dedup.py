"""SimHash near-duplicates found with a Gray-order hierarchical index.

Fingerprints are computed in Arrow batches.  Two fingerprints at ``radius`` differing bits agree on
at least ``blocks - radius`` of ``blocks`` equal blocks of bits, so each distinct fingerprint goes,
once for every choice of that many blocks, to the group of those that agree with it there; a group of
one is gone before the shuffle of groups.  A group of more than ``HOT`` is split by choices among the halves of
its other blocks, after which its members agree on 48 of 64 bits: no group has more than 65,536.  A task sorts the fingerprints of its groups by Gray rank,
builds a tree whose nodes are masked bit patterns shared by all fingerprints below, and walks it for
all of them at once, adding up the differing bits from the root and dropping a node with its whole
group when they exceed the radius.  It sends back one row per fingerprint and local component, never
pairs.  Components meet in rounds of min-label propagation with label jumping, each written to the
shared folder.

Defined results: a null, empty or blank text has no shingle and fingerprint zero, linked like any
other; a very long text is hashed whole; fewer words than a shingle give the whole sequence as one shingle; repeated rows share a
fingerprint and component; a null id gets a component like any other but never names one unless all
ids of the component are null; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import near_copies
from tessera.llm.common import Scratch

SHINGLE, SEED, RADIUS, BLOCKS, LEVEL_BITS = 3, 42, 2, 4, 4
#: Differing bits at which the pipeline's stage takes two documents for candidates: they agree on one of four blocks.
STAGE_RADIUS = 3
#: Fingerprints of a group from which it is split once more.
HOT = 1024
#: (fingerprint, node) pairs that a walk holds at a time.
FRONTIER = 1 << 20
#: Rows of whole groups that a task gathers before it searches them.
GATHER = 1 << 18

_POP = np.array([bin(i).count("1") for i in range(256)], np.int8)
_LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text, as an unsigned number."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOW).split()  # bytes.split() cuts at U+0009-U+000D and space alone
    if not w:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(w) - size + 1)
    h = np.fromiter((digest(b" ".join(w[i : i + size]), seed) for i in range(n)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp): fp holds the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, fp bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each pattern in the Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """A tree over distinct (group, fingerprint) rows; the children of a node share its pattern and differ in the next bits."""

    def __init__(self, group: np.ndarray, fp: np.ndarray, bits: int = LEVEL_BITS):
        order = np.lexsort((gray_rank(fp), group))
        self.group, self.fp, self.bits, self.depth = group[order], fp[order], bits, 64 // bits
        n = len(fp)
        new = np.ones(n, bool)
        new[1:] = self.group[1:] != self.group[:-1]
        self.levels = [np.flatnonzero(new)]  # where each node's rows begin; the level above all is a node per group
        self.child = []
        for d in range(self.depth):
            seg = self.fp >> np.uint64(64 - (d + 1) * bits)
            new[1:] |= seg[1:] != seg[:-1]
            self.levels.append(np.flatnonzero(new))
            self.child.append(np.append(np.searchsorted(self.levels[d + 1], self.levels[d]), len(self.levels[d + 1])))

    def within(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of row numbers of one group within the radius, in bounded pieces; each pair in both orders, and each row with itself."""
        root = np.searchsorted(self.levels[0], np.arange(len(self.fp)), "right") - 1
        stack = [(0, np.arange(len(self.fp)), root, np.zeros(len(self.fp), np.int8))]
        mask = np.uint64((1 << self.bits) - 1)
        while stack:
            d, row, node, far = stack.pop()
            if d == self.depth:
                yield row, self.levels[d][node]
                continue
            lo, count = self.child[d][node], self.child[d][node + 1] - self.child[d][node]
            if len(row) > 1 and count.sum() > FRONTIER:
                half = len(row) // 2
                stack += [(d, row[:half], node[:half], far[:half]), (d, row[half:], node[half:], far[half:])]
                continue
            shift = np.uint64(64 - (d + 1) * self.bits)
            row, far = np.repeat(row, count), np.repeat(far, count)
            node = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(len(row))
            pattern = self.fp[self.levels[d + 1][node]]
            far = far + _POP[(((pattern ^ self.fp[row]) >> shift) & mask).astype(np.intp)]
            ok = far <= radius
            stack.append((d + 1, row[ok], node[ok], far[ok]))


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row of each row's component."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            before = root.copy()
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while (deep := root[root]) is not None and (deep != root).any():
                root = deep
            if (before == root).all():
                break
    return root


def _local(radius: int, gather: int = GATHER):
    """Per fingerprint and group with a partner: (fp, the smallest fingerprint of its local component)."""
    kind = pa.schema([("fp", pa.int64()), ("hub", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        last: pa.RecordBatch | None = None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held.append(b)
                size += b.num_rows
                if size < gather:
                    continue
            if not held and last is None:
                break
            t = pa.Table.from_batches(([last] if last is not None else []) + held).combine_chunks()
            held, size, last = [], 0, None
            choice, block = t.column("choice").to_numpy(), t.column("block").to_numpy()
            if b is not None:  # rows come sorted by group: the last group may go on in the next batch
                tail = np.flatnonzero((choice != choice[-1]) | (block != block[-1]))
                cut = int(tail[-1]) + 1 if len(tail) else 0
                rest = t.slice(cut).combine_chunks().to_batches()
                last, t = rest[0] if rest else None, t.slice(0, cut)
                if not cut:
                    continue
                choice, block = choice[:cut], block[:cut]
            group = np.cumsum(np.concatenate([[0], (choice[1:] != choice[:-1]) | (block[1:] != block[:-1])]))
            index = GrayIndex(group, t.column("fp").to_numpy().view(np.uint64))
            root = _roots(len(group), index.within(radius))
            paired = np.bincount(root, minlength=len(root))[root] > 1
            fp = index.fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fp[paired]), pa.array(fp[root[paired]])], schema=kind)

    return run


def _choices(pieces: list[int], keep: int, base: int = 0) -> list[int]:
    """Masks, as signed numbers, of every choice of ``keep`` pieces together with ``base``."""
    found = [sum(kept, base) for kept in itertools.combinations(pieces, keep)]
    return [m - (1 << 64) * (m >= 1 << 63) for m in found]


def _grouped(rows: DataFrame) -> DataFrame:
    """The rows (fp, choice, block) of groups of two or more, with the size ``n`` of their group."""
    several = rows.groupBy("choice", "block").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(several, ["choice", "block"]).select("fp", "choice", "block", "n")


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, hot: int = HOT) -> DataFrame:
    """Rows (fp, hub) that connect every two distinct fingerprints within the radius through a common hub.

    Two of a split group differ in ``radius`` of the ``2 * radius`` halves at most, so they meet in a choice of the others.
    """
    width = 64 // blocks
    part = lambda at, size: ((1 << size) - 1) << at
    places = [width * k for k in range(blocks)]
    first = _choices([part(p, width) for p in places], blocks - radius)
    finer = []
    for kept in itertools.combinations(places, blocks - radius):
        halves = [part(p + h, width // 2) for p in places if p not in kept for h in (0, width // 2)]
        finer.append(_choices(halves, radius, sum(part(p, width) for p in kept)))
    table = lambda masks: F.array(*[F.lit(m).cast("bigint") for m in masks])
    rows = _grouped(distinct.select("fp", F.posexplode(table(first)).alias("choice", "mask")).select("fp", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("block")))
    again = rows.where(F.col("n") > hot).select("fp", "choice", F.posexplode(F.get(F.array(*map(table, finer)), F.col("choice"))).alias("turn", "mask"))
    again = _grouped(again.select("fp", (len(first) + F.col("choice") * len(finer[0]) + F.col("turn")).alias("choice"), F.col("fp").bitwiseAND(F.col("mask")).alias("block")))
    rows = rows.where(F.col("n") <= hot).unionAll(again).select("fp", "choice", "block")
    rows = rows.repartition("choice", "block").sortWithinPartitions("choice", "block")
    return rows.mapInArrow(_local(radius), "fp bigint, hub bigint").where("fp <> hub").distinct()


def components(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (fp, lead): the least label of each node's component.  nodes: (fp, lead), edges: (fp, hub), both ends nodes.

    A round takes the least label over each edge in both directions and hands it on to the node whose label it beats, then
    jumps: the label of the node whose own label was taken.  It goes on until no label changes.
    """
    both = scratch.table(edges.select("fp", "hub").unionAll(edges.select(F.col("hub").alias("fp"), F.col("fp").alias("hub"))), "edges")
    touched = both.select("fp").distinct()
    start = nodes.join(touched, "fp", "left_semi").select("fp", F.struct("lead", "fp").alias("best"))
    now = scratch.table(start.select("fp", "best"), "labels-0")
    for turn in itertools.count(1):
        seen = both.join(now.select(F.col("fp").alias("hub"), "best"), "hub").select("fp", "best").unionAll(now.select("fp", "best"))
        least = seen.groupBy("fp").agg(F.min("best").alias("best"))
        beaten = least.join(now.withColumnRenamed("best", "old"), "fp").where("best < old").select(F.col("old.fp").alias("fp"), "best")
        least = least.unionAll(beaten).groupBy("fp").agg(F.min("best").alias("best"))
        jump = now.select(F.col("fp").alias("to"), F.col("best").alias("far"))
        after = least.withColumn("to", F.col("best.fp")).join(jump, "to", "left").select("fp", F.least("best", F.coalesce("far", "best")).alias("best"))
        after = scratch.table(after, f"labels-{turn}")
        changed = after.join(now.withColumnRenamed("best", "old"), "fp").where("best <> old").limit(1).count()
        if turn > 1:
            scratch.drop(f"labels-{turn - 2}")
        now = after
        if not changed:
            break
    rest = nodes.join(now.select("fp", F.col("best.lead").alias("low")), "fp", "left")
    return rest.select("fp", F.coalesce("low", "lead").alias("lead"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, fp (signed) and component_id, the smallest doc_id within reach."""
    with Scratch(docs.sparkSession) as scratch:
        prints = scratch.table(fingerprints(docs, id_col, text_col), "prints")
        # the label is a pair so that a null id, which sorts first, loses against every other
        nodes = scratch.table(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("lead")), "nodes")
        edges = scratch.table(links(nodes.select("fp"), radius, hot=hot), "links")
        found = scratch.table(components(nodes, edges, scratch), "found")  # written, so that a fingerprint of very many documents can be split
        return scratch.result(prints.join(found, "fp").select("doc_id", "fp", F.col("lead.doc_id").alias("component_id")))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def candidates(nodes: DataFrame, scratch: Scratch, radius: int = STAGE_RADIUS, hot: int = HOT) -> DataFrame:
    """Pairs (fp, hub) of the keys of nodes (key, fp) to check: nodes of one fingerprint with the first of them, and firsts that the index links."""
    firsts = scratch.table(nodes.groupBy("fp").agg(F.min("key").alias("first")), "firsts")
    same = nodes.select("key", "fp").join(firsts, "fp").where("key <> first").select(F.col("key").alias("fp"), F.col("first").alias("hub"))
    near = scratch.table(links(firsts.select("fp"), radius, hot=hot), "near")
    ends = near.join(firsts, "fp").join(firsts.toDF("hub", "first_hub"), "hub")
    return same.unionAll(ends.select(F.col("first").alias("fp"), F.col("first_hub").alias("hub")))


def stage(spark, docs: DataFrame, hot: int = near_copies.HOT, rounds: int = near_copies.ROUNDS, sent: int = near_copies.SENT) -> DataFrame:
    """Keeps the document of smallest id of each component of near copies; of rows that repeat that id, the one whose text digest is smallest.

    Near copies share 0.8 or more of their five-word shingles.  Fingerprints that the Gray-order index links are checked on the whole sets; two similar sets may
    differ in more bits than any index can search, and ``near_copies`` adds the links that are left.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column of the input clashes
    ident, text = F.col(names[docs.columns.index("doc_id")]).cast("bigint"), F.col(names[docs.columns.index("text")]).cast("string")
    named = docs.toDF(*names).withColumns({"key": F.xxhash64(ident, text), "mark": F.hash(text, ident)})
    with Scratch(spark) as scratch:
        lead = F.struct(ident.isNull().alias("none"), ident.alias("id"), "key", "mark").alias("lead")
        # of equal texts one is compared, the others never leave their task but for their digests
        first = named.select(lead, F.xxhash64(text).alias("d1"), F.hash(text, F.lit(1)).alias("d2")).groupBy("d1", "d2").agg(F.min("lead").alias("lead"))
        first = scratch.table(first.select("lead.key", "lead.mark"), "first")
        rows = named.select("key", "mark", lead, text.alias("text")).dropDuplicates(["key", "mark"]).join(first.hint("merge"), ["key", "mark"], "left_semi")
        nodes = near_copies.sets(rows, fingerprint).select(F.monotonically_increasing_id().alias("key"), "*")
        nodes = scratch.table(nodes, "nodes")  # the numbers stand once they are written
        known = near_copies.verified(candidates(nodes, scratch), nodes, scratch, "fingerprinted", sent)
        edges = scratch.table(near_copies.links(nodes, known, scratch, hot, rounds, sent), "links")
        found = components(nodes.select(F.col("key").alias("fp"), "lead"), edges, scratch).withColumnRenamed("lead", "least")
        kept = nodes.select(F.col("key").alias("fp"), "lead").join(found, "fp").where("lead = least")
        kept = scratch.result(kept.select("lead.key", "lead.mark"), "kept")
    out = named.join(kept, ["key", "mark"], "left_semi").dropDuplicates(["key", "mark"])
    return out.select(*names).toDF(*docs.columns)
