"""Near copies by exact similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Two sets that similar share one of their first ``n - ceil(0.8 n) + 1`` shingles in any order that holds for all sets.
The order here is by hash, with shingles of hot groups last, so each set goes, once for each of those shingles, to
the shingle's group, with the shingle's place in its order.  If it is the first that two sets share, what comes after it bounds all
they share: a pair that could not be similar then is left to another group, and most sets, whose place is too late for a set as large as
their own, are never the smaller of a pair at all.  In a group of over ``HOT`` members are first held against one of them, that with the
earliest place, which differs least from the rest; those similar to it are marked with it, and so on among the unmarked for ``ROUNDS`` rounds.
Two with one mark are linked through it and need not meet, nor do two that links known before tie to one other; every other pair does.  A pair whose parities of hashes dealt over 128 bits, and
then over ``BITS``, differ in more bits than the sets may differ in is no copy; every other is verified on the whole sets.  No link between components is lost.

Defined results: equal sets (blank and null texts too) are copies; fewer words than a shingle are one shingle; a very long text is
one set of all its shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

SHINGLE, SEED = 5, 42
#: Similarity of copies, as a fraction.
OVER, UNDER = 4, 5
HOT, ROUNDS = 128, 2
#: Hot shingles, or keys of sets to compare, that are sent to all tasks; more are joined.
SENT = 1 << 20
BITS = 512
#: Sets of more than LONG shingles are also dealt over WIDE bits, as BITS soon tell nothing of them.
LONG, WIDE = 1024, 1 << 14

_LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text in ascending order, as signed numbers; a text without words has one, that of nothing."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOW).split()
    digest, n = xxhash.xxh64_intdigest, max(1, len(w) - SHINGLE + 1)
    return np.unique(np.fromiter((digest(b" ".join(w[i : i + SHINGLE]), SEED) for i in range(n)), np.uint64, n).view(np.int64))


def sets(rows: DataFrame, fingerprint: Callable[[str | None], int]) -> DataFrame:
    """Rows (lead, grams, parity, wide, fp) from (lead, text): the shingle hashes, their parities and the text's 64-bit fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            found = [shingles(t) for t in texts]
            prints = pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64), pa.int64())
            ends = np.cumsum([0, *map(len, found)])
            grams = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found]), pa.int64()))
            odd = lambda g, bits: np.packbits((np.bincount(g & (bits - 1), minlength=bits) & 1).astype(np.uint8)).view(np.int64)
            parity = pa.array([odd(g, BITS) for g in found], pa.list_(pa.int64()))
            wide = pa.array([odd(g, WIDE) if len(g) > LONG else None for g in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("lead"), grams, parity, wide, prints], names=["lead", "grams", "parity", "wide", "fp"])

    lead = rows.schema["lead"].dataType.simpleString()
    return rows.select("lead", "text").mapInArrow(run, f"lead {lead}, grams array<bigint>, parity array<bigint>, wide array<bigint>, fp bigint")


def prefixes(grams: DataFrame, hot: np.ndarray) -> DataFrame:
    """Rows (gram, key, n, p) of the leading shingles of each set, those of ``hot`` (ascending) last; p: the place in that order, from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, firsts, places = [], [], [], []
            for key, g in zip(b.column("key").to_numpy(), b.column("grams")):
                g = g.values.to_numpy()
                n = len(g)
                take = n - -(-OVER * n // UNDER) + 1 if n else 0
                if len(hot):
                    late = hot[np.minimum(np.searchsorted(hot, g), len(hot) - 1)] == g
                    g = np.concatenate([g[~late], g[late]])
                firsts.append(g[:take])
                keys.append(np.full(take, key, np.int64))
                sizes.append(np.full(take, n, np.int32))
                places.append(np.arange(1, take + 1, dtype=np.int32))
            cols = [np.concatenate([np.zeros(0, t), *c]) for c, t in ((firsts, np.int64), (keys, np.int64), (sizes, np.int32), (places, np.int32))]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["gram", "key", "n", "p"])

    return grams.select("key", "grams").mapInArrow(run, "gram bigint, key bigint, n int, p int")


def prefixes_joined(grams: DataFrame, hot: DataFrame) -> DataFrame:
    """``prefixes`` for any number of hot shingles, a table of ``gram``."""
    rows = grams.select("key", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(hot.withColumn("late", F.lit(True)), "gram", "left")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.col("late").isNotNull(), "gram"))
    return rows.withColumn("p", place).where(F.col("p") <= F.col("n") - F.expr(f"({OVER} * n + {UNDER - 1}) div {UNDER}") + 1).select("gram", "key", "n", "p")


def fits(n: Column, m: Column, p: Column, q: Column) -> Column:
    """Whether sets of n and m shingles may be similar if the first they share is at place p of one and q of the other."""
    most = 1 + F.least(n - p, m - q)
    return (n * UNDER >= m * OVER) & (m * UNDER >= n * OVER) & (most * (OVER + UNDER) >= (n + m) * OVER)


def verified(pairs: DataFrame, nodes: DataFrame, scratch: Scratch, name: str, sent: int = SENT) -> DataFrame:
    """The distinct pairs (fp, hub) whose sets are similar; sets of pairs that may be are all that is shuffled."""
    side = lambda k, n, p: nodes.select(F.col("key").alias(k), F.size("grams").alias(n), F.col("parity").alias(p))
    both = pairs.select("fp", "hub").distinct().join(side("fp", "n", "p"), "fp").join(side("hub", "m", "q"), "hub")
    apart = sum((F.bit_count(F.get("p", F.lit(k)).bitwiseXOR(F.get("q", F.lit(k)))) for k in range(BITS // 64)), F.lit(0))
    most = (F.col("n") + F.col("m")) * (UNDER - OVER)
    close = scratch.table(both.where(apart * (OVER + UNDER) <= most).select("fp", "hub", "n", "m"), f"{name}-close")
    both = close.join(nodes.select(F.col("key").alias("fp"), F.col("wide").alias("p")), "fp").join(nodes.select(F.col("key").alias("hub"), F.col("wide").alias("q")), "hub")
    apart = F.aggregate(F.zip_with("p", "q", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    maybe = scratch.table(both.where(F.coalesce(apart * (OVER + UNDER) <= most, F.lit(True))).select("fp", "hub"), f"{name}-maybe")
    keys = scratch.table(maybe.select(F.explode(F.array("fp", "hub")).alias("key")).distinct(), f"{name}-keys")
    sent = F.broadcast(keys) if scratch.few(keys, sent) else keys
    compared = scratch.table(nodes.select("key", "grams").join(sent, "key", "left_semi"), f"{name}-compared")
    left = maybe.join(compared.select(F.col("key").alias("fp"), F.col("grams").alias("a")), "fp")
    right = compared.select(F.col("key").alias("hub"), F.col("grams").alias("b"))
    shared, total = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")
    found = scratch.table(left.join(right, "hub").where(shared * (OVER + UNDER) >= total * OVER).select("fp", "hub"), name)
    for done in ("close", "maybe", "keys", "compared"):
        scratch.drop(f"{name}-{done}")
    return found


def _sized(rows: DataFrame) -> DataFrame:
    """The rows of groups of two or more, with the size ``g`` of their group."""
    return rows.join(rows.groupBy("gram").agg(F.count("*").alias("g")).where("g > 1"), "gram")


def _marks(linked: DataFrame, own: DataFrame) -> DataFrame:
    """Rows (key, mark): each end fp of a link with the least hub that it is linked to; a hub, of ``own``, is marked with itself."""
    new = linked.groupBy(F.col("fp").alias("key")).agg(F.min("hub").alias("mark"))
    return own.unionAll(new.join(own, "key", "left_anti"))


def links(nodes: DataFrame, known: DataFrame, scratch: Scratch, hot: int = HOT, rounds: int = ROUNDS, sent: int = SENT) -> DataFrame:
    """Similar pairs (fp, hub) of nodes (key, grams, parity, wide), which connect every two similar ones; those already ``known`` are among them."""
    seen = prefixes(nodes, np.zeros(0, np.int64)).groupBy("gram").agg(F.count("*").alias("g")).where(F.col("g") > hot).select("gram")
    late = scratch.table(seen, "late")
    if scratch.few(late, sent):
        first = prefixes(nodes, np.sort(late.toArrow().column("gram").to_numpy()))
    else:
        first = prefixes_joined(nodes, late)
    first = scratch.table(first, "prefixes")
    rows = scratch.table(_sized(first), "groups")
    scratch.drop("prefixes")
    c, edges, marks = F.col, [known], None
    plain = rows.where(c("g") > hot)
    for turn in range(rounds):
        # a set may be the smaller of a pair up to the place from which a set of its own size is out of reach
        free = plain.where((c("n") - c("p") + 1) * (OVER + UNDER) >= c("n") * 2 * OVER)
        free = free if marks is None else free.join(marks, "key", "left_anti")
        hubs = free.groupBy("gram").agg(F.count("*").alias("free"), F.min(F.struct("p", "key", "n")).alias("first")).where(c("free") > hot).select("gram", "first")
        hubs = scratch.table(hubs, f"hubs-{turn}")
        if not hubs.limit(1).count():
            break
        met = plain.select("gram", "key", "n", "p").join(hubs, "gram").where((c("key") != c("first.key")) & fits(c("n"), c("first.n"), c("p"), c("first.p")))
        edges.append(verified(met.select(c("key").alias("fp"), c("first.key").alias("hub")), nodes, scratch, f"covered-{turn}", sent))
        new = _marks(edges[-1], hubs.select(c("first.key").alias("key"), c("first.key").alias("mark")).distinct())
        new = new if marks is None else marks.unionAll(new.join(marks, "key", "left_anti"))
        marks = scratch.table(new, f"marks-{turn}")
    fold = lambda k: reduce(lambda x, y: x.bitwiseXOR(y), [F.get("parity", F.lit(i)) for i in range(k, BITS // 64, 2)])  # noqa: E731  the parities of 128 bits
    before = _marks(known, known.select(c("hub").alias("key"), c("hub").alias("mark")).distinct()).withColumnRenamed("mark", "before")
    # marks meet the sets, of which there are far fewer than rows of groups; each of these then takes one row of its set
    sides = nodes.select("key", fold(0).alias("u"), fold(1).alias("v")).join(before, "key", "left")
    sides = sides.withColumn("mark", F.lit(None).cast("bigint")) if marks is None else sides.join(marks, "key", "left")
    rows = scratch.table(rows.drop("g").join(sides, "key"), "marked")
    scratch.drop("groups")
    one = rows.where((c("n") - c("p") + 1) * (OVER + UNDER) >= c("n") * 2 * OVER)
    two = rows.toDF(*[f"{x}2" for x in rows.columns]).withColumnRenamed("gram2", "gram")
    smaller = (c("n") < c("n2")) | ((c("n") == c("n2")) & (c("key") < c("key2")))
    apart = ~F.coalesce(c("mark") == c("mark2"), F.lit(False)) & ~F.coalesce(c("before") == c("before2"), F.lit(False))
    odd = F.bit_count(c("u").bitwiseXOR(c("u2"))) + F.bit_count(c("v").bitwiseXOR(c("v2")))
    close = odd * (OVER + UNDER) <= (c("n") + c("n2")) * (UNDER - OVER)
    pairs = one.join(two, "gram").where(smaller & apart & fits(c("n"), c("n2"), c("p"), c("p2")) & close)
    edges.append(verified(pairs.select(c("key").alias("fp"), c("key2").alias("hub")), nodes, scratch, "pairs", sent))
    found = edges[0]
    for e in edges[1:]:
        found = found.unionAll(e)
    return found
