"""Mixing sources to target weights by systematic sampling.

Every document expects ``target / source size`` copies.  Within a source the expected copies are
prefix-summed, one random offset is added, and a document is emitted once for each integer its stretch
of the sum crosses.  Of ``DRAWS`` random offsets the one whose words come nearest to the source's target is taken.  The order inside a source is by size class, then by a hashed bucket, so that the
sample is spread evenly over sizes and the words taken come close to the target; a size class has a bucket
for every ``ROWS`` of its rows, and prefix sums of buckets are taken before those of rows, so a source with a third of
all rows is many pieces of a few hundred rows at any size.  Sums are fixed-point integers: reruns agree on any number of
machines.

Defined results: a null text has size 0, a very long one is a document like others; a null source is a source, last in order; repeated rows
share what their sum crosses, each as often as its own stretch says; an empty table gives an empty result;
a source of size 0 has target 0 and nothing is taken.  ``stage`` replaces columns of the input named
size, source_size, target, copies or copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, Scratch

WEIGHTS, CAP, CLASSES_PER_OCTAVE, SEED = (5, 2, 1), 3, 4, 20240607
#: Rows of a bucket, about, and offsets drawn for each source.
ROWS, DRAWS = 512, 32
#: Rows of a table about sources that is sent to all tasks; a longer one is joined.
SENT = 1 << 16
#: Fixed point: copies count in units of 2 ** -BITS.
BITS = 40


def draw(seed: int, *parts: Column) -> Column:
    """A number of 60 bits drawn by the parts, texts or null: the same in every run and engine."""
    texts = [x for p in parts for x in (F.lit(":"), F.coalesce(p.cast("string"), F.lit("null")))]
    return F.conv(F.substring(F.md5(F.concat(F.lit(str(seed)), *texts)), 1, 15), 16, 10).cast("bigint")


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Rows (none, name, source_size, target) from (none, name, source_size): shares by weight of the total, capped.

    Targets are min(cap * size, level * weight); the level is found in order of cap * size / weight, where
    a source is capped as long as the level that its successors would share lies above its own ratio.
    """
    order = Window.orderBy("none", F.col("name"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(x).cast("bigint") for x in weights]), (turn + 1).cast("int")))
    up = Window.orderBy(F.col("source_size") / F.col("weight"), "none", "name")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    w = w.select(
        "*",
        F.sum("source_size").over(total).alias("all"),
        (cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("capped"),
        (F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left"),
    )
    level = F.col("level")
    w = w.withColumn("level", (F.col("all") - F.col("capped")).cast("double") / F.col("left").cast("double"))
    fits = level * F.col("weight") <= F.col("source_size") * cap
    w = w.withColumn("final", F.min(F.when(fits, F.struct(F.col("capped").alias("c"), level.alias("v")))).over(total)["v"])
    target = F.least((F.col("source_size") * cap).cast("double"), F.col("final") * F.col("weight"))
    return w.select("none", "name", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def places(rows: DataFrame, strata: list[str], bucket: list[str], expected: str, order: list) -> DataFrame:
    """Adds ``__place``: where each row's stretch of the prefix sum of ``expected`` (fixed point) begins within a stratum, less its whole copies.

    bucket: columns that split a stratum into pieces, pieces of pieces and so on, in order; order: within the smallest.  Sums go up level by
    level, so that no task sees more than the pieces of one piece.
    """
    one = F.lit(1 << BITS).cast("decimal(38,0)")
    keys = [*strata, *bucket]
    total = rows.groupBy(*keys).agg(F.sum(F.col(expected).cast("decimal(20,0)")).cast("decimal(38,0)").alias("__sum"))
    base = None
    for depth in range(len(bucket) - 1, -1, -1):
        above, own = [*strata, *bucket[:depth]], [*strata, *bucket[: depth + 1]]
        run = Window.partitionBy(*above).orderBy(bucket[depth]).rowsBetween(Window.unboundedPreceding, -1)
        level = total.select(*own, F.coalesce(F.sum("__sum").over(run), F.lit(0)).cast("decimal(38,0)").alias(f"__base{depth}"))
        base = level if base is None else base.join(level, own)
        total = total.groupBy(*above).agg(F.sum("__sum").cast("decimal(38,0)").alias("__sum"))
    bases = [f"__base{depth}" for depth in range(len(bucket))]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    prefix = F.coalesce(F.sum(F.col(expected).cast("decimal(20,0)")).over(w), F.lit(0)).cast("decimal(38,0)")
    own = rows.withColumn("__own", prefix).join(base, keys)
    place = F.pmod(sum((F.col(c) for c in bases), F.col("__own")).cast("decimal(38,0)"), one).cast("bigint")
    return own.withColumn("__place", place).drop("__own", *bases)


def crossed(offset: Column) -> Column:
    """The integers that a row's stretch crosses once the offset is added."""
    return F.shiftright(F.pmod(F.col("__place") + offset, F.lit(1 << BITS)) + F.col("__expected"), BITS)


def mix(docs: DataFrame, scratch: Scratch, carry: list[str], seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lazy: bool = False) -> DataFrame:
    """The columns ``carry`` with size, source_size, target (double) and copies (long, 0 to ``cap``) of each row.

    Texts are read to measure them, and shuffled only when carried.  lazy: the result is not made of tables that go with the block, but
    measures its rows again.
    """
    held = [f"c{i}" for i in range(len(carry))]  # so that no column of the input clashes
    rows = docs.select(*[docs[c].alias(h) for c, h in zip(carry, held)], docs[id_col].alias("__id"), docs[text_col].alias("__text"), docs[source_col].cast("string").alias("__source"))
    rows = rows.select("*", size_of(F.col("__text")).alias("size")).select(
        *held,
        "__id",
        "size",
        F.col("__source").isNull().alias("none"),
        F.coalesce("__source", F.lit("")).alias("name"),
        F.floor(CLASSES_PER_OCTAVE * F.log2(F.col("size") + 1) + 1e-9).cast("int").alias("__class"),
        draw(seed, F.col("__id"), F.col("__text")).alias("__draw"),
        F.xxhash64("__text").alias("__tie"),
    )
    write = scratch.result if lazy else scratch.table
    measured = scratch.table(rows.drop(*held) if lazy else rows, "measured")
    goal = targets(measured.groupBy("none", "name").agg(F.sum("size").alias("source_size")), weights, cap)
    share = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    goal = goal.withColumn("__expected", F.least(F.floor(share * (1 << BITS)), F.lit(cap << BITS)).cast("bigint"))
    goal = goal.join(measured.groupBy("none", "name", "__class").agg(F.count("*").alias("n")), ["none", "name"])
    goal = write(goal.select("none", "name", "__class", "source_size", "target", "__expected", F.ceil(F.col("n") / ROWS).alias("__buckets")), "goal")
    source, bucket, order = ["none", "name"], ["__class", "__bucket"], ["size", "__id", "__tie"]
    few = scratch.few(goal, SENT)  # a row for each size class of a source; tables with a row for each source are shorter
    sent = lambda df: F.broadcast(df) if few else df
    dealt = lambda df: df.join(sent(goal), [*source, "__class"]).withColumn("__bucket", F.pmod("__draw", "__buckets").cast("int"))
    narrow = places(dealt(measured).select(*source, *bucket, *order, "__expected", "target"), source, bucket, "__expected", order)
    offsets = [F.pmod(draw(seed, F.lit(k), F.when(~F.col("none"), F.col("name"))), F.lit(1 << BITS)) for k in range(DRAWS)]
    drawn = goal.select(*source).distinct().select(*source, F.array(*offsets).alias("offsets"))
    words = narrow.join(sent(drawn), source).groupBy(*source).agg(F.first("target").alias("target"), F.first("offsets").alias("offsets"), *[F.sum(F.col("size") * crossed(F.col("offsets")[k])).alias(f"w{k}") for k in range(DRAWS)])
    off = [F.struct(F.abs(F.col(f"w{k}") - F.col("target")), F.lit(k), F.col("offsets")[k].alias("offset")) for k in range(DRAWS)]
    best = write(words.select(*source, F.array_min(F.array(*off))["offset"].alias("__offset")), "offsets")
    out = places(dealt(rows if lazy else measured), source, bucket, "__expected", order).join(sent(best), source).withColumn("copies", crossed(F.col("__offset")))
    return out.select(*[F.col(h).alias(c) for c, h in zip(carry, held)], "size", "source_size", "target", "copies")


def digest(docs: DataFrame) -> DataFrame:
    with Scratch(docs.sparkSession) as scratch:
        mixed = mix(docs.select("doc_id", "source", "text"), scratch, ["doc_id"])
        return scratch.result(mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")))


def stage(spark, docs: DataFrame) -> DataFrame:
    """The mix: a document once for each copy taken, with ``copy`` from 1; other columns as they came.

    A document without a word weighs nothing and follows its source's rate like others.
    """
    base = docs.drop("size", "source_size", "target", "copies", "copy")
    with Scratch(spark) as scratch:
        mixed = mix(base, scratch, base.columns, lazy=True).where("copies > 0").drop("size", "source_size", "target")
        return mixed.select(*base.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))


SQL = rf"""
WITH m AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size FROM documents
), s AS (SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM m GROUP BY 1
), w AS (SELECT *, CASE r % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS weight, sum(source_size) OVER () AS total FROM s
), v AS (
  SELECT a.source, a.r, a.source_size / a.weight::double AS ratio, (a.total - {CAP} * coalesce((SELECT sum(b.source_size) FROM w b WHERE b.source_size * a.weight < a.source_size * b.weight), 0))::double
    / (SELECT sum(b.weight) FROM w b WHERE b.source_size * a.weight >= a.source_size * b.weight)::double AS level
  FROM w a
), level AS (SELECT arg_min(level, ratio) AS level FROM v WHERE level <= {CAP} * ratio
), goal AS (SELECT source, source_size, least(({CAP} * source_size)::double, level * weight) AS target FROM w, level
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size::double * {1 << BITS}::double), {CAP << BITS})::bigint ELSE 0 END AS e FROM goal
), c AS (
  SELECT m.*, target, source_size, e, floor({CLASSES_PER_OCTAVE} * log2(size + 1) + 1e-9)::int AS kind, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, 'null') || ':' || coalesce(text, 'null')), 1, 15))::bigint AS draw
  FROM m JOIN g ON m.source IS NOT DISTINCT FROM g.source
), b AS (SELECT *, draw % ceil(count(*) OVER (PARTITION BY source, kind) / {ROWS}::double)::bigint AS bucket FROM c
), p AS (SELECT *, coalesce(sum(e::hugeint) OVER (PARTITION BY source ORDER BY kind, bucket, size, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM b
), o AS (SELECT source, k, ('0x' || substr(md5('{SEED}:' || k || ':' || coalesce(source, 'null')), 1, 15))::bigint % {1 << BITS} AS shift FROM goal, range({DRAWS}) r(k)
), t AS (SELECT o.source, k, shift, any_value(target) AS target, sum((((place + shift) % {1 << BITS} + e) // {1 << BITS}) * size) AS taken FROM p JOIN o ON p.source IS NOT DISTINCT FROM o.source GROUP BY 1, 2, 3
), best AS (SELECT source, shift FROM t QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(taken - target), k) = 1)
SELECT doc_id, size, source_size, target, ((((place + shift) % {1 << BITS} + e) // {1 << BITS}) * size)::bigint AS taken FROM p JOIN best ON p.source IS NOT DISTINCT FROM best.source
"""
