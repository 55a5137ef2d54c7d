"""Line dedup with a log-template tree, in DataFrame operations only.

A line's words are its fields; a word with a digit or an at sign is a variable field at once,
unless such words make up more than ``MOST`` percent of the line (a table's row keeps its numbers).  The line
goes down a tree of fixed depth: first by its number of words, then by its leading words (``DEPTH``, or half of a
shorter line's), to a leaf.  A leaf has any number of templates: every line as it stands, and, where the leaf holds several
lines, every line with one of ``PIECES`` stretches of its remaining words generalised to a variable field; at most
about a fifth of a line's words vary.  Lines under ``LEAST`` words have no variable stretch.  The first document that
shows a template (smallest doc_id, nulls last) owns it; a line goes from every document but the owner of all
its templates.

Distinct lines are aggregated map-side before they meet, so the commonest line of all is one row per task, and
templates are formed only in leaves of several lines; only digests and numbers are shuffled until the dropped line
numbers meet their document.

Defined results: blank lines are never dropped and a null text stays null; very long texts are lines like others; rows that
repeat both id and text are one document and are treated alike; repeats of a line within its first document stay; other
columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

DEPTH, PIECES, LEAST, MOST = 8, 5, 5, 40
SPACE = r"[\x20\x09-\x0D]+"
VARIABLE = "<*>"
_LAST = (1 << 63) - 1


def plain_line(line: Column) -> Column:
    """The line with single spaces."""
    odd = F.contains(line, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(line, F.lit(c))
    plain = F.when(odd, F.regexp_replace(line, SPACE, " ")).otherwise(line)
    return F.trim(plain)


def generalised(plain: Column) -> Column:
    """The line with its variable words generalised, if they are few enough."""
    return F.when(plain.rlike("[0-9@]"), F.regexp_replace(plain, r"[^ ]*[0-9@][^ ]*", VARIABLE)).otherwise(plain)


def n_words(line: Column) -> Column:
    """Words of a line with single spaces."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def few(line: Column) -> Column:
    """Whether generalised words are at most ``MOST`` percent of a line with single spaces."""
    fields = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(VARIABLE), F.lit("")))) / len(VARIABLE)
    return fields * 100 <= n_words(line) * MOST


def lines_of(docs: DataFrame) -> DataFrame:
    """One row per line with a word, from (key, mark, doc_id, text): its number, leaf, digests and templates t0 to t4.

    Columns are made one step at a time, so that no expression is evaluated twice for a line.
    """
    blank = F.btrim("line", F.lit(" \t\x0b\x0c\r")) == ""
    own = ["key", "mark", "doc_id", "line_no"]
    rows = docs.select("key", "mark", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where(~blank)
    rows = rows.select(*own, plain_line(F.col("line")).alias("plain"))
    rows = rows.select(*own, "plain", generalised(F.col("plain")).alias("mask"))
    rows = rows.select(*own, F.when(few(F.col("mask")), F.col("mask")).otherwise(F.col("plain")).alias("line"))
    rows = rows.select("*", n_words(F.col("line")).alias("n"))
    rows = rows.select("*", F.least(F.lit(DEPTH), F.expr("(n + 1) div 2")).cast("int").alias("depth"))
    rows = rows.select("*", F.ceil((F.col("n") - F.col("depth")) / PIECES).cast("int").alias("step"))
    head = lambda k: F.expr(f"substring_index(line, ' ', depth + {k} * step)")
    tail = lambda k: F.expr(f"substring_index(line, ' ', least(0, depth + {k + 1} * step - n))")  # noqa: E731  the words after the stretch
    has = lambda k: (F.col("n") >= LEAST) & (F.col("depth") + k * F.col("step") < F.col("n"))
    return rows.select(
        *own,
        F.xxhash64("n", head(0)).alias("leaf"),
        F.xxhash64("line").alias("h1"),
        F.xxhash64(F.lit(1), "line").alias("h2"),
        *[F.when(has(k), F.xxhash64(F.lit(k), "n", head(k), tail(k))).alias(f"t{k}") for k in range(PIECES)],
    )


def verdicts(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (h1, h2, key, mark) of distinct lines that go from some document: the owner's, who keeps them."""
    ts = [f"t{k}" for k in range(PIECES)]
    owner = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), "key", "mark")
    distinct = lines.groupBy("h1", "h2").agg(F.min(owner).alias("owner"), F.min("key").alias("low"), F.max("key").alias("high"), F.min("leaf").alias("leaf"), *[F.min(t).alias(t) for t in ts])
    distinct = scratch.table(distinct, "distinct")
    leaves = scratch.table(distinct.where("t0 IS NOT NULL").groupBy("leaf").agg(F.count("*").alias("c")).where("c > 1").select("leaf"), "leaves")
    shown = scratch.table(distinct.select("h1", "h2", "owner", "leaf", *ts).join(leaves, "leaf").select("h1", "h2", "owner", F.explode(F.array_compact(F.array(*ts))).alias("t")), "shown")
    shared = scratch.table(shown.groupBy("t").agg(F.min("owner").alias("first"), F.count("*").alias("c")).where("c > 1").select("t", "first"), "shared")
    earlier = shown.join(shared, "t").where("first < owner").select("h1", "h2", F.col("first").alias("owner"))
    again = distinct.where("low <> high").select("h1", "h2", "owner").unionAll(earlier)
    return again.groupBy("h1", "h2").agg(F.min("owner").alias("owner")).select("h1", "h2", "owner.key", "owner.mark")


def dropped(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (key, mark, n_gone, flags) of documents that lose a line: flags holds, by line number, the lines with a word that go."""
    lines = scratch.table(lines_of(docs), "lines")
    owners = scratch.table(verdicts(lines, scratch).toDF("h1", "h2", "of", "of2"), "verdicts")
    judged = lines.select("key", "mark", "line_no", "h1", "h2").join(owners, ["h1", "h2"]).where("key <> of OR mark <> of2")
    gone = judged.groupBy("key", "mark").agg(F.array_sort(F.collect_set("line_no")).alias("gone"))
    prior = F.concat(F.array(F.lit(-1)), F.slice("gone", 1, F.size("gone") - 1))
    runs = F.zip_with("gone", prior, lambda a, b: F.concat(F.array_repeat(F.lit(False), a - b - 1), F.array(F.lit(True))))
    return gone.select("key", "mark", F.size("gone").alias("n_gone"), F.flatten(runs).alias("flags"))


def judged_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, Column, Column, Column]:
    """The input with its columns renamed c0, c1 and so on, and of each row the text without dropped lines, its lines and its dropped lines (longs)."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column of the input clashes
    rows = docs.toDF(*names)
    text, ident = F.col(names[docs.columns.index(text_col)]).cast("string"), F.col(names[docs.columns.index(id_col)]).cast("bigint")
    rows = rows.withColumns({"key": F.xxhash64(ident, text), "mark": F.hash(text, ident)})
    with Scratch(docs.sparkSession) as scratch:
        gone = scratch.result(dropped(rows.select("key", "mark", ident.alias("doc_id"), text.alias("text")), scratch), "gone")
    out = rows.join(gone.hint("merge"), ["key", "mark"], "left")  # one plan at every size
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.coalesce(F.get("flags", i), F.lit(False)))
    return (
        out,
        F.when(F.col("flags").isNull(), text).otherwise(F.array_join(kept, "\n")),
        F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).cast("bigint"),
        F.coalesce("n_gone", F.lit(0)).cast("bigint"),
    )


def dedup_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The input with its text without dropped lines, then n_lines and n_dropped (longs), which take the place of columns of that name."""
    out, text, n_lines, n_dropped = judged_lines(docs, text_col, id_col)
    cols = [text.alias(c) if c == text_col else F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ("n_lines", "n_dropped")]
    return out.select(*cols, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def digest(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame) -> DataFrame:
    """The documents without their dropped lines; documents that keep no word go, n_chars is counted anew."""
    out, text, _, n_dropped = judged_lines(docs)
    names = [f"c{i}" for i in range(len(docs.columns))]
    out = out.select(*names, text.alias("kept"), n_dropped.alias("n")).where(~((F.col("n") > 0) & (F.regexp_replace("kept", SPACE, "") == "")))
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("kept"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(n)).alias(c) for n, c in zip(names, docs.columns)])


SQL = rf"""
WITH lines AS (
  SELECT doc_id, u.i - 1 AS line_no, trim(regexp_replace(u.line, '[\x20\x09-\x0D]+', ' ', 'g')) AS plain
  FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: struct_pack(line := x, i := i))) AS u FROM documents)
), shown AS (
  SELECT doc_id, line_no, CASE WHEN (length(mask) - length(replace(mask, '{VARIABLE}', ''))) / {len(VARIABLE)} * 100 <= len(string_split(mask, ' ')) * {MOST} THEN mask ELSE plain END AS line
  FROM (SELECT *, regexp_replace(plain, '[^ ]*[0-9@][^ ]*', '{VARIABLE}', 'g') AS mask FROM lines WHERE plain <> '')
), fields AS (
  SELECT *, string_split(line, ' ') AS w, len(string_split(line, ' ')) AS n, least({DEPTH}, (len(string_split(line, ' ')) + 1) // 2) AS d FROM shown
), uniq AS (
  SELECT line, any_value(w) AS w, any_value(n) AS n, any_value(d) AS d, ceil((any_value(n) - any_value(d)) / {PIECES})::INT AS step, min(doc_id) AS owner FROM fields GROUP BY line
), templates AS (
  SELECT line, owner, line AS t FROM uniq
  UNION ALL
  SELECT line, owner, n::VARCHAR || ' ' || k::VARCHAR || ' ' || array_to_string(w[1 : d + k * step], ' ') || chr(10) || coalesce(array_to_string(w[d + (k + 1) * step + 1 : n], ' '), '')
  FROM uniq, range({PIECES}) r(k) WHERE n >= {LEAST} AND d + k * step < n
), owners AS (SELECT t, min(owner) AS owner FROM templates GROUP BY t
), verdict AS (SELECT line, min(owners.owner) AS owner FROM templates JOIN owners USING (t) GROUP BY line
), gone AS (SELECT doc_id, list(line_no) AS gone FROM fields JOIN verdict USING (line) WHERE doc_id <> owner GROUP BY doc_id)
SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped,
  sha256(CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)), '') END) AS kept_sha256
FROM documents LEFT JOIN gone USING (doc_id)
"""
