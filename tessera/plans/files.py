"""File formats, written and read back: what comes out is what went in."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import strings as S
from tessera.sources import sinks
from tessera.sources import tables as T
from tessera.sources.shared import folder
from tessera.sources.tables import table
from tessera.streaming import events as E

_PARTS = "p_partkey bigint, p_name string, p_brand string, p_size bigint, p_retailprice double"
_COLUMNS = [x.split()[0] for x in _PARTS.split(", ")]
_SQL = "SELECT p_partkey, p_name, p_brand, p_size::bigint AS p_size, p_retailprice FROM part"


def _parts(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", "p_name", "p_brand", F.col("p_size").cast("bigint").alias("p_size"), "p_retailprice")


@query(_SQL)
def csv_scan(s, d):
    sinks.write_csv(_parts(s, d), path := folder(s))
    return T.csv(s, path, _PARTS)


@query("SELECT p_partkey AS id, p_name AS label, p_brand AS maker, p_size::bigint AS extent, p_retailprice AS cost FROM part")
def csv_new_header(s, d):
    """The file's header is skipped for names of our own."""
    sinks.write_csv(_parts(s, d), path := folder(s))
    return T.csv(s, path, "id bigint, label string, maker string, extent bigint, cost double")


@query("SELECT * FROM (" + _SQL + ") WHERE p_size > 25")
def excel_csv_scan(s, d):
    """A file for spreadsheets, with a byte-order mark."""
    sinks.write_excel_csv(_parts(s, d).where("p_size > 25"), path := folder(s))
    return T.csv(s, path, _PARTS)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_document_scan(s, d):
    """One JSON document that holds a list."""
    rows = table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey")  # a few rows at any size
    path = folder(s)
    rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns)), {"pretty": "true"}).alias("value")).write.text(path)
    return T.json_document(s, path, "n_nationkey bigint, n_name string, n_regionkey bigint")


@query("SELECT text AS prompt, role AS chosen, 'x' || turn AS rejected, CASE WHEN conv_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM conversations")
def jsonl_splits_scan(s, d):
    """JSON lines of two named splits."""
    c = table(s, d, "conversations").select("conv_id", F.col("text").alias("prompt"), F.col("role").alias("chosen"), F.concat(F.lit("x"), F.col("turn").cast("string")).alias("rejected"))
    files = {"validation": folder(s), "train": folder(s)}
    for split, path in files.items():
        c.where((F.col("conv_id") % 5 == 0) == F.lit(split == "validation")).drop("conv_id").write.json(path)
    return T.jsonl_splits(s, files, T.PREFERENCES)


@query("SELECT '' AS instruction, text AS input, role AS output FROM conversations WHERE role = 'user'")
def jsonl_scan(s, d):
    """Rows of the fine-tuning format; an empty text stays one."""
    path = folder(s)
    table(s, d, "conversations").where("role = 'user'").select(F.lit("").alias("instruction"), F.col("text").alias("input"), F.col("role").alias("output")).write.json(path)
    return s.read.schema(T.SFT_ROWS).json(path)


@query("SELECT count(*) AS n, round(avg(contains(lower(text), 'sorry')::int), 6) AS share FROM conversations")
def report_json(s, d):
    """A report of one row, written as a JSON object."""
    c = table(s, d, "conversations")
    sinks.write_report(c.agg(F.count("*").alias("n"), F.round(F.avg(F.contains(F.lower("text"), F.lit("sorry")).cast("int")), 6).alias("share")), path := folder(s))
    return s.read.schema("n bigint, share double").json(path)


@query("SELECT role AS prompt, text AS completion, length(text)::bigint AS score FROM conversations ORDER BY role, text LIMIT 5")
def tracker_table(s, d):
    """The first rows by prompt, as a tracker shows them."""
    c = table(s, d, "conversations").select(F.col("role").alias("prompt"), F.col("text").alias("completion"), F.length("text").cast("bigint").alias("score"))
    return sinks.sample_table(c, "prompt", "completion", 5, "score")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(s, d):
    """The stream of events in windows of an hour, run to its end."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.read.parquet(f"{d}/events.parquet").schema)
    out = E.to_memory(E.windowed(E.source(s, d, "events.parquet", schema)), "tessera_windows", "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(r"WITH n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM documents) SELECT doc_id, doc_id // 8 AS batch, n::int AS n, (max(n) OVER (PARTITION BY doc_id // 8))::int AS padded FROM n")
def collate(s, d):
    """Batches of eight padded to their longest member: lengths and padded lengths, as a collator gives them; no padding is made."""
    n = table(s, d, "documents").select("doc_id", F.expr("doc_id div 8").alias("batch"), F.size(S.tokens("text")).alias("n"))
    longest = n.groupBy("batch").agg(F.max("n").alias("padded"))
    return n.join(longest, "batch").select("doc_id", "batch", "n", "padded")
