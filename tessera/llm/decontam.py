"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` cuts the training documents into segments and stores the positional postings of
every token of each; a segment is one row of a table in the shared folder, of about a megabyte, and the table is
written in small row groups, so that neither its writer nor a reader ever holds many.  ``search`` intersects
offset-adjusted postings inside each segment, from the rarest query term to the commonest, so no
posting is ever shuffled and a hot term is as cheap as its list in one segment.  Phrases
(``contamination``) and terms in proximity (``proximity``) are exact.

Defined results: a null or empty text has no words and no hits; a text longer than a segment is a
segment of its own, read whole; repeated rows are separate documents, each with its own result; a null id
stays null; empty tables give empty results (or documents without hits); other columns are ignored, so they
may clash with anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, chunks_by_bytes, text_bytes, tokens

SEGMENT_BYTES = 1 << 20
#: Query items go to the executors in blocks of at most this many bytes of text.
BLOCK_BYTES = 4 << 20
WINDOW = 10
#: Candidates that are intersected at a time.
CANDIDATES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True

INDEX_SCHEMA = "segment string, doc_ids array<bigint>, marks array<int>, doc_starts array<int>, terms array<string>, counts array<int>, postings binary"


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts in order, and their number per text."""
    raw, offsets = text_bytes(texts)
    raw = _LOWER[raw]
    starts, ends, counts = tokens(raw, offsets, _WORD)
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32 if len(raw) < 1 << 31 else np.int64)
    kind = pa.StringArray if at.dtype == np.int32 else pa.LargeStringArray
    return kind.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw[_WORD[raw]]))), counts


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for b in batches:
        text = b.column("text")
        sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        for lo, hi in chunks_by_bytes(sizes, SEGMENT_BYTES):
            flat, counts = words(text.slice(lo, hi - lo))
            coded = flat.dictionary_encode()
            ids = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable").astype(np.uint32)
            posts = np.diff(order, prepend=np.uint32(0))  # small numbers, which compress; wraps around between terms
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{part}-{n}"]),
                    pa.array([b.column("doc_id").slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())),
                    pa.array([b.column("mark").slice(lo, hi - lo).to_pylist()], pa.list_(pa.int32())),
                    pa.array([np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)], pa.list_(pa.int32())),
                    pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string())),
                    pa.array([np.bincount(ids, minlength=len(coded.dictionary)).astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([posts.tobytes()], pa.binary()),
                ],
                names=["segment", "doc_ids", "marks", "doc_starts", "terms", "counts", "postings"],
            )
            n += 1


def build_index(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores the postings of every token: rows of ``INDEX_SCHEMA``.  A document's mark is a digest of its text and id."""
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = narrow.select("doc_id", F.hash("text", "doc_id").alias("mark"), "text")
    return scratch.table(marked.mapInArrow(_segments, INDEX_SCHEMA), "index", **{"parquet.page.size.row.check.min": "1"})


class _Segment:
    """A stored segment with its postings as sorted keys (term, position)."""

    def __init__(self, row: dict):
        self.doc_ids, self.marks, self.starts = row["doc_ids"], row["marks"], row["doc_starts"].to_numpy().astype(np.int64)
        self.terms, self.counts = row["terms"].cast(pa.string()), row["counts"].to_numpy().astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.positions = np.cumsum(np.frombuffer(row["postings"], np.uint32), dtype=np.uint32).astype(np.int64)
        self.keys = np.repeat(np.arange(len(self.counts), dtype=np.int64) << 32, self.counts) | self.positions

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = (term << 32) | position
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return (position >= 0) & (self.keys[at] == key)

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, "right") - 1

    def lookup(self, vocabulary: pa.Array) -> np.ndarray:
        found = pc.index_in(vocabulary, value_set=self.terms)
        return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)


class Queries:
    """A block of distinct word sequences, as rows of vocabulary numbers padded with -1."""

    def __init__(self, sequences: dict[tuple[str, ...], list]):
        self.owners = list(sequences.values())
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for s in sequences for t in s))}
        self.vocabulary = pa.array(list(vocabulary), pa.string())
        self.lengths = np.array([len(s) for s in sequences], np.int64)
        self.rows = np.full((len(sequences), int(self.lengths.max(initial=1))), -1, np.int64)
        for i, s in enumerate(sequences):
            self.rows[i, : len(s)] = [vocabulary[t] for t in s]


def _rarest_first(seg: _Segment, q: Queries):
    """Of the sequences whose terms all occur: their numbers, terms and the order from the rarest, in bounded pieces."""
    if not len(q.rows) or not len(seg.keys):
        return
    pad = q.rows < 0
    term = np.where(pad, 0, seg.lookup(q.vocabulary)[q.rows])
    alive = np.flatnonzero((term >= 0).all(axis=1))
    term, pad = term[alive], pad[alive]
    df = np.where(pad, np.iinfo(np.int64).max, seg.counts[term])
    order = np.argsort(df, axis=1, kind="stable")
    load = df[np.arange(len(alive)), order[:, 0]]
    begin, total = 0, 0
    for i, x in enumerate(load.tolist()):
        if i > begin and total + x > CANDIDATES:
            yield alive[begin:i], term[begin:i], order[begin:i], load[begin:i]
            begin, total = i, 0
        total += x
    if begin < len(alive):
        yield alive[begin:], term[begin:], order[begin:], load[begin:]


def _postings_of(seg: _Segment, term: np.ndarray, load: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and positions of each row's term."""
    row = np.repeat(np.arange(len(term)), load)
    within = np.arange(len(row)) - np.repeat(np.cumsum(load) - load, load)
    return row, seg.positions[seg.first[term][row] + within]


def phrases(seg: _Segment, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """Exact occurrences: sequence numbers and start positions in the segment."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for number, term, order, load in _rarest_first(seg, q):
        length = q.lengths[number]
        row, pos = _postings_of(seg, term[np.arange(len(term)), order[:, 0]], load)
        start = pos - order[row, 0]
        for k in range(1, term.shape[1]):
            slot = order[row, k]
            ok = (k >= length[row]) | seg.has(term[row, slot], start + slot)
            row, start = row[ok], start[ok]
        ok = start >= 0
        row, start = row[ok], start[ok]
        ok = start + length[row] <= seg.starts[np.minimum(seg.doc_of(start) + 1, len(seg.starts) - 1)]
        found.append((number[row[ok]], start[ok]))
    return tuple(np.concatenate(x) for x in zip(*found))


def near(seg: _Segment, q: Queries, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``slop`` words with every term of a sequence, by sequence number and start; they lie in one document."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for number, term, order, load in _rarest_first(seg, q):
        length = q.lengths[number]
        row, pos = _postings_of(seg, term[np.arange(len(term)), order[:, 0]], load)
        doc = seg.doc_of(pos)
        lo, hi = seg.starts[doc], seg.starts[doc + 1]
        row, start, lo, hi = (np.repeat(x, slop) for x in (row, pos, lo, hi))
        start = start - np.tile(np.arange(slop), len(pos))
        ok = (start >= lo) & (start < hi)
        row, start, hi = row[ok], start[ok], hi[ok]
        for k in range(1, term.shape[1]):
            key = (term[row, order[row, k]] << 32) | start
            at = np.searchsorted(seg.keys, key)
            nxt = seg.keys[np.minimum(at, len(seg.keys) - 1)]
            ok = (k >= length[row]) | ((at < len(seg.keys)) & (nxt < key + np.minimum(slop, hi - start)))
            row, start, hi = row[ok], start[ok], hi[ok]
        pairs = np.unique(np.stack([number[row], start]), axis=1)
        found.append((pairs[0], pairs[1]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, _Segment]]:
    for b in batches:
        for i in range(b.num_rows):
            lists = {c: b.column(c)[i].values for c in ("doc_ids", "marks", "doc_starts", "terms", "counts")}
            yield b.column("segment")[i].as_py(), _Segment(lists | {"postings": b.column("postings")[i].as_buffer()})


def _contaminated(q: Queries):
    kind = pa.schema([("segment", pa.string()), ("ordinal", pa.int32()), ("doc_id", pa.int64()), ("mark", pa.int32()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.int64()))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, seg in _rows(batches):
            number, start = phrases(seg, q)
            covered = np.zeros(int(seg.starts[-1]) + 1, np.int32)
            np.add.at(covered, start, 1)
            np.add.at(covered, start + q.lengths[number], -1)
            hit = np.flatnonzero(np.cumsum(covered[:-1]))
            items: dict[int, set] = {}
            for d, i in {*zip(seg.doc_of(start).tolist(), number.tolist())}:
                items.setdefault(d, set()).update(q.owners[i])
            at = np.searchsorted(hit, seg.starts)
            n = len(seg.doc_ids)
            hits = [(hit[at[d] : at[d + 1]] - seg.starts[d]).astype(np.int32) for d in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * n), pa.array(np.arange(n, dtype=np.int32)), seg.doc_ids, seg.marks, pa.array(np.diff(seg.starts)), pa.array(hits, kind.field("hits").type), pa.array([sorted(items.get(d, ()), key=lambda x: (x is None, x)) for d in range(n)], kind.field("items").type)],
                schema=kind,
            )

    return search


def windows(text: str | None, size: int) -> list[tuple[str, ...]]:
    w = words(pa.array([text], pa.string()))[0].to_pylist()
    return [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def item_blocks(items: DataFrame, cut, id_col: str = "item_id", text_col: str = "text") -> Iterator[Queries]:
    """The items as blocks of bounded size; ``cut`` turns a text into sequences.  Items stream through the driver, a block at a time."""
    block: dict[tuple[str, ...], list] = {}
    size = 0
    for row in items.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        for s in cut(row.t):
            owners = block.setdefault(s, [])
            if row.i not in owners:
                owners.append(row.i)
        size += len(row.t or "")
        if size > BLOCK_BYTES:
            yield Queries(block)
            block, size = {}, 0
    yield Queries(block)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, mark, n_words, hits (sorted positions of words inside occurrences) and items (sorted ids).

    An item gives every run of ``window`` words, or itself when it is shorter.
    """
    out = "segment string, ordinal int, doc_id bigint, mark int, n_words bigint, hits array<int>, items array<bigint>"
    with Scratch(docs.sparkSession) as scratch:
        index = build_index(docs, scratch, id_col, text_col)
        parts = [index.mapInArrow(_contaminated(q), out) for q in item_blocks(items, lambda t: windows(t, window))]
        if len(parts) > 1:
            found = parts[0]
            for p in parts[1:]:
                found = found.unionAll(p)
            flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
            found = found.groupBy("segment", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.first("mark").alias("mark"), F.first("n_words").alias("n_words"), flat("hits"), flat("items"))
        else:
            found = parts[0]
        return scratch.result(found.select("doc_id", "mark", "n_words", "hits", "items"))


def proximity(docs: DataFrame, queries: DataFrame, slop: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, start): every stretch of ``slop`` words of one document that holds all the words of an item.

    A stretch may run past a document's end, where it is shorter.
    """
    kind = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int32())])

    def cut(text):
        w = tuple(dict.fromkeys(words(pa.array([text], pa.string()))[0].to_pylist()))
        return [w] if w else []

    def searcher(q: Queries):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, seg in _rows(batches):
                number, start = near(seg, q, slop)
                doc = seg.doc_of(start)
                ids = seg.doc_ids.to_pylist()
                rows = [(ids[d], i, s) for d, n, s in zip(doc.tolist(), number.tolist(), (start - seg.starts[doc]).tolist()) for i in q.owners[n]]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else ((), (), ()), kind)], schema=kind)

        return search

    with Scratch(docs.sparkSession) as scratch:
        index = build_index(docs, scratch, id_col, text_col)
        found = None
        for q in item_blocks(queries, cut):
            part = index.mapInArrow(searcher(q), "doc_id bigint, item_id bigint, start int")
            found = part if found is None else found.unionAll(part)
        return scratch.result(found)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from ``contamination``."""
    joined = F.array_join(F.array_sort(F.transform(F.filter("items", lambda x: x.isNotNull()), lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", F.size("hits").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def stage(spark, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Removes the words inside benchmark passages' documents: documents with any hit go.  A null id goes with its own rows only when hit.

    Documents are matched back by two digests of id and text, so that repeated ids are judged each by their own text; the join is the
    same at every size.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column of the input clashes
    key = F.xxhash64("doc_id", "text")
    bad = contamination(docs.select(key.alias("doc_id"), "text"), items).where(F.size("hits") > 0).select(F.col("doc_id").alias("key"), "mark").distinct()
    keyed = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names)], key.alias("key"))
    text = F.col(names[docs.columns.index("text")]).cast("string")
    kept = keyed.withColumn("mark", F.hash(text, F.col("key"))).join(bad.hint("merge"), ["key", "mark"], "left_anti")
    return kept.select(*names).toDF(*docs.columns)


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH docs AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents
), items AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark
), wins AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS g FROM items, range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1) r(i) WHERE len(w) > 0
), grams AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM docs, (SELECT DISTINCT n FROM wins) s, range(1, len(w) - n + 2) r(i)
), hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN wins USING (n, g)
), places AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, range(0, n) k(j) GROUP BY 1
), named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::varchar AS s FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)
"""
