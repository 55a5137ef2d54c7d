"""Removal of every byte covered by a long string that also starts anywhere else.

1. Anchors.  Each start of a ``LENGTH``-byte string has one anchor, the smallest digest of the ``GRAM``-byte
   strings inside it, so equal strings have equal anchors.  Starts that share an anchor are neighbours: an
   anchor stands for a segment, the bytes of all its strings.
2. An anchor digest found once has no partner and goes.  Equal segments of a digest are counted: two or more
   repeat as a whole, and one stands for all of them.
3. Different segments of a digest meet in shards.  A shard's suffix array is induced (``suffix_array``), and
   permuted common prefixes of ``LENGTH`` or more tell which starts repeat.  A digest with over ``HOT``
   segments is first cut by content into short pieces (see ``_pieces``), equal ones are counted, and only
   different pieces that agree in all their common bytes meet; where over ``HOT`` of those are different still,
   their few strings are counted by digest.  Which way a group goes changes what a task holds, never the result.
4. Spans go back to their documents, which are cut in bytes.

Texts are shuffled once; after that only those of documents that share an anchor move.  Matches are judged on
the input and never cross documents.

Defined results: a null text is empty; a very long one is one row, cut in place; texts under ``LENGTH`` bytes lose nothing; repeated rows remove each other
when long enough; a null id is carried; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, chunks_by_bytes, text_bytes
from tessera.llm.suffix_array import common_prefixes, suffix_array

LENGTH, GRAM = 400, 64
#: Segments of one digest from which it is cut into pieces (and pieces of one group from which strings are counted), and the starts of a piece.
HOT, PIECE = 1024, 16
SHARD_BYTES, CHUNK_BYTES = 1 << 20, 1 << 21
#: Bits of a digest that give way to its position: as many whatever is read together, or equal strings could choose by other bits.  A text has under 2^31 bytes.
POSITION_BITS = 31

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _signed(x: int) -> int:
    return x - (1 << 64) * (x >= 1 << 63)


def gram_digests(raw: np.ndarray, size: int) -> np.ndarray:
    """A mixed 64-bit digest of the ``size`` bytes from each position, from prefix sums of a polynomial."""
    n = len(raw)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    del power
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n - size, 0), _INVERSE, np.uint64)]))
    h = (sums[size:] - sums[: n - size + 1]) * back
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts end to end: first start and number of starts of each segment, its anchor's position and digest."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, np.zeros(0, np.uint64)
    h = gram_digests(raw, gram)
    bits = np.uint64(POSITION_BITS)
    packed = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)  # ties go to the leftmost
    w = length - gram + 1
    block = np.concatenate([packed, np.full((-len(packed)) % w, np.iinfo(np.uint64).max)]).reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    at = (np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts]) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    valid = np.zeros(starts + 1, np.int32)  # starts whose string ends in the same text
    size = np.diff(offsets)
    full = size >= length
    np.add.at(valid, offsets[:-1][full], 1)
    np.add.at(valid, offsets[1:][full] - length + 1, -1)
    inside = np.cumsum(valid[:starts]) > 0
    new = inside.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
    begin = np.flatnonzero(new)
    stop = inside.copy()
    stop[:-1] &= (at[1:] != at[:-1]) | ~inside[1:]
    return begin, np.flatnonzero(stop) + 1 - begin, at[begin], h[at[begin]]


def _find(length: int):
    names = ["k", "k2", "p", "n", "a", "h", "g"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("n_bytes").to_numpy()
            for lo, hi in chunks_by_bytes(sizes, CHUNK_BYTES):
                raw, offsets = text_bytes(b.column("text").slice(lo, hi - lo))
                begin, n, at, h = anchors(raw, offsets, length)
                doc = np.searchsorted(offsets, begin, "right") - 1
                view = memoryview(raw.tobytes())
                g = np.fromiter((_signed(xxhash.xxh3_64_intdigest(view[s:e])) for s, e in zip(begin.tolist(), (begin + n + length - 1).tolist())), np.int64, len(begin))
                take = pa.array(doc + lo)
                cols = [b.column("k").take(take), b.column("k2").take(take), *(pa.array(x.astype(np.int32)) for x in (begin - offsets[doc], n, at - begin)), pa.array(h.view(np.int64)), pa.array(g)]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, types)], names=names)

    return run


def _starts_to_runs(flags: np.ndarray) -> list[int]:
    """Flat (begin, end) pairs of the true stretches."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.tolist()


def repeats(pieces: list[bytes], counts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece, which starts of ``length`` bytes also start elsewhere among the pieces; counts over 1 repeat as a whole."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    text = np.frombuffer(b"\0".join(pieces) + b"\0\0", np.uint8).astype(np.uint16) + 2
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    text[begin + sizes] = 1
    text[-1] = 0
    room = np.zeros(len(text), np.int64)
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    room[: len(owner)] = (begin + sizes)[owner] - np.arange(len(owner))
    sa = suffix_array(text)
    phi, shared = common_prefixes(text, sa, room)
    hit = np.zeros(len(text), bool)
    long = np.flatnonzero(shared >= length)
    hit[long] = True
    hit[phi[long]] = True
    return [np.ones(max(0, s - length + 1), bool) if c > 1 else hit[b : b + max(0, s - length + 1)] for b, s, c in zip(begin.tolist(), sizes.tolist(), counts)]


def _segments(length: int):
    """Segments to compare, from affected texts; their digest is the group they meet in."""
    names = ["grp", "h", "g", "m", "body"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, marks in zip(b.column("body"), b.column("marks")):
                raw = text.as_py()
                out += [(x["h"], x["h"], x["g"], x["m"], raw[x["p"] : x["p"] + x["n"] + length - 1]) for x in marks.as_py() if x["send"] == 1]
                if len(out) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return run


def _pieces(length: int):
    """Hot segments cut into pieces: the starts of a segment by their distance from the anchor, ``PIECE`` at a time.

    All strings of one distance class hold the same stretch of bytes, whatever segment they come from; its digest
    is the group, so equal strings are in one group and a group differs in ``PIECE`` bytes at either end at most.
    """
    names = ["grp", "b", "h", "g", "at", "body"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, marks in zip(batch.column("body"), batch.column("marks")):
                raw, out = text.as_py(), []
                for x in marks.as_py():
                    if x["send"] != 2:
                        continue
                    segment, s = raw[x["p"] : x["p"] + x["n"] + length - 1], 0
                    while s < x["n"]:
                        number = (s - x["a"]) // PIECE
                        e = min(x["n"], (number + 1) * PIECE + x["a"])
                        core = segment[(number + 1) * PIECE + x["a"] - 1 : number * PIECE + x["a"] + length]
                        body = segment[s : e + length - 1]
                        grp = xxhash.xxh3_64_intdigest(core, (x["h"] + number) & 0xFFFFFFFFFFFFFFFF)
                        out.append((_signed(grp), _signed(xxhash.xxh3_64_intdigest(body)), x["h"], x["g"], s, body))
                        s = e
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return run


def _sharded(length: int):
    names, types = ["h", "g", "runs"], [pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def judge(rows: list[tuple]) -> pa.RecordBatch:
        found = repeats([r[3] for r in rows], [r[2] for r in rows], length)
        out = [(h, g, _starts_to_runs(f)) for (h, g, _, _), f in zip(rows, found) if f.any()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for b in batches:
            for grp, *row in zip(*(b.column(c).to_pylist() for c in ("grp", "h", "g", "m", "body"))):
                if size > SHARD_BYTES and grp != last:
                    yield judge(rows)
                    rows, size = [], 0
                rows.append(tuple(row))
                size += len(row[-1])
                last = grp
        if rows:
            yield judge(rows)

    return run


def _strings(length: int):
    """Every string of a piece, by its digest."""
    names, types = ["grp", "b", "at", "d1", "d2", "m"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for grp, b, m, body in zip(*(batch.column(c).to_pylist() for c in ("grp", "b", "m", "body"))):
                for at in range(len(body) - length + 1):
                    d = xxhash.xxh3_128_intdigest(body[at : at + length])
                    out.append((grp, b, at, _signed(d >> 64), _signed(d & 0xFFFFFFFFFFFFFFFF), m))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return run


def _cut(length: int):
    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.int32())), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, body, marks, runs in zip(*(b.column(c) for c in ("doc_id", "body", "marks", "runs"))):
                raw, gone = body.as_py(), []
                for x in marks.as_py():
                    if x["m"] > 1:
                        gone.append((x["p"], x["p"] + x["n"] + length - 1))
                for x in runs.as_py() or ():
                    gone += [(x["p"] + s, x["p"] + e + length - 1) for s, e in zip(x["runs"][::2], x["runs"][1::2])]
                spans: list[int] = []
                for s, e in sorted(gone):
                    if spans and s <= spans[-1]:
                        spans[-1] = max(spans[-1], e)
                    else:
                        spans += [s, e]
                edges = [0, *spans, len(raw)]
                out.append((doc.as_py(), len(raw), spans, b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2]))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else ((), (), (), ()), kind)], schema=kind)

    return run


def dedup_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (flat begin, end of removed bytes; null when untouched) and kept (bytes)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("k"), F.hash("text", "doc_id").alias("k2"), "doc_id", F.octet_length("text").alias("n_bytes"), "text")
    found = scratch.table(rows.where(F.col("n_bytes") >= length).select("k", "k2", "n_bytes", "text").mapInArrow(_find(length), "k bigint, k2 int, p int, n int, a int, h bigint, g bigint"), "anchors")
    # written first, so that the join deals both sides anew and a digest with very many rows can be split
    twice = scratch.table(found.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "twice")
    shared = scratch.table(found.join(twice, "h"), "shared")
    scratch.drop("anchors")
    segments = scratch.table(shared.groupBy("h", "g").agg(F.count("*").alias("m"), F.min(F.struct("k", "k2", "p")).alias("rep")), "segments")
    kinds = scratch.table(segments.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    several = segments.join(kinds, "h", "left").select("h", "g", "m", F.coalesce("kinds", F.lit(1)).alias("kinds"), "rep")
    told = shared.join(several, ["h", "g"])
    chosen = (F.struct("k", "k2", "p") == F.col("rep")) & (F.col("kinds") > 1)
    send = F.when(chosen & (F.col("kinds") > hot), 2).when(chosen, 1).otherwise(0)
    marks = told.groupBy("k", "k2").agg(F.array_sort(F.collect_set(F.struct("p", "n", "a", "h", "g", "m", send.alias("send")))).alias("marks"))
    joined = rows.join(marks, ["k", "k2"], "left")
    body = F.when(F.col("marks").isNotNull(), F.col("text").cast("binary"))
    texts = scratch.table(joined.select("k", "k2", "doc_id", F.col("n_bytes").cast("bigint").alias("n_bytes"), "marks", body.alias("body"), F.when(F.col("marks").isNull(), F.col("text").cast("binary")).alias("whole")), "texts")
    touched = texts.where("marks IS NOT NULL")
    shard = lambda df: df.repartition("grp").sortWithinPartitions("grp").mapInArrow(_sharded(length), "h bigint, g bigint, runs array<int>")
    parts = touched.select("body", "marks").mapInArrow(_segments(length), "grp bigint, h bigint, g bigint, m bigint, body binary")
    pieces = scratch.table(touched.where(F.exists("marks", lambda x: x["send"] == 2)).select("body", "marks").mapInArrow(_pieces(length), "grp bigint, b bigint, h bigint, g bigint, at int, body binary"), "pieces")
    own = F.struct("h", "g", "at")
    equal = pieces.groupBy("grp", "b").agg(F.count("*").alias("m"), F.min(own).alias("rep"))
    one = scratch.table(pieces.join(equal, ["grp", "b"]).where(own == F.col("rep")).select("grp", "b", "m", "body"), "distinct")
    crowds = scratch.table(one.groupBy("grp").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("grp"), "crowds")
    strings = one.join(crowds, "grp").mapInArrow(_strings(length), "grp bigint, b bigint, at int, d1 bigint, d2 bigint, m bigint")
    again = scratch.table(strings.groupBy("d1", "d2").agg(F.sum("m").alias("c")).where("c > 1").select("d1", "d2"), "again")
    crowded = strings.join(again, ["d1", "d2"]).groupBy("grp", "b").agg(F.flatten(F.transform(F.collect_set("at"), lambda x: F.array(x, x + 1))).alias("runs"))
    calm = one.join(crowds, "grp", "left_anti").select("grp", F.col("grp").alias("h"), F.col("b").alias("g"), "m", "body")
    cold, warm = shard(parts), shard(calm).select(F.col("h").alias("grp"), F.col("g").alias("b"), "runs").unionAll(crowded)
    warm = pieces.select("grp", "b", "h", "g", "at").join(warm, ["grp", "b"]).select("h", "g", F.transform("runs", lambda x: x + F.col("at")).alias("runs"))
    runs = scratch.table(cold.unionAll(warm), "runs")
    single = touched.select("k", "k2", F.explode("marks").alias("x")).where("x.m = 1").select("k", "k2", "x.p", "x.h", "x.g")
    back = single.join(runs, ["h", "g"]).groupBy("k", "k2").agg(F.collect_set(F.struct("p", "runs")).alias("runs"))
    cut = touched.join(back, ["k", "k2"], "left").select("doc_id", "body", "marks", "runs").mapInArrow(_cut(length), "doc_id bigint, n_bytes bigint, spans array<int>, kept binary")
    return texts.where("marks IS NULL").select("doc_id", "n_bytes", F.lit(None).cast("array<int>").alias("spans"), F.col("whole").alias("kept")).unionAll(cut)


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``dedup_spans`` kept in the shared folder."""
    with Scratch(docs.sparkSession) as scratch:
        return scratch.result(dedup_spans(docs, scratch, length))


def digest(docs: DataFrame) -> DataFrame:
    with Scratch(docs.sparkSession) as scratch:
        out = dedup_spans(docs, scratch)
        n = F.coalesce(F.size("spans"), F.lit(0))
        removed = (F.col("n_bytes") - F.octet_length("kept")).cast("bigint")
        return scratch.result(out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.when(n > 0, (n / 2).cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")))
