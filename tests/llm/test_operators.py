"""The operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, decontam, html_extract, line_dedup, mixing, quality_classifier, quality_rules, queries, simhash_dedup, suffix_dedup, token_counts, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, h string, name string, size string, marks string"
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def prose(n, seed=0):
    return ". ".join(f"word{(i * 7919 + seed * 31) % 997} goes{(i * i + seed) % 89} on{i % 7} and{i % 13} then{seed}" for i in range(n)) + "."


LONG = prose(3000, 5)
TEXTS = [
    (1, "The cat sat on the mat. " * 30, "en", "a"),
    (2, prose(40, 1) + "\nAll rights reserved.\n" + prose(30, 2), "en", "a"),
    (3, prose(40, 1) + "\nAll rights reserved.\n" + prose(30, 3), "en", "b"),
    (4, "before " + ITEM.upper() + ", after " + prose(12, 4), "de", None),
    (5, None, None, None),
    (6, "", "en", "b"),
    (7, LONG, "en", "c"),
    (8, LONG[:9000] + " changed here. " + LONG[9000:], "en", "c"),
    (None, prose(25, 9), "fr", "a"),
    (10, prose(60, 10), "fr", "a"),
    (10, prose(60, 10), "fr", "a"),
    (11, prose(60, 10), "fr", "ü"),
    (12, " \t\n ", "es", "b"),
    (13, "kilo alpha", "es", ""),
    (14, "É" * 500 + " x", "es", "b"),
    (15, "one | two | three | four\nabc abc abc abc abc abc abc abc abc\nSHOUTING LOUDLY ABOUT NOTHING AT ALL\n" + prose(20, 6), "en", "b"),
]
ROWS = [(i, t, la, s, len(t or ""), "k", "h", "n", "s", "m") for i, t, la, s in TEXTS]
ITEMS = [(1, ITEM), (10, "kilo alpha"), (2, None), (3, "!!"), (None, "kilo alpha")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def bag(rows):
    return Counter(map(tuple, rows))


def test_decontamination(spark, docs, empty):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    grams = defaultdict(set)
    for i, t in ITEMS:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            grams[tuple(w[k : k + 10])].add(i)
    want = []
    for i, t, *_ in ROWS:
        w, hit, items = words(t), set(), set()
        for g, owners in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    items |= owners
        named = ",".join(sorted(str(x) for x in items if x is not None))
        want.append((i, len(w), len(hit), len(items), hashlib.sha256(named.encode()).hexdigest(), bool(hit)))
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert bag(decontam.digest(decontam.contamination(docs, items)).collect()) == bag(want)
    assert sum(x[-1] for x in want) == 2
    assert decontam.contamination(empty, items).count() == 0
    assert decontam.contamination(docs, items.limit(0)).where(F.size("hits") > 0).count() == 0


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    whole = bag(decontam.digest(decontam.contamination(docs, items)).collect())
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 5)
    monkeypatch.setattr(decontam, "CANDIDATES", 3)
    assert bag(decontam.digest(decontam.contamination(docs, items)).collect()) == whole


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x a y b z c"), (2, "a a a"), (3, "c b a")], "doc_id bigint, text string")
    found = decontam.proximity(docs, spark.createDataFrame([(7, "a b c")], "item_id bigint, text string"), 4)
    assert bag(found.collect()) == bag([(3, 7, 0)])
    found = decontam.proximity(docs, spark.createDataFrame([(7, "a b c")], "item_id bigint, text string"), 5)
    assert bag(found.collect()) == bag([(1, 7, 1), (3, 7, 0)])


def test_mixing(spark, docs, empty):
    rows = mixing.digest(docs).collect()
    size = Counter()
    for i, t, la, s, *_ in ROWS:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, free = sum(size.values()), {}, set(order)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * size[s] for s in over}
        free -= over
    got = {(r.doc_id, r.size): r for r in rows}
    assert len(rows) == len(ROWS)
    for i, t, la, s, *_ in ROWS:
        r = got[(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))]
        if i != 11:  # shares its key with no other source
            assert r.source_size == size[s] and r.target == pytest.approx(target[s], abs=1e-6)
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
    assert bag(rows) == bag(mixing.digest(docs.repartition(7)).collect())
    assert mixing.digest(empty).count() == 0


def test_mixing_meets_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.pmod(F.col("id"), F.lit(4))).alias("source"), F.repeat(F.lit("w "), (F.pmod(F.xxhash64("id"), F.lit(300)) + 1).cast("int")).alias("text"))
    for r in mixing.digest(docs).join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r.t - r.g) < 0.03 * r.g


def test_line_dedup(spark, docs, empty):
    out = line_dedup.dedup_lines(docs)
    assert set(docs.columns) <= set(out.columns)
    rows = {r.doc_id: r for r in out.where("doc_id <> 10 AND doc_id IS NOT NULL").collect()}
    assert rows[2].text == TEXTS[1][1] and rows[2].n_dropped == 0
    assert rows[3].text == TEXTS[2][1].split("\n")[2] and rows[3].n_dropped == 2
    assert rows[5].text is None and rows[6].text == "" and rows[12].text == " \t\n "
    assert rows[11].text == "" and rows[11].n_dropped == 1  # document 10 shows the line first
    assert out.where("doc_id = 10").select("text").distinct().count() == 1
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_templates_generalise(spark):
    line = "one two three four five six seven eight " + " ".join(f"t{'abcdefghijklmnopqrstuvwxyz'[k]}" for k in range(15))
    other = line.replace("tc", "changed")
    far = " ".join(line.split()[:8]) + " " + " ".join(f"u{'abcdefghijklmnopqrstuvwxyz'[k]}" for k in range(15))
    rows = [(1, line), (2, other), (3, far), (4, "call 555-123 now"), (5, "call 999 now\nleft"), (6, "x@y.z wrote"), (7, "left")]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [out[i].n_dropped for i in range(1, 8)] == [0, 1, 0, 0, 1, 0, 1]
    assert out[5].text == "left"


def brute_repeats(texts, n):
    seen = Counter(b[i : i + n] for b in texts for i in range(len(b) - n + 1))
    out = []
    for b in texts:
        spans = []
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + n
                else:
                    spans.append([i, i + n])
        at, kept = 0, b""
        for s, e in spans:
            kept, at = kept + b[at:s], e
        out.append((len(b), len(b) - len(kept + b[at:]), len(spans), hashlib.sha256(kept + b[at:]).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 0])
def test_suffix_dedup(spark, docs, empty, monkeypatch, hot):
    real = suffix_dedup.dedup_spans
    monkeypatch.setattr(suffix_dedup, "dedup_spans", lambda d, s: real(d, s, hot=hot))
    periodic = [(20, "ab" * 700, "", "", 0, "", "", "", "", ""), (21, "For " * 300 + "end", "", "", 0, "", "", "", "", "")]
    rows = ROWS + periodic
    want = [(r[0], *x) for r, x in zip(rows, brute_repeats([(r[1] or "").encode() for r in rows], 400))]
    assert bag(suffix_dedup.digest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()) == bag(want)
    assert suffix_dedup.digest(empty).count() == 0


def test_token_counts(spark, docs, empty, tmp_path):
    import tiktoken  # noqa: F401

    enc = token_counts.encoder(token_counts.load(spark, token_counts.TOKENIZER))
    want = Counter()
    seen = set()
    for i, t, la, s, *_ in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)):
        if t in seen and (i, t) not in [(10, TEXTS[9][1])]:
            continue
        seen.add(t)
        want[(s, la, "words-1")] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        want[(s, la, "bpe-1")] += len(enc.encode_ordinary(t or "")) + 1
    got = {(r.source, r.lang, r.version): r.n_tokens for r in token_counts.totals(docs).collect()}
    assert got == {k: v for k, v in want.items() if v or k in got}
    assert token_counts.totals(empty).count() == 0


def test_token_count_query_counts_every_row(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    enc, want = token_counts.encoder(token_counts.load(spark, token_counts.TOKENIZER)), defaultdict(lambda: [0, 0])
    for i, t, la, s, *_ in ROWS:
        for v, n in (("words-1", len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))), ("bpe-1", len(enc.encode_ordinary(t or "")))):
            want[(s, la, v)][0] += 1
            want[(s, la, v)][1] += n
    got = queries.op5_token_counts(spark, str(tmp_path)).collect()
    assert bag((r.source, r.lang, r.version, r.n_docs, r.n_tokens) for r in got) == bag((*k, *v) for k, v in want.items())


def test_commits_are_idempotent(spark, tmp_path):
    r = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    make = lambda rows: spark.createDataFrame(rows, "op string, source string, lang string, version string, tokens bigint, old_tokens bigint")
    first = make([("insert", "a", "en", "v", 5, None), ("insert", "a", "en", "v", 7, None), ("insert", None, None, "v", 1, None)])
    assert r.commit("1", first) and not r.commit("1", first)
    r.commit("2", make([("delete", None, None, "v", 1, None), ("revise", "a", "en", "v", 9, 7)]))
    want = [("a", "en", "v", 2, 14)]
    assert bag(r.totals().collect()) == bag(want)
    r.compact()
    assert bag(r.totals().collect()) == bag(want) and not r.commit("1", first)
    r.commit("3", make([("insert", "a", "en", "v", 1, None)]))
    r.compact()
    assert bag(r.totals().collect()) == bag([("a", "en", "v", 3, 15)])


def test_quality_rules(docs, empty):
    got = {}
    for r in quality_rules.assess(docs).collect():
        got.setdefault(r.doc_id, r)
    for i, t, *_ in ROWS:
        r, t = got[i], t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        c = Counter(zip(w, w[1:], w[2:]))
        hit = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len({*lines}), len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert got[10].kept and got[None].kept and got[15].kept
    assert [quality_rules.line_fault(x) for x in TEXTS[15][1].split("\n")] == ["navigation", "chant", "shouting", None]
    assert quality_rules.assess(empty).count() == 0


def test_quality_classifier_and_toxicity(spark, empty):
    rows = [(i, prose(20 + i % 30, i) + (" idiot" if i % 5 == 1 else "")) for i in range(300)] + [(1000 + i, "THE!! BIG!! | SALE $$$ ### " * (5 + i % 20)) for i in range(100)] + [(None, None), (2000, ""), (2000, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 1000), int(i < 1000 and i % 5 == 1)) for i, _ in rows if i is not None and i < 2000] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    out = quality_classifier.classify(docs, labels)
    assert out.count() == len(rows) and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    right = out.where("held_out").join(labels, "doc_id").select(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.95
    assert quality_classifier.classify(docs, labels.limit(0)).select("score").distinct().first().score == pytest.approx(0.5)
    assert quality_classifier.classify(empty, labels).count() == 0
    tox = toxicity.severity(docs, labels)
    assert tox.count() == len(rows)
    hit = {r.doc_id: r for r in tox.collect()}
    assert all(hit[i].toxic == (i < 1000 and i % 5 == 1) for i, _ in rows if i is not None and i < 2000)
    assert all(0 <= r.severity <= 3 for r in hit.values())
    assert toxicity.severity(docs, labels.limit(0)).where("toxic").count() == 0
    assert toxicity.severity(empty, labels).count() == 0


def test_ordinal_recovers_order():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((4000, 1)) * 4
    y = np.digitize(x[:, 0] * 2 + rng.logistic(size=4000), [2, 4, 6])
    m = toxicity.Ordinal(1).fit(x, y, 600)
    assert abs(m.w[0] - 2) < 0.3 and (np.diff(m.thresholds) > 0).all()
    e = m.probabilities(np.array([0.0, 4.0, 8.0]) * 1.0) @ np.arange(4)
    assert e[0] < e[1] < e[2]


def test_html(spark):
    page = "<html><head><title>T</title></head><body><header>Site</header><nav><a>Home</a></nav><div class='ad'>Buy</div><article><h1>Head &amp; tail</h1><p>First  <b>para</b>\ngraph one two three four.<p>Be.<script>x('</p>')</script><div class=comments><p>I disagree</p></div><p>Last &#233;nd with more words here.</article><aside>Side</aside><form>Name <input></form><footer>&copy; me</footer></body>"
    plain = "<body><nav><a>Home</a> <a>More</a></nav><p>Some long text of a page that has no article element at all, only this.</p><p>And a second paragraph that is long enough to stay in the cluster.</p></body>"
    pages = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "v", "", "x"), (4, "w", plain, "x"), (4, "w", plain, "x"), (5, "y", "<p>cut <b", "x")], "page_id bigint, url string, html string, text string")
    got = html_extract.extract(pages)
    rows = {r.page_id: r for r in got.collect()}
    assert rows[1].text == "Head & tail\nFirst para graph one two three four.\nBe.\nLast énd with more words here."
    assert rows[1].n_chars == len(rows[1].text) and rows[2].text == "" and rows[3].n_chars == 0
    assert rows[4].text.count("\n") == 1 and "Home" not in rows[4].text and rows[5].text.startswith("cut")
    assert got.count() == 6 and html_extract.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p class='ad'>Buy this<div>Text of the article that stays.</div></article>", "Text of the article that stays."),
        ("<article><ul><li class='promo'><b>Buy<li>First point of the list.<li>Second point.</ul></article>", "First point of the list.\nSecond point."),
        ("<article><table><tr><td class='ad'>Buy<td>One cell<tr><td>Next row of cells</table></article>", "One cell\nNext row of cells"),
        ("<div class='site-header'>Site</div><article><div class='entry-header'><h1>Title</h1></div><p>Body of the text.</p></article><div class='footer'>me</div>", "Title\nBody of the text."),
        ("<article><dl><dt>Term<dd class='sponsored'>Buy<dt>Other term</dl></article>", "Term\nOther term"),
    ],
)
def test_html_optional_tags_and_headers(page, want):
    assert "\n".join(html_extract.blocks(f"<html><body>{page}</body></html>")) == want


def test_simhash(docs, empty):
    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    ids, prints = [r[0] for r in ROWS], [fp(r[1]) for r in ROWS]
    root = list(range(len(ROWS)))
    for _ in ROWS:
        for a in range(len(ROWS)):
            for b in range(len(ROWS)):
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    lead = defaultdict(list)
    for i, r in zip(ids, root):
        lead[r].append(i)
    want = [(i, f"{p:016x}", min((x for x in lead[r] if x is not None), default=None)) for i, p, r in zip(ids, prints, root)]
    for hot in (simhash_dedup.HOT, 1):
        assert bag(simhash_dedup.digest(simhash_dedup.near_duplicates(docs, hot=hot)).collect()) == bag(want)
    assert simhash_dedup.near_duplicates(empty).count() == 0


def test_gray_index_finds_all_pairs():
    import numpy as np

    rng = np.random.default_rng(3)
    fp = np.unique(np.concatenate([rng.integers(0, 1 << 62, 60, np.uint64)] + [rng.integers(0, 1 << 62, 60, np.uint64) & np.uint64(0xFF00FF)]))
    group = (np.arange(len(fp)) % 2).astype(np.int64)
    index = simhash_dedup.GrayIndex(group, fp)
    found = {(a, b) for x, y in index.within(2) for a, b in zip(x.tolist(), y.tolist())}
    want = {(a, b) for a in range(len(fp)) for b in range(len(fp)) if index.group[a] == index.group[b] and int(index.fp[a] ^ index.fp[b]).bit_count() <= 2}
    assert found == want


@pytest.mark.parametrize("gather", [2, 4, 8, 100])
def test_last_group_of_a_task_is_searched(gather):
    import pyarrow as pa

    fp, block = [16, 17, 32, 33, 64, 65, 128, 129], [1, 1, 2, 2, 3, 3, 3, 3]
    t = pa.table({"fp": pa.array(fp, pa.int64()), "choice": pa.array([0] * 8, pa.int32()), "block": pa.array(block, pa.int64())})
    found = [r for b in simhash_dedup._local(1, gather)(iter(t.to_batches(max_chunksize=2))) for r in b.to_pylist() if r["fp"] != r["hub"]]
    assert sorted(({r["fp"], r["hub"]} for r in found), key=min) == [{16, 17}, {32, 33}, {64, 65}, {128, 129}]


@pytest.mark.parametrize("hot", [simhash_dedup.HOT, 3])
@pytest.mark.parametrize("radius", [1, 2, 3])
def test_split_groups_lose_no_link(spark, hot, radius):
    import random

    from tessera.llm.common import Scratch

    draw = random.Random(radius)
    fp = {0, -1, -(1 << 63)}
    for centre in [draw.getrandbits(64) for _ in range(4)]:
        fp |= {int.from_bytes((centre ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(5)))).to_bytes(8, "big"), "big", signed=True) for _ in range(60)}
    fp = sorted(fp)
    root = {x: x for x in fp}
    near = [(a, b) for a in fp for b in fp if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius]
    before = None
    while before != root:
        before = dict(root)
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    rows = spark.createDataFrame([(x,) for x in fp], "fp bigint")
    with Scratch(spark) as s:
        edges = s.table(simhash_dedup.links(rows, radius, hot=hot), "links")
        got = simhash_dedup.components(rows.select("fp", F.struct(F.lit(False).alias("none"), F.col("fp").alias("doc_id")).alias("lead")), edges, s)
        assert {r.fp: r.lead.doc_id for r in got.collect()} == root


def test_long_chain_is_one_component(spark):
    from tessera.llm.common import Scratch

    nodes = spark.range(60).select(F.col("id").alias("fp"), F.struct(F.lit(False).alias("none"), F.col("id").alias("doc_id")).alias("lead"))
    edges = spark.range(59).select(F.col("id").alias("hub"), (F.col("id") + 1).alias("fp"))
    with Scratch(spark) as s:
        assert simhash_dedup.components(nodes, edges, s).select("lead.doc_id").distinct().collect()[0].doc_id == 0


def test_descending_chain_is_one_component(spark):
    from tessera.llm.common import Scratch

    chain = [1, *range(300, 1, -1)]
    nodes = spark.createDataFrame([(x,) for x in chain], "fp bigint").select("fp", F.struct(F.lit(False).alias("none"), F.col("fp").alias("doc_id")).alias("lead"))
    edges = spark.createDataFrame(list(zip(chain[1:], chain)), "fp bigint, hub bigint")
    with Scratch(spark) as s:
        assert [r.doc_id for r in simhash_dedup.components(nodes, edges, s).select("lead.doc_id").distinct().collect()] == [1]
        assert sum("/labels-" in path for path in s.made) < 30


@pytest.mark.parametrize("hot, rounds, sent", [(128, 8, 1000), (3, 8, 1 << 20), (3, 1, 0)])
def test_near_copies_of_four_fifths_leave(spark, empty, hot, rounds, sent):
    import random

    draw, rows = random.Random(4), [(None, "a b c"), (900, "A  b c"), (901, ""), (902, None), (None, "x y z")]
    for base in range(6):
        words = [f"w{draw.randrange(400)}" for _ in range(draw.choice((30, 150, 400)))]
        for k in range(12):
            at = list(words)
            for _ in range(draw.randrange(0, 1 + len(words) // 20)):
                at[draw.randrange(len(at))] = f"v{draw.randrange(400)}"
            rows.append((base * 100 + k, " ".join(at)))
    sets = []
    for _, t in rows:
        w = low(t).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4) if w else 0)})
    near = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = list(range(len(rows)))
    for _ in rows:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = simhash_dedup.stage(spark, docs, hot, rounds, sent)
    got = bag((r.doc_id, r.text) for r in kept.collect())
    at = [k for k in range(len(rows)) if (rows[k][0], rows[k][1]) in got]
    assert len(at) == sum(got.values())
    assert sorted(at) == sorted(min((k for k in range(len(rows)) if root[k] == r), key=order) for r in set(root))
    assert any(4 * len(sets[a] | sets[b]) <= 5 * len(sets[a] & sets[b]) < 4.5 * len(sets[a] | sets[b]) for a, b in near)


def test_stage_links_by_fingerprint_and_checks_the_sets(spark, monkeypatch):
    import random

    from tessera.llm import near_copies

    draw = random.Random(8)
    words = [f"w{draw.randrange(5000)}" for _ in range(3000)]
    near = [" ".join(words[:k] + ["new"] + words[k + 1 :]) for k in (0, 700, 1500, 2999)]
    dull = ["a b c " * 300 + " ".join(f"{kind}{k}" for k in range(60)) for kind in "xy"]  # one fingerprint, few common shingles
    prints = [simhash_dedup.fingerprint(t) for t in near + dull]
    assert all((prints[0] ^ p).bit_count() <= 3 for p in prints[:4]) and prints[4] == prints[5]
    docs = spark.createDataFrame(list(enumerate(near + dull)), "doc_id bigint, text string").repartition(3)
    seen = []
    monkeypatch.setattr(near_copies, "links", lambda nodes, known, *a: seen.append(known.count()) or known)  # without the links that fingerprints don't tell
    assert sorted(r.doc_id for r in simhash_dedup.stage(spark, docs).collect()) == [0, 4, 5] and seen[0] >= 3


@pytest.mark.parametrize("hot", [simhash_dedup.HOT, 2])
def test_candidates_of_the_stage_connect_all_within_three_bits(spark, hot):
    import random

    from tessera.llm.common import Scratch

    draw = random.Random(3)
    fps = [draw.getrandbits(64) for _ in range(20)]
    for fp in list(fps):
        for _ in range(5):
            for at in draw.sample(range(64), draw.randrange(0, 4)):
                fp ^= 1 << at
            fps.append(fp)
    nodes = spark.createDataFrame([(k, f - (1 << 64) * (f >> 63)) for k, f in enumerate(fps)], "key bigint, fp bigint").repartition(3)
    root = list(range(len(fps)))

    def low_end(a):
        return a if root[a] == a else low_end(root[a])

    with Scratch(spark) as s:
        for r in simhash_dedup.candidates(nodes, s, hot=hot).collect():
            root[low_end(r.fp)] = low_end(r.hub)
    assert all(low_end(a) == low_end(b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3)


def left_join_rows(plan):
    """Rows that the left outer joins of a finished plan made."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return left_join_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return left_join_rows(plan.plan())
    own = [plan.metrics().apply("numOutputRows").value()] if kind.endswith("JoinExec") and plan.joinType().toString() == "LeftOuter" else []
    return sum((left_join_rows(plan.children().apply(i)) for i in range(plan.children().size())), own)


def test_marks_join_the_sets_and_not_the_rows_of_their_groups(spark, monkeypatch):
    from tessera.llm.common import Scratch

    made, table = {}, Scratch.table

    def watched(self, df, name, **options):
        if name == "marked":
            made["rows"] = len(df.collect())
            made["left"] = left_join_rows(df._jdf.queryExecution().executedPlan())
        return table(self, df, name, **options)

    monkeypatch.setattr(Scratch, "table", watched)
    texts = [" ".join([*(f"common{w}" for w in range(60)), *(f"own{k}x{w}" for w in range(k % 7))]) + f" last{k}" for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert [r.doc_id for r in simhash_dedup.stage(spark, docs, hot=5).collect()] == [0]
    assert made["rows"] > 10 * len(texts) and made["left"] == [len(texts)] * 2


def test_pipeline(spark, docs, empty, tmp_path):
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if k < 4:
            assert out.columns == at.columns
        assert stage(spark, empty, str(tmp_path)).count() == 0
        at = out
    ids = {r.doc_id for r in at.collect()}
    assert ids <= {2, 7, 10, None, 15, 3} and 5 not in ids
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()


def test_executors_collect_garbage_around_a_stage(spark, docs, tmp_path):
    held = spark._jvm.java.util.WeakHashMap()
    held.put("a key that nothing else holds", 1)
    corpus_pipeline.rules(spark, docs, str(tmp_path))  # makes no table, so that nothing else collects
    assert held.size() == 0


def test_executors_collect_garbage_between_tables_of_a_stage(spark, monkeypatch):
    times = []
    monkeypatch.setattr(common, "give_back", lambda s: times.append(s))
    monkeypatch.setattr(common, "TIDY", -1)
    with common.Scratch(spark) as scratch:
        scratch.table(spark.range(3), "plain")
        assert not times
        with common.tidy(spark):
            assert scratch.table(spark.range(3), "tidied").count() == 3
            assert len(times) == 2
        assert len(times) == 3
        scratch.table(spark.range(3), "after")
    assert len(times) == 3
