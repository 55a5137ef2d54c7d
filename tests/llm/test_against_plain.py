"""The operators against plain Python that shares no code with them, and their bounds."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, decontam, html_extract, line_dedup, mixing, quality_classifier, quality_rules, simhash_dedup, suffix_array, suffix_dedup, token_counts, toxicity
from tessera.llm.common import Scratch

SPACE = r"[\x20\x09-\x0D]+"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def bag(rows):
    return Counter(map(tuple, rows))


# bounds of what tables, batches and settings hold


def test_tables_have_small_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = spark.range(3000).select(F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.sha2(F.concat(F.col("id").cast("string"), i.cast("string")), 256))).alias("text"))
    with Scratch(spark) as scratch:
        scratch.table(rows.coalesce(1), "long")
        files = list(__import__("pathlib").Path(scratch.root.removeprefix("file:")).rglob("long/*.parquet"))
        groups = [pq.ParquetFile(f).metadata.row_group(i).total_byte_size for f in files for i in range(pq.ParquetFile(f).num_row_groups)]
    assert len(groups) > 4 and max(groups) < 24 << 20


def test_settings_come_back_after_blocks_on_two_threads(spark):
    import threading

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, inside, leave = spark.conf.get(key), threading.Event(), threading.Event()

    def other():
        with Scratch(spark):
            inside.set()
            leave.wait(30)

    with Scratch(spark):
        t = threading.Thread(target=other)
        t.start()
        inside.wait(30)
    assert spark.conf.get(key) == common.SHORT[key]
    leave.set()
    t.join()
    assert spark.conf.get(key) == before


def test_results_go_with_the_block_around_them(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id bigint, text string")
    with Scratch(spark) as around:
        found = simhash_dedup.near_duplicates(docs)
        assert found.count() == 2 and around.made
        made = list(around.made)
    assert not any(common.exists(spark, p) for p in made)


# 1: segments


@pytest.mark.parametrize("size", [1, 60, 1 << 20])
def test_index_of_many_segments(spark, monkeypatch, size):
    draw = random.Random(1)
    texts = [" ".join(draw.choice("abcdefgh") for _ in range(draw.randrange(60))) for _ in range(40)] + [None, "", "a"]
    items = [(k, " ".join(draw.choice("abcdefgh") for _ in range(n))) for k, n in enumerate((1, 2, 3, 12))]
    want = {}
    for i, t in enumerate(texts):
        w, hit = words(t), set()
        for _, item in items:
            x = words(item)
            for s in range(max(1, len(x) - 9)):
                g = x[s : s + 10]
                hit |= {p + q for p in range(len(w) - len(g) + 1) if w[p : p + len(g)] == g for q in range(len(g))}
        want[i] = (len(w), len(hit))
    monkeypatch.setattr(decontam, "SEGMENT_BYTES", size)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    found = decontam.digest(decontam.contamination(docs, spark.createDataFrame(items, "item_id bigint, text string")))
    assert {r.doc_id: (r.n_words, r.n_hit) for r in found.collect()} == want


SMALL_HEAP = """
import sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
s = SparkSession.builder.master("local[2]").config("spark.driver.memory", "700m").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate()
from tessera.llm import decontam
word = F.concat(F.lit("w"), F.pmod(F.xxhash64("id", "k"), F.lit(20000)).cast("string"))
docs = s.range(20000).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(700)))).groupBy("id").agg(F.concat_ws(" ", F.collect_list(word)).alias("text")).withColumnRenamed("id", "doc_id")
docs.repartition(2).write.parquet(sys.argv[1] + "/docs")
docs = s.read.parquet(sys.argv[1] + "/docs")
items = docs.where("doc_id = 7").select(F.lit(1).alias("item_id"), F.substring_index("text", " ", 12).alias("text"))
print("FOUND", decontam.contamination(docs, items).where(F.size("hits") > 0).select("doc_id", F.size("hits")).collect())
"""


def test_index_is_searched_in_a_small_heap(tmp_path):
    """Ninety megabytes of text in two files."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    run = subprocess.run([sys.executable, "-c", SMALL_HEAP, str(tmp_path)], env=os.environ | {"PYTHONPATH": root}, cwd=root, capture_output=True, text=True, timeout=600)
    assert "FOUND [Row(doc_id=7, size(hits)=12)]" in run.stdout, run.stderr[-2000:]


# 2: the sample, recomputed


def drawn(*values):
    """60 bits of a digest of the seed and the values."""
    return int(hashlib.md5(":".join([str(mixing.SEED), *("null" if v is None else str(v) for v in values)]).encode()).hexdigest()[:15], 16)


def plain_mix(rows, per_bucket):
    """(doc_id, copies) of rows (doc_id, text, source)."""
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(words(t))
    order = sorted((s for s in size if s is not None), key=str.encode) + [None] * (None in size)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, total = {}, set(order), sum(size.values())
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        target |= {s: 3.0 * size[s] for s in over} if over else share
        free -= over or free
    out = []
    for s in order:
        e = min(math.floor(target[s] / size[s] * (1 << 40)), 3 << 40) if size[s] else 0
        kind = lambda t: math.floor(4 * math.log2(len(words(t)) + 1))
        own = [(i, t) for i, t, x in rows if x == s]
        count = Counter(kind(t) for _, t in own)
        key = lambda r: (kind(r[1]), drawn(r[0], r[1]) % -(-count[kind(r[1])] // per_bucket), len(words(r[1])), r[0] is not None, r[0] or 0)
        own.sort(key=key)
        tries = []
        for k in range(32):
            place, copies = drawn(k, s) % (1 << 40), []
            for _ in own:
                copies.append((place + e) >> 40)
                place = (place + e) % (1 << 40)
            tries.append((abs(sum(c * len(words(t)) for c, (_, t) in zip(copies, own)) - target[s]), k, copies))
        out += zip((i for i, _ in own), min(tries)[2])
    return out


@pytest.mark.parametrize("per_bucket", [4, 4096])
def test_mix_is_the_systematic_sample(spark, monkeypatch, per_bucket):
    draw = random.Random(2)
    rows = [(k, "w " * draw.choice((0, 1, 3, 20, 21, 300)), draw.choice(("a", "b", "ü", "", None))) for k in range(400)] + [(None, "w w", "a"), (7000, None, "b"), (7000, None, "b")]
    monkeypatch.setattr(mixing, "ROWS", per_bucket)
    got = mixing.digest(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3))
    n = {k: len(words(t)) for k, t, _ in rows}
    assert bag((r.doc_id, r.taken) for r in got.collect()) == bag((i, c * n[i]) for i, c in plain_mix(rows, per_bucket))


# 3: lines, pair by pair


def plain_lines(docs):
    """The texts of (doc_id, text) without the lines that match a line of an earlier document."""

    def fields(line):
        w = words(line)
        m = ["<*>" if re.search("[0-9@]", x) else x for x in w]
        return tuple(m if 100 * m.count("<*>") <= 40 * len(m) else w)

    def match(a, b):
        if a == b:
            return True
        n = len(a)
        if n != len(b) or n < 5:
            return False
        d = min(8, (n + 1) // 2)
        step = -(-(n - d) // 5)
        differ = [k for k in range(n) if a[k] != b[k]]
        return differ[0] >= d and len({(k - d) // step for k in differ}) == 1

    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0))
    lines = [[fields(x) for x in (docs[k][1] or "").split("\n")] for k in range(len(docs))]
    out = {}
    for at, k in enumerate(order):
        earlier = [y for j in order[:at] if docs[j] != docs[k] for y in lines[j] if y]
        kept = [raw for raw, x in zip((docs[k][1] or "").split("\n"), lines[k]) if not x or not any(match(x, y) for y in earlier)]
        out[k] = None if docs[k][1] is None else "\n".join(kept)
    return [out[k] for k in range(len(docs))]


def some_lines(seed, n=60):
    draw = random.Random(seed)
    bases = [[draw.choice("red green blue sun moon sea land 12 x@y".split()) for _ in range(draw.choice((1, 3, 4, 5, 6, 9, 16, 18, 23)))] for _ in range(12)]
    docs = []
    for k in range(n):
        lines = []
        for _ in range(draw.randrange(6)):
            w = list(draw.choice(bases))
            for _ in range(draw.choice((0, 0, 1, 1, 2, 3))):
                w[draw.randrange(len(w))] = draw.choice("ab cd ef gh 7 99".split())
            lines.append(draw.choice((" ", "  ", "\t")).join(w))
        docs.append((draw.choice((k, k, k, None)), "\n".join([*lines, draw.choice(("", " ", "end"))])))
    return docs + [(5000, None), (5001, ""), docs[0], docs[1]]


@pytest.mark.parametrize("seed", range(4))
def test_lines_match_a_plain_tree(spark, seed):
    docs = [(k if i is None else i, t) for k, (i, t) in enumerate(some_lines(seed), 9000)]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3))
    assert bag((r.doc_id, r.text) for r in got.collect()) == bag((d[0], t) for d, t in zip(docs, plain_lines(docs)))


def test_leaf_holds_several_templates(spark):
    head = "one two three four five six seven eight "
    a, b = head + "a b c d e f g h i j", head + "q r s t u v w x y z"
    rows = [(1, a), (2, b), (3, b.replace("q", "changed")), (4, a.replace("j", "other")), (5, head + "n o t h i n g a l l")]
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1, 5: 0}


# 4: suffix arrays, and one hot passage with many different ends


@pytest.mark.parametrize("long_bucket", [0, 4, suffix_array.LONG_BUCKET])
def test_suffix_array_is_sorted(long_bucket):
    draw = np.random.default_rng(0)
    strings = [draw.integers(1, k + 1, n) for k in (1, 2, 3, 26, 300) for n in (1, 2, 3, 50, 700)] + [np.tile([1, 2], 200), np.tile([2, 1, 1], 100), np.arange(1, 90), np.arange(90, 1, -1)]
    for x in strings:
        s = np.append(x, 0).astype(np.int64)
        t = tuple(s.tolist())
        assert suffix_array.suffix_array(s, long_bucket).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("hot", [0, 2, 1024])
def test_hot_passage_with_many_ends(spark, hot):
    draw = random.Random(3)
    letters = lambda n: "".join(draw.choice("abcdefghij ") for _ in range(n))
    core = letters(430)
    texts = [letters(draw.randrange(30, 90)) + core[draw.randrange(20) : 430 - draw.randrange(20)] + letters(draw.randrange(30, 90)) for _ in range(40)]
    texts += [letters(50) + core[:392] + draw.choice("abc") * 9 + letters(20) for _ in range(20)] + [letters(900), core, core, "é" * 500]
    seen = Counter(b[i : i + 400] for b in (t.encode() for t in texts) for i in range(len(b) - 399))
    want = {}
    for k, t in enumerate(texts):
        b = t.encode()
        gone = {j for i in range(len(b) - 399) if seen[b[i : i + 400]] > 1 for j in range(i, i + 400)}
        want[k] = bytes(x for j, x in enumerate(b) if j not in gone)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    with Scratch(spark) as scratch:
        got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup_spans(docs, scratch, hot=hot).collect()}
    assert got == want


def test_repeat_beside_a_long_text(spark):
    draw = random.Random(4)
    letters = lambda n: "".join(draw.choices("abcdefghij ", k=n))
    # the two least digests of the passage differ only in their last 22 bits
    passage = "quwdq uwmrwafexsvkqqqcnq jnmyawifivhlszxszmwyekmdyswpejvxfliigqj" + letters(272) + "mlp fjefeoeukwqghllyonj snsveyvtjxyagktavvwqnhcukvbirqaacipdvc q"
    before, after = letters(1 << 21), letters(300)
    docs = spark.createDataFrame([(1, passage), (2, before + passage + after)], "doc_id bigint, text string").repartition(2, "doc_id")
    with Scratch(spark) as scratch:
        got = {r.doc_id: (r.spans, bytes(r.kept).decode()) for r in suffix_dedup.dedup_spans(docs, scratch).collect()}
    assert got == {1: ([0, 400], ""), 2: ([len(before), len(before) + 400], before + after)}


# 5: pieces of long texts, and writers that race


def test_long_texts_are_encoded_in_pieces(spark):
    encode = token_counts.encoder(token_counts.load(spark, token_counts.TOKENIZER)).encode_ordinary
    draw = random.Random(5)
    for _ in range(30):
        t = "".join(draw.choice(["word", " ", "  ", "\n", "é", "don't", " a", "12", "!?", " Ж", "\t"]) for _ in range(300))
        assert token_counts.n_tokens(encode, t, 20) == len(encode(t))


def test_second_writer_of_a_batch_changes_nothing(spark, tmp_path):
    r = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    rows = spark.createDataFrame([("insert", "a", "en", "v", 5, None)], "op string, source string, lang string, version string, tokens bigint, old_tokens bigint")
    token_counts.deltas(rows).write.parquet(f"{r.root}/_new-other")
    assert r.commit("1", rows)
    assert not r._renamed("_new-other", "batch-1") and r.totals().first().n_tokens == 5
    base, loose, _ = r._listed()
    assert r.compact() and r.totals().first().n_tokens == 5 and not r.committed("2")
    assert r.commit("2", rows) and r.totals().first().n_tokens == 10
    assert r._totals(base, []).count() == 0 and loose == ["batch-1"]


# 7: the discriminant by formula


def test_discriminant_scores_by_its_formula():
    draw = np.random.default_rng(7)
    x = {0: draw.normal(0, 1, (80, 14)), 1: draw.normal(0.7, 2, (120, 14))}
    model = quality_classifier.Discriminant({k: float(len(v)) for k, v in x.items()}, {k: v.sum(axis=0) for k, v in x.items()}, {k: v.T @ v for k, v in x.items()})
    cov = {k: np.cov(v.T, bias=True) for k, v in x.items()}
    pooled = (80 * cov[0] + 120 * cov[1]) / 200
    scale = np.sqrt(np.diag(pooled) + 1e-3)
    at, z = draw.normal(0, 2, (9, 14)), {}
    for k in (0, 1):
        s = (0.6 * cov[k] + 0.3 * pooled) / np.outer(scale, scale) + 0.1 * np.diag(np.diag(pooled) / scale**2) + 1e-3 * np.eye(14)
        d = (at - x[k].mean(axis=0)) / scale
        z[k] = -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1] + math.log(len(x[k]) / 200)
    assert model.score(at) == pytest.approx(1 / (1 + np.exp(z[0] - z[1])), abs=1e-9)


# 8: pages whose markup once lost the article

TEXT = "Text of the article goes on for a while, and then some more."
BODY = f"<h1>Head</h1><p>{TEXT}</p><p>Short.</p><p>{TEXT} {TEXT}</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<article class='post has-comments'>{BODY}</article>",
        f"<nav><a>Home</a></nav><div class='content has-sidebar'>{BODY}</div><div class=sidebar><p>Other things to read here</div>",
        f"<div class='no-sidebar'>{BODY}</div>",
        f"<article id='newsletter-12'>{BODY}</article>",
        f"<article class='recipe cookies'>{BODY}</article>",
        f"<nav><ul><li><a>Home</a><li><a>Menu</a></ul><article>{BODY}</article>",
        f"<form><input>Search<article>{BODY}</article>",
        f"<form action=x><div class=content>{BODY}</div></form>",
        f"<article>{BODY}</article><section class='comments'><article class=comment><p>I disagree with all that was said here before</p></article></section>",
        f"<article>{BODY}<div id='comments'><h2>Comments</h2><article class=comment><p>I disagree with all that was said</p></article></div></article>",
        f"<div class=story>{BODY}</div><div class=related><article><h2>Other</h2><p>teaser text</p></article></div><article><p>read also</article>",
        f"<div class=story>{BODY}</div><article><h2>Other</h2><p>teaser text</p></article><article><p>read also</article>",
        f"<div class='page ad-supported'><article>{BODY}</article></div><div class='ad-slot'>Buy now and win</div>",
        f"<header class='site-header'><h1>Site</h1><nav>a b</nav></header><main>{BODY}</main><footer>x</footer>",
        f"<div class='cookie-banner'><p>We use cookies on this site, accept them all please and go on.</p></div><div id=main-content>{BODY}</div>",
        f"<article>{BODY}<aside>Pull</aside></article><aside><article><p>teaser</article></aside>",
    ],
)
def test_page_keeps_its_article(page):
    assert html_extract.blocks(f"<html><body>{page}</body></html>") == ["Head", TEXT, "Short.", f"{TEXT} {TEXT}"]


def test_long_page_is_read_whole():
    page = "<body><nav>" + "<a>x</a>" * 5000 + "</nav><article>" + f"<p>{TEXT}</p>" * 5000 + "</article></body>"
    assert html_extract.blocks(page) == [TEXT] * 5000


# 9: what the fit may hold


def test_fit_sample_is_bounded_under_repeated_ids(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(k, "other text") for k in range(2, 40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(1, 0), (3, 0)], "doc_id bigint, toxic int")
    got = toxicity._sample(docs, labels, 5).collect()
    assert len(got) == 5 and len({r.doc_id for r in got}) == 5
    every = {r.doc_id: r for r in toxicity._sample(docs, labels, 100).collect()}
    held = {r.doc_id for r in labels.where(toxicity.held_out()).collect()}
    assert set(every) == set(range(1, 40)) - held and held and all(r.y == i % 2 for i, r in every.items())


def test_cumulative_link_by_its_formula():
    m = toxicity.Ordinal(2)
    m.w, m.first, m.gaps = np.array([1.0, -2.0]), 0.5, np.array([0.0, math.log(2)])
    s = lambda u: 1 / (1 + math.exp(-u))
    for z in (-1.0, 0.0, 3.0):
        upto = [s(0.5 - z), s(1.5 - z), s(3.5 - z), 1.0]
        assert m.probabilities(np.array([z]))[0] == pytest.approx([upto[0], *(b - a for a, b in zip(upto, upto[1:]))])


def test_fit_is_at_the_greatest_likelihood():
    draw = np.random.default_rng(4)
    x = draw.random((500, 2)) * 3
    y = np.digitize(x @ [1.0, -0.5] + draw.logistic(size=500), [0.5, 1.5, 3.0])
    m = toxicity.Ordinal(2).fit(x, y)
    s = lambda u: 1 / (1 + np.exp(-u))

    def likelihood(w, cuts):
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        z = x @ w
        return np.log(s(edge[y + 1] - z) - s(edge[y] - z)).mean() - toxicity.PENALTY / 2 * (w @ w)

    best = likelihood(m.w, m.thresholds)
    assert all(likelihood(m.w + draw.normal(size=2) * 0.03, m.thresholds + draw.normal(size=3) * 0.03) < best + 1e-5 for _ in range(200))


# clashing names: every column of the input passes through every stage


def test_stages_carry_columns_of_any_name(spark, tmp_path):
    names = "kept cleaned n_words n_lines n_dropped n_gone flags key mark lead grams gone d1 row file __key c0 c1".split()
    prose = lambda s: ". ".join(f"word{i}of{s} goes{i}to{s} on" for i in range(40)) + "."
    rows = [(k, prose(k), "en", "s", 5, *(f"{n}{k}" for n in names)) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    for out in (quality_rules.stage(spark, docs), line_dedup.stage(spark, docs), simhash_dedup.stage(spark, docs), decontam.stage(spark, docs, items)):
        assert out.columns == docs.columns
        assert {r.doc_id: tuple(r[n] for n in names) for r in out.collect()} == {r[0]: r[5:] for r in rows}
    labels = spark.createDataFrame([(k, k % 2, k % 2, "z") for k in range(6)], "doc_id bigint, quality int, toxic int, text string")
    extra = docs.withColumns({"score": F.lit(1), "x": F.lit(2), "y": F.lit(3), "severity": F.lit(4), "grade": F.lit(5), "predicted": F.lit(6)})
    assert quality_classifier.classify(extra, labels).count() == 6 and toxicity.severity(extra, labels).count() == 6
    pages = spark.createDataFrame([(1, "u", "<p>Some text of a page.", "a", "b", "c")], "page_id bigint, url string, html string, text string, n_chars string, c0 string")
    assert html_extract.extract(pages).first().text == "Some text of a page."


def test_long_texts_are_scored_whole(spark):
    long = "fine words go on and on. " * 40_000
    docs = spark.createDataFrame([(k, long + ("idiot " * 9 if k == 1 else "")) for k in (1, 2)] + [(k, "you idiot " if k % 2 else "good day to you") for k in range(10, 90)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2, k % 2) for k in range(10, 90)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.severity(docs, labels).collect()}
    assert got[1].severity > got[2].severity
    assert quality_classifier.classify(docs, labels).where("score BETWEEN 0 AND 1").count() == 82


def test_equal_texts_score_equally(spark):
    rows = [(k, f"some words number {k % 7} " * (3 + k % 7) + ("idiot " if k % 7 == 1 else "")) for k in range(140)] + [(5, "some words number 5 " * 8)] * 3 + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(k, int(k % 7 > 3), int(k % 7 == 1)) for k in range(140)] + [(5, 0, 0), (5, 1, 1)], "doc_id bigint, quality int, toxic int")
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for out, score in ((quality_classifier.classify(docs, labels), "score"), (toxicity.severity(docs, labels), "severity")):
        assert out.count() == len(rows)
        both = out.join(text.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]), "doc_id").groupBy("text").agg((F.max(score) - F.min(score)).alias("d")).agg(F.max("d")).first()[0]
        assert both < 1e-9 or score == "severity" and both < 1e-6
        assert out.where("doc_id IS NULL").select(F.round(score, 9)).distinct().count() == 1
        again = out.select("doc_id", F.round(score, 9).alias("s")).collect()
        assert bag(again) == bag(out.select("doc_id", F.round(score, 9).alias("s")).collect())


# the pipeline, stage by stage


def fault(line):
    w = words(line)
    n, seps = len(w), {"|", "»", "›", ">", "•", "·", "::", "/"}
    if not n:
        return False
    letters = [c for c in line if c.isalpha()]
    noisy = [x for x in w if re.search(r"[#*$%&|<>]{2,}", x) or not x.strip("#*$%&|<>")]
    return bool(
        n <= 30 and quality_rules.BOILERPLATE.search(line)
        or n >= 3 and 5 * len([x for x in w if x in seps]) >= n
        or n >= 3 and 10 * len(noisy) > 3 * n
        or n >= 5 and letters and 10 * sum(c.isupper() for c in letters) > 7 * len(letters)
        or n >= 8 and 2 * max(Counter(w).values()) > n
        or n >= 3 and not set(line) & set(".!?…:;,。！？।؟、，")
    )


def plain_rules(docs):
    out = []
    for i, t, s in docs:
        w, lines = words(t), (t or "").split("\n")
        c = Counter(zip(w, w[1:], w[2:]))
        hit = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lost = sum(len(words(x)) for x in lines if fault(x))
        if len(w) >= 50 and 2 * len(hit) <= len(w) and 2 * lost <= len(w):
            out.append((i, "\n".join(x for x in lines if not fault(x)), s))
    return out


def plain_dedup(docs):
    texts = plain_lines([d[:2] for d in docs])
    return [(i, new, s) for (i, t, s), new in zip(docs, texts) if new == t or words(new)]


def plain_near(docs):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for _, t, _ in docs:
        w = words(low(t))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4) if w else 0)})
    root = list(range(len(docs)))
    for _ in docs:
        for a in range(len(docs)):
            for b in range(a):
                if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    lead = {}
    for k in sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0)):
        lead.setdefault(root[k], k)
    return [d for k, d in enumerate(docs) if lead[root[k]] == k]


def plain_clean(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    grams = {tuple(x[k : k + 10]) for x in map(cut, items) for k in range(max(1, len(x) - 9) if x else 0)}
    has = lambda w: any(tuple(w[k : k + len(g)]) == g for g in grams for k in range(len(w) - len(g) + 1))
    return [d for d in docs if not has(cut(d[1]))]


def test_pipeline_stage_by_stage(spark, tmp_path):
    draw = random.Random(11)
    vocabulary = [f"{a}{b}" for a in "ba ce di fo gu ha ki lo mu ne".split() for b in "n r st l m nd".split()]
    sentence = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n)).capitalize() + "."
    shared = [sentence(draw.choice((4, 7, 20))) for _ in range(6)]
    items = [sentence(14), sentence(6), None, "!!"]
    rows = []
    for k in range(70):
        lines = [sentence(draw.randrange(4, 30)) for _ in range(draw.randrange(2, 9))]
        if k % 4 == 0:
            lines.insert(draw.randrange(len(lines)), draw.choice(shared))
        if k % 5 == 0:
            lines.append(draw.choice(("All rights reserved.", "home | about | help", "NO SHOUTING PLEASE IN HERE NOW", "no mark at all in this line")))
        if k % 9 == 0:
            lines.append("and so " + draw.choice(items[:2])[:-1].lower() + " they said.")
        rows.append((k, "\n".join(lines), draw.choice(("a", "b", "c", "d"))))
    for k in range(70, 82):  # near copies in one line, so that line dedup leaves them
        w = rows[k - 70][1].replace("\n", " ").split()
        w[draw.randrange(len(w))] = "changed"
        rows.append((k, " ".join(w), "b"))
    rows += [(90, None, "a"), (91, "", None), (92, "few words.", "a")]
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    at, want, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), rows, []
    for (_, stage), plain in zip(corpus_pipeline.STAGES, (plain_rules, plain_dedup, plain_near, lambda d: plain_clean(d, items), None)):
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(f"{tmp_path}/{len(sizes)}")
        at = spark.read.parquet(f"{tmp_path}/{len(sizes)}")
        got = bag((r.doc_id, r.text, r.source) for r in at.collect())
        if plain:
            want = plain(want)
            assert got == bag(want) and all(r.n_chars == len(r.text) for r in at.collect())
        else:
            copies = dict(plain_mix(want, mixing.ROWS))
            want = [d for d in want for _ in range(copies[d[0]])]
            assert got == bag(want)
        sizes.append(len(want))
    assert len(rows) > sizes[0] >= sizes[1] > sizes[2] > sizes[3] > 10 and sizes[4] > 5
    assert bag((r.doc_id, r.text, r.source) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == got
