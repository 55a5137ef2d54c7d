"""Line-first quality rules.

Every line is judged by itself: prose must hold a sentence mark, navigation is known by its separators,
symbol noise and shouting by their share, chants by one word's share, boilerplate by fixed phrases.
Failing lines are removed; a document that loses too much of its words that way is rejected, as is one
that fails the base rules.

Defined results: a null, empty or blank text has no words and fails the base rules; lines are compared as
they are; a very long text is judged whole, in one piece; each row is judged alone, so repeated rows agree; other columns pass through
``stage`` untouched, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MAX_REPEAT_SHARE, MAX_LOST_SHARE = 50, 0.5, 0.5

# The characters that the contract counts as symbols, and the white space of its words.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")

#: Prose has one of these somewhere in a line, even where its end was cut.
MARKS = ".!?…:;,。！？।؟、，"
SEPARATORS = {"|", "»", "›", ">", "•", "·", "::", "/"}
#: Fixed phrases; ``assess`` and ``stage`` take others, for other languages.
BOILERPLATE = re.compile(
    r"all rights reserved|licensed under|released under the .{1,40} licen[cs]e|terms of (use|service)|privacy policy|cookie (policy|settings)|accept (all )?cookies"
    r"|enable javascript|sign up for|subscribe to our|click here|powered by|skip to (main )?content",
    re.I,
)
SYMBOL_WORD = re.compile(r"[#*$%&|<>]{2,}|^[#*$%&|<>]+$")


def line_fault(line: str, phrases: re.Pattern = BOILERPLATE) -> str | None:
    """Why a line goes, or None.  Blank lines stay."""
    w = WORDS.findall(line)
    n = len(w)
    if not n:
        return None
    if n <= 30 and phrases.search(line):
        return "boilerplate"
    if n >= 3 and sum(x in SEPARATORS for x in w) * 5 >= n:
        return "navigation"
    if n >= 3 and sum(bool(SYMBOL_WORD.search(x)) for x in w) * 10 > 3 * n:
        return "symbols"
    if n >= 5:
        letters = [c for c in line if c.isalpha()]
        if letters and sum(c.isupper() for c in letters) * 10 > 7 * len(letters):
            return "shouting"
    if n >= 8 and max(Counter(w).values()) * 2 > n:
        return "chant"
    if n >= 3 and not any(c in line for c in MARKS):
        return "punctuation"
    return None


def repeat_words(w: list[bytes]) -> int:
    """Words inside windows of three words that occur twice or more in the text, the first included."""
    if len(w) < 4:
        return 0
    windows = list(zip(w, w[1:], w[2:]))
    count = Counter(windows)
    if len(count) == len(windows):
        return 0
    total, upto = 0, 0  # words before upto are counted
    for i, x in enumerate(windows):
        if count[x] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def judge(text: str | None, phrases: re.Pattern = BOILERPLATE) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text)."""
    text = text or ""
    w = text.encode("utf-8", "surrogatepass").split()
    n = len(w)
    lines = text.split("\n")
    seen: set[str] = set()
    dup = lost = 0
    kept_lines = []
    for line in lines:
        k = len(line.encode("utf-8", "surrogatepass").split())
        if k:
            dup += line in seen
            seen.add(line)
        if line_fault(line, phrases):
            lost += k
        else:
            kept_lines.append(line)
    repeats = repeat_words(w)
    failed = n < MIN_WORDS or repeats > MAX_REPEAT_SHARE * n
    return (n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeats, failed, not failed and lost <= MAX_LOST_SHARE * n, "\n".join(kept_lines))


SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, cleaned string"


def _judged(with_text: bool, phrases: re.Pattern):
    names = [x.split()[0] for x in SCHEMA.split(", ")][: None if with_text else -1]
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                got = [judge(t.as_py(), phrases) for t in part.column(part.num_columns - 1)]
                cols = [pa.array([x[i] for x in got], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cols], names=[f"c{i}" for i in range(part.num_columns - 1)] + names)

    return run


def _assessed(docs: DataFrame, text_col: str, keep: tuple[str, ...], with_text: bool, phrases: re.Pattern) -> DataFrame:
    """The columns ``keep`` as c0, c1 and so on, with the columns of ``SCHEMA``."""
    chosen = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(keep)], docs[text_col].cast("string").alias("text"))
    fields = ", ".join([f"c{i} {chosen.schema[i].dataType.simpleString()}" for i in range(len(keep))] + [SCHEMA if with_text else SCHEMA.rpartition(", ")[0]])
    return chosen.mapInArrow(_judged(with_text, phrases), fields)


def assess(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_text: bool = False, phrases: re.Pattern = BOILERPLATE) -> DataFrame:
    """The columns ``keep`` with the counts and verdicts of each row, and its cleaned text if asked for."""
    out = _assessed(docs, text_col, keep, with_text, phrases)
    return out.toDF(*keep, *out.columns[len(keep) :])


def stage(spark, docs: DataFrame, phrases: re.Pattern = BOILERPLATE) -> DataFrame:
    """Documents that stay, with their failing lines removed and n_chars, where there is one, counted anew."""
    others = [c for c in docs.columns if c != "text"]
    new = {c: F.col(f"c{i}") for i, c in enumerate(others)} | {"text": F.col("cleaned")}
    if "n_chars" in others:
        new["n_chars"] = F.length("cleaned").cast(docs.schema["n_chars"].dataType)
    return _assessed(docs, "text", tuple(others), True, phrases).where("kept").select(*[new[c].alias(c) for c in docs.columns])


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS.pattern}') AS w FROM documents
), x AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d
), l AS (SELECT doc_id, line, regexp_extract_all(line, '{WORDS.pattern}') AS w FROM x
), m AS (
  SELECT *, len(w) AS n, len(list_filter(w, lambda x: x IN ({", ".join(f"'{s}'" for s in sorted(SEPARATORS))}))) AS seps, len(list_filter(w, lambda x: regexp_matches(x, '{SYMBOL_WORD.pattern}'))) AS noisy,
    length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) AS upper, len(list_filter(w, lambda x: x = list_aggregate(w, 'mode'))) AS often
  FROM l WHERE len(w) > 0
), f AS (
  SELECT *, n <= 30 AND regexp_matches(line, '(?i){BOILERPLATE.pattern}') OR n >= 3 AND seps * 5 >= n OR n >= 3 AND noisy * 10 > 3 * n OR n >= 5 AND letters > 0 AND upper * 10 > 7 * letters
    OR n >= 8 AND often * 2 > n OR n >= 3 AND NOT regexp_matches(line, '[{MARKS}]') AS fault FROM m
), g AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, coalesce(sum(n) FILTER (fault), 0) AS lost FROM f GROUP BY 1
), v AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS three FROM d, range(1, len(w) - 1) r(i)
), twice AS (SELECT doc_id, three FROM v GROUP BY 1, 2 HAVING count(*) > 1
), r AS (SELECT doc_id, count(DISTINCT i + j) AS repeats FROM v JOIN twice USING (doc_id, three), range(3) k(j) GROUP BY 1
), b AS (
  SELECT doc_id, len(w)::bigint AS n_words, list_sum(list_transform(w, lambda x: length(x)))::bigint AS word_chars, length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g'))::bigint AS n_symbols, coalesce(dup, 0)::bigint AS n_dup_lines,
    coalesce(repeats, 0)::bigint AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN g USING (doc_id) LEFT JOIN r USING (doc_id)
), c AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words > {MAX_REPEAT_SHARE} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= {MAX_LOST_SHARE} * n_words AS kept FROM c
"""
