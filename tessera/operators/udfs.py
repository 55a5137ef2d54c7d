"""Operators no expression can state, as Arrow-batched functions: ROUGE-L and best-fit packing."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[a-z0-9]+")
_VOWELS = frozenset("aeiou")
# The suffix rules of Porter's stemmer (1980), by step; each takes the first suffix that fits.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    """The word as runs of consonants and vowels: "cv" per letter; y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(w):
        out += "v" if x in _VOWELS or x == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(w: str) -> int:
    """How often consonants follow vowels."""
    return len(re.findall("v+c+", _shape(w)))


def _short(w: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


@lru_cache(maxsize=1 << 16)
def stem(w: str) -> str:
    """Porter's stem of a lower-case word; words of up to two letters stay, and so do words with digits but for their endings."""
    if len(w) <= 2:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    elif cut := next((s for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[: -len(s)])), None):
        w = w[: -len(cut)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        if (s := _longest(w, rules)) and _measure(w[: -len(s)]):
            w = w[: -len(s)] + rules[s]
    if (s := _longest(w, _STEP4)) and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit sets of positions."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def rouge_l(prediction, reference) -> Column:
    """F-measure of the longest common subsequence of words, those of over three letters stemmed; 0 when either has none."""

    @F.pandas_udf("double")
    def score(p: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(p, r):
            a, b = ([stem(w) if len(w) > 3 else w for w in _WORD.findall((t or "").lower())] for t in (x, y))
            n = lcs(a, b) if a and b else 0
            out.append(2 * n / (len(a) + len(b)) if n else 0.0)
        return pd.Series(out, dtype="float64")

    return score(prediction, reference)


def pack(df: DataFrame, key: str, length: str, capacity: int, rows: int = 1 << 16) -> DataFrame:
    """Sequences into bins of ``capacity`` by best fit, longest first, per shard of the key's digest: key, length, shard and bin.

    A sequence longer than a bin is cut to it; of equally long ones the smaller key goes first.  There is a shard for every ``rows`` sequences,
    which bounds what one task holds at any size.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        from bisect import bisect_left, insort

        pdf = pdf.assign(**{length: pdf[length].clip(upper=capacity)}).sort_values([length, key], ascending=[False, True])
        room: list[tuple[int, int]] = []
        bins, n = [], 0
        for size in pdf[length]:
            at = bisect_left(room, (size, -1))
            if at < len(room):
                left, b = room.pop(at)
            else:
                left, b, n = capacity, n, n + 1
            bins.append(b)
            insort(room, (left - size, b))
        return pdf.assign(bin=bins)[[key, length, "shard", "bin"]]

    shards = df.agg(F.greatest(F.ceil(F.count("*") / rows), F.lit(1)).alias("__shards"))  # one row
    named = df.select(F.col(key).cast("bigint").alias(key), F.col(length).cast("bigint").alias(length)).crossJoin(F.broadcast(shards))
    named = named.select(key, length, F.pmod(F.xxhash64(key), "__shards").cast("int").alias("shard"))
    return named.groupBy("shard").applyInPandas(fit, f"{key} bigint, {length} bigint, shard int, bin bigint")


def reward_function(fn) -> Column:
    """A user's reward of texts as a column function; ``None`` is null."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fn(t) for t in texts], dtype="float64")

    return run


def formatted(df: DataFrame, fn, columns: list[str]) -> DataFrame:
    """Rows of ``text``: a user's formatting function gives a list of texts for each row (1 to n)."""

    def run(batches):
        for b in batches:
            out = []
            for row in b[columns].to_dict("records"):
                made = fn(row)
                if not isinstance(made, list):
                    raise TypeError("a formatting function returns a list of texts")
                out += made
            yield pd.DataFrame({"text": pd.Series(out, dtype="object")})

    return df.select(*columns).mapInPandas(run, "text string")


def metric(df: DataFrame, key: str, fn, fields: str) -> DataFrame:
    """Partial results of a user's function: a row (key, fields) for each group in each Arrow batch.

    fn: from a table of the group's rows in the batch to a dict of ``fields``.  The caller merges partial results, so a group is never in one task.
    """
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            for k in t.column(key).unique():
                own = t.filter(pc.equal(t.column(key), k)) if k.is_valid else t.filter(pc.is_null(t.column(key)))
                got = fn(own)
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], b.schema.field(key).type), *[pa.array([got[n]]) for n in names]], names=[key, *names])

    return df.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {fields}")


def embedded(fn, size: int = 256):
    """A user's embedding model as a column function: texts go to it ``size`` at a time, and it gives a vector for each."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for lo in range(0, len(texts), size):
            got = fn(list(texts.iloc[lo : lo + size]))
            if len(got) != len(texts.iloc[lo : lo + size]):
                raise ValueError("an embedding function returns a vector for each text")
            out += [[float(x) for x in v] for v in got]
        return pd.Series(out, dtype="object")

    return run


def judged(fn):
    """A user's judge of prompt and two answers as a column function: 0 or 1 for the better, -1 where it can't tell."""

    @F.pandas_udf("int")
    def run(prompt: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([-1 if (x := fn(p, (u, v))) is None else int(x) for p, u, v in zip(prompt, a, b)], dtype="int32")

    return run


def tokenised(spark, vocabulary: bytes, pattern: str):
    """Token numbers of a byte-level vocabulary (lines of base64 token and rank) as a column function; null has none."""
    sent = spark.sparkContext.broadcast(vocabulary)  # a vocabulary file, as large for any corpus

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        encode = _encoder(sent.value, pattern).encode_ordinary
        return pd.Series([encode(t) if t else [] for t in texts], dtype="object")

    return run


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes, pattern: str):
    import base64

    import tiktoken

    ranks = {base64.b64decode(t): int(r) for t, _, r in (line.partition(b" ") for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
