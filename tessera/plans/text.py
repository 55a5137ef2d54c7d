"""Templates, flags, parsing and token arrays over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.functions import arrays as A
from tessera.functions import strings as S
from tessera.operators import shape as H
from tessera.plans import views as V
from tessera.sources.tables import literal, table


def _like(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


@query(f"SELECT doc_id, {_like('text', S.UNSAFE)} AS unsafe FROM documents")
def safety_flags(s, d):
    return table(s, d, "documents").select("doc_id", S.safety_flag("text").alias("unsafe"))


@query(f"SELECT conv_id, turn, {_like('text', S.REFUSALS)} AS refusal FROM conversations")
def refusal_flags(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", S.looks_like_refusal("text").alias("refusal"))


@query("SELECT * FROM (VALUES (1, true), (2, false), (3, true), (4, false)) t(id, refusal)")
def refusal_literals(s, d):
    return literal(s, [(1, "Sorry, I can't help with that."), (2, "Sure."), (3, "I’m UNABLE to"), (4, "candid")], "id int, x string").select("id", S.looks_like_refusal("x").alias("refusal"))


@query("WITH " + V.PREF_TEXT + r" SELECT conv_id, lower(regexp_replace(chosen, '^\s+|\s+$', '', 'g')) = lower(regexp_replace(upper(rejected), '^\s+|\s+$', '', 'g')) AS em FROM pref_text")
def exact_match(s, d):
    return V.pref_text(s, d).select("conv_id", S.exact_match("chosen", F.upper("rejected")).alias("em"))


_SYS = S.SYSTEM.replace("'", "''")


@query(rf"SELECT conv_id, turn, '{_SYS}' || chr(10) || CASE WHEN regexp_replace(role, '^\s+|\s+$', '', 'g') <> '' THEN '[INSTRUCTION]' || chr(10) || role || chr(10) ELSE '' END || CASE WHEN turn % 2 = 0 THEN '[INPUT]' || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10) ELSE '' END || '[RESPONSE]' || chr(10) || text AS prompt FROM conversations WHERE text <> ''")
def sft_format(s, d):
    c = table(s, d, "conversations").where("text <> ''")
    return c.select("conv_id", "turn", S.sft_prompt("role", F.when(F.col("turn") % 2 == 0, F.col("text")), "text").alias("prompt"))


@query(f"SELECT conv_id, turn, '{_SYS}' || chr(10) || '[INSTRUCTION]' || chr(10) || text || chr(10) || '[RESPONSE]' || chr(10) AS prompt FROM conversations")
def dpo_format(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", S.dpo_prompt("text").alias("prompt"))


@query("SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || '</s>' || chr(10), '' ORDER BY turn) || '<|assistant|>' || chr(10) AS chat FROM conversations WHERE role IN ('user', 'system', 'assistant') GROUP BY 1")
def chat_render(s, d):
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return table(s, d, "conversations").groupBy("conv_id").agg(m.alias("m")).select("conv_id", S.chat("m").alias("chat"))


@query("SELECT doc_id, regexp_replace(list_extract(string_split('x [RESPONSE]' || chr(10) || text || '  ', '[RESPONSE]' || chr(10)), -1), '^\\s+|\\s+$', '', 'g') AS answer FROM documents")
def marker_extract_documents(s, d):
    """What follows the last marker, of every document."""
    return table(s, d, "documents").select("doc_id", S.response_part(F.concat(F.lit("x [RESPONSE]\n"), "text", F.lit("  "))).alias("answer"))


@query(r"SELECT conv_id, turn, regexp_replace(CASE WHEN turn % 3 = 1 THEN role ELSE text END, '^\s+|\s+$', '', 'g') AS answer FROM conversations")
def marker_extract(s, d):
    """After the one marker, after the last of two, or the whole text where there is none."""
    t, m = F.col("text"), S.RESPONSE + "\n"
    x = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("p " + m + "  "), t, F.lit(" \n"))).when(F.col("turn") % 3 == 1, F.concat(F.lit(m), t, F.lit(m + " "), "role")).otherwise(F.concat(F.lit(" "), t, F.lit(" ")))
    return table(s, d, "conversations").select("conv_id", "turn", S.response_part(x).alias("answer"))


@query("SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'A' WHEN 4 THEN CASE WHEN turn % 2 = 0 THEN 'A' ELSE 'B' END END AS winner FROM conversations")
def judge_parse(s, d):
    """The verdict of an answer's last line; both named: the first; none named: a fallback; no answer: null."""
    t = F.col("text")
    kinds = [F.concat(t, F.lit("\nwin: a")), F.concat(t, F.lit("\n  WIN: B \n\n")), F.concat(F.lit("WIN: B\n"), t, F.lit("\nWin: A or win: b")), F.lit("  \n"), F.concat(t, F.lit("\nunclear"))]
    x = F.get(F.array(*kinds), (F.col("conv_id") % 5).cast("int"))
    return table(s, d, "conversations").select("conv_id", "turn", S.verdict(x, F.when(F.col("turn") % 2 == 0, "A").otherwise("B")).alias("winner"))


@query("SELECT conv_id, turn, 'Q: ' || role || ' A: ' || text AS filled FROM conversations")
def template_format(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", S.fill("Q: {a} A: {b}", a="role", b="text").alias("filled"))


@query("SELECT conv_id, turn, text AS rest, starts_with(role || text, 'user') AS bos FROM conversations")
def strip_prompt_prefix(s, d):
    c = table(s, d, "conversations").withColumn("full", F.concat("role", "text"))
    return c.select("conv_id", "turn", S.without_prefix("full", "role").alias("rest"), F.startswith("full", F.lit("user")).alias("bos"))


@query("SELECT page_id, list_extract(string_split(url, '/'), -1) AS name FROM pages")
def basename(s, d):
    return table(s, d, "pages").select("page_id", S.basename("url").alias("name"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::bigint AS n FROM documents")
def token_count(s, d):
    return V.tokens(s, d).select("doc_id", F.size("tokens").cast("bigint").alias("n"))


@query("WITH " + V.TOKENS + " SELECT doc_id, array_to_string(tokens[-16:], ' ') AS kept_end, array_to_string(tokens[1:16], ' ') AS kept_start FROM tokens")
def truncate_tokens(s, d):
    return V.tokens(s, d).select("doc_id", F.array_join(A.keep_end("tokens", 16), " ").alias("kept_end"), F.array_join(A.keep_start("tokens", 16), " ").alias("kept_start"))


@query("WITH " + V.TOKENS + " SELECT doc_id, least(len(tokens), 8)::bigint AS ignored, greatest(len(tokens) - 8, 0)::bigint AS learned FROM tokens")
def label_mask(s, d):
    t = V.tokens(s, d).withColumn("l", A.label_mask(A.keep_start("tokens", 8), A.shifted(F.transform("tokens", lambda x: F.length(x)), 8)))
    return t.select("doc_id", F.size(F.filter("l", lambda x: x == -100)).cast("bigint").alias("ignored"), F.size(F.filter("l", lambda x: x != -100)).cast("bigint").alias("learned"))


@query("WITH " + V.TOKENS + " SELECT doc_id FROM tokens WHERE len(tokens) <= 120 AND len(tokens) >= 2")
def len_filter(s, d):
    return V.tokens(s, d).where((F.size("tokens") <= 120) & (F.size("tokens") >= 2)).select("doc_id")


@query("WITH " + V.TOKENS + " SELECT doc_id, (CASE WHEN list_position(tokens, 'the') IS NULL OR list_position(tokens, 'the') = 0 THEN len(tokens) ELSE list_position(tokens, 'the') END)::bigint AS kept, list_contains(tokens, 'the') AS ended FROM tokens")
def first_eos_mask(s, d):
    return V.tokens(s, d).select("doc_id", F.size(A.until_first("tokens", F.lit("the"))).cast("bigint").alias("kept"), A.has("tokens", F.lit("the")).alias("ended"))


@query("WITH " + V.TOKENS + " SELECT doc_id, (len(tokens) + CASE WHEN tokens[1] = 'The' THEN 0 ELSE 1 END + CASE WHEN tokens[-1] = '</s>' THEN 0 ELSE 1 END)::bigint AS n FROM tokens WHERE len(tokens) > 0")
def add_bos_eos(s, d):
    t = V.tokens(s, d).where(F.size("tokens") > 0)
    return t.select("doc_id", F.size(A.with_eos(A.with_bos("tokens", F.lit("The")), F.lit("</s>"))).cast("bigint").alias("n"))


_TURNS = r"t AS (SELECT conv_id, turn, role = 'assistant' AS y, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS s FROM conversations), u AS (SELECT * FROM t WHERE len(s) > 0)"


@query(f"WITH {_TURNS} SELECT conv_id, repeat('0,', greatest(12 - count(*), 0)) || string_agg(len(s)::varchar, ',' ORDER BY turn) AS lft, string_agg(len(s)::varchar, ',' ORDER BY turn) || repeat(',0', greatest(12 - count(*), 0)) AS rgt, string_agg(repeat('-100,', len(s) - 1) || y::int::varchar, ',' ORDER BY turn) AS steps FROM u GROUP BY 1")
def pad_and_steps(s, d):
    """Token counts of a conversation's turns padded to 12 at either side, and the labels of its steps: a turn's tokens are ignored but for the last."""
    t = table(s, d, "conversations").select("conv_id", "turn", (F.col("role") == "assistant").alias("y"), S.tokens("text").alias("s")).where(F.size("s") > 0)
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "y", "s"))).alias("x"))
    j = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")
    n = F.transform("x", lambda v: F.size(v["s"]))
    return g.select("conv_id", j(A.pad(n, 12, 0, left=True)).alias("lft"), j(A.pad(n, 12, 0)).alias("rgt"), j(A.step_labels(F.col("x.s"), F.col("x.y"))).alias("steps"))


@query("WITH " + V.TOKENS + " SELECT doc_id, p.i - 1 AS pos, p.t AS token FROM (SELECT doc_id, unnest(list_transform(tokens, lambda t, i: struct_pack(t := t, i := i))) AS p FROM tokens)")
def padding_free(s, d):
    """Sequences laid end to end with position ids."""
    return V.tokens(s, d).select("doc_id", F.posexplode("tokens").alias("pos", "token")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "token")


_PAIRED = "WITH " + V.PREF_TEXT + r", p AS (SELECT conv_id, list_filter(regexp_split_to_array('shared words ' || chosen, '\s+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array('shared words ' || rejected, '\s+'), lambda x: x <> '') AS b FROM pref_text)"


@query(f"{_PAIRED}, q AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])), least(len(a), len(b)) + 1) AS first FROM p) SELECT conv_id, array_to_string(a[1:first - 1], ' ') AS shared, (len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) + abs(len(a) - len(b)))::int AS differing FROM q")
def prompt_extract(s, d):
    """What the token sequences of both answers begin with, and how many places differ."""
    p = V.pref_text(s, d).select("conv_id", *[S.tokens(F.concat(F.lit("shared words "), c)).alias(n) for n, c in (("a", "chosen"), ("b", "rejected"))])
    return p.select("conv_id", F.array_join(A.common_prefix("a", "b"), " ").alias("shared"), A.differing("a", "b").alias("differing"))


@query("WITH " + V.TOKENS + " SELECT doc_id, sha256(array_to_string(tokens[2:], ' ')) AS nxt, list_contains(tokens, 'of') AS has_of FROM tokens")
def shift_tokens(s, d):
    """Every token but the first, as a digest, and whether a token is anywhere."""
    return V.tokens(s, d).select("doc_id", F.sha2(F.array_join(A.shifted("tokens"), " "), 256).alias("nxt"), A.has("tokens", F.lit("of")).alias("has_of"))


@query("WITH " + V.TOKENS + " SELECT doc_id, len(tokens)::int AS n FROM tokens")
def length_validated(s, d):
    """Tokens with their masks; a row where the two differ in length would end the run."""
    t = V.tokens(s, d).withColumn("mask", F.transform("tokens", lambda x: F.lit(1)))
    return H.same_length(t, "tokens", "mask").select("doc_id", F.size("tokens").alias("n"))


@query(r"WITH x AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w FROM documents), n AS (SELECT doc_id, length(w)::double / 4 AS v FROM x), m AS (SELECT doc_id, max(v) AS m FROM n GROUP BY 1), z AS (SELECT doc_id, any_value(m) + ln(sum(exp(v - m))) AS z FROM n JOIN m USING (doc_id) GROUP BY 1) SELECT doc_id, round(-sum(exp(v - z) * (v - z)), 6) AS entropy FROM n JOIN z USING (doc_id) GROUP BY 1")
def token_entropy(s, d):
    """Entropy of the softmax of logits (a quarter of a word's length stands in for them)."""
    t = V.tokens(s, d).where(F.size("tokens") > 0).select("doc_id", F.transform("tokens", lambda x: F.length(x) / F.lit(4.0)).alias("logits"))
    return t.select("doc_id", F.round(A.softmax_entropy("logits"), 6).alias("entropy"))
