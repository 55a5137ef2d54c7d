"""String expressions: cleaning, flags, prompt templates, parsing of model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed from version strings, words of the safety screen, refusal phrases, templates.
NOISE = ["®", "–", "Ã", "ã", "³", "[", "]", "'"]
UNSAFE = ["kill", "hate", "violence", "bomb"]
REFUSALS = ["cannot", "can not", "i can't", "i cannot", "sorry", "i won't", "i will not", "i’m unable", "not able"]
SYSTEM = "<s>[SYSTEM]\nYou are a helpful, concise assistant.\n</s>"
INSTRUCTION, INPUT, RESPONSE = "[INSTRUCTION]", "[INPUT]", "[RESPONSE]"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(x), r"^\s+|\s+$", "")


def drop_literals(x, literals: list[str] | None = None) -> Column:
    """Without any of the given one-character texts."""
    return F.translate(col(x), "".join(NOISE if literals is None else literals), "")


def masked_version(x) -> Column:
    """Punctuation, white space and letters as zeros."""
    out = F.regexp_replace(col(x), r"[-+|/:;(_)@]", "0")
    return F.regexp_replace(F.regexp_replace(out, r"\s+", "0"), r"[A-Za-z]+", "0")


def first_dot_only(x) -> Column:
    """Only the first dot stays."""
    x = col(x)
    at = F.instr(x, ".")
    return F.when(at == 0, x).otherwise(F.concat(F.substr(x, F.lit(1), at), F.replace(F.substr(x, at + 1), F.lit("."), F.lit(""))))


def version_number(x) -> Column:
    """A free-text version as a number; what isn't one is null."""
    return first_dot_only(masked_version(drop_literals(x))).try_cast("double")


def price(x) -> Column:
    """``$1,234.50`` or ``1,000+`` as a number."""
    return F.replace(F.btrim(F.btrim(col(x), F.lit("$")), F.lit("+")), F.lit(","), F.lit("")).try_cast("double")


def size_mb(x, sentinel: str = "Varies with device") -> Column:
    """``19M`` or ``201k`` in megabytes (thousands rounded to three digits, half to even); the sentinel is null."""
    x = F.nullif(col(x), F.lit(sentinel))
    k = F.bround(F.btrim(x, F.lit("k")).try_cast("double") / 1024, 3)
    return F.when(x.contains("k"), k).otherwise(F.btrim(x, F.lit("M")).try_cast("double"))


def epoch(x, pattern: str = "MMMM d, yyyy") -> Column:
    """Seconds since 1970 of a written date, in the session's time zone; what isn't a date is null."""
    return F.unix_timestamp(F.try_to_timestamp(col(x), F.lit(pattern)))


def exact_match(a, b) -> Column:
    """Equal but for case and outer white space."""
    return F.lower(strip(a)) == F.lower(strip(b))


def _any(x, phrases: list[str]) -> Column:
    low = F.lower(col(x))
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p))
    return out


def safety_flag(x) -> Column:
    """Holds one of the screened words anywhere, inside longer words too."""
    return _any(x, UNSAFE)


def looks_like_refusal(x) -> Column:
    return _any(x, REFUSALS)


def sft_prompt(instruction, given, output=None) -> Column:
    """Tagged blocks joined by line feeds; blank or null parts have no block, the response's tag ends it unless an output follows."""
    block = lambda tag, x: F.when(strip(x) != "", F.concat(F.lit(tag + "\n"), strip(x)))
    tail = F.lit(RESPONSE + "\n") if output is None else F.concat(F.lit(RESPONSE + "\n"), col(output))
    return F.concat_ws("\n", F.lit(SYSTEM), block(INSTRUCTION, instruction), block(INPUT, given), tail)


def dpo_prompt(prompt) -> Column:
    return F.concat(F.lit(f"{SYSTEM}\n{INSTRUCTION}\n"), col(prompt), F.lit(f"\n{RESPONSE}\n"))


def response_part(x, marker: str = RESPONSE + "\n") -> Column:
    """What follows the last marker, stripped."""
    return strip(F.substring_index(col(x), marker, -1))


def verdict(x, fallback) -> Column:
    """A or B from the last line of a judge's answer; ``fallback`` when it names neither; null for an empty answer."""
    last = F.upper(strip(F.element_at(F.split(strip(x), r"\R"), -1)))
    named = F.when(last.contains("WIN: A"), "A").when(last.contains("WIN: B"), "B").otherwise(fallback)
    return F.when(strip(x) == "", F.lit(None)).otherwise(named)


def fill(template: str, **values) -> Column:
    """A template with ``{name}`` slots."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), col(v))
    return out


def chat(messages, eos: str = "</s>", generate: bool = True) -> Column:
    """Role-tagged turns of user, system and assistant; other roles are left out; ``generate`` adds the assistant's tag."""
    known = F.filter(col(messages), lambda m: m["role"].isin("user", "system", "assistant"))
    turns = F.transform(known, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit(eos + "\n")))
    return F.array_join(F.concat(turns, F.array(F.lit("<|assistant|>\n"))) if generate else turns, "")


def without_prefix(x, prefix) -> Column:
    """The text after its first ``length(prefix)`` characters."""
    return F.substr(col(x), F.length(col(prefix)) + 1)


def basename(x) -> Column:
    return F.substring_index(col(x), "/", -1)


def tokens(x) -> Column:
    """White-space tokens."""
    return F.filter(F.split(col(x), r"\s+"), lambda t: t != "")
