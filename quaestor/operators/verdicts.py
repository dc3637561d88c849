"""Graded verdicts: recovery of JSON, normalisation, two passes, questions and a holistic verdict."""

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# Labels by score, and further words that stand for a score.
LABELS = ("not_addressed", "inadequate", "partially_adequate", "adequate")
SCORE_WORDS: dict[str, int] = {
    "not_addressed": 0,
    "missing": 0,
    "inadequate": 1,
    "poor": 1,
    "partially_adequate": 2,
    "partial": 2,
    "partially_addressed": 2,
    "adequate": 3,
    "good": 3,
}
# Of each worst severity, the verdict and the risk.
WORST = {"Critical": ("reject", "critical"), "Major": ("revise_major", "high"), "Minor": ("revise_minor", "medium"), "Recommendation": ("approve", "low")}
DEFAULT_SCORE = 1
#: Characters of a token, and the share of a context from which a warning is due.
CHARS_PER_TOKEN, WARN_PERCENT = 4, 85


def _word(raw: Column) -> Column:
    return F.translate(F.lower(F.trim(F.coalesce(raw, F.lit("")))), "- ", "__")


def score_of(raw: Column, inherited: Column | None = None) -> Column:
    """0 to 3 from a number's text or a word; what is neither gives the inherited score, or 1."""
    known = _word(raw)
    out = F.when(known.rlike("^0*[0-3]$"), F.substring(known, -1, 1).cast("int"))
    for word, score in SCORE_WORDS.items():
        out = out.when(known == word, F.lit(score))
    return out.otherwise(F.coalesce(inherited, F.lit(DEFAULT_SCORE)) if inherited is not None else F.lit(DEFAULT_SCORE))


def label_of(raw: Column, score: Column) -> Column:
    """A valid label as it is, else the score's."""
    known = _word(raw)
    return F.when(known.isin(*LABELS), known).otherwise(F.get(F.array(*map(F.lit, LABELS)), score))


def unfenced(answer: Column) -> Column:
    """A model's answer without thinking tags; of fenced blocks, the last one's text."""
    plain = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", "")
    fenced = F.regexp_extract_all(plain, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1))
    return strip(F.when(F.size(fenced) > 0, F.element_at(fenced, -1)).otherwise(plain))


def _first_object(text: str) -> str | None:
    """The JSON object that the first brace opens; if that is none, what lies between the outermost braces, if that is. Two
    passes over the text at most."""
    first, last = text.find("{"), text.rfind("}")
    if first < 0:
        return None
    try:
        return text[first : json.JSONDecoder().raw_decode(text, first)[1]]
    except (ValueError, RecursionError):
        pass
    try:
        json.loads(text[first : last + 1])
        return text[first : last + 1]
    except (ValueError, RecursionError):
        return None


def recovered(answer: Column) -> Column:
    """The JSON object in a model's answer as text, or null. Answers that parse stay in the JVM; the others are searched by
    an Arrow function."""
    @F.arrow_udf("string")
    def search(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _first_object(t) for t in texts.to_pylist()], pa.string())

    text = unfenced(answer)
    whole = F.try_parse_json(text).isNotNull() & text.startswith("{")
    return F.when(whole, text).otherwise(search(F.when(~whole, text)))


def filled_questions(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, question, score): expected questions by position; ones without an answer inherit the theme's score."""
    both = expected.join(found.select(*keys, "theme_score").distinct(), [k for k in keys if k in expected.columns])
    return both.join(found.drop("theme_score"), [*keys, "pos"], "left").select(*keys, "pos", F.coalesce("text", "question").alias("question"), score_of(F.col("raw_score"), F.col("theme_score")).alias("score"))


def reconcile(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score, label, reconciled, origin): the second pass, else the first, else a fallback of the default score.
    `origin` is set here and never read from an answer, so that none can pose as a fallback."""
    a = first.select(*keys, F.col("score").alias("s1"), F.col("label").alias("l1"))
    b = second.select(*keys, F.col("score").alias("s2"), F.col("label").alias("l2"))
    both = a.join(b, keys, "full")
    score = F.coalesce("s2", "s1", F.lit(DEFAULT_SCORE))
    return both.select(
        *keys, score.alias("score"), label_of(F.coalesce("l2", "l1"), score).alias("label"), F.col("s2").isNotNull().alias("reconciled"),
        F.when(F.col("s2").isNotNull(), "second").when(F.col("s1").isNotNull(), "first").otherwise("fallback").alias("origin"),
    )


def changed(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, changed): whether the score or label differs between passes, or the second one asks something new."""
    a = first.select(*keys, F.col("score").alias("s1"), F.col("label").alias("l1"), F.col("questions").alias("q1"))
    b = second.select(*keys, F.col("score").alias("s2"), F.col("label").alias("l2"), F.col("questions").alias("q2"))
    new = F.size(F.array_except(F.coalesce("q2", F.array().cast("array<string>")), F.coalesce("q1", F.array().cast("array<string>")))) > 0
    return a.join(b, keys).select(*keys, (~F.col("s1").eqNullSafe(F.col("s2")) | ~F.col("l1").eqNullSafe(F.col("l2")) | new).alias("changed"))


def disagreements(rows: DataFrame, key: str, order: str, theme: str) -> DataFrame:
    """(key, n_changed, themes): the changed themes of each protocol, in theme order."""
    hits = F.array_sort(F.collect_list(F.when(F.col("changed"), F.struct(order, theme))))
    return rows.groupBy(key).agg(F.count_if("changed").alias("n_changed"), F.array_join(F.transform(hits, lambda x: x[theme]), ",").alias("themes"))


def distinct_questions(rows: DataFrame, key: str, signature: list[str], order: list[str]) -> DataFrame:
    """Each question once, the first of equal ones, with its place among a protocol's questions."""
    first = Window.partitionBy(key, *signature).orderBy(*order)
    once = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def holistic(sections: DataFrame, key: str) -> DataFrame:
    """(key, verdict, risk) from the worst severity of a protocol's sections; none is the mildest."""
    ranks = {name: i for i, name in enumerate(reversed(WORST), start=1)}
    rank = F.lit(0)
    for name, i in ranks.items():
        rank = F.when(F.col("severity") == name, i).otherwise(rank)
    worst = sections.groupBy(key).agg(F.max(rank).alias("rank"))
    verdict, risk = F.lit("approve"), F.lit("low")
    for name, i in ranks.items():
        verdict, risk = F.when(F.col("rank") == i, WORST[name][0]).otherwise(verdict), F.when(F.col("rank") == i, WORST[name][1]).otherwise(risk)
    return worst.select(key, verdict.alias("verdict"), risk.alias("risk"))


def context_budget(chars: Column, context: int) -> Column:
    """ok, warn or overflow of a prompt in a context of so many tokens."""
    used = F.floor(chars / CHARS_PER_TOKEN)
    return F.when(used > context, "overflow").when(used * 100 >= context * WARN_PERCENT, "warn").otherwise("ok")


def review(prompts: DataFrame, provider, schema: str) -> DataFrame:
    """Runs a provider (an iterator of pandas frames to one of frames) over prompts in Arrow batches; which provider, and
    whether it may be reached, is settled before. Tests use a deterministic stub."""
    return prompts.mapInPandas(provider, schema)
