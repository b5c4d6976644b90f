"""Scalar functions of answer grading, retries and reports, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

JUDGE_FAILURE = "Failed to parse judge output:"
RUN_FAILURE = "Evaluation execution failure:"
ERROR_ANSWER = "[EVALUATION_ERROR]"

BASIC, HYBRID, ADAPTIVE, FULL = SYSTEMS = ("basic_rag", "hybrid_rag", "adaptive_rag", "full_rag")
#: Other spellings of the four systems.
SYSTEM_NAMES: Mapping[str, str] = {
    "basic": BASIC,
    "basic_rag": BASIC,
    "baseline": BASIC,
    "baseline_rag": BASIC,
    "hybrid": HYBRID,
    "hybrid_rag": HYBRID,
    "adaptive": ADAPTIVE,
    "adaptive_rag": ADAPTIVE,
    "full": FULL,
    "full_rag": FULL,
}


def system_name(name: Column, strict: bool = True) -> Column:
    """The system of a name in any case, with hyphens or spaces; an unknown one raises, or is null if not strict."""
    clean = F.regexp_replace(F.lower(F.trim(name)), "[- ]", "_")
    found = F.create_map(*(F.lit(x) for pair in SYSTEM_NAMES.items() for x in pair))[clean]
    if not strict:
        return found
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown system: "), F.coalesce(name, F.lit("null")))).cast("string"))


def score_band(score: Column, strict: bool = True) -> Column:
    """The words for a score from 0 to 4; one outside raises, or is null if not strict."""
    bands = F.when(score == 0, "does not satisfy").when(score < 1, "very poor").when(score < 2, "partially satisfies").when(score < 3, "mostly satisfactory").otherwise("strongly satisfies")
    inside = score.between(0.0, 4.0)
    if not strict:
        return F.when(inside, bands)
    return F.when(inside, bands).when(score.isNotNull(), F.raise_error(F.lit("a score lies between 0 and 4")).cast("string"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def overall(given: Column, correctness: Column, faithfulness: Column, relevance: Column) -> Column:
    """The given overall score, or the mean of the three if none is given or it is 0 though they are not."""
    mean = F.round((correctness + faithfulness + relevance) / 3, 4)
    return F.when(given.isNull() | ((given == 0) & (mean > 0)), mean).otherwise(given)


def judged(reply: Column) -> Column:
    """Struct of correctness, faithfulness, relevance, overall and reason from a judge's reply.

    The JSON is in a fence or from the first to the last brace. Missing scores are 0, others are held within 0 and 4.
    A reply that can't be read has zeros and a reason that starts with JUDGE_FAILURE.
    """
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braced = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    data = F.from_json(F.when(fenced != "", fenced).otherwise(braced), "correctness string, faithfulness string, relevance string, reason string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    raw = [F.coalesce(data[k], F.lit("0")) for k in ("correctness", "faithfulness", "relevance")]
    number = [x.try_cast("double") for x in raw]
    good = data.isNotNull() & data["_corrupt"].isNull() & (F.trim(braced) != "") & number[0].isNotNull() & number[1].isNotNull() & number[2].isNotNull()
    c, f, r = (clamp(x, 0.0, 4.0) for x in number)
    reason = F.trim(F.coalesce(data["reason"], F.lit("")))
    zero = F.lit(0.0)
    return F.when(
        good,
        F.struct(c.alias("correctness"), f.alias("faithfulness"), r.alias("relevance"), F.round((c + f + r) / 3, 4).alias("overall"), F.when(reason == "", "Evaluated by judge.").otherwise(reason).alias("reason")),
    ).otherwise(F.struct(zero.alias("correctness"), zero.alias("faithfulness"), zero.alias("relevance"), zero.alias("overall"), F.lit(f"{JUDGE_FAILURE} no JSON object of scores").alias("reason")))


def sigmoid(x: Column) -> Column:
    """Logistic function of x held within -5 and 5."""
    return 1 / (1 + F.exp(-clamp(x, -5.0, 5.0)))


def normalised(vector: Column) -> Column:
    """A vector of unit length; one of length zero stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def percent_difference(a: Column, b: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(a - b, b) * 100, 2), F.lit(0.0))


def duration(seconds: Column) -> Column:
    """--, 45s, 12m 34s or 1h 02m 03s."""
    s = F.floor(seconds).cast("int")
    return (
        F.when(seconds.isNull() | (seconds < 0), "--")
        .when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm %02ds", F.floor(s / 60).cast("int"), s % 60))
        .otherwise(F.format_string("%dh %02dm %02ds", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60))
    )


def retry_delay(header: Column, body: Column, attempt: Column, base: float = 2.0, most: float = 60.0) -> Column:
    """Seconds to wait: the header's, or the body's "try again in" plus half a second, or base * 2^attempt; `most` at most."""
    told = header.try_cast("double")
    hinted = F.regexp_extract(body, r"(?i)try again in (\d+(?:\.\d+)?)\s*s", 1).try_cast("double") + 0.5
    return F.least(F.lit(most), F.when(told > 0, told).when(hinted > 0, hinted).otherwise(base * F.pow(F.lit(2.0), attempt)))


def quota_spent(body: Column) -> Column:
    """Whether an error speaks of a daily token quota."""
    low = F.lower(body)
    return low.contains("tokens per day") | low.contains("(tpd)")


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with sorted keys; columns that start with _ don't count."""
    return F.sha2(F.to_json(F.struct(*sorted(c for c in columns if not c.startswith("_")))), 256)
