"""Validation: rule lists that split rows into accepted and rejected ones, or stop the run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.parse import criteria_options, target_key, valid_number


class InvalidRows(ValueError):
    """Rows that a run may not contain."""


def reasons(rules: Mapping[str, Column]) -> Column:
    """Names of the rules a row breaks, in order; a rule that is null is broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))


def quarantine(df: DataFrame, rules: Mapping[str, Column], column: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rejected rows carry the names of the rules they break."""
    marked = df.withColumn(column, reasons(rules))
    return marked.where(F.size(column) == 0).drop(column), marked.where(F.size(column) > 0)


def skip(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    return quarantine(df, rules)[0]


def demand(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """The rows as they are; reading a row that breaks a rule stops the run with the rule's name."""
    out = df
    broken = F.get(reasons(rules), 0)
    return out.where(F.when(broken.isNotNull(), F.raise_error(F.concat(F.lit("rule broken: "), broken)).cast("boolean")).otherwise(True))


def demand_none(df: DataFrame, what: str) -> None:
    """Stop if ``df`` has any row."""
    row = df.limit(1).collect()
    if row:
        raise InvalidRows(f"{what}: {row[0].asDict()}")


def demand_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, once its keys are known to be unique and it has rows."""
    if not df.take(1):
        raise InvalidRows("no rows")
    demand_none(df.groupBy(*keys).count().where("count > 1"), "repeated key")
    return df


def success(status: Column, error: Column, outcome: Column) -> Column:
    """A call succeeded: status null or 200..299, no error, outcome null or completed."""
    return (status.isNull() | status.between(200, 299)) & error.isNull() & (outcome.isNull() | (outcome == "completed"))


def failure_reason(status: Column, error: Column, outcome: Column) -> Column:
    return F.when(~(status.isNull() | status.between(200, 299)), F.concat(F.lit("status "), status.cast("string"))).when(error.isNotNull(), "error").when(outcome.isNotNull() & (outcome != "completed"), F.concat(F.lit("outcome "), outcome))


def sums_to_one(distribution: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(F.aggregate(F.map_values(distribution), F.lit(0.0), lambda acc, x: acc + x) - 1) <= tolerance


def on_grid(p: Column, digits: int = 2) -> Column:
    """Whether all probabilities lie on the decimal grid."""
    return F.forall(p, lambda x: F.abs(F.round(x, digits) - x) < 1e-12)


def rounded_sum(p: Column) -> Column:
    """Probabilities sum to 1 within what rounding explains: n * 0.005 on a two-digit grid, else n * 1e-6, plus 1e-8."""
    unit = F.when(on_grid(p), F.lit(0.005)).otherwise(F.lit(1e-6))
    return F.abs(F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x) - 1) <= F.size(p) * unit + 1e-8


def record_rules(kind: Column, criteria: Column, target: Column, distribution: Column, forbidden: Column | None = None) -> dict[str, Column]:
    """What a decision record must satisfy; ``forbidden`` is an array of names found where they would leak the answer."""
    options = criteria_options(criteria, kind)
    rules = {
        "type": kind.isin("choice", "noul", "score"),
        "criteria": options.isNotNull() & (F.size(options) > 0),
        "target": F.array_contains(options, target_key(target, kind)),
        "distribution keys": distribution.isNull() | (F.array_sort(F.map_keys(distribution)) == F.array_sort(options)),
        "distribution sum": distribution.isNull() | sums_to_one(distribution),
    }
    return rules if forbidden is None else rules | {"leaked name": F.size(forbidden) == 0}


def schema_rules(kind: Column, choices: Column) -> dict[str, Column]:
    """A scorer's schema: an enum or boolean with 1 to 26 different choices."""
    return {"kind": kind.isin("enum", "boolean"), "choices": (F.size(choices) >= 1) & (F.size(choices) <= 26), "distinct": F.size(F.array_distinct(choices)) == F.size(choices)}


def teacher_rules(labels: Column, p: Column, options: Column, score: Column, confidence: Column) -> dict[str, Column]:
    """A teacher's answer: the same labels, probabilities within bounds and summing to 1 as rounded, the score near the expected level."""
    expected = F.aggregate(F.transform(p, lambda x, i: x * i), F.lit(0.0), lambda acc, x: acc + x)
    return {
        "labels": F.array_sort(labels) == F.array_sort(options),
        "bounds": F.forall(p, lambda x: valid_number(x) & (x <= 1)),
        "sum": rounded_sum(p),
        "score": score.isNull() | (F.abs(score - expected) <= F.size(p) * 0.005 + 1e-8),
        "confidence": confidence.isNull() | (valid_number(confidence) & (confidence <= 1)),
    }


def structure_rules(state: Column, options: Column, rationale: Column, least_words: int = 15) -> dict[str, Column]:
    words = F.size(F.filter(F.split(F.trim(state), r"(?U)\s+"), lambda w: w != ""))
    return {"words": words >= least_words, "options": F.size(options) >= 2, "rationale": F.length(F.trim(rationale)) > 0}


def quote_rules(quotes: Column, text: Column, longest: int = 180) -> dict[str, Column]:
    """Two to four different quotes, each short and literally in the text."""
    return {"count": F.size(F.array_distinct(quotes)).between(2, 4) & (F.size(F.array_distinct(quotes)) == F.size(quotes)), "literal": F.forall(quotes, lambda q: F.contains(text, q) & (F.length(q) <= longest))}


def review_rules(checks: list[Column], agrees: Column, quotes: Column, text: Column) -> dict[str, Column]:
    """A blind review: every check true, the target agreed on, the quotes literal."""
    return {f"check {i}": c for i, c in enumerate(checks)} | {"target": agrees} | quote_rules(quotes, text)


def code_block(text: Column) -> Column:
    """The one fenced Python block of 6 to 24 lines, without outer blanks; null if there is none or more."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```python\s*\n(.*?)```"), 1)
    code = F.regexp_replace(F.get(blocks, 0), r"(?U)^\s+|\s+$", "")
    lines = F.size(F.split(code, r"\r\n|[\n\r]"))
    return F.when((F.size(blocks) == 1) & lines.between(6, 24), code)


def check_settings(saved: Mapping, current: Mapping, keys: list[str]) -> None:
    """A resumed run must have been started with the same settings."""
    changed = [k for k in keys if saved.get(k) != current.get(k)]
    if changed:
        raise InvalidRows(f"settings differ from the saved run: {', '.join(changed)}")


def current_results(results: DataFrame, requests: DataFrame, key: str = "id", digest: str = "payload_sha256") -> DataFrame:
    """Results that still belong to a request: the key known and the payload unchanged."""
    return results.join(requests.select(key, digest).distinct(), [key, digest], "left_semi")
