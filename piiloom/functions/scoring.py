"""Risk score of one document from its span array, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from piiloom import rules as R
from piiloom.functions.text import lookup


def type_totals(spans: Column) -> Column:
    """``array<struct<entity_type, n, confidence_sum>>`` in order of first appearance."""
    types = F.array_distinct(F.transform(spans, lambda s: s["entity_type"]))

    def total(entity_type):
        own = F.filter(spans, lambda s: s["entity_type"] == entity_type)
        return F.struct(
            entity_type.alias("entity_type"),
            F.size(own).alias("n"),
            F.aggregate(own, F.lit(0.0), lambda acc, s: acc + s["confidence"])
            .alias("confidence_sum"))

    return F.transform(types, total)


def type_score(weight: Column, mean_confidence: Column, n: Column) -> Column:
    return weight * mean_confidence * F.log2(F.lit(1.0) + n)


def weight_of(entity_type: Column, weights: dict | None = None) -> Column:
    return lookup(R.WEIGHTS if weights is None else weights, entity_type, R.UNKNOWN_WEIGHT)


def combination_boost(has_type, combinations=R.COMBINATIONS) -> Column:
    """Sum of all matching combinations; ``has_type(name)`` is a boolean column."""
    boost = F.lit(0.0)
    for types, points in combinations:
        present = has_type(types[0])
        for name in types[1:]:
            present = present & has_type(name)
        boost = boost + F.when(present, F.lit(float(points))).otherwise(F.lit(0.0))
    return boost


def apply_floor_and_cap(score: Column, has_type) -> Column:
    def any_of(names):
        result = F.lit(False)
        for name in names:
            result = result | has_type(name)
        return result

    floored = (F.when(any_of(R.CRITICAL_TYPES), F.greatest(score, F.lit(R.CRITICAL_FLOOR)))
               .when(any_of(R.HIGH_TYPES), F.greatest(score, F.lit(R.HIGH_FLOOR)))
               .otherwise(score))
    return F.least(floored, F.lit(R.MAX_SCORE))


def adjusted(base: Column, n_types: Column, has_type, combinations=R.COMBINATIONS) -> Column:
    """Diversity, critical factor, combinations, floor and cap on a base score."""
    score = base * (F.lit(1.0) + F.lit(R.DIVERSITY_STEP) * (n_types - 1))
    critical = F.lit(False)
    for name in R.CRITICAL_TYPES:
        critical = critical | has_type(name)
    score = F.when(critical, score * R.CRITICAL_FACTOR).otherwise(score)
    score = score + combination_boost(has_type, combinations)
    return F.when(n_types == 0, F.lit(0.0)).otherwise(apply_floor_and_cap(score, has_type))


def score_totals(totals: Column, weights: dict | None = None,
                 combinations=R.COMBINATIONS) -> Column:
    """Risk score from :func:`type_totals`."""
    base = F.aggregate(totals, F.lit(0.0), lambda acc, t: acc + type_score(
        weight_of(t["entity_type"], weights), t["confidence_sum"] / t["n"], t["n"]))
    return adjusted(base, F.size(totals),
                    lambda name: F.exists(totals, lambda t: t["entity_type"] == name),
                    combinations)


def band(score: Column) -> Column:
    result = None
    for limit, name in R.BANDS:
        result = (F.when(score < limit, F.lit(name)) if result is None
                  else result.when(score < limit, F.lit(name)))
    return result.otherwise(F.lit(R.TOP_BAND))


def sensitivity(weight: Column) -> Column:
    result = None
    for limit, name in R.SENSITIVITIES:
        result = (F.when(weight >= limit, F.lit(name)) if result is None
                  else result.when(weight >= limit, F.lit(name)))
    return result.otherwise(F.lit(R.LOWEST_SENSITIVITY))
