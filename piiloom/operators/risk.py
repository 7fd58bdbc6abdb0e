"""Risk scoring.

``score_documents`` works on the ``spans`` array of each document row and
never shuffles; it is the path of the pipeline.  The ``risk_*`` steps compute
the same numbers from a stored entity table with partial aggregation on
``(doc_id, entity_type)`` and then ``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piiloom import rules as R
from piiloom.functions import scoring as S
from piiloom.functions.columns import with_computed


def score_documents(scanned: DataFrame, weights: dict | None = None,
                    combinations=R.COMBINATIONS) -> DataFrame:
    """Add ``type_totals``, ``risk_score`` and ``risk_band``; no spans give 0.0, LOW."""
    totals = with_computed(scanned, type_totals=S.type_totals(F.col("spans")))
    scored = with_computed(totals, risk_score=S.score_totals(
        F.col("type_totals"), weights, combinations))
    return scored.withColumn("risk_band", S.band(F.col("risk_score")))


def risk_by_type(entities: DataFrame, weights: dict | None = None) -> DataFrame:
    """Weight x mean confidence x log2(1 + count) per document and type."""
    totals = entities.groupBy("doc_id", "entity_type").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"))
    return totals.withColumn("type_score", S.type_score(
        S.weight_of(F.col("entity_type"), weights), F.col("mean_confidence"), F.col("n")))


def risk_base(by_type: DataFrame) -> DataFrame:
    """Per document: summed score, number of types, and the set of types.

    The set has at most one entry per entity type, so it stays small.
    """
    return by_type.groupBy("doc_id").agg(
        F.sum("type_score").alias("base"), F.count("*").alias("n_types"),
        F.collect_set("entity_type").alias("types"))


def _has(name):
    return F.array_contains("types", name)


def risk_diversity(base: DataFrame) -> DataFrame:
    """Multiply by 1 + 0.3 per additional type."""
    return base.withColumn("score", F.col("base") * (
        F.lit(1.0) + F.lit(R.DIVERSITY_STEP) * (F.col("n_types") - 1)))


def risk_critical_boost(scores: DataFrame) -> DataFrame:
    """Multiply by 1.5 where a critical type is present."""
    critical = F.arrays_overlap("types", F.array(*[F.lit(t) for t in R.CRITICAL_TYPES]))
    return scores.withColumn("score", F.when(
        critical, F.col("score") * R.CRITICAL_FACTOR).otherwise(F.col("score")))


def risk_combinations(scores: DataFrame, combinations=R.COMBINATIONS) -> DataFrame:
    """Add the points of every combination of types present."""
    boost = S.combination_boost(_has, combinations)
    return (scores.withColumn("combination_points", boost)
            .withColumn("score", F.col("score") + F.col("combination_points")))


def risk_floor_cap(scores: DataFrame) -> DataFrame:
    """Raise to the tier's floor, then cap at 100."""
    return scores.withColumn("score", S.apply_floor_and_cap(F.col("score"), _has))


def risk_band(scores: DataFrame, column: str = "score") -> DataFrame:
    return scores.withColumn("risk_band", S.band(F.col(column)))


def risk_from_entities(entities: DataFrame, documents: DataFrame | None = None,
                       weights: dict | None = None,
                       combinations=R.COMBINATIONS) -> DataFrame:
    """Scores and bands from an entity table; ``documents`` adds those without entities."""
    steps = risk_base(risk_by_type(entities, weights))
    steps = risk_critical_boost(risk_diversity(steps))
    steps = risk_floor_cap(risk_combinations(steps, combinations))
    scores = steps.select("doc_id", F.col("score").alias("risk_score"))
    if documents is not None:
        scores = (documents.select("doc_id").join(scores, "doc_id", "left")
                  .select("doc_id", F.coalesce("risk_score", F.lit(0.0)).alias("risk_score")))
    return risk_band(scores, "risk_score")


def risk_explain(scored: DataFrame, weights: dict | None = None) -> DataFrame:
    """Contributors by weight, a summary sentence and a note on diversity.

    Ties between weights keep the order of first appearance in the text.
    """
    ranked = F.transform(F.col("type_totals"), lambda t, i: F.struct(
        (-S.weight_of(t["entity_type"], weights)).alias("rank"), i.alias("position"),
        t["entity_type"].alias("entity_type"), t["n"].alias("n"),
        S.weight_of(t["entity_type"], weights).alias("weight"),
        S.sensitivity(S.weight_of(t["entity_type"], weights)).alias("sensitivity")))
    df = with_computed(scored, contributors=F.array_sort(ranked))
    n = F.size("contributors")
    top = F.get("contributors", F.lit(0))
    lead = F.concat(F.lit("Score driven primarily by "), top["entity_type"], F.lit(" ("),
                    top["sensitivity"], F.lit(" sensitivity)"))
    rest = F.when(n > 1, F.concat(F.lit(" combined with "), (n - 1).cast("string"),
                                  F.lit(" other type(s)"))).otherwise(F.lit(""))
    note = F.concat(n.cast("string"), F.lit(" different PII types detected — diversity "
                                            "multiplier ×"),
                    F.format_string("%.1f", F.lit(1.0) + F.lit(R.DIVERSITY_STEP) * (n - 1)),
                    F.lit(" applied"))
    return (df.withColumn("summary", F.when(n == 0, F.lit("No PII detected."))
                          .otherwise(F.concat(lead, rest)))
            .withColumn("diversity_note", F.when(n > 1, note))
            .withColumn("unique_types", n))


def contributor_rows(explained: DataFrame) -> DataFrame:
    """One row per contributor of :func:`risk_explain`, best first."""
    rows = explained.select("doc_id", F.posexplode("contributors").alias("position", "c"))
    return rows.select("doc_id", "position", "c.entity_type", "c.n", "c.weight", "c.sensitivity")


def high_risk(scored: DataFrame, minimum: float = R.POLICY_SCORE) -> DataFrame:
    """Documents at or above the policy gate."""
    return scored.filter(F.col("risk_score") >= F.lit(float(minimum)))
