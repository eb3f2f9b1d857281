"""Field results of rules and models: evidence that must stand in the text, and who prevails when they differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidence from which a model's value stands in for a rule's, and those of the older conflict rules.
MODEL, PARENT, RULE, TITLE = 0.65, 0.55, 0.7, 0.9
UNKNOWN = "UNKNOWN"


def known(value: Column) -> Column:
    return F.coalesce(value != UNKNOWN, F.lit(False))


def stands(title: Column, description: Column, text: Column, start: Column, end: Column, source: Column) -> Column:
    """Whether evidence is what its source holds at its place, and no link or address."""
    whole = F.when(F.upper(source) == "TITLE", title).when(F.upper(source) == "DESCRIPTION", description)
    contact = text.rlike(r"(?i)https?://|www\.|[\w.+-]@[\w-]+(?:\.[\w-]+)*\.[a-z]{2}")
    exact = (start >= 0) & (end >= start) & (end <= F.length(whole)) & (F.substring(whole, start + 1, end - start) == text)
    return F.coalesce((text != "") & ~contact & exact, F.lit(False))


def result(value: Column, confidence: Column, source: Column, valid: Column) -> Column:
    """struct(value, confidence, source): unknown and without confidence where the evidence does not stand."""
    holds = known(value) & F.coalesce(valid, F.lit(False))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0))))
    return F.struct(F.when(holds, value).otherwise(UNKNOWN).alias("value"), F.when(holds, sure).otherwise(0.0).alias("confidence"), F.when(holds, source).otherwise(UNKNOWN).alias("source"))


def hybrid(rule: Column, model: Column, threshold: float = MODEL) -> Column:
    """struct(value, confidence, source, warnings): the rule's value if known, else the model's from the threshold on.

    A model that knows another value than the rule gives a warning; it does not prevail.
    """
    by_rule, by_model = known(rule["value"]), known(model["value"])
    chosen = lambda field, otherwise: F.when(by_rule, rule[field]).when(by_model & (model["confidence"] >= threshold), model[field]).otherwise(otherwise)
    value = chosen("value", F.lit(UNKNOWN))
    differs = by_rule & by_model & (rule["value"] != model["value"])
    return F.struct(
        value.alias("value"), chosen("confidence", F.lit(0.0)).alias("confidence"), F.when(value != UNKNOWN, "HYBRID").otherwise(UNKNOWN).alias("source"),
        F.when(differs, F.array(F.lit("RULE_ML_CONTRADICTION"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def hybrid_fields(rules: DataFrame, models: DataFrame, keys: list[str], threshold: float = MODEL) -> DataFrame:
    """keys and the hybrid result of rows of either side (keys, value, confidence, source); a side without a row knows nothing."""
    side = lambda df, name: df.select(*keys, F.struct("value", "confidence").alias(name))
    both = side(rules, "rule").join(side(models, "model"), keys, "full")
    nothing = F.struct(F.lit(UNKNOWN).alias("value"), F.lit(0.0).alias("confidence"))
    return both.select(*keys, hybrid(F.coalesce("rule", nothing), F.coalesce("model", nothing), threshold).alias("r")).select(*keys, "r.*")


def parent_and_leaf(parent: Column, leaf: Column, model: Column, confidence: Column) -> Column:
    """struct(parent, leaf): a confident model names the parent, and the leaf stays only under its own parent; else the taxonomy's."""
    by_model = known(model) & F.coalesce(confidence >= PARENT, F.lit(False))
    chosen = F.when(by_model, model).otherwise(F.coalesce(parent, F.lit(UNKNOWN)))
    return F.struct(chosen.alias("parent"), F.when(known(chosen) & (parent == chosen), leaf).otherwise(UNKNOWN).alias("leaf"))


def preferred(rule: Column, confidence: Column, model: Column, least: float = RULE) -> Column:
    """The rule's value if it is sure, else the model's if known, else the rule's."""
    return F.when(known(rule) & F.coalesce(confidence >= least, F.lit(False)), rule).when(known(model), model).otherwise(rule)


def seniority_of(title: Column, title_confidence: Column, model: Column, model_confidence: Column, by_experience: Column) -> Column:
    """A sure title, else a sure model, else what the experience says, else unknown."""
    sure = lambda value, confidence, least: known(value) & F.coalesce(confidence >= least, F.lit(False))
    return F.when(sure(title, title_confidence, TITLE), title).when(sure(model, model_confidence, RULE), model).otherwise(F.coalesce(by_experience, F.lit(UNKNOWN)))
