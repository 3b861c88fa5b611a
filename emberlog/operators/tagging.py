"""Rule tagging: first matching rule by confidence assigns the attack technique."""

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.constants.attack_rules import CONFIDENCE_RANK, RULES, TECHNIQUES, Rule
from emberlog.functions.once import once
from emberlog.functions.text import fold_case, search


def rules_from_table(table: DataFrame, max_patterns: int = 10_000) -> tuple[Rule, ...]:
    """Rules from an editable table (technique, confidence, pattern, rule_order, pattern_order).

    Rules are compiled into the plan as expressions, so the driver reads them; a table with more than
    ``max_patterns`` rows is refused, none is left out: ``rule_table.tag_by_rule_table`` takes any number.
    """
    columns = ("technique", "confidence", "pattern", "rule_order", "pattern_order")
    rows = table.select(*columns).limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"the rule table holds more than {max_patterns} patterns")
    grouped: dict = {}
    for row in sorted(rows, key=lambda r: (r.rule_order, r.pattern_order)):
        grouped.setdefault((row.rule_order, row.technique, row.confidence), []).append(row.pattern)
    return tuple(
        Rule(technique, confidence, tuple(patterns))
        for (_, technique, confidence), patterns in grouped.items()
    )


def _ordered(rules: Sequence[Rule]) -> list[Rule]:
    """Highest confidence first, table order among equals; unknown confidences never win."""
    known = [rule for rule in rules if rule.confidence in CONFIDENCE_RANK]
    return sorted(known, key=lambda rule: -CONFIDENCE_RANK[rule.confidence])


def _case(branches: list[tuple[Column, Column]], otherwise: Column) -> Column:
    result = F.when(*branches[0])
    for condition, value in branches[1:]:
        result = result.when(condition, value)
    return result.otherwise(otherwise)


def tag_events(
    events: DataFrame,
    rules: Sequence[Rule] = RULES,
    techniques: dict[str, tuple[str, str]] = TECHNIQUES,
    message_col: str = "message",
    raw_col: str | None = "raw",
) -> DataFrame:
    """Add technique_id, technique_name, tactic, mitre_confidence and matched_rule.

    The search text is message and raw joined by a space. Rules are tried from the highest
    confidence down until the first hit; the pattern that hit is looked up afterwards among the
    winning rule's patterns only.
    """
    ranked = _ordered(rules)
    message = F.coalesce(F.col(message_col), F.lit(""))
    raw = F.coalesce(F.col(raw_col), F.lit("")) if raw_col else F.lit("")
    text = F.col("_text")
    folded = F.col("_folded")
    with_text = events.withColumn("_text", F.concat(message, F.lit(" "), raw)).withColumn(
        "_folded", fold_case(text)
    )

    hit_any = [
        (reduce(or_, [search(text, folded, p) for p in rule.patterns]), F.lit(index))
        for index, rule in enumerate(ranked)
    ]
    no_rule = F.lit(None).cast("int")
    with_rule = with_text.withColumn("_rule", _case(hit_any, no_rule) if hit_any else no_rule)
    with_rule = once(with_rule, "_text", "_folded", "_rule")

    chosen = F.col("_rule")

    def per_rule(values: list) -> Column:
        if not ranked:
            return F.lit(None).cast("string")
        return F.when(
            chosen.isNotNull(), F.array(*[F.lit(v) for v in values])[chosen]
        )

    def first_pattern(rule: Rule) -> Column:
        if len(rule.patterns) == 1:
            return F.lit(rule.patterns[0])
        branches = [(search(text, folded, p), F.lit(p)) for p in rule.patterns[:-1]]
        return _case(branches, F.lit(rule.patterns[-1]))

    none = F.lit(None).cast("string")
    matched = [(chosen == index, first_pattern(rule)) for index, rule in enumerate(ranked)]
    unknown = ("Unknown", "Unknown")
    return with_rule.select(
        *events.columns,
        per_rule([rule.technique for rule in ranked]).alias("technique_id"),
        per_rule([techniques.get(rule.technique, unknown)[0] for rule in ranked]).alias("technique_name"),
        per_rule([techniques.get(rule.technique, unknown)[1] for rule in ranked]).alias("tactic"),
        F.coalesce(per_rule([rule.confidence for rule in ranked]), F.lit("NONE")).alias("mitre_confidence"),
        (_case(matched, none) if matched else none).alias("matched_rule"),
    )


def technique_report(tagged: DataFrame, top: int = 8) -> DataFrame:
    """Most frequent techniques."""
    return (
        tagged.filter(F.col("technique_id").isNotNull())
        .groupBy("technique_id", "technique_name")
        .agg(F.count("*").alias("n_events"))
        .orderBy(F.desc("n_events"), "technique_id")
        .limit(top)
    )


def tactic_report(tagged: DataFrame) -> DataFrame:
    """Events per tactic, most frequent first."""
    return (
        tagged.filter(F.col("tactic").isNotNull())
        .groupBy("tactic")
        .agg(F.count("*").alias("n_events"))
        .orderBy(F.desc("n_events"), "tactic")
    )


def tag_rate(tagged: DataFrame) -> DataFrame:
    """Total and tagged events with the share in percent."""
    return tagged.agg(
        F.count("*").alias("total_events"),
        F.count("technique_id").alias("tagged_events"),
    ).select(
        "total_events",
        "tagged_events",
        F.when(
            F.col("total_events") > 0,
            F.round(F.col("tagged_events") / F.col("total_events") * 100, 1),
        )
        .otherwise(F.lit(0.0))
        .alias("tag_rate"),
    )


def tagging_accuracy(tagged: DataFrame, expected_col: str = "expected_technique") -> DataFrame:
    """Labelled events: share with any technique and share with the expected one, in percent.

    Only rows with an expected technique count as threats.
    """
    threat = F.col(expected_col).isNotNull()
    return (
        tagged.filter(threat)
        .agg(
            F.count("*").alias("threat_events"),
            F.count("technique_id").alias("classified"),
            F.count_if(F.col("technique_id") == F.col(expected_col)).alias("correct"),
        )
        .select(
            "threat_events",
            "classified",
            "correct",
            *[
                F.when(F.col("threat_events") > 0, F.round(F.col(c) / F.col("threat_events") * 100, 1))
                .otherwise(F.lit(0.0))
                .alias(name)
                for c, name in (("classified", "classification_rate"), ("correct", "accuracy"))
            ],
        )
    )
