"""Triage: rule cascade, prompt text, answer ingest, quality rubric and reports."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.constants import triage_text as X
from emberlog.functions.once import once
from emberlog.functions.text import contains_any, strip_space
from emberlog.operators.queries import index_percentiles

_CASCADES = {"v1": X.CASCADE_V1, "v2": X.CASCADE_V2}
_RESULT_FIELDS = [
    "threat_type", "explanation", "attacker_intent", "risk", "recommendations",
    "false_positive_probability",
]
#: Fields are read as text and converted one by one, so that an odd field does not void the others.
_ANSWER_TYPE = (
    "array<struct<threat_type:string,explanation:string,attacker_intent:string,risk:string,"
    "recommendations:string,false_positive_probability:string>>"
)


def _profile(profile: str) -> None:
    if profile not in _CASCADES:
        raise ValueError(f"profile must be v1 or v2, not {profile!r}")


def _score(df: DataFrame) -> Column:
    if "anomaly_score" not in df.columns:
        return F.lit(0.0)
    return F.coalesce(F.col("anomaly_score").cast("double"), F.lit(0.0))


def _address() -> Column:
    return F.coalesce("source_ip", F.lit("unknown"))


def triage(
    events: DataFrame, profile: str = "v1", cascade: Sequence[X.Verdict] | None = None
) -> DataFrame:
    """Add the cascade's answer as columns; first branch with a matching word or score wins.

    The last branch catches everything, the one before goes by score. Profile v2 names its ``prompt_style`` too.
    """
    _profile(profile)
    verdicts = list(cascade or _CASCADES[profile])
    lowered = F.col("_lower")
    score = _score(events)
    branch = None
    for index, verdict in enumerate(verdicts):
        if index == len(verdicts) - 1:
            branch = branch.otherwise(index)
        elif verdict.words:
            hit = contains_any(lowered, verdict.words)
            branch = F.when(hit, index) if branch is None else branch.when(hit, index)
        else:
            branch = branch.when(score >= X.ANOMALY_SCORE, index)

    def filled(text: Column) -> Column:
        with_ip = F.replace(text, F.lit("{ip}"), _address())
        return F.replace(with_ip, F.lit("{score}"), F.format_string("%.2f", score))

    def chosen(values: list) -> Column:
        return F.array(*[F.lit(v) for v in values])[F.col("_branch")]

    texts = F.array(*[F.array(*[F.lit(r) for r in v.recommendations]) for v in verdicts])[F.col("_branch")]
    prepared = events.withColumn("_lower", F.lower(F.coalesce("message", F.lit("")))).withColumn(
        "_branch", branch
    )
    style = [F.lit("rule-based").alias("prompt_style")] if profile == "v2" else []
    return once(prepared.drop("_lower"), "_branch").select(
        *events.columns,
        chosen([v.threat_type for v in verdicts]).alias("threat_type"),
        filled(chosen([v.explanation for v in verdicts])).alias("explanation"),
        chosen([v.attacker_intent for v in verdicts]).alias("attacker_intent"),
        chosen([v.risk for v in verdicts]).alias("risk"),
        F.transform(texts, filled).alias("recommendations"),
        chosen([v.false_positive_probability for v in verdicts]).alias("false_positive_probability"),
        F.lit("rule-based").alias("source"),
        F.lit(0).cast("long").alias("latency_ms"),
        *style,
    )


def enrichment_key(profile: str = "v1") -> Column:
    """Key of events that share one answer. Missing values count as empty (NONE in v1)."""
    _profile(profile)

    def text(name: str, default: str = "") -> Column:
        return F.coalesce(F.col(name), F.lit(default))

    if profile == "v1":
        parts = [text("technique_id", "NONE"), text("severity"), F.substring(text("message"), 1, 60)]
        return F.md5(F.concat_ws("|", *parts))
    parts = [text("technique_id"), text("severity"), text("source_ip"), F.substring(text("message"), 1, 50)]
    return F.md5(F.concat_ws("_", *parts))


def distinct_requests(events: DataFrame, profile: str = "v1", order_col: str = "id") -> DataFrame:
    """One event per key, the first by ``order_col``: the rows worth sending to a slow step."""
    keyed = events.withColumn("cache_key", enrichment_key(profile))
    row = F.struct(*[F.col(c) for c in events.columns])
    return (
        keyed.groupBy("cache_key")
        .agg(F.min_by(row, order_col).alias("r"), F.count("*").alias("n_events"))
        .select("cache_key", "n_events", "r.*")
    )


def attach_answers(events: DataFrame, answers: DataFrame, profile: str = "v1") -> DataFrame:
    """Give every event the answer of its key (``cache_key`` in ``answers``)."""
    return (
        events.withColumn("cache_key", enrichment_key(profile)).join(answers, "cache_key", "left")
    )


def cache_report(events: DataFrame, profile: str = "v1") -> DataFrame:
    """Requests, distinct keys and the share saved by answering each key once."""
    keys = events.groupBy(enrichment_key(profile).alias("k")).agg(F.count("*").alias("n"))
    return keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("requests"), F.count("*").alias("distinct_keys")
    ).select(
        "requests",
        "distinct_keys",
        F.when(F.col("requests") > 0, F.round(1 - F.col("distinct_keys") / F.col("requests"), 4))
        .otherwise(F.lit(0.0))
        .alias("hit_rate"),
    )


def prompt_style() -> Column:
    """Prompt style by severity: worked examples for the two highest, else the short one."""
    return F.when(F.col("severity").isin("CRITICAL", "HIGH"), "few_shot").otherwise("fast")


def _event_block(df: DataFrame, urgency: dict[str, str]) -> Column:
    urgent = F.lit("")
    for severity, line in urgency.items():
        urgent = F.when(F.col("severity") == severity, line).otherwise(urgent)

    def named(name: str) -> Column:
        value = F.col(name) if name in df.columns else F.lit(None).cast("string")
        return F.coalesce(F.nullif(value, F.lit("")), F.lit("not identified"))

    return F.concat(
        F.lit("\nSecurity Event:\n- Message      : "), F.coalesce("message", F.lit("")),
        F.lit("\n- Severity     : "), F.coalesce("severity", F.lit("UNKNOWN")),
        F.lit("\n- Source IP    : "), _address(),
        F.lit("\n- Anomaly Score: "), F.format_string("%.2f", _score(df)), F.lit(" / 1.0"),
        F.lit("\n- MITRE Technique: "), named("technique_id"),
        F.lit("\n- MITRE Tactic   : "), named("tactic"),
        F.lit("\n"), urgent,
    )


def build_prompts(events: DataFrame, style: str | None = None, profile: str = "v2") -> DataFrame:
    """Add ``prompt_style`` and ``prompt``.

    Styles of v2: few_shot, chain, fast; chosen by severity when not given. v1 has one layout.
    """
    _profile(profile)
    if profile == "v1":
        prompt = F.concat(
            F.lit(X.ROLE_LINE + X.EXAMPLE_V1), _event_block(events, X.URGENCY_V1),
            F.lit("\n" + X.ANSWER_FORMAT_V1),
        )
        return events.withColumn("prompt_style", F.lit("v1")).withColumn("prompt", prompt)
    chosen = F.lit(style) if style else prompt_style()
    block = F.col("_block")
    closing = F.lit("\n" + X.ANSWER_FORMAT_V2)
    prompt = (
        F.when(
            F.col("prompt_style") == "few_shot",
            F.concat(F.lit(X.ROLE_LINE + X.EXAMPLES_V2), block, F.lit(X.ANSWER_FORMAT_V2)),
        )
        .when(F.col("prompt_style") == "chain", F.concat(F.lit(X.CHAIN_OPENING), block, closing))
        .otherwise(F.concat(F.lit(X.FAST_OPENING), block, closing))
    )
    return (
        events.withColumn("prompt_style", chosen)
        .withColumn("_block", _event_block(events, X.URGENCY_V2))
        .withColumn("prompt", prompt)
        .drop("_block")
    )


def ingest_answers(answers: DataFrame, text_col: str = "answer", profile: str = "v1") -> DataFrame:
    """Parse answer texts: code fences are stripped; a text that is no JSON object becomes a text row."""
    _profile(profile)
    fallback = X.TEXT_FALLBACK[profile]
    raw = F.col(text_col)
    fenced = F.split(raw, "```")[1]
    body = F.when(raw.contains("```"), F.regexp_replace(fenced, r"^json", "")).otherwise(raw)
    # In brackets, two objects in a row are no valid array, and one object is one element.
    parsed = F.from_json(F.concat(F.lit("["), F.col("_body"), F.lit("]")), _ANSWER_TYPE, {"allowSingleQuotes": "false"})
    table = answers.withColumn("_body", strip_space(body)).withColumn(
        "_found", F.when(F.col("_body").like("{%}"), parsed)
    )
    table = table.withColumn("_p", F.when(F.size("_found") == 1, F.get("_found", F.lit(0))))
    valid = F.col("_p").isNotNull()
    listed = F.from_json("_p.recommendations", "array<string>")
    single = F.when(F.col("_p.recommendations").isNotNull(), F.array("_p.recommendations"))
    read = {name: F.col(f"_p.{name}") for name in _RESULT_FIELDS}
    read["recommendations"] = F.when(F.col("_p.recommendations").startswith("["), listed).otherwise(single)
    read["false_positive_probability"] = F.col("_p.false_positive_probability").try_cast("double")
    missing = {
        "threat_type": F.lit(X.FALLBACK_THREAT),
        "explanation": F.substring(raw, 1, fallback["explanation_length"]),
        "attacker_intent": F.lit(fallback["attacker_intent"]),
        "risk": F.lit(X.FALLBACK_RISK),
        "recommendations": F.array(F.lit(fallback["recommendation"])),
        "false_positive_probability": F.lit(X.FALLBACK_PROBABILITY),
    }
    kept = [c for c in answers.columns if c not in _RESULT_FIELDS + ["source"]]
    return table.select(
        *kept,
        *[F.when(valid, read[name]).otherwise(missing[name]).alias(name) for name in _RESULT_FIELDS],
        F.when(valid, "model-json").otherwise("model-text").alias("answer_source"),
    )


def quality_rubric(results: DataFrame) -> DataFrame:
    """Add ``quality_score`` (at most 90), ``grade`` and the list of ``issues``."""
    probability = F.col("false_positive_probability")
    n_recommendations = F.coalesce(F.size("recommendations"), F.lit(0))
    n_recommendations = F.when(F.col("recommendations").isNull(), 0).otherwise(n_recommendations)
    present = {
        "threat_type": F.coalesce(F.col("threat_type") != "", F.lit(False)),
        "explanation": F.coalesce(F.col("explanation") != "", F.lit(False)),
        "attacker_intent": F.coalesce(F.col("attacker_intent") != "", F.lit(False)),
        "risk": F.coalesce(F.col("risk") != "", F.lit(False)),
        "recommendations": n_recommendations > 0,
        "false_positive_probability": F.coalesce(probability != 0, F.lit(False)),
    }
    long_text = F.char_length(F.coalesce("explanation", F.lit(""))) > 100
    three = n_recommendations >= 3
    valid = F.coalesce((probability >= 0.0) & (probability <= 1.0), F.lit(False))
    threat = F.coalesce("threat_type", F.lit(""))
    specific = (F.char_length(threat) > 5) & (threat != X.FALLBACK_THREAT)

    def points(condition: Column, value: int) -> Column:
        return F.when(condition, value).otherwise(0)

    score = points(long_text, 10) + points(three, 10) + points(valid, 5) + points(specific, 5)
    for name in X.RUBRIC_FIELDS:
        score = score + points(present[name], 10)
    issues = [F.when(~present[name], f"Missing field: {name}") for name in X.RUBRIC_FIELDS] + [
        F.when(~long_text, "Explanation too short"),
        F.when(
            ~three,
            F.concat(F.lit("Only "), n_recommendations.cast("string"), F.lit(" recommendations (need 3)")),
        ),
        F.when(~valid, "Invalid FP probability"),
        F.when(~specific, "Generic threat type"),
    ]
    grade = None
    for letter, limit in X.GRADES:
        hit = F.col("quality_score") >= limit
        grade = F.when(hit, letter) if grade is None else grade.when(hit, letter)
    return (
        results.withColumn("quality_score", score)
        .withColumn("grade", grade.otherwise("D"))
        .withColumn("issues", F.array_compact(F.array(*issues)))
    )


def quality_report(scored: DataFrame) -> DataFrame:
    """Mean score, grade A and B counts, latency percentiles and requests answered from the cache."""
    slow = scored.filter(F.col("latency_ms") > 0)
    percentiles = index_percentiles(slow, "latency_ms")
    return scored.agg(
        F.count("*").alias("n_analyses"),
        F.round(F.avg("quality_score"), 1).alias("mean_quality"),
        F.count_if(F.col("quality_score") >= 90).alias("grade_a"),
        F.count_if((F.col("quality_score") >= 75) & (F.col("quality_score") < 90)).alias("grade_b"),
        F.count_if(F.coalesce(F.col("latency_ms"), F.lit(0)) <= 0).alias("cache_saves"),
    ).select(
        "*",
        percentiles.select("p50").scalar().alias("latency_p50"),
        percentiles.select("p95").scalar().alias("latency_p95"),
    )


def triage_rows(scored: DataFrame) -> DataFrame:
    """Flat result rows for the report sink."""
    return scored.select(
        F.substring("message", 1, 80).alias("event"),
        "severity",
        F.col("technique_id").alias("technique"),
        "threat_type",
        F.col("quality_score").alias("quality"),
        "grade",
        "source",
        "latency_ms",
        F.col("false_positive_probability").alias("fp_prob"),
    )
