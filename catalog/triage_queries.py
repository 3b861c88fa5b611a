"""Triage and prompt data over the given tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import base
from catalog.duck_base import any_word, over, text
from catalog.registry import query
from emberlog.constants import triage_text as X
from emberlog.operators import triage as T
from emberlog.session import new_stage_path, stage
from emberlog.sources.answers import answer_batch, batch_report


def _branch(cascade, lowered: str, score: str) -> str:
    whens = []
    for i, verdict in enumerate(cascade[:-1]):
        condition = any_word(lowered, verdict.words) if verdict.words else f"{score} >= {X.ANOMALY_SCORE}"
        whens.append(f"WHEN {condition} THEN {i}")
    return f"CASE {' '.join(whens)} ELSE {len(cascade) - 1} END"


def _by_branch(cascade, value) -> str:
    return "CASE b " + " ".join(f"WHEN {i} THEN {value(v)}" for i, v in enumerate(cascade)) + " END"


def _filled(expr: str) -> str:
    return f"replace(replace({expr}, '{{ip}}', source_ip), '{{score}}', printf('%.2f', anomaly_score))"


def _triage(cascade, source: str, keys: str) -> str:
    """SELECT with all answer columns over a source with message, source_ip and anomaly_score."""
    return f"""SELECT {keys}, {_by_branch(cascade, lambda v: text(v.threat_type))} AS threat_type,
      {_filled(_by_branch(cascade, lambda v: text(v.explanation)))} AS explanation,
      {_by_branch(cascade, lambda v: text(v.attacker_intent))} AS attacker_intent,
      {_by_branch(cascade, lambda v: text(v.risk))} AS risk,
      {_filled(_by_branch(cascade, lambda v: text(' | '.join(v.recommendations))))} AS recommendations,
      {_by_branch(cascade, lambda v: str(len(v.recommendations)))} AS n_recommendations,
      CAST({_by_branch(cascade, lambda v: str(v.false_positive_probability))} AS DOUBLE) AS false_positive_probability
    FROM (SELECT *, {_branch(cascade, 'lower(message)', 'anomaly_score')} AS b FROM {source})"""


_COLUMNS = ["threat_type", "explanation", "attacker_intent", "risk"]


def _flat(df, *keys):
    return df.select(
        *keys, *_COLUMNS, F.array_join("recommendations", " | ").alias("recommendations"),
        F.size("recommendations").alias("n_recommendations"), "false_positive_probability",
    )


@query("triage_v1", over("events", _triage(X.CASCADE_V1, "ev", "id")))
def triage_v1(spark, sf):
    return _flat(T.triage(base.stored_events(spark, sf), "v1"), "id")


@query("triage_v2", over("events", _triage(X.CASCADE_V2, "ev", "id, 'rule-based' AS prompt_style")))
def triage_v2(spark, sf):
    return _flat(T.triage(base.stored_events(spark, sf), "v2"), "id", "prompt_style")


_TURNS = (
    "(SELECT conv_id, turn, text AS message, 'unknown' AS source_ip, turn / 10.0::DOUBLE AS anomaly_score FROM conversations)"
)


@query("triage_conversations", _triage(X.CASCADE_V1, _TURNS, "conv_id, turn"))
def triage_conversations(spark, sf):
    turns = base.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("text").alias("message"), F.lit("unknown").alias("source_ip"),
        (F.col("turn") / 10.0).alias("anomaly_score"),
    )
    return _flat(T.triage(turns, "v1"), "conv_id", "turn")


KEY_V1 = "md5(coalesce(technique_id, 'NONE') || '|' || severity || '|' || substr(message, 1, 60))"
KEY_V2 = "md5(coalesce(technique_id, '') || '_' || severity || '_' || source_ip || '_' || substr(message, 1, 50))"


@query("enrichment_keys", over("events", f"SELECT id, {KEY_V1} AS key_v1, {KEY_V2} AS key_v2 FROM ev"))
def enrichment_keys(spark, sf):
    return base.stored_events(spark, sf).select(
        "id", T.enrichment_key("v1").alias("key_v1"), T.enrichment_key("v2").alias("key_v2")
    )


@query("distinct_requests", over(
    "events",
    f"SELECT cache_key, n_events, id, severity, source_ip FROM (SELECT *, {KEY_V1} AS cache_key, "
    f"count(*) OVER (PARTITION BY {KEY_V1}) AS n_events, row_number() OVER (PARTITION BY {KEY_V1} ORDER BY id) AS rn FROM ev) WHERE rn = 1",
))
def distinct_requests(spark, sf):
    rows = T.distinct_requests(base.stored_events(spark, sf), "v1")
    return rows.select("cache_key", "n_events", "id", "severity", "source_ip")


@query("cache_report", over(
    "events",
    f"SELECT count(*) AS requests, count(DISTINCT {KEY_V2}) AS distinct_keys, "
    f"round(1 - count(DISTINCT {KEY_V2}) / count(*), 4) AS hit_rate FROM ev",
))
def cache_report(spark, sf):
    return T.cache_report(base.stored_events(spark, sf), "v2")


# Three batches in the order of the ids.
_THIRDS = f"""asked AS MATERIALIZED (SELECT *, CAST((id - 1) * 3 // (SELECT max(id) FROM ev) AS BIGINT) AS batch, {KEY_V1} AS cache_key FROM ev),
firsts AS MATERIALIZED (SELECT cache_key, min(batch) AS first_batch, min(id) AS first_id FROM asked GROUP BY 1)"""


def _answer(requests):
    """The rule cascade stands for the slow step."""
    return T.triage(requests, "v1").select("cache_key", *_COLUMNS, "source", "latency_ms")


def _answered_thirds(spark, sf, retried):
    """The answered batches of the three thirds of the events; those in ``retried`` are answered twice."""
    events = base.stored_events(spark, sf)
    last = events.agg(F.max("id")).scalar()
    events = stage(events.withColumn("third", F.floor((F.col("id") - 1) * 3 / last)), "thirds")
    path = new_stage_path(spark, "answers")
    for number in range(3):
        rows = events.filter(F.col("third") == number)
        for _ in range(2 if number in retried else 1):
            answered = answer_batch(rows, path, number, _answer)
        yield number, answered


@query("answered_batches", over(
    "events",
    "SELECT batch, count(*) AS requests, count(*) FILTER (id = first_id) AS asked, count(*) FILTER (id <> first_id) AS hits, "
    "round(count(*) FILTER (id <> first_id) / count(*), 4) AS hit_rate FROM asked JOIN firsts USING (cache_key) GROUP BY batch",
    _THIRDS,
))
def answered_batches(spark, sf):
    """Hits per batch: a later batch asks only keys that no earlier one has; the second batch is retried."""
    reports = [
        batch_report(rows).withColumn("batch", F.lit(n).cast("long")) for n, rows in _answered_thirds(spark, sf, {1})
    ]
    return reduce(DataFrame.unionByName, reports)


@query("answered_events", over(
    "events",
    "SELECT e.id, e.batch, e.cache_key, f.first_id AS asked_by, e.id <> f.first_id AS cached, a.threat_type, a.explanation, "
    "'rule-based' || CASE WHEN e.id <> f.first_id THEN ' [cached]' ELSE '' END AS source "
    f"FROM asked e JOIN firsts f USING (cache_key) JOIN ({_triage(X.CASCADE_V1, 'ev', 'id')}) a ON a.id = f.first_id",
    _THIRDS,
))
def answered_events(spark, sf):
    """Every event with the answer that its key got when it was first asked."""
    batches = [
        rows.select("id", F.col("third").alias("batch"), "cache_key", "asked_by", "cached", "threat_type", "explanation", "source")
        for _, rows in _answered_thirds(spark, sf, {0})
    ]
    return reduce(DataFrame.unionByName, batches)


@query("attached_answers", over(
    "events",
    f"SELECT e.id, a.n_events, a.first_id FROM (SELECT id, {KEY_V1} AS k FROM ev) e "
    f"JOIN (SELECT {KEY_V1} AS k, count(*) AS n_events, min(id) AS first_id FROM ev GROUP BY 1) a USING (k)",
))
def attached_answers(spark, sf):
    events = base.stored_events(spark, sf)
    answers = T.distinct_requests(events, "v1").select("cache_key", "n_events", F.col("id").alias("first_id"))
    return T.attach_answers(events, answers, "v1").select("id", "n_events", "first_id")


def _block(urgency: dict) -> str:
    urgent = "CASE severity " + " ".join(f"WHEN '{k}' THEN {text(v)}" for k, v in urgency.items()) + " ELSE '' END"
    nl = "chr(10)"
    return (
        f"{nl} || 'Security Event:' || {nl} || '- Message      : ' || message || {nl} || '- Severity     : ' || severity || {nl} "
        f"|| '- Source IP    : ' || source_ip || {nl} || '- Anomaly Score: ' || printf('%.2f', anomaly_score) || ' / 1.0' || {nl} "
        f"|| '- MITRE Technique: ' || coalesce(technique_id, 'not identified') || {nl} "
        f"|| '- MITRE Tactic   : ' || coalesce(tactic, 'not identified') || {nl} || {urgent}"
    )


_PROMPT_V1 = f"{text(X.ROLE_LINE + X.EXAMPLE_V1)} || {_block(X.URGENCY_V1)} || chr(10) || {text(X.ANSWER_FORMAT_V1)}"
_FEW = f"{text(X.ROLE_LINE + X.EXAMPLES_V2)} || {_block(X.URGENCY_V2)} || {text(X.ANSWER_FORMAT_V2)}"
_FAST = f"{text(X.FAST_OPENING)} || {_block(X.URGENCY_V2)} || chr(10) || {text(X.ANSWER_FORMAT_V2)}"
_CHAIN = f"{text(X.CHAIN_OPENING)} || {_block(X.URGENCY_V2)} || chr(10) || {text(X.ANSWER_FORMAT_V2)}"


@query("prompts_by_severity", over(
    "events",
    "SELECT id, prompt_style, md5(prompt) AS prompt_md5, length(prompt) AS prompt_length FROM ("
    "SELECT id, CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'few_shot' ELSE 'fast' END AS prompt_style, "
    f"CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN {_FEW} ELSE {_FAST} END AS prompt FROM ev)",
))
def prompts_by_severity(spark, sf):
    return T.build_prompts(base.stored_events(spark, sf)).select(
        "id", "prompt_style", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_length")
    )


@query("chain_prompts", over("events", f"SELECT id, md5({_CHAIN}) AS prompt_md5 FROM ev"))
def chain_prompts(spark, sf):
    return T.build_prompts(base.stored_events(spark, sf), "chain").select("id", F.md5("prompt").alias("prompt_md5"))


@query("v1_prompts", over("events", f"SELECT id, md5({_PROMPT_V1}) AS prompt_md5 FROM ev"))
def v1_prompts(spark, sf):
    return T.build_prompts(base.stored_events(spark, sf), profile="v1").select("id", F.md5("prompt").alias("prompt_md5"))


# Answer texts built from the conversations: plain JSON, fenced JSON, or the text as it is.
_ANSWERS = """
SELECT conv_id, turn, text, CASE turn % 3
  WHEN 0 THEN '{"threat_type":"Type ' || CAST(conv_id AS STRING) || '","explanation":"n ' || CAST(length(text) AS STRING)
    || '","attacker_intent":"i","risk":"r","recommendations":["a","b","c"],"false_positive_probability":0.' || CAST(turn % 10 AS STRING) || '}'
  WHEN 1 THEN 'Here it is: ```json' || chr(10) || '{"threat_type":"Fenced","explanation":"' || repeat('x', 90 + length(text) % 20)
    || '","risk":"","recommendations":["a"],"false_positive_probability":2.5}' || chr(10) || '``` done'
  ELSE text END AS answer FROM {conversations}
"""
_DUCK_ANSWERS = _ANSWERS.replace("{conversations}", "conversations")


def _answers(spark, sf):
    base.table(spark, sf, "conversations").createOrReplaceTempView("emberlog_given_conversations")
    return spark.sql(_ANSWERS.replace("{conversations}", "emberlog_given_conversations"))


_INGESTED = f"""
SELECT conv_id, turn, kind <> 2 AS valid,
  CASE kind WHEN 0 THEN 'Type ' || conv_id WHEN 1 THEN 'Fenced' ELSE 'AI Analysis' END AS threat_type,
  CASE kind WHEN 0 THEN 'n ' || length(text) WHEN 1 THEN repeat('x', CAST(90 + length(text) % 20 AS INT)) ELSE substr(text, 1, 250) END AS explanation,
  CASE kind WHEN 0 THEN 'i' WHEN 1 THEN NULL ELSE 'See explanation above' END AS attacker_intent,
  CASE kind WHEN 0 THEN 'r' WHEN 1 THEN '' ELSE 'Review manually' END AS risk,
  CASE kind WHEN 0 THEN 'a,b,c' WHEN 1 THEN 'a' ELSE 'Investigate this event immediately' END AS recommendations,
  CASE kind WHEN 0 THEN (turn % 10) / 10.0::DOUBLE WHEN 1 THEN 2.5 ELSE 0.1 END AS false_positive_probability
FROM (SELECT *, turn % 3 AS kind FROM ({_DUCK_ANSWERS}))"""


@query("ingest_answers", _INGESTED)
def ingest_answers(spark, sf):
    rows = T.ingest_answers(_answers(spark, sf))
    return rows.select(
        "conv_id", "turn", (F.col("answer_source") == "model-json").alias("valid"), "threat_type", "explanation",
        "attacker_intent", "risk", F.array_join("recommendations", ",").alias("recommendations"),
        "false_positive_probability",
    )


def _points(condition: str, value: int) -> str:
    return f"CASE WHEN {condition} THEN {value} ELSE 0 END"


_N_RECS = "(length(recommendations) - length(replace(recommendations, ',', '')) + 1)"
_SCORE = " + ".join((
    _points("threat_type <> ''", 10), _points("explanation <> ''", 10), _points("coalesce(attacker_intent, '') <> ''", 10),
    _points("risk <> ''", 10), _points("recommendations <> ''", 10), _points("false_positive_probability <> 0", 10),
    _points("length(explanation) > 100", 10), _points(f"{_N_RECS} >= 3", 10),
    _points("false_positive_probability BETWEEN 0 AND 1", 5),
    _points("length(threat_type) > 5 AND threat_type <> 'AI Analysis'", 5),
))
_ISSUES = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN NOT ({ok}) THEN {message} END" for ok, message in (
        ("threat_type <> ''", "'Missing field: threat_type'"),
        ("explanation <> ''", "'Missing field: explanation'"),
        ("coalesce(attacker_intent, '') <> ''", "'Missing field: attacker_intent'"),
        ("risk <> ''", "'Missing field: risk'"),
        ("recommendations <> ''", "'Missing field: recommendations'"),
        ("false_positive_probability <> 0", "'Missing field: false_positive_probability'"),
        ("length(explanation) > 100", "'Explanation too short'"),
        (f"{_N_RECS} >= 3", f"'Only ' || {_N_RECS} || ' recommendations (need 3)'"),
        ("false_positive_probability BETWEEN 0 AND 1", "'Invalid FP probability'"),
        ("length(threat_type) > 5 AND threat_type <> 'AI Analysis'", "'Generic threat type'"),
    )
) + "], lambda x: x IS NOT NULL), '; ')"
_RUBRIC = f"""SELECT *, CASE WHEN quality_score >= 90 THEN 'A' WHEN quality_score >= 75 THEN 'B'
    WHEN quality_score >= 60 THEN 'C' ELSE 'D' END AS grade
  FROM (SELECT conv_id, turn, {_SCORE} AS quality_score, {_ISSUES} AS issues FROM ({_INGESTED}))"""


def _scored(spark, sf):
    return T.quality_rubric(T.ingest_answers(_answers(spark, sf)))


@query("quality_rubric", _RUBRIC)
def quality_rubric(spark, sf):
    return _scored(spark, sf).select(
        "conv_id", "turn", "quality_score", "grade", F.array_join("issues", "; ").alias("issues")
    )


_LATENCY = "conv_id * 37 % 1900"


@query("quality_report", f"""
    WITH scored AS (SELECT *, {_LATENCY} AS latency_ms FROM ({_RUBRIC})),
    slow AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS rn, count(*) OVER () AS n FROM scored WHERE latency_ms > 0)
    SELECT count(*) AS n_analyses, round(avg(quality_score), 1) AS mean_quality,
      count(*) FILTER (quality_score >= 90) AS grade_a, count(*) FILTER (quality_score >= 75 AND quality_score < 90) AS grade_b,
      count(*) FILTER (latency_ms <= 0) AS cache_saves,
      (SELECT max(latency_ms) FROM slow WHERE rn = n // 2) AS latency_p50,
      (SELECT max(latency_ms) FROM slow WHERE rn = least(CAST(floor(n * 0.95) AS BIGINT), n - 1)) AS latency_p95
    FROM scored""")
def quality_report(spark, sf):
    return T.quality_report(_scored(spark, sf).withColumn("latency_ms", F.expr(_LATENCY)))


@query("triage_rows", over(
    "events",
    "SELECT substr(message, 1, 80) AS event, severity, technique_id AS technique, threat_type, "
    "60 - CASE WHEN n_recommendations > 0 THEN 0 ELSE 10 END + CASE WHEN length(explanation) > 100 THEN 10 ELSE 0 END "
    "+ CASE WHEN n_recommendations >= 3 THEN 10 ELSE 0 END + 10 AS quality, false_positive_probability AS fp_prob "
    f"FROM ({_triage(X.CASCADE_V2, 'ev', 'message, severity, technique_id')})",
))
def triage_rows(spark, sf):
    rows = T.triage_rows(T.quality_rubric(T.triage(base.stored_events(spark, sf), "v2")))
    return rows.select("event", "severity", "technique", "threat_type", "quality", "fp_prob")
