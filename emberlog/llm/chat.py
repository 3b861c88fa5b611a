"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold a conversation again and again while it grows. Every turn gets the hash of the turns
up to it (exclusive-or of position-bound turn hashes, so it rolls); a conversation whose full hash is a
shorter prefix hash of another one is dropped by an anti join, equal conversations collapse to the one with
the smallest id, and what is left is rendered.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.session import stage

#: Turn numbers per block; prefixes roll inside a block and over the blocks of a conversation.
BLOCK_TURNS = 256
#: Turns per rendered row; longer conversations give several parts.
PART_TURNS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

_KEYS = ["_conv", "_block"]


def _on_block(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnRenamed("_conv", "_conv2").withColumnRenamed("_block", "_block2")
    same = F.col("_conv").eqNullSafe(F.col("_conv2")) & (F.col("_block") == F.col("_block2"))
    return left.join(right, same).drop("_conv2", "_block2")


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """_conv, _pos (from 1), _turns, _role, _text and the rolling hashes _h1, _h2 of every turn.

    Repeated rows count once. Turns of equal number are ordered by role, then text; a null number is first,
    null role and text are empty; a null id is an id of its own. Extra columns are not read.
    """
    clean = turns.select(
        F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"),
        F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"),
        F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS).cast("long"), F.lit(-(1 << 62))).alias("_block"),
    ).distinct()
    inside = Window.partitionBy(*_KEYS).orderBy(F.col("_turn").asc_nulls_first(), "_role", "_text")
    local = clean.withColumn("_local", F.row_number().over(inside))
    before = Window.partitionBy("_conv").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        clean.groupBy(*_KEYS)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_turns", F.sum("_n").over(Window.partitionBy("_conv")))
        .drop("_n")
    )
    placed = _on_block(local, counts).withColumn("_pos", F.col("_before") + F.col("_local"))
    for i in (1, 2):
        placed = placed.withColumn(f"_t{i}", F.xxhash64(F.lit(i), "_pos", F.length("_role"), "_role", "_text"))
    placed = stage(placed.drop("_before", "_local"), "chat-turns")
    rolled = Window.partitionBy(*_KEYS).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy(*_KEYS).agg(F.bit_xor("_t1").alias("_b1"), F.bit_xor("_t2").alias("_b2"))
    for i in (1, 2):
        totals = totals.withColumn(f"_o{i}", F.coalesce(F.bit_xor(f"_b{i}").over(before), F.lit(0)))
        placed = placed.withColumn(f"_r{i}", F.bit_xor(f"_t{i}").over(rolled))
    joined = _on_block(placed, totals.drop("_b1", "_b2"))
    return joined.select(
        "_conv", "_pos", "_turns", "_role", "_text",
        *[F.col(f"_r{i}").bitwiseXOR(F.col(f"_o{i}")).alias(f"_h{i}") for i in (1, 2)],
    )


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """_conv, _turns and n_copies of the conversations that are no prefix of a longer one.

    Equal conversations count as one, with the smallest id.
    """
    whole = prefixes.filter(F.col("_pos") == F.col("_turns"))
    finals = whole.groupBy("_turns", "_h1", "_h2").agg(
        F.min("_conv").alias("_conv"), F.count(F.lit(1)).alias("n_copies")
    )
    shorter = prefixes.filter(F.col("_pos") < F.col("_turns"))
    keys = shorter.select(F.col("_pos").alias("_turns"), "_h1", "_h2").distinct()
    return finals.join(keys, ["_turns", "_h1", "_h2"], "left_anti").select("_conv", "_turns", "n_copies")


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn in the chat template; its own markers in a text are broken up."""
    safe = F.replace(text, F.lit("<|im_"), F.lit("<| im_"))
    return F.concat(F.lit(OPEN), role, F.lit("\n"), safe, F.lit(CLOSE + "\n"))


def format_chats(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, part, n_turns, n_copies, text: the maximal conversations, rendered.

    A part has at most ``part_turns`` turns, so no row gathers an unbounded conversation; the parts of a
    conversation, joined in order, are its full text. An empty table gives an empty result.
    """
    prefixes = stage(turn_prefixes(turns), "chat-prefixes")
    kept = maximal_conversations(prefixes).withColumnRenamed("_conv", "_kept").withColumnRenamed("_turns", "n_turns")
    part = F.floor((F.col("_pos") - 1) / part_turns).cast("int")
    return (
        prefixes.join(kept, F.col("_conv").eqNullSafe(F.col("_kept")))
        .select(F.col("_conv").alias("conv_id"), part.alias("part"), "n_turns", "n_copies", "_pos",
                rendered_turn(F.col("_role"), F.col("_text")).alias("_text"))
        .groupBy("conv_id", "part", "n_turns", "n_copies")
        .agg(F.sort_array(F.collect_list(F.struct("_pos", "_text"))).alias("_parts"))
        .select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.col("_parts._text"), "").alias("text"))
    )


CHAT_SQL = f"""
WITH clean AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), placed AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w AS prefix
  FROM clean WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), finals AS (
  SELECT min(conv_id) AS conv_id, n, count(*) AS n_copies FROM placed WHERE pos = n
  AND prefix NOT IN (SELECT prefix FROM placed WHERE pos < n) GROUP BY prefix, n
)
SELECT p.conv_id, CAST((p.pos - 1) // {PART_TURNS} AS INTEGER) AS part, f.n AS n_turns, f.n_copies,
  string_agg('{OPEN}' || p.role || chr(10) || replace(p.text, '<|im_', '<| im_') || '{CLOSE}' || chr(10), ''
             ORDER BY p.pos) AS text
FROM placed p JOIN finals f ON p.conv_id IS NOT DISTINCT FROM f.conv_id
GROUP BY p.conv_id, (p.pos - 1) // {PART_TURNS}, f.n, f.n_copies
"""
