"""The prefix trie against brute force and SQL."""

import os
import random

import brute
import pytest
from compare import connect, differences
from conftest import SF_DIR

from emberlog.llm import catalog, turn_trie

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, _conv string, n1 string, depth string, _row string"


def _same(spark, rows):
    frame = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)
    got = sorted(map(tuple, turn_trie.prefix_trie(frame).collect()), key=str)
    assert got == sorted(brute.trie(rows), key=str)


def test_equals_sql(spark):
    name = "op13_turn_bitmaps"
    assert differences(catalog.QUERIES[name](spark, SF_DIR), connect(SF_DIR), catalog.SQL[name]) == ""


def test_nulls_ties_repeats_and_a_busy_conversation(spark):
    rng = random.Random(3)
    rows = [
        (rng.choice([None, *range(40)]) if rng.random() < 0.7 else 7, rng.choice([None, 1, 2, 3, 700, 9000]),
         rng.choice(["u", None, "a"]), rng.choice(["x", "y", None, "", "\u00e9", "long " * 2000]))
        for _ in range(2500)
    ]
    _same(spark, rows)


def test_long_common_beginnings(spark, monkeypatch):
    """Conversations that share many turns, over several blocks of positions and conversations, many of them equal."""
    monkeypatch.setattr(turn_trie, "POSITIONS", 4)
    monkeypatch.setattr(turn_trie, "CONVERSATIONS", 8)
    monkeypatch.setattr(turn_trie, "CUT", 4)
    rng, rows = random.Random(5), []
    for c in range(60):
        length, split = rng.choice([0, 1, 8, 20, 21]), rng.choice([3, 9, 30])
        rows += [(c * 3, t, "u" if t % 2 else "a", f"t{t}" if t < split else f"s{t}-{c % 3}") for t in range(length)]
    _same(spark, rows)


def test_no_rows(spark):
    assert turn_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert turn_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", "", "", "", "")], SCHEMA)).count() == 0
