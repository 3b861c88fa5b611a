"""Personal data against plain expressions, and what the patterns learn."""

import os

import brute
import pytest
from conftest import SF_DIR
from hypothesis import given, settings
from hypothesis import strategies as st

from emberlog.llm import pii

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

CARD = "4000000000000002"
TEXTS = [
    "a@b.c@d.e a@b x@y.z_q@r.s .@-.- a@b.c.", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.0255 1.1.1.256.9.9.9.9 é1.2.3.4",
    f"{CARD} {CARD[:4]}-{CARD[4:8]} {CARD[8:]} x", f"{CARD}x{CARD}  {CARD}-{CARD}", f"{CARD}0000 1{CARD}",
    "+1 (743) 555-3824 +123 +12345678( +1234567890123456 ++12 34 56 78 +1.2.3.4.5.6.7.8", "0" * 16 + " " + "0" * 19,
    "9 " * 5000, "1.2.3.4 " * 400, "a@b.cc " * 300, "x" * 5000 + "@y.z", "+1" * 400,
]


def _same(frame):
    rows = frame.select("doc_id", "text").collect()
    got = pii.private_report(frame).collect()
    want = sorted((str(i), brute.sha_of_spans(brute.private(t)), *(sum(k == x for x, *_ in brute.private(t)) for k in pii.KINDS[:4])) for i, t in rows)
    assert sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want
    return got


def test_base_spans(spark, docs, edge, no_rows):
    for frame in (docs, edge, spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")):
        _same(frame)
    assert pii.private_report(no_rows).count() == 0


def test_random_texts(spark):
    texts = []

    @given(st.text("0123.45@- +()a\né", max_size=60), st.text("4 -0", max_size=40))
    @settings(max_examples=400, deadline=None)
    def some(text, more):
        texts.append(text + more)

    some()
    _same(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"some words here card {int(CARD) + 0 * i} then {i} more") for i in range(3)]
    valid = [str(4 * 10**15 + 7 * k) for k in range(4000)]
    valid = [v for v in valid if brute.luhn(v)][:40]
    rows = [(i, f"words before, card {v} and words after") for i, v in enumerate(valid)]
    rows += [(900, "words before, card 4000000000000003 and more"), (901, "version 12345678 of the tool"), (902, "clean text only")]
    got = {r.doc_id: r for r in _same(spark.createDataFrame(rows, "doc_id bigint, text string"))}
    assert got[900].spans == "learned:19:35" and got[900].n_card == 0
    assert got[901].spans == "" and got[902].spans == ""


OTHER = ["4000-000000-00002", "0171-5551234", "DE89370400440532013000", "123-45-6789", "jane_doe"]


def test_patterns_reach_other_shapes(spark):
    cards = [v for v in (str(4 * 10**15 + 7 * k) for k in range(4000)) if brute.luhn(v)][:80]
    rows = [(i, f"words {i} before, card {v} for words {i} after") for i, v in enumerate(cards)]
    rows += [(900 + i, f"other words, card {token} and more") for i, token in enumerate(OTHER)]
    rows += [(950 + i, f"version {token} of the tool") for i, token in enumerate(OTHER)]
    got = {r.doc_id: r for r in _same(spark.createDataFrame(rows, "doc_id bigint, text string"))}
    for i, token in enumerate(OTHER):
        assert got[900 + i].spans == f"learned:18:{18 + len(token)}" and got[950 + i].spans == ""


def test_contexts_around_whole_spans(spark):
    phones = [f"+1 (743) 555-{3000 + k}" for k in range(40)]
    rows = [(i, f"words {i} x call {p} y{i} or more") for i, p in enumerate(phones)]
    cards = [v for v in (str(4 * 10**15 + 7 * k) for k in range(4000)) if brute.luhn(v)][:40]
    rows += [(100 + i, f"words, card {v[:4]} {v[4:8]} {v[8:12]} {v[12:]} y{i} more") for i, v in enumerate(cards)]
    rows += [(900, "please call 0171-5551234 or"), (901, "your card 4000 0000 0000 0003 x"), (902, "dial 0171-5551234 so")]
    rows += [(910 + i, f"from host10.net {p} done") for i, p in enumerate(phones)]
    rows += [(990, "via host10.net 0171-5551299 x")]
    got = {r.doc_id: r for r in _same(spark.createDataFrame(rows, "doc_id bigint, text string"))}
    assert [got[i].spans for i in (900, 901, 902)] == ["learned:12:24", "learned:10:29", ""]
    assert got[990].spans == "learned:15:27"
