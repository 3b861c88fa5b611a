"""Mixing, secrets, packing, quality, chat and sharding against plain Python, with edge rows."""

import hashlib
import os
import zlib
from collections import defaultdict

import brute
import numpy as np
import pytest
from compare import connect, differences
from conftest import SF_DIR
from hypothesis import given, settings
from hypothesis import strategies as st

from emberlog.llm import catalog, chat, mixing, packing, quality, scan, sharding

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    assert differences(catalog.QUERIES[name](spark, SF_DIR), connect(SF_DIR), catalog.SQL[name]) == ""


def _shards_hold(frame, n):
    rows = frame.collect()
    assert len(rows) == n
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    if n:
        sizes = [len(by.get(k, [])) for k in range(8)]
        assert max(sizes) - min(sizes) <= 1
    return rows


def test_shards(docs, edge, no_rows):
    first = _shards_hold(sharding.document_shards(docs), docs.count())
    again = _shards_hold(sharding.document_shards(docs.repartition(3)), docs.count())
    key = lambda r: (r.doc_id, r.shard, r.slot)
    assert sorted(map(key, first)) == sorted(map(key, again))
    for r in _shards_hold(sharding.document_shards(edge), edge.count()):
        assert r.size >= 1 and r.law == "rows" and r.grown_shard is None
    _shards_hold(sharding.document_shards(no_rows), 0)
    texts = dict(docs.select("doc_id", "text").collect())
    assert all(r.text_crc32 == brute.crc(texts[r.doc_id]) and r.size == len((texts[r.doc_id] or "").encode()) + 1 for r in first)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 4097])
def test_feistel_is_a_permutation(spark, n):
    from pyspark.sql import functions as F

    places = [r[0] for r in spark.range(n).select(sharding.feistel_place(F.col("id"), n, 7)).collect()]
    assert sorted(places) == list(range(n))


def _mixture(frame, docs):
    rows = frame.collect()
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += len(brute.words(r.text))
    want = brute.targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r.size and r.taken == r.size * r.copies
    return rows


def test_mixture(docs, edge, no_rows):
    rows = _mixture(mixing.mixture_plan(docs), docs.collect())
    assert sorted(r.taken for r in rows) == sorted(r.taken for r in mixing.mixture_plan(docs.repartition(5)).collect())
    assert len(_mixture(mixing.mixture_plan(edge), edge.collect())) == edge.count()
    assert mixing.mixture_plan(no_rows).count() == 0
    copies = sum(r.copies for r in rows)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == copies
    assert mixing.mix_documents(edge).columns == edge.columns and mixing.mix_documents(no_rows).count() == 0


def test_mixture_comes_near_its_targets(spark):
    docs = spark.range(40_000).selectExpr(
        "id as doc_id", "repeat('w ', cast(1 + id % 50 as int)) as text", "concat('s', id % 5) as source"
    )
    got = mixing.mixture_plan(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(r["sum(taken)"] == pytest.approx(r["max(target)"], rel=0.005) for r in got)
    few = docs.selectExpr("doc_id", "repeat('w ', cast(if(doc_id % 97 = 0, 900, 1 + doc_id % 9) as int)) as text",
                          "concat('s', doc_id % 20) as source").filter("doc_id < 10000")
    got = mixing.mixture_plan(few).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(r["sum(taken)"] == pytest.approx(r["max(target)"], rel=0.05) for r in got)


def test_mixing_leaves_columns_of_any_name_alone(spark):
    names = ["_draw", "_rate", "_of", "rate", "shift", "copies", "size"]
    docs = spark.createDataFrame([(1, "a b", "x", *names), (2, None, None, *names)], ["doc_id", "text", "source", *names])
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert {tuple(r)[3:] for r in mixed.collect()} == {tuple(names)}


TOKEN = "ghp_" + "a1B2" * 7 + "xy"
SECRETS = [
    "Password = 'abc_def' token: x1y2z3w4 SECRET=abc api_key:\"aaaaaa", "password=token=abcdef passwd=secret:abcdef",
    "ApiKey=1234567 apikey 123456 api__key=1234567", "AKIA" + "A" * 16 + "b AKIAAKIA" + "1" * 20 + " akia" + "A" * 20,
    "0123456789abcdef01234567 ABCDEF0123456789abcdef0123456789 é0123456789abcdef0123456é", "f" * 24 + "F" + "f" * 23,
    TOKEN + scan.crc_base62(TOKEN[4:]) + " " + TOKEN + "aaaaaa", "İ token=abcdef", "tokenTOKEN='secretpassword=1'",
]


@given(st.text("tokensecrpawdikyAKI_=:\"' 0af", max_size=80))
@settings(max_examples=300, deadline=None)
def test_secrets_of_any_text(text):
    words = scan.automaton() if not hasattr(test_secrets_of_any_text, "w") else test_secrets_of_any_text.w
    test_secrets_of_any_text.w = words
    got = [(scan.KINDS[k], a, b) for a, k, b, _ in scan.find_secrets(text, words) if k < 3]
    assert got == brute.secrets(text)


def test_secrets(spark, docs, edge, no_rows):
    odd = spark.createDataFrame([(i, t, "x") for i, t in enumerate(SECRETS)], "doc_id bigint, text string, spans string")
    for frame in (docs, edge, odd):
        texts = frame.select("doc_id", "text").collect()
        want = sorted((str(i), brute.sha_of_spans(brute.secrets(t))) for i, t in texts)
        assert sorted((str(r.doc_id), r.base_sha256) for r in scan.secret_report(frame).collect()) == want
    checked = {r.doc_id: r for r in scan.secret_report(odd).collect()}
    assert checked[6].n_checked == 1 and "checked:0:40" in checked[6].spans
    assert scan.secret_report(no_rows).count() == 0
    clean = scan.redact_secrets(odd)
    assert clean.columns == odd.columns
    assert scan.redact_secrets(edge).count() == edge.count()
    assert {r.doc_id: r.text for r in clean.collect()}[0] == "[SECRET]' [SECRET] SECRET=abc [SECRET]"


@given(st.text("ab \n\t'.é  s1", max_size=60))
@settings(max_examples=300, deadline=None)
def test_chunked_ids_equal_the_tokenizer(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = test_chunked_ids_equal_the_tokenizer
    if not hasattr(own, "made"):
        own.made = packing.Encoder(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert list(np.frombuffer(own.made[0].ids(text), "<u4")) == own.made[1].encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 256), max_size=200))
@settings(max_examples=60, deadline=None)
def test_differencing_deals_every_piece_once(lengths):
    parts = packing.deal(lengths)
    assert sorted(i for p in parts for i in p) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in p) <= 1024 for p in parts)


def test_packing(docs, edge, no_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for frame in (docs, edge):
        whole = defaultdict(int)
        for r in frame.collect():
            ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
            whole[r.doc_id, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())] += 1
        pieces = packing.pack_documents(frame).collect()
        by, used = defaultdict(list), defaultdict(list)
        for p in pieces:
            by[p.doc_id, p.doc_tokens].append((p.start, bytes(p.ids)))
            used[p.sequence_id].append((p.offset, len(p.ids) // 4))
        got = defaultdict(int)
        for (doc, n), parts in by.items():
            starts = sorted(set(parts))
            if len(starts) == len(parts):
                got[doc, n, zlib.crc32(b"".join(x for _, x in starts))] += 1
        assert all(whole[k] == v for k, v in got.items())
        assert sum(n * v for (_, n, _), v in whole.items()) == sum(len(p.ids) // 4 for p in pieces)
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024
    assert packing.packing_report(no_rows).count() == 0
    tokens = sum(len(p.ids) // 4 for p in packing.pack_documents(docs).collect())
    windows = packing.pack_documents(docs).select("sequence_id").distinct().count()
    assert tokens / (1024 * windows) > 0.95


def test_quality(docs, edge, no_rows):
    for frame in (docs, edge):
        texts = {}
        for r in frame.collect():
            texts.setdefault((r.doc_id, len(brute.words(r.text)), sum(map(len, brute.words(r.text)))), r.text)
        got = quality.quality_report(frame).collect()
        assert len(got) == frame.count()
        for r in got:
            want = brute.quality(texts[r.doc_id, r.n_words, r.word_chars])
            assert {k: r[k] for k in want} == want
            assert not (r.kept and r.base_failed)
    assert quality.quality_report(no_rows).count() == 0
    kept = quality.keep_good(edge)
    assert kept.columns == edge.columns
    assert quality.keep_good(docs).count() == sum(r.kept for r in quality.quality_report(docs).collect())


def test_verdicts_agree_with_labels(spark, docs):
    labels = dict(spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "quality").collect())
    got = [(r.kept, labels[r.doc_id]) for r in quality.quality_report(docs).collect() if r.doc_id in labels]
    good = [k for k, q in got if q == 1]
    assert sum(good) / len(good) > 0.95


CHATS = [
    (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"),
    (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"), (4, 0, "user", None), (4, None, None, "<|im_end|>"),
    (None, 0, "user", "a"), (None, 1, "assistant", "x"), (5, 0, "user", "a"), (5, 0, "user", "a"), (5, 0, "tool", "t"),
    *[(6, i, "user", str(i)) for i in range(700)], *[(7, i, "user", str(i)) for i in range(300)],
]


def test_chat_edges(spark):
    frame = spark.createDataFrame([(*c, 9, "z") for c in CHATS], "conv_id bigint, turn bigint, role string, text string, part int, _pos string")
    connection = connect(SF_DIR)
    connection.register("edge_chats", frame.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    sql = chat.CHAT_SQL.replace("FROM conversations", "FROM edge_chats")
    assert differences(chat.format_chats(frame), connection, sql) == ""
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_digest_of_no_spans():
    assert brute.sha_of_spans([]) == hashlib.sha256(b"").hexdigest()
