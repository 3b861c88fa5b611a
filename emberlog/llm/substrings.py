"""Removal of repeated byte strings by bucket-pointer refinement.

A position's bucket at depth 2h is the pair of its bucket at depth h and the bucket of the position h
later; buckets are named by 64-bit hashes of these pairs, so names agree between tasks and each depth reuses
the names of the one before. The initial buckets hold q-grams; refinement goes on by doubling, and to any depth up to twice the
last one by two overlapping pointers. Units are bytes (what is removed) or words (passages that are reported).

Only sampled positions are exchanged: every window of LENGTH bytes selects the least q-gram bucket among
its first SPREAD positions as its anchor. Equal windows select equal anchors, so a window whose anchor is
alone in its bucket at depth LENGTH - SPREAD is not repeated. Anchors that share a bucket are refined by the
string that all their windows cover: equal strings repeat all windows at once; where a bucket splits,
one member of every part has its windows refined to full depth, one bucket each.
"""

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.once import once
from emberlog.llm.frames import ship_with_tasks, small_batches
from emberlog.session import stage

ship_with_tasks(__name__)

LENGTH = 400
#: Passages of so many words are reported, not removed, by one string of SHARED words of theirs.
PASSAGE, SHARED = 50, 25


class Scale(NamedTuple):
    """Repeats of ``length`` units; a window's anchor is among its first ``spread`` positions, chosen by its ``gram`` units.

    Buckets are kept at the depths ``near`` <= length - spread <= 2 * near and ``deep`` <= length <= 2 * deep, powers of two.
    """

    length: int
    spread: int
    gram: int
    near: int
    deep: int
    units: Callable[[bytes], np.ndarray]



MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def pair_name(first: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Name of the bucket that holds (first, later)."""
    x = first * MULTIPLIER + later
    x ^= x >> np.uint64(30)
    x *= MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


LETTERS = pair_name(np.arange(1, 257, dtype=np.uint64), np.full(256, 77, np.uint64))


def _byte_units(text: bytes) -> np.ndarray:
    return LETTERS[np.frombuffer(text, np.uint8)]


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _word_units(text: bytes) -> np.ndarray:
    """Names of the words of a text, from differences of one running polynomial over its bytes."""
    data = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(np.r_[True, _GAPS[data], True]))
    starts, ends = edges[::2], edges[1::2]
    up, down = (_UP, _DOWN) if len(data) < len(_UP) else (_powers(BASE, len(data)), _powers(UNBASE, len(data)))
    sums = np.r_[np.uint64(0), np.cumsum(LETTERS[data] * up[: len(data)], dtype=np.uint64)]
    return pair_name((sums[ends] - sums[starts]) * down[starts], (ends - starts).astype(np.uint64))


BASE = 0xD1342543DE82EF95
UNBASE = pow(BASE, -1, 1 << 64)
_UP, _DOWN = _powers(BASE, 1 << 14), _powers(UNBASE, 1 << 14)
#: White space, as in SPACE.
_GAPS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
BYTES = Scale(LENGTH, 128, 16, 256, 256, _byte_units)
WORDS = Scale(PASSAGE, PASSAGE - SHARED + 1, 4, 16, 16, _word_units)


def refine(names: np.ndarray, scale: Scale) -> dict[int, np.ndarray]:
    """Bucket names of all positions at the scale's depths, each from the depth half as deep."""
    depth, kept = 1, {}
    while True:
        if depth in (scale.gram, scale.near, scale.deep):
            kept[depth] = names
        if depth == scale.deep:
            return kept
        names = pair_name(names[:-depth], names[depth:])
        depth *= 2


def deepen(names: np.ndarray, depth: int, at: np.ndarray, length: int) -> np.ndarray:
    """Names of the strings of ``length`` (depth .. 2 * depth) units at the positions ``at``."""
    return pair_name(names[at], names[at + (length - depth)])


def anchors(grams: np.ndarray, windows: int, spread: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) for each anchor that some of the windows 0 .. windows - 1 selects."""
    size = min(len(grams), windows + spread - 1)
    low = (grams[:size] & HIGH) | np.arange(size, dtype=np.uint64)
    step = 1
    while 2 * step <= spread:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < spread:
        low = np.minimum(low[: len(low) - (spread - step)], low[spread - step :])
    chosen = (low[:windows] & LOW).astype(np.int64)
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    return chosen[first], first, np.r_[first[1:], windows] - 1


def _bytes(value) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid and value.as_py() else b""


def _combined(order_keys: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sort order by the keys (first key first) and, per prefix of keys, whether a row starts a group."""
    order = np.lexsort(order_keys[::-1])
    starts, new = [], np.zeros(len(order), bool)
    for key in order_keys:
        k = key[order]
        new = new | np.r_[True, k[1:] != k[:-1]] if len(k) else new
        starts.append(new)
    return order, starts


def _with_company(start: np.ndarray) -> np.ndarray:
    """Whether a row's group (given where groups start) has other rows."""
    return ~(start & np.r_[start[1:], True]) if len(start) else start


def _anchor_rows(scale: Scale):
    """(row, text) -> one row per anchor: part, key, context, row, place, flags.

    flags: 1 the context occurs again in this batch, 2 the key has other contexts in this batch, 4 first of
    its context in this batch. Of a batch's anchors with one key, the first goes to the key's task, the others
    are dealt by their document, so that a frequent passage does not gather in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, spread = scale.length, scale.spread
        names = ["part", "key", "context", "row", "place", "flags"]
        for batch in batches:
            keys, contexts, places, counts = [], [], [], []
            for text in batch.column(1):
                data = scale.units(_bytes(text))
                windows = len(data) - length + 1
                if windows <= 0:
                    counts.append(0)
                    continue
                depths = refine(data, scale)
                deep = depths[scale.deep]
                at, lo, hi = anchors(depths[scale.gram], windows, spread)
                keys.append(deepen(depths[scale.near], scale.near, at, length - spread))
                reach = ((at - lo) * spread + (at - hi)).astype(np.uint64)
                ends = pair_name(deepen(deep, scale.deep, lo, length), deepen(deep, scale.deep, hi, length))
                contexts.append(pair_name(ends, reach))
                places.append((at << 16) | ((at - lo) << 8) | (at - hi))
                counts.append(len(at))
            row = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), counts)
            if not len(row):
                continue
            key, context, place = (np.concatenate(x) for x in (keys, contexts, places))
            key, context = key.view(np.int64), context.view(np.int64)
            order, (by_key, by_context) = _combined([key, context])
            key, context, place, row = key[order], context[order], place[order], row[order]
            group = np.cumsum(by_key) - 1
            several = np.bincount(group, by_context)[group] > 1
            flags = _with_company(by_context) * 1 + several * 2 + by_context * 4
            part = np.where(by_key, key, row)
            columns = (part, key, context, row, place, flags.astype(np.int8))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return run


def _window_rows(scale: Scale):
    """(row, text, places) -> part, key, row, at, known for all windows of the given anchors at full depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ats, counts = [], [], []
            for text, places in zip(batch.column(1), batch.column(2), strict=True):
                place = np.asarray(places.values, np.int64)
                deep = refine(scale.units(_bytes(text)), scale)[scale.deep]
                lo, hi = (place >> 16) - ((place >> 8) & 255), (place >> 16) - (place & 255)
                size = hi - lo + 1
                at = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                keys.append(deepen(deep, scale.deep, at, scale.length))
                ats.append(at)
                counts.append(len(at))
            if not counts:
                continue
            row = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), counts)
            key, at = np.concatenate(keys).view(np.int64), np.concatenate(ats)
            order, (new,) = _combined([key])
            key, at, row = key[order], at[order], row[order]
            part = np.where(new, key, row)
            columns = [pa.array(c) for c in (part, key, row, at, _with_company(new))]
            for start in range(0, len(key), 200_000):
                cut = [c.slice(start, 200_000) for c in columns]
                yield pa.RecordBatch.from_arrays(cut, names=["part", "key", "row", "at", "known"])

    return run


def _passage_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) -> key, row, n: anchored strings of SHARED words, one row per string and batch, n its occurrences here.

    Where a string occurs again in the batch, its occurrences are also counted per row at once (key null).
    """
    for batch in batches:
        keys, counts = [], []
        for text in batch.column(1):
            data = WORDS.units(_bytes(text))
            windows = len(data) - WORDS.length + 1
            if windows <= 0:
                counts.append(0)
                continue
            depths = refine(data, WORDS)
            at, _, _ = anchors(depths[WORDS.gram], windows, WORDS.spread)
            keys.append(deepen(depths[WORDS.near], WORDS.near, at, SHARED))
            counts.append(len(at))
        if not keys:
            continue
        row = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), counts)
        found, first, of, n = np.unique(np.concatenate(keys).view(np.int64), return_index=True, return_inverse=True, return_counts=True)
        yield _passage_batch(pa.array(found), row[first], n)
        rows, here = np.unique(row[n[of] > 1], return_counts=True)
        yield _passage_batch(pa.nulls(len(rows), pa.int64()), rows, here)


def _passage_batch(key: pa.Array, row: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([key, pa.array(row, pa.int64()), pa.array(n, pa.int64())], names=["key", "row", "n"])


def shared_passages(texts: DataFrame) -> DataFrame:
    """row, n_passages: how many anchored strings of SHARED words of a text occur elsewhere too, from (row, text).

    Each window of PASSAGE words has such a string at its anchor, so a passage of PASSAGE words that occurs twice is always seen.
    """
    found = texts.select("row", "text").mapInArrow(_passage_rows, "key bigint, row bigint, n bigint")
    # A batch sends one row per string, so a frequent string has as many rows as batches.
    alone = found.filter("key is not null").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n = 1 and _n > 1")
    counted = alone.select("row", "n").unionByName(found.filter("key is null").select("row", "n"))
    return counted.groupBy("row").agg(F.sum("n").alias("n_passages"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans, n_passages) -> doc_id, n_bytes, merged removed spans, kept bytes, n_passages."""
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        sizes, merged, kept = [], [], []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            data = text.as_py().encode("utf-8", "surrogatepass")
            runs: list[list[int]] = []
            for start, end in sorted((s["start"], s["end"]) for s in spans.as_py()):
                if runs and start <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], end)
                else:
                    runs.append([start, end])
            edges = [0, *[x for run in runs for x in run], len(data)]
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            sizes.append(len(data))
            merged.append([{"start": a, "end": b} for a, b in runs])
        columns = [pa.array(sizes, pa.int64()), pa.array(merged, span_type), pa.array(kept, pa.binary()), batch.column(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "spans", "kept", "n_passages"])


def repeated_spans(texts: DataFrame, scale: Scale = BYTES) -> DataFrame:
    """row, start, end (in units) of strings that start elsewhere too, from (row, text); they may overlap and touch."""
    found = texts.select("row", "text").mapInArrow(
        _anchor_rows(scale), "part bigint, key bigint, context bigint, row bigint, place bigint, flags tinyint"
    )
    by_key, by_context = Window.partitionBy("part", "key"), Window.partitionBy("part", "key", "context")
    several = (F.max(F.col("flags").bitwiseAND(2)).over(by_key) > 0) | (F.min("context").over(by_key) != F.max("context").over(by_key))
    again = (F.col("flags").bitwiseAND(1) > 0) | (F.count(F.lit(1)).over(by_context) > 1)
    first = (F.col("flags").bitwiseAND(4) > 0) & (
        (F.col("part") != F.col("key")) | (F.struct("row", "place") == F.min(F.struct("row", "place")).over(by_context))
    )
    marked = found.select("row", "place", several.alias("several"), again.alias("again"), first.alias("first"))
    marked = stage(marked.filter("several or again"), "anchors")
    at, lo, hi = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(255), F.col("place").bitwiseAND(255)
    whole = marked.filter("again").select("row", (at - lo).alias("start"), (at - hi + scale.length).alias("end"))
    open_ = marked.filter("several and first").groupBy("row").agg(F.collect_list("place").alias("places"))
    windows = (
        texts.join(open_, "row").select("row", "text", "places")
        .mapInArrow(_window_rows(scale), "part bigint, key bigint, row bigint, at bigint, known boolean")
        .withColumn("_n", F.count(F.lit(1)).over(by_key))
        .filter("known or _n > 1")
        .select("row", F.col("at").alias("start"), (F.col("at") + scale.length).alias("end"))
    )
    return whole.unionByName(windows)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs: start, end), kept (remaining bytes) and n_passages of every document.

    Removed is every byte of a LENGTH-byte string that also starts elsewhere, in the same or another document,
    judged on the input. Null text is empty; shorter texts stay; repeated rows are documents of their own, so all
    of a repeated text of LENGTH bytes or more goes. n_passages counts shared passages of words (``shared_passages``), which are
    reported only. An empty table gives an empty result. Other columns are not
    read. Documents are keyed by a 64-bit hash of id and text.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    texts = once(docs.select("doc_id", text).withColumn("row", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text")), "row")
    none = F.lit(None).cast("struct<start:bigint,end:bigint>")
    found = repeated_spans(texts).select("row", F.struct("start", "end").alias("span"), F.lit(0).cast("long").alias("n_passages"))
    found = found.unionByName(shared_passages(texts).select("row", none.alias("span"), "n_passages"))
    spans = found.groupBy("row").agg(F.collect_list("span").alias("spans"), F.sum("n_passages").alias("n_passages"))
    spans = stage(spans, "repeats")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary, n_passages bigint"
    cut = texts.join(spans, "row").select("doc_id", "text", "spans", "n_passages").mapInArrow(_cut, schema)
    same = texts.join(spans, "row", "left_anti").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.col("text").cast("binary").alias("kept"),
        F.lit(0).cast("long").alias("n_passages"),
    )
    return cut.unionByName(same)


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages of every document."""
    return without_repeats(docs).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_passages",
    )
