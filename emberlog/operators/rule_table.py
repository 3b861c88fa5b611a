"""Tagging by a rule table of any size: required texts are searched, expressions verify hits only.

A table of one slice goes to the tasks, which find its required texts with one automaton. A larger table is joined: the
tasks get a filter of fixed size, hash what passes it, and the hashes meet those of the required texts.
"""

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.constants.attack_rules import CONFIDENCE_RANK
from emberlog.functions import text as text_functions
from emberlog.functions.once import once
from emberlog.functions.text import lookup, required_literal
from emberlog.operators.ranking import row_numbers
from emberlog.session import stage

# Task functions travel with their code, so executors need no installed copy of this package.
for _module in (sys.modules[__name__], text_functions):
    cloudpickle.register_pickle_by_value(_module)

#: Patterns whose sizes are added up before the driver sees them; the smallest unit of a slice.
BLOCK = 1_024
#: Bytes of pattern text that one pass sends to every task.
SLICE_BYTES = 8 << 20

_TAGS = ("technique_id", "technique_name", "tactic", "mitre_confidence", "matched_rule")
_FIRST = (*_TAGS, "priority")
_FIRST_TYPE = ", ".join(f"{name} string" for name in _TAGS) + ", priority long"
_PATTERN = _TAGS.index("matched_rule")
#: Letters beyond ASCII that a search ignoring case takes for "s" and "i"; lower() keeps them or adds a mark.
_FOLD = str.maketrans({"ſ": "s", "ı": "i", "İ": "i"})

#: Bytes of a required text that are looked for: all up to 16, of longer ones the last so many.
KEY_SIZES = [*range(1, 17), *(step << power for power in range(6) for step in (20, 24, 28, 32))]
#: Places of the table of first four bytes, words of the filter at most, bytes of text hashed at once, expressions kept compiled.
GRAM_BITS, WORD_BITS, CHUNK_BYTES, COMPILED = 18, 22, 1 << 18, 1 << 14
# Fixed values of the polynomial hash (odd, so that it has an inverse) and of its mixing.
_BASE, _MIX, _SIZE_MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def required_texts(pattern: str) -> list[str]:
    """ASCII texts, in lower case, of which every match holds at least one; empty if nothing is known.

    An alternation without groups or classes needs one text per branch.
    """
    branches = pattern.split("|") if not re.search(r"[(\[\\]", pattern) else [pattern]
    found = []
    for branch in branches:
        runs = re.findall(r"[\x00-\x7f]+", required_literal(branch)[0])
        if not runs:
            return []
        found.append(max(runs, key=len).lower())
    return sorted(set(found))


def ranked_patterns(rules: DataFrame, techniques: DataFrame) -> DataFrame:
    """Patterns in the order in which they win: ``priority`` from 0, the tag columns and ``matched_rule``.

    Highest confidence first, then rule and pattern order. Unknown confidences and NULL patterns never
    win; techniques missing from ``techniques`` (technique, name, tactic) are called Unknown. Written once.
    """
    names = techniques.groupBy("technique").agg(F.min_by(F.struct("name", "tactic"), F.struct("name", "tactic")).alias("_t"))
    rank = lookup(F.col("confidence"), CONFIDENCE_RANK, -1)
    known = rules.filter(F.col("pattern").isNotNull()).withColumn("_rank", rank).filter("_rank >= 0")
    rows = known.join(names, "technique", "left").select(
        "_rank", "rule_order", "pattern_order",
        F.col("technique").alias("technique_id"),
        F.coalesce("_t.name", F.lit("Unknown")).alias("technique_name"),
        F.coalesce("_t.tactic", F.lit("Unknown")).alias("tactic"),
        F.col("confidence").alias("mitre_confidence"),
        F.col("pattern").alias("matched_rule"),
    )
    order = [F.desc("_rank"), F.col("rule_order"), F.col("pattern_order"), F.col("matched_rule")]
    return stage(row_numbers(rows, order, "priority").select("priority", *_TAGS), "ranked-patterns")


def _bounds(ranked: DataFrame, slice_bytes: int, block: int) -> list[tuple[int, int]]:
    """First and last block of each slice of about ``slice_bytes``; a slice holds whole blocks, at least one."""
    size = reduce(lambda left, right: left + right, [F.coalesce(F.octet_length(c), F.lit(0)) for c in _TAGS])
    blocks = (
        ranked.groupBy(F.floor(F.col("priority") / block).alias("b")).agg(F.sum(size).alias("n")).orderBy("b")
    ).toLocalIterator()
    first, last, held = None, None, 0
    bounds = []
    for row in blocks:
        if first is not None and held + row.n > slice_bytes:
            bounds.append((first, last))
            first, held = None, 0
        first, last, held = row.b if first is None else first, row.b, held + row.n
    if first is not None:
        bounds.append((first, last))
    return bounds


def _slice(ranked: DataFrame, bounds: tuple[int, int], block: int) -> list[tuple]:
    """The patterns of one slice in winning order: the tag values, then the priority."""
    inside = ranked.filter((F.col("priority") >= bounds[0] * block) & (F.col("priority") < (bounds[1] + 1) * block))
    return [tuple(row) for row in inside.orderBy("priority").select(*_TAGS, "priority").collect()]


class _Matcher:
    """The first of some patterns that a text matches, all of them tried only as far as needed."""

    def __init__(self, patterns: list[tuple]):
        self.patterns = patterns
        self.compiled: dict[int, re.Pattern] = {}
        self.open: list[int] = []
        owners: dict[str, list[int]] = {}
        for number, row in enumerate(patterns):
            texts = required_texts(row[_PATTERN])
            for text in texts:
                owners.setdefault(text, []).append(number)
            if not texts:
                self.open.append(number)
        self.automaton = ahocorasick.Automaton()
        for text, numbers in owners.items():
            self.automaton.add_word(text, numbers)
        if owners:
            self.automaton.make_automaton()

    def _matches(self, number: int, text: str) -> bool:
        if number not in self.compiled:
            self.compiled[number] = re.compile(self.patterns[number][_PATTERN], re.IGNORECASE)
        return self.compiled[number].search(text) is not None

    def first(self, text: str | None) -> tuple:
        """Tag values and priority of the first pattern found in ``text``, else Nones."""
        candidates = set(self.open) if text is not None else set()
        if len(self.automaton) and text is not None:
            folded = text.translate(_FOLD).lower()
            for _, numbers in self.automaton.iter(folded):
                candidates.update(numbers)
        for number in sorted(candidates):
            if self._matches(number, text):
                return self.patterns[number]
        return (None,) * len(_FIRST)


def _first_match(patterns: list[tuple]):
    """Arrow function: text -> tag values and priority of the first of ``patterns`` that it matches."""

    @F.pandas_udf(_FIRST_TYPE)
    def first(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = _Matcher(patterns)
        for texts in batches:
            found = pd.DataFrame([matcher.first(text) for text in texts], columns=list(_FIRST), dtype=object)
            yield found.astype({"priority": "Int64"})

    return first


class _Windows:
    """Hashes of any parts of a run of bytes: a polynomial modulo 2^64, mixed with the part's size."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.inverse = self._powers(pow(_BASE, -1, 1 << 64), n + 1)
        terms = (data.astype(np.uint64) + np.uint64(1)) * self._powers(_BASE, n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        factors = np.full(n, base, np.uint64)
        factors[:1] = 1
        return np.cumprod(factors, dtype=np.uint64)

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        h = (self.sums[at + size] - self.sums[at]) * self.inverse[at] + np.uint64(size * _SIZE_MIX % (1 << 64))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(_MIX)
        return h ^ (h >> np.uint64(29))


def _grams(data: np.ndarray) -> np.ndarray:
    """Place of the four bytes from every byte on in the table of first bytes; the last three have none."""
    wide = data.astype(np.uint32)
    four = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    return (four * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)


_KEY_TYPE = f"priority long, {', '.join(f'{name} string' for name in _TAGS)}, size int, key long, gram int"


def _pattern_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(priority, tags) -> a row per required text with its hash; ``size`` is the place in KEY_SIZES, NULL without a text."""
    for batch in batches:
        of, sizes, keys = [], [], []
        for row, pattern in enumerate(batch.column("matched_rule").to_pylist()):
            for text in required_texts(pattern) or [None]:
                size = None if text is None else int(np.searchsorted(KEY_SIZES, len(text), "right")) - 1
                of.append(row)
                sizes.append(size)
                keys.append(b"" if text is None else text.encode()[-KEY_SIZES[size]:])
        starts = np.cumsum([0, *map(len, keys)])[:-1]
        data = np.frombuffer(b"".join(keys) + b"\xff" * 4, np.uint8)
        windows, grams = _Windows(data), _grams(data)
        place = np.array([-1 if size is None else size for size in sizes])
        hashed = np.zeros(len(keys), np.uint64)
        for size in np.unique(place[place >= 0]):
            hashed[place == size] = windows.hashes(starts[place == size], KEY_SIZES[size])
        four = np.where(place >= KEY_SIZES.index(4), grams[np.minimum(starts, len(grams) - 1)].astype(np.int64), -1)
        taken = batch.take(pa.array(of, pa.int64()))
        columns = [*taken.columns, pa.array(sizes, pa.int32()), pa.array(hashed.view(np.int64)), pa.array(four, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=[*taken.schema.names, "size", "key", "gram"])


def _table(rows: DataFrame, size: int) -> np.ndarray:
    """(place, bits) rows as an array of ``size`` words."""
    found = rows.toArrow()
    words = np.zeros(size, np.uint64)
    words[found.column("place").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return words


@dataclass
class _Filter:
    """Which sizes may start with four bytes, sizes below four, and three bits per key in one word of a Bloom filter."""

    grams: np.ndarray
    always: int
    words: np.ndarray

    @staticmethod
    def over(keys: DataFrame) -> "_Filter":
        """At most 2^GRAM_BITS + 2^WORD_BITS rows come to the driver, however many keys there are."""
        size_bit = F.expr("bit_or(shiftleft(1L, size))")
        n = keys.count()
        bits = max(1, min(WORD_BITS, (n // 4).bit_length()))
        spread = [F.expr(f"shiftleft(1L, cast(shiftright(key, {shift}) & 63 AS INT))") for shift in (0, 6, 12)]
        word = F.shiftrightunsigned(F.col("key"), 64 - bits)
        words = keys.groupBy(word.alias("place")).agg(F.bit_or(reduce(lambda a, b: a.bitwiseOR(b), spread)).alias("bits"))
        grams = keys.filter("gram >= 0").groupBy(F.col("gram").alias("place")).agg(size_bit.alias("bits"))
        always = keys.filter("gram < 0").agg(size_bit).first()[0] or 0
        return _Filter(_table(grams, 1 << GRAM_BITS), always, _table(words, 1 << bits))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        one, low = np.uint64(1), np.uint64(63)
        bits = one << (hashes & low) | one << (hashes >> np.uint64(6) & low) | one << (hashes >> np.uint64(12) & low)
        shift = np.uint64(65 - len(self.words).bit_length())
        return self.words[hashes >> shift] & bits == bits

    def candidates(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Different (number of the text, hash) of the parts of texts that may be keys."""
        starts = np.cumsum([0, *(len(text) + 1 for text in texts)])[:-1]
        # No text in UTF-8 holds the byte between two of them.
        data = np.frombuffer(b"\xff".join(texts) + b"\xff" * 4, np.uint8)
        sizes = self.grams[_grams(data)] | np.uint64(self.always)
        places = np.flatnonzero(sizes)
        sizes, windows = sizes[places], _Windows(data)
        of, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for number in range(int(np.bitwise_or.reduce(sizes, initial=0)).bit_length()):
            at = places[(sizes >> np.uint64(number) & np.uint64(1)).astype(bool)]
            at = at[at + KEY_SIZES[number] <= len(data)]
            hashes = windows.hashes(at, KEY_SIZES[number])
            kept = self.holds(hashes)
            of.append(np.searchsorted(starts, at[kept], "right") - 1)
            found.append(hashes[kept])
        pairs = np.unique(np.rec.fromarrays([np.concatenate(of), np.concatenate(found)], names="of,key"))
        return pairs["of"], pairs["key"]


def _find_keys(shared):
    """Arrow function: (row, text) -> (row, text, key) for every hash in a text that may be a key."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Filter(*shared.value)
        for batch in batches:
            texts = [text.translate(_FOLD).lower().encode("utf-8", "surrogatepass") for text in batch.column(1).to_pylist()]
            ends = np.cumsum([len(text) + 1 for text in texts])
            cuts = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, CHUNK_BYTES), "right")
            for low, high in zip(cuts, [*cuts[1:], len(texts)], strict=True):
                if low == high:
                    continue
                of, keys = known.candidates(texts[low:high])
                taken = batch.take(pa.array(of + low))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(keys.view(np.int64))], names=["_row", "_text", "key"])

    return find


def _matching(text: Column, pattern: Column) -> Column:
    """Whether a text matches a pattern."""

    @F.pandas_udf("boolean")
    def matching(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        compiled: dict[str, re.Pattern] = {}
        for texts, patterns in batches:
            found = []
            for value, expression in zip(texts, patterns, strict=True):
                if expression not in compiled:
                    if len(compiled) >= COMPILED:
                        compiled.clear()
                    compiled[expression] = re.compile(expression, re.IGNORECASE)
                found.append(compiled[expression].search(value) is not None)
            yield pd.Series(found, dtype=bool)

    return matching(text, pattern)


def _tagged_by_join(events: DataFrame, ranked: DataFrame, text: Column, slice_bytes: int, block: int) -> DataFrame:
    """``events`` with ``_tag``, the tags of the first pattern, by a join of hashes; texts that hit are shuffled once."""
    spark = events.sparkSession
    rows = stage(events.withColumn("_row", F.monotonically_increasing_id()), "rows-to-tag")
    keys = stage(ranked.select("priority", *_TAGS).mapInArrow(_pattern_keys, _KEY_TYPE), "pattern-keys")
    passing = _Filter.over(keys.filter("size IS NOT NULL"))
    shared = spark.sparkContext.broadcast((passing.grams, passing.always, passing.words))
    found = rows.select("_row", text.alias("_text")).mapInArrow(_find_keys(shared), "_row long, _text string, key long")
    hits = found.join(keys.filter("size IS NOT NULL").select("key", F.struct("priority", *_TAGS).alias("_tag")), "key")
    hits = hits.filter(_matching(F.col("_text"), F.col("_tag.matched_rule"))).select("_row", "_tag")
    # Patterns without a required text are tried on every row, a slice at a time; few tables have more than one.
    untold = keys.filter("size IS NULL")
    for bounds in _bounds(untold, slice_bytes, block):
        tried = rows.select("_row", _first_match(_slice(untold, bounds, block))(text).alias("_first"))
        tried = once(tried, "_first").filter("_first.priority IS NOT NULL")
        hits = hits.unionByName(tried.select("_row", F.struct("_first.priority", *[f"_first.{name}" for name in _TAGS]).alias("_tag")))
    best = hits.groupBy("_row").agg(F.min("_tag").alias("_tag"))
    return rows.join(best, "_row", "left").drop("_row")


def _search_text(events: DataFrame, message_col: str, raw_col: str | None) -> Column:
    message = F.coalesce(F.col(message_col), F.lit(""))
    raw = F.coalesce(F.col(raw_col), F.lit("")) if raw_col else F.lit("")
    return F.concat(message, F.lit(" "), raw)


def tag_by_rule_table(
    events: DataFrame,
    rules: DataFrame,
    techniques: DataFrame,
    message_col: str = "message",
    raw_col: str | None = "raw",
    slice_bytes: int = SLICE_BYTES,
    block: int = BLOCK,
) -> DataFrame:
    """Like ``tag_events``, with the rules as data: (technique, confidence, pattern, rule_order, pattern_order).

    The patterns are put in winning order. If they fit one slice of ``slice_bytes`` (whole blocks of ``block``
    patterns), it is sent to the tasks: all required texts in a row are found with one automaton, expressions are
    tried only where their text occurs, in winning order until the first match, and nothing is shuffled. A larger
    table is joined: hashes of the required texts meet hashes of the parts of the search texts that pass a filter
    of bounded size, hits are verified by their expressions, and the first one is joined back to its row. So the work
    grows with the rows and the patterns, not with their product. Expressions that have no required text are tried
    on each row, as they must be, a slice at a time.

    NULL texts count as empty, so they can match patterns that match an empty text. Without rules every row
    has NULL tags and confidence NONE. An expression that cannot be compiled raises an error in the first
    task that has to try it.
    """
    columns = [c for c in events.columns if c not in _TAGS]
    ranked = ranked_patterns(rules, techniques)
    kept = events.select(*columns)
    text = _search_text(kept, message_col, raw_col)
    bounds = _bounds(ranked, slice_bytes, block)
    if len(bounds) > 1:
        tagged = _tagged_by_join(kept, ranked, text, slice_bytes, block)
    elif bounds:
        tagged = once(kept.withColumn("_tag", _first_match(_slice(ranked, bounds[0], block))(text)), "_tag")
    else:
        tagged = kept.withColumn("_tag", F.struct(*[F.lit(None).cast("string").alias(name) for name in _TAGS]))
    tags = {name: F.col(f"_tag.{name}") for name in _TAGS}
    tags["mitre_confidence"] = F.coalesce(tags["mitre_confidence"], F.lit("NONE"))
    return tagged.select(*columns, *[value.alias(name) for name, value in tags.items()])
