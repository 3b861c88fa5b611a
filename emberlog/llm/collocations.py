"""Phrase mining by direct-address tiling.

Words that are frequent in their language get ids by falling frequency. A phrase of k words is the pair of the two phrases of k - 1
words that overlap in it, so every length is counted the same way: pairs of neighbouring ids fall into tiles of ids by ids;
full tiles are counted by a dense bincount, the others as sorted coordinates. The frequent pairs, ranked again by frequency, are
the ids of the next length. Ids go to the tasks in slices of bounded size; a table with more ids takes more passes.
"""

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.frames import global_row_numbers, ship_with_tasks, small_batches
from emberlog.session import stage

ship_with_tasks(__name__)

LEAST, LONGEST, TOP = 100, 5, 2000
UNKNOWN_LANG = "und"
#: Ids of a tile's side, and how many pairs make a tile worth a dense count.
TILE = 1024
DENSE = TILE * TILE // 8
#: Words or phrases shipped to the tasks at once: at most some 100 MB.
SLICE = 1 << 20
#: Ids per row of encoded text (a row ends with a document), pairs counted at once, different words counted at once, counts per batch.
CHUNK, PAIRS, WORDS, SENT = 1 << 18, 1 << 21, 1 << 18, 1 << 16

# Bytes that end a piece, and blanks.
ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: Lower case; every end of a piece becomes a full stop, every blank a space.
PLAIN = bytes.maketrans(_UPPER + ENDS + BLANKS, _LOWER + b"." * len(ENDS) + b" " * len(BLANKS))


def tokens(text: str | None) -> list[bytes]:
    """The words of a text in order, with a full stop between pieces."""
    if not text:
        return []
    # What Python counts as white space is a blank or the end of a piece, so split() cuts at blanks only.
    return text.encode("utf-8", "surrogatepass").translate(PLAIN).replace(b".", b" . ").split()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> partial counts lang, word, n."""
    counts: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            found.pop(b".", None)
            columns = [pa.array([lang] * len(found), pa.string()), pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts.setdefault(lang, Counter()).update(tokens(text.as_py()))
            if sum(map(len, counts.values())) > WORDS:
                yield from flush()
    yield from flush()


def _ids_frame(rows: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.astype("<i4").tobytes() for r in rows], pa.binary())], names=["ids"])


def _squeeze(ids: np.ndarray) -> np.ndarray:
    """Ids with runs of -1 (no id, end of a piece) cut to one; they end with -1."""
    return ids[(ids >= 0) | np.r_[True, ids[:-1] >= 0]]


def _encoder(words: dict[str, dict[bytes, int]], last: bool):
    """(lang, text, perhaps ids found before) -> the same with more ids, or at last rows of ids of several documents.

    -1 stands between pieces and for words without id.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            rows = []
            for i, (lang, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                ids = np.array([*map(words.get(lang, {}).get, tokens(text.as_py()), repeat(-1)), -1], np.int32)
                if batch.num_columns > 2:
                    ids = np.maximum(ids, np.frombuffer(batch.column(2)[i].as_buffer(), "<i4"))
                rows.append(_squeeze(ids) if last else ids)
            if not last:
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], _ids_frame(rows).column(0)], names=["lang", "text", "ids"])
                continue
            held += rows
            size += sum(map(len, rows))
            if size >= CHUNK:
                yield _ids_frame([np.concatenate(held)])
                held, size = [], 0
        if held:
            yield _ids_frame([np.concatenate(held)])

    return encode


def tile_counts(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (left, right) pairs of ids and how often each occurs."""
    across = int(right.max()) // TILE + 1 if len(right) else 1
    # Tile and cell in one number below 2^62, sorted in place: the only array as long as the input that is held.
    code = left.astype(np.int64)
    code //= TILE
    code *= across
    code += right // TILE
    code *= TILE * TILE
    code += (left % TILE) * TILE + right % TILE
    code.sort()
    tile = code // (TILE * TILE)
    cuts = np.r_[0, np.flatnonzero(tile[1:] != tile[:-1]) + 1, len(code)]
    names = tile[cuts[:-1]] if len(code) else tile
    del tile
    out, rest, kept = [], np.ones(len(code), bool), np.diff(cuts)
    for k in np.flatnonzero(kept >= DENSE):
        cells = np.bincount(code[cuts[k]:cuts[k + 1]] - names[k] * TILE * TILE, minlength=TILE * TILE)
        rest[cuts[k]:cuts[k + 1]] = False
        full = np.flatnonzero(cells)
        out.append((full // TILE + names[k] // across * TILE, full % TILE + names[k] % across * TILE, cells[full]))
    code = code[rest] if out else code
    del rest
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    n = np.diff(np.r_[starts, len(code)])
    code = code[starts]
    tile, cell = code // (TILE * TILE), code % (TILE * TILE)
    out.append((tile // across * TILE + cell // TILE, tile % across * TILE + cell % TILE, n))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if len(out) > 1 else out[0]


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ids -> partial counts p, q, n of neighbouring ids."""
    held, size = [], 0

    def count() -> Iterator[pa.RecordBatch]:
        ids = np.concatenate(held)
        held.clear()
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        left, right = ids[at], ids[at + 1]
        del ids, at
        columns = tile_counts(left, right)
        del left, right
        # Small batches: both sides of the pipe hold one whole.
        for start in range(0, len(columns[0]), SENT):
            yield pa.RecordBatch.from_arrays([pa.array(c[start:start + SENT], pa.int64()) for c in columns], names=["p", "q", "n"])

    for batch in batches:
        for row in batch.column(0):
            held.append(np.frombuffer(row.as_buffer(), "<i4"))
            size += len(held[-1])
            if size >= PAIRS:
                yield from count()
                size = 0
    if held:
        yield from count()


def _pair_encoder(pairs: np.ndarray, ranks: np.ndarray, last: bool):
    """Rows of ids (and ids of pairs from earlier slices) -> the same with ids of the pairs that start at each place, at last these alone.

    Squeezing in a step of its own would keep a second Python worker beside that of every task.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, done = [], []
            for i, row in enumerate(batch.column(0)):
                ids = np.frombuffer(row.as_buffer(), "<i4").astype(np.int64)
                out = np.frombuffer(batch.column(1)[i].as_buffer(), "<i4").copy() if batch.num_columns > 1 else np.full(len(ids), -1, np.int32)
                at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
                key = (ids[at] << 32) | ids[at + 1]
                place = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
                hit = pairs[place] == key
                out[at[hit]] = ranks[place[hit]]
                if last:
                    out = _squeeze(out)
                    if len(out) > 1:
                        yield _ids_frame([out])
                    continue
                rows.append(row.as_py())
                done.append(out.astype("<i4").tobytes())
            if last:
                continue
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(done, pa.binary())], names=["ids", "next"])

    return encode


def _ranked(counts: DataFrame, names: list[str], name: str) -> tuple[DataFrame, int]:
    """The frequent rows with ``id`` from 0 by falling count, written once, and how many they are."""
    frequent = stage(counts.filter(F.col("a") >= LEAST), name)
    ranked = stage(global_row_numbers(frequent, [F.col("a").desc(), *map(F.col, names)], "id"), f"{name}-ranked")
    size = ranked.count()
    if size >= 1 << 31:
        raise ValueError("more than 2^31 frequent phrases of one length: raise LEAST")
    return ranked, size


def _slice(ranked: DataFrame, start: int) -> pa.Table:
    """At most SLICE rows with ids from ``start`` on, for the tasks."""
    return ranked.filter((F.col("id") >= start) & (F.col("id") < start + SLICE)).toArrow()


def _encode_words(texts: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """Rows of word ids; a pass over the texts for each SLICE of words."""
    for start in range(0, max(size, 1), SLICE):
        table, known = _slice(words.select("lang", "word", "id"), start), {}
        for lang, word, i in zip(*(table.column(c).to_pylist() for c in ("lang", "word", "id")), strict=True):
            known.setdefault(lang, {})[word] = i
        last = start + SLICE >= size
        texts = stage(texts.mapInArrow(_encoder(known, last), "ids binary" if last else "lang string, text string, ids binary"), "phrase-ids")
    return texts


def _encode_pairs(rows: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """Rows of the ids of the frequent pairs that start at each place; a pass for each SLICE of pairs."""
    for start in range(0, size, SLICE):
        table = _slice(pairs.select("p", "q", "id"), start)
        p, q, ids = (table.column(c).to_numpy() for c in ("p", "q", "id"))
        key = (p << 32) | q
        order = np.argsort(key)
        last = start + SLICE >= size
        encode = _pair_encoder(key[order], ids[order].astype(np.int32), last)
        rows = stage(rows.mapInArrow(encode, "ids binary" if last else "ids binary, next binary"), "phrase-ids")
    return rows


def _cut_scores(words: int, a: Column, n: Column, firsts: Column, rests: Column) -> Column:
    """The lowest-scoring cut of phrases of ``words`` words: a struct of score, k, l, r.

    firsts[k - 1] is the count of the first k words, rests[k - 1] that of the last k; exact in decimals of 38 digits.
    """

    def cut(k: int) -> Column:
        l, r = firsts[k - 1], rests[words - k - 1]
        top = F.lit(1000).cast("decimal(4,0)") * a.cast("decimal(16,0)") * n.cast("decimal(18,0)")
        score = F.call_function("div", top.cast("decimal(38,0)"), (l.cast("decimal(18,0)") * r.cast("decimal(18,0)")).cast("decimal(38,0)"))
        return F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))

    return F.least(*map(cut, range(1, words))) if words > 2 else cut(1)


def phrases(docs: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r, n, score of every phrase that is kept; ``top_phrases`` ranks them.

    Null lang is UNKNOWN_LANG, null text is empty; repeated rows count again; an empty table or one without frequent pairs gives no
    rows. Other columns are not read. Counts are exact at any size: a language's words may come to 10^16.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN_LANG)).alias("lang"), "text")
    counts = texts.mapInArrow(_word_counts, "lang string, word binary, n bigint")
    counts = stage(counts.groupBy("lang", "word").agg(F.sum("n").alias("a")), "word-counts")
    totals = counts.groupBy("lang").agg(F.sum("a").alias("n"))
    words, size = _ranked(counts, ["lang", "word"], "phrase-words")
    rows = _encode_words(texts, words, size)
    none = F.array().cast("array<bigint>")
    level = words.select("id", "lang", F.decode("word", "UTF-8").alias("phrase"), F.decode("word", "UTF-8").alias("tail"), "a", none.alias("firsts"), none.alias("rests"))
    found = []
    for k in range(2, LONGEST + 1):
        counted = rows.mapInArrow(_pair_counts, "p bigint, q bigint, n bigint").groupBy("p", "q").agg(F.sum("n").alias("a"))
        pairs, size = _ranked(counted, ["p", "q"], f"phrase-pairs-{k}")
        if not size:
            break
        if k < LONGEST:
            rows = _encode_pairs(rows, pairs, size)
        first = level.select(F.col("id").alias("p"), "lang", "phrase", F.array_append("firsts", F.col("a")).alias("firsts"))
        rest = level.select(F.col("id").alias("q"), "tail", F.array_append("rests", F.col("a")).alias("rests"))
        here = pairs.join(first, "p").join(rest, "q")
        level = stage(here.select("id", "p", "q", "lang", F.concat_ws(" ", "phrase", "tail").alias("phrase"), "tail", "a", "firsts", "rests"), f"phrases-{k}")
        found.append(level)
    if not found:
        return docs.sparkSession.createDataFrame([], "lang string, words int, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")
    parts = []
    for k, here in enumerate(found, 2):
        if k - 1 < len(found):
            # A phrase inside a longer one of the same count is also inside one that is one word longer.
            longer = found[k - 1]
            inside = longer.select(F.col("p").alias("id"), "a").unionByName(longer.select(F.col("q").alias("id"), "a"))
            most = inside.groupBy("id").agg(F.max("a").alias("_most"))
            here = here.join(most, "id", "left").filter(F.col("_most").isNull() | (F.col("_most") < F.col("a")))
        scored = here.join(totals, "lang").withColumn("cut", _cut_scores(k, F.col("a"), F.col("n"), F.col("firsts"), F.col("rests")))
        parts.append(scored.select("lang", F.lit(k).alias("words"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def top_phrases(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of each language; ties by count, then phrase."""
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = phrases(docs).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "words")


PHRASE_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN_LANG}') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), '{_UPPER.decode()}', '{_LOWER.decode()}'), '[.,;:!?\n\v\f\r]')) AS piece
  FROM documents
), split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces
), lists AS (SELECT * FROM split WHERE len(w) > 0
), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_slice(w, i, i + k - 1))) AS g
  FROM lists, range(1, {LONGEST + 1}) AS r(k) WHERE len(w) >= k
), f AS (SELECT lang, k, g, count(*) AS a FROM grams GROUP BY lang, k, g HAVING count(*) >= {LEAST}
), cuts AS (
  SELECT c.lang, c.k, c.g, c.a, l.a AS l, r.a AS r, t.n, l.k AS at_,
    (1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS score
  FROM f c JOIN f l ON l.lang = c.lang AND l.k < c.k AND l.g = list_slice(c.g, 1, l.k)
  JOIN f r ON r.lang = c.lang AND r.k = c.k - l.k AND r.g = list_slice(c.g, l.k + 1, c.k)
  JOIN totals t ON t.lang = c.lang
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, at_) = 1
), inside AS (
  SELECT lang, unnest([list_slice(g, 1, k - 1), list_slice(g, 2, k)]) AS g, a FROM f WHERE k > 2
), most AS (SELECT lang, g, max(a) AS a FROM inside GROUP BY lang, g
), kept AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, b.n, b.score::BIGINT AS score, b.k::INTEGER AS words
  FROM best b LEFT JOIN most m ON m.lang = b.lang AND m.g = b.g WHERE coalesce(m.a, 0) < b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score, words
FROM kept QUALIFY rank <= {TOP}
"""
