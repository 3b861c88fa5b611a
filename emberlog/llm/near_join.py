"""Jaccard join of word-shingle sets by parity sketches.

The sketch of a set has B words of 64 bits: every shingle XORs its hash into one word, chosen by the hash.
A shingle that only one of two sets has can change one word, so the number of words that differ (the
sketches' Hamming distance over words) is a lower bound of the symmetric difference. Sets with likeness
of at least t have a symmetric difference of at most d = (1 - t) / (1 + t) of their summed sizes, so with
B = d + 1 words at least one is equal (pigeonhole). Sets meet per band of sizes: B depends on the band
alone, and a set near the upper end of its band also enters the next one. Sets with an equal word are
candidates and are verified exactly.

Candidates are first compared by size and by a sketch of parity bits, whose Hamming distance bounds the
symmetric difference in the same way. Groups of copies do not turn into all pairs. Equal texts are one node; the nodes of a bucket are verified
against its smallest node, links are merged into classes, and only nodes that still are in different
classes meet again within their bucket.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.functions.once import once
from emberlog.llm.components import components
from emberlog.llm.frames import ship_with_tasks, small_batches
from emberlog.session import discard, stage

ship_with_tasks(__name__)

WIDTH = 3
PERCENT = 90
#: Sketches of fewer words also meet in words that no shingle falls in. In longer sketches these words
#: are left out: a pair just at the threshold, at its band's upper end, loses its only equal word with a chance of
#: B! / B^(B - 1) that each difference has its own word, times that of an empty last one: 1e-13 at 80 % and B = 32.
FEW_WORDS = 32
#: A band's largest size over its smallest.
BAND = 1.3
ROWS_OUT = 200_000
#: Sketch words are shuffled in so many parts, one after the other, to keep less on disk; sketches are made once for each.
PASSES = 2
#: 64-bit words of the parity bits that candidates are compared by before they are verified.
BIT_WORDS = 8

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal numbers stay equal, others spread."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, A-Z lower-cased; a shorter text is one shingle."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(width, len(words))
    many = len(words) - span + 1
    acc = np.full(many, span, np.uint64)
    for k in range(span):
        acc = mixed(acc * MULTIPLIER + hashes[k : k + many])
    return np.unique(acc)


def band_starts(percent: int, up_to: int = 1 << 40) -> list[int]:
    """Smallest size of each band; a set can only be linked within its band and the two beside it."""
    starts = [1]
    while starts[-1] < up_to:
        starts.append(max(int(starts[-1] * BAND), starts[-1] * 100 // percent + 1))
    return starts


def sketch_keys(shingles: np.ndarray, percent: int, starts: list[int]) -> np.ndarray:
    """One 64-bit key per sketch word of a set, in each band it enters."""
    n = len(shingles)
    band = int(np.searchsorted(starts, n, "right")) - 1
    bands = [band, band + 1] if 100 * n >= percent * starts[band + 1] else [band]
    keys, spread = [], mixed(shingles)
    for b in bands:
        most = starts[b + 1] - 1
        count = 2 * most * (100 - percent) // (100 + percent) + 1
        # Shingles are sorted, so those of one word are neighbours.
        word = ((shingles >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        value = np.bitwise_xor.reduceat(spread, first)
        at = word[first]
        if count < FEW_WORDS:
            full = np.zeros(count, np.uint64)
            full[at.astype(np.int64)] = value
            value, at = full, np.arange(count, dtype=np.uint64)
        keys.append(mixed(value + mixed(at * MULTIPLIER + np.uint64(b + 1))))
    return np.concatenate(keys)


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """BIT_WORDS * 64 parity bits: every shingle flips one, so two sets' bits differ in no more places
    than their symmetric difference has shingles."""
    spread = mixed(shingles ^ MULTIPLIER)
    flips = np.bincount((spread % np.uint64(64 * BIT_WORDS)).astype(np.int64), minlength=64 * BIT_WORDS) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


def _described(width: int):
    """(node, text) -> (node, text, size, parity bits)."""
    names = ["node", "text", "n", *[f"s{i}" for i in range(BIT_WORDS)]]

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch.column(1)]
            bits = np.array([parity_bits(s) for s in sets], np.int64).reshape(-1, BIT_WORDS)
            columns = [*batch.columns, pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, bits.T)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return described


def possible(percent: int, one: str = "_1", two: str = "_2") -> Column:
    """Whether sizes and parity bits of two sets allow the likeness; true for every linked pair."""
    n1, n2 = F.col("n" + one), F.col("n" + two)
    apart = sum((F.bit_count(F.col(f"s{i}{one}").bitwiseXOR(F.col(f"s{i}{two}"))) for i in range(BIT_WORDS)), F.lit(0))
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & ((100 + percent) * apart <= (100 - percent) * (n1 + n2))


def _sketches(width: int, percent: int, turn: int = 0, turns: int = 1):
    """(node, text) -> (part, key, node, kind, n): kind 0 and 1 are sketch words, 2 has the set's size.

    Rows of equal ``key`` belong to the same of ``turns`` turns. Combines before the shuffle: of the nodes in a batch with the same word, the first goes to the word's
    task; the others, known to have company (kind 1), are dealt by their own number.
    """
    starts = band_starts(percent)
    names = ["part", "key", "node", "kind", "n"]

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, first = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)
            keys, sizes = [], []
            for i in first:
                shingles = shingle_set(batch.column(1)[int(i)].as_py(), width)
                sizes.append(len(shingles))
                keys.append(sketch_keys(shingles, percent, starts) if len(shingles) else np.empty(0, np.uint64))
            key = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
            node = np.repeat(nodes, [len(k) for k in keys])
            mine, own = key % turns == turn, nodes % turns == turn
            key, node, nodes, sizes = key[mine], node[mine], nodes[own], np.asarray(sizes, np.int64)[own]
            order = np.argsort(key, kind="stable")
            key, node = key[order], node[order]
            new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.empty(0, bool)
            alone = new & np.r_[new[1:], True] if len(key) else new
            part = np.where(new, key, node)
            kind = np.where(alone, 0, 1).astype(np.int8)
            part, key = np.r_[part, nodes], np.r_[key, nodes]
            node, kind = np.r_[node, nodes], np.r_[kind, np.full(len(nodes), 2, np.int8)]
            n = np.r_[np.zeros(len(order), np.int64), sizes]
            for at in range(0, len(part), ROWS_OUT):
                cut = [pa.array(c[at : at + ROWS_OUT]) for c in (part, key, node, kind, n)]
                yield pa.RecordBatch.from_arrays(cut, names=names)

    return sketches


def _verified(width: int, percent: int):
    """(a, b, text_a, text_b) -> the pairs (a, b) whose sets are linked."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def of(node: int, text: str) -> np.ndarray:
            if node not in known:
                if len(known) > 200:
                    known.clear()
                known[node] = shingle_set(text, width)
            return known[node]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for i in range(len(a)):
                one, two = of(a[i], batch.column(2)[i].as_py()), of(b[i], batch.column(3)[i].as_py())
                common = len(np.intersect1d(one, two, assume_unique=True))
                good.append(100 * common >= percent * (len(one) + len(two) - common) and common > 0)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return verified


def text_nodes(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` with ``_text`` (null: empty) and its 64-bit hash ``_node``; equal texts are one node."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("_text")
    return once(docs.select(*columns, text).withColumn("_node", F.xxhash64("_text")), "_node")


def _pairs(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


class Links:
    """The steps of the join over the texts of ``docs``; ``made`` gets the paths of the tables that ``sizes`` reads."""

    def __init__(self, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT):
        self.docs, self.width, self.percent = docs, width, percent
        self.made: list[str] = []
        small_batches(docs.sparkSession)
        kept = reduce(DataFrame.unionByName, [self._shared_words(turn) for turn in range(PASSES)])
        self.buckets = kept.filter("kind < 2").select("key", "node").distinct()
        self.sizes = kept.filter("kind = 2").groupBy("node").agg(F.max("n").alias("n_shingles"))

    def _shared_words(self, turn: int) -> DataFrame:
        """The sketch words of one turn that several nodes have, and the sizes of its nodes."""
        rows = text_nodes(self.docs).select("_node", "_text").mapInArrow(
            _sketches(self.width, self.percent, turn, PASSES), "part bigint, key bigint, node bigint, kind tinyint, n bigint"
        )
        same = Window.partitionBy("part", "key")
        shared = rows.withColumn("_lo", F.min("node").over(same)).withColumn("_hi", F.max("node").over(same))
        return stage(shared.filter("kind > 0 or _lo <> _hi").select("key", "node", "kind", "n"), "sketch-words", self.made)

    def verify(self, pairs: DataFrame) -> DataFrame:
        left = self.texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        right = self.texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        met = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        return met.mapInArrow(_verified(self.width, self.percent), "a bigint, b bigint")

    def classes(self) -> DataFrame:
        """node, root of every node that is linked to another one.

        Tables are deleted as soon as those that follow from them are written, and pairs are written before texts join them.
        """
        spark = self.docs.sparkSession
        of_buckets: list[str] = []
        of_texts: list[str] = []
        buckets = stage(self.buckets, "buckets", of_buckets)
        wanted = buckets.select(F.col("node").alias("_node")).distinct()
        found = text_nodes(self.docs).join(wanted, "_node", "left_semi").dropDuplicates(["_node"])
        bits = ", ".join(f"s{i} bigint" for i in range(BIT_WORDS))
        self.texts = stage(
            found.select("_node", "_text").mapInArrow(_described(self.width), f"node bigint, text string, n bigint, {bits}"),
            "candidate-texts",
            of_texts,
        )
        facts = self.texts.drop("text")
        likely = possible(self.percent)

        def facts_of(node: str, suffix: str) -> DataFrame:
            return facts.select(*[F.col(c).alias(node if c == "node" else c + suffix) for c in facts.columns])

        pivots = buckets.groupBy("key").agg(F.min("node").alias("pivot"))
        met = buckets.join(pivots, "key").filter("node <> pivot").select(*_pairs(F.col("node"), F.col("pivot"))).distinct()
        first = met.join(facts_of("a", "_1"), "a").join(facts_of("b", "_2"), "b").filter(likely).select("a", "b")
        first = stage(first, "pairs", of_buckets)
        links = stage(self.verify(first), "links")
        rooted = buckets.join(components(links), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        of_roots: list[str] = []
        rooted = stage(rooted, "rooted", of_roots)
        discard(spark, of_buckets)
        split = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
        of_open: list[str] = []
        open_ = stage(rooted.join(split, "key").join(facts, "node"), "open-buckets", of_open)
        discard(spark, of_roots)
        one = open_.select("key", *[F.col(c).alias(c + "_1") for c in open_.columns if c != "key"])
        two = open_.select("key", *[F.col(c).alias(c + "_2") for c in open_.columns if c != "key"])
        rest = one.join(two, (one["key"] == two["key"]) & (F.col("root_1") < F.col("root_2")) & likely)
        rest = stage(rest.select(*_pairs(F.col("node_1"), F.col("node_2"))).distinct(), "pairs", of_texts)
        discard(spark, of_open)
        more = stage(self.verify(rest), "links")
        discard(spark, of_texts)
        return components(links.unionByName(more))


def near_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every document.

    Two documents link when their sets of ``width``-word shingles (A-Z lower-cased) have a likeness of at
    least ``percent`` %. Texts with fewer words are one shingle; null, empty and blank texts have none and
    link with nothing. Null ids are in their class but never name it (null if it has no other id). Repeated
    rows stay; an empty table gives an empty result. Other columns are not read.
    """
    links = Links(docs, width, percent)
    roots = links.classes()
    narrow = text_nodes(docs, "doc_id").select("doc_id", F.col("_node").alias("node"))
    rooted = (
        narrow.join(links.sizes, "node")
        .join(roots, "node", "left")
        .select("doc_id", "n_shingles", "node", F.coalesce("root", "node").alias("root"))
    )
    rooted = stage(rooted, "document-classes")
    discard(docs.sparkSession, links.made)
    names = rooted.groupBy("root").agg(F.min("doc_id").alias("_name"))
    return rooted.join(names, "root").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("_name")).alias("component_id"), "node", "root",
    )


def one_of_each_group(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each class: the smallest id (null last), then text hash.

    Rows equal in id and text count as one, except those without words, which all stay.
    """
    classes = stage(near_classes(docs, width, percent).select("doc_id", "n_shingles", "node", "root"), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), F.col("node").alias("node"))
    chosen = classes.filter("n_shingles > 0").groupBy("root").agg(F.min(order).alias("_best")).select(
        F.col("_best.id").alias("_id"), F.col("_best.node").alias("_of")
    )
    row = F.struct(*docs.columns).alias("_row")
    rows = once(docs.select(row).withColumn("_key", F.xxhash64(F.coalesce(F.col("_row.text"), F.lit("")))), "_key")
    blank = ~F.coalesce(F.col("_row.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")

    def named(df: DataFrame, doc: str) -> DataFrame:
        """``_late`` and ``_doc`` tell ids apart without nulls, so that one shuffle serves the dropping and the join."""
        some = F.lit(0).cast(docs.schema["doc_id"].dataType)
        return df.withColumns({"_late": F.col(doc).isNull(), "_doc": F.coalesce(F.col(doc), some)})

    keys = ["_key", "_late", "_doc"]
    single = named(rows.filter(~blank), "_row.doc_id").dropDuplicates(keys)
    best = single.join(named(chosen, "_id").select(F.col("_of").alias("_key"), "_late", "_doc"), keys).select("_row.*")
    return best.unionByName(rows.filter(blank).select("_row.*"))
