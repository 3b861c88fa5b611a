"""Packing documents into training windows by Karmarkar-Karp multiway differencing.

Documents are tokenised where they are read. Full windows are cut off long documents; what is left is
cut into pieces and collected into blocks. A block's pieces are dealt to windows by differencing: the two
partial partitions with the largest imbalance are merged, the fullest part of one with the emptiest
of the other, until one partition with near-equal windows is left. If a window then exceeds the capacity,
the block gets one window more. Nothing is shuffled; a block has a fixed number of pieces.
"""

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.frames import ship_with_tasks, small_batches

ship_with_tasks(__name__)

CAPACITY = 1024
#: Longest piece of what a document leaves after its full windows.
PIECE = 256
#: Pieces that are dealt together; a task's last block has up to twice as many.
BLOCK = 256
#: Distinct chunks whose ids a worker remembers (memory bound, not a result).
REMEMBERED = 300_000
VOCABULARY = "byte_bpe_50k"
END_ID = 0
SPECIAL = "<|endoftext|>"

#: White space other than blanks and line ends; texts with it, or with runs of both, are cut with more care.
OTHER_SPACE = re.compile(r"[^\S \n]")
CUT = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit integers.

    A pre-token never reaches across a single blank between two other characters, so a text is encoded
    chunk by chunk and the ids of chunks seen before are looked up.
    """

    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        self.file = public_tokenizers.path(f"{name}.json")
        lines = open(public_tokenizers.path(f"{name}.tiktoken"), "rb")
        with lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.seen: dict[str, bytes] = {}
        self.full = None

    def _plain(self, chunk: str) -> bytes:
        return np.asarray(self.encoding.encode_ordinary(chunk), "<u4").tobytes()

    def _miss(self, chunk: str) -> bytes:
        """The ids of a chunk with the blank before it."""
        ids = self._plain(" " + chunk)
        if len(self.seen) < REMEMBERED and len(chunk) < 40:
            self.seen[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if SPECIAL in text:
            if self.full is None:
                from tokenizers import Tokenizer

                self.full = Tokenizer.from_file(self.file)
            return np.asarray(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        odd = "  " in text or "\n " in text or " \n" in text or text[0] == " " or text[-1] == " "
        chunks = CUT.split(text) if odd or OTHER_SPACE.search(text) else text.split(" ")
        get, miss = self.seen.get, self._miss
        return b"".join([self._plain(chunks[0]), *[get(c) or miss(c) for c in chunks[1:]]])


def difference(lengths: list[int], windows: int) -> list[list[int]]:
    """Indexes of ``lengths`` dealt to ``windows`` parts of near-equal sums, by differencing."""
    heap = []
    for i, length in enumerate(lengths):
        sums = np.zeros(windows, np.int64)
        sums[0] = length
        heap.append((-length, i, sums, [(i,), *[()] * (windows - 1)]))
    heapq.heapify(heap)
    made = len(lengths)
    while len(heap) > 1:
        _, _, sums, parts = heapq.heappop(heap)
        _, _, other, more = heapq.heappop(heap)
        total = sums + other[::-1]
        order = np.argsort(-total, kind="stable")
        joined = [(a, b) if a and b else a or b for a, b in zip(parts, reversed(more), strict=True)]
        total = total[order]
        heapq.heappush(heap, (int(total[-1] - total[0]), made, total, [joined[k] for k in order]))
        made += 1
    return [_flat(part) for part in heap[0][3]] if heap else []


def _flat(part: tuple) -> list[int]:
    """The indexes in a tree of pairs, in order."""
    out, left = [], [part]
    while left:
        top = left.pop()
        if isinstance(top, int):
            out.append(top)
        else:
            left.extend(top)
    return sorted(out)


def deal(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """As few near-equal windows as hold all pieces within the capacity (each piece fits alone)."""
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        parts = difference(lengths, windows)
        most = max((sum(lengths[i] for i in part) for part in parts), default=0)
        if most <= capacity:
            return [part for part in parts if part]
        windows += max(1, windows * (most - capacity) // (2 * capacity))


def _packer(capacity: int, piece: int, block: int, vocabulary: str, id_type: pa.DataType):
    schema = pa.schema(
        [("doc_id", id_type), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
         ("sequence_id", pa.int64()), ("offset", pa.int64())]
    )

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        waiting: list[tuple] = []

        def packed(pieces: list[tuple]) -> list[tuple]:
            nonlocal sequence
            rows = []
            for part in deal([len(p[2]) // 4 for p in pieces], capacity):
                offset = 0
                for i in part:
                    rows.append((*pieces[i], sequence, offset))
                    offset += len(pieces[i][2]) // 4
                sequence += 1
            return rows

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(text.as_py()) + END_ID.to_bytes(4, "little")
                tokens = len(ids) // 4
                start = 0
                while tokens - start >= capacity:
                    rows.append((doc_id, start, ids[4 * start : 4 * (start + capacity)], tokens, sequence, 0))
                    sequence, start = sequence + 1, start + capacity
                while start < tokens:
                    end = min(tokens, start + piece)
                    waiting.append((doc_id, start, ids[4 * start : 4 * end], tokens))
                    start = end
                while len(waiting) >= 2 * block:
                    rows += packed(waiting[:block])
                    del waiting[:block]
            yield frame(rows)
        if waiting:
            yield frame(packed(waiting))

    return pack


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, piece: int = PIECE, block: int = BLOCK, vocabulary: str = VOCABULARY
) -> DataFrame:
    """Pieces of all documents in windows: doc_id, start, ids (binary, 4 bytes each), doc_tokens, sequence_id, offset.

    Null text is empty: such a document is its end mark alone. Every id lies in one piece; a window holds
    at most ``capacity`` ids, gapless from offset 0. Repeated rows and equal ids are packed like any others;
    an empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        _packer(capacity, piece, block, vocabulary, to_arrow_type(id_type)),
        f"doc_id {id_type.simpleString()}, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint",
    )


def packing_report(docs: DataFrame) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack_documents(docs).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )
