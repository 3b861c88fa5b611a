"""Secret scans: Aho-Corasick keyword prefilter, anchored expressions near hits, embedded checksums.

One automaton holds the words that start an assignment, the access-key prefix, the prefixes of token
formats with a built-in checksum, and all four-character hexadecimal strings (every run of hexadecimal
characters starts with one). It runs once over the text; an expression is tried only at a hit, anchored
there.
"""

import re
import zlib
from collections.abc import Iterator
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.frames import ship_with_tasks, small_batches

ship_with_tasks(__name__)

ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Token formats whose last six characters are the base-62 CRC-32 of the thirty before them.
CHECKED_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", "checked")

SPANS = "array<struct<start:bigint,kind:int,end:bigint,valid:boolean>>"


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        found.add_word(word, (0, len(word)))
    found.add_word("akia", (1, 4))
    for prefix in CHECKED_PREFIXES:
        found.add_word(prefix, (3, len(prefix)))
    for four in product("0123456789abcdef", repeat=4):
        found.add_word("".join(four), (2, 4))
    found.make_automaton()
    return found


def crc_base62(body: str) -> str:
    number, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        number, digit = divmod(number, 62)
        digits = BASE62[digit] + digits
    return digits


def find_secrets(text: str, words: ahocorasick.Automaton) -> list[tuple[int, int, int, bool | None]]:
    """(start, kind, end, valid) of a text's secrets by start, then kind.

    valid is None without an embedded checksum; tokens of a checked format whose checksum is wrong are
    no secrets. Per kind, matches are leftmost and do not overlap; too short ones are dropped.
    """
    ends, found = [0, 0, 0, 0], []
    # Lower case of A-Z only, so that positions stay the same.
    for last, (kind, length) in words.iter(text.encode("utf-8", "replace").lower().decode("utf-8")):
        start = last - length + 1
        if start < ends[kind]:
            continue
        if kind == 2:
            match = HEX.match(text, start)
            good = match and match.end() - start >= 24
        elif kind == 0:
            match = ASSIGN.match(text, start)
            good = match and len(match[2]) >= 6
        elif kind == 1:
            match = ACCESS.match(text, start)
            good = match and match.end() - start >= 20
        else:
            match = CHECKED.match(text, start)
            good = match and crc_base62(match[1]) == match[2]
        if match:
            ends[kind] = match.end()
        if good:
            found.append((start, kind, match.end(), True if kind == 3 else None))
    return sorted(found, key=lambda s: s[:2])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = automaton()
    kind = pa.list_(
        pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("valid", pa.bool_())])
    )
    for batch in batches:
        spans = []
        for text in batch.column("_text"):
            text = text.as_py()
            found = find_secrets(text, words) if text else []
            spans.append([{"start": a, "kind": k, "end": b, "valid": v} for a, k, b, v in found])
        names = [n for n in batch.schema.names if n != "_text"]
        columns = [batch.column(n) for n in names] + [pa.array(spans, kind)]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "_spans"])


def secret_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` of every row with ``_spans``: start, kind (index in KINDS), end, valid.

    Positions are code points, ends exclusive. Null text is empty; an empty table gives an empty result;
    repeated rows give repeated rows. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(_scan, f"{schema}, _spans {SPANS}" if schema else f"_spans {SPANS}")


def span_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts per kind, digest of the base spans and all spans of every document."""
    found = secret_spans(docs, keep=("doc_id",))
    spans = F.col("_spans")

    def count(kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    base = F.filter(spans, lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        count(3).alias("n_checked"), F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
    )


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; overlapping spans by one mark.

    Rows and columns stay; null text stays null.
    """
    small_batches(docs.sparkSession)

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for text in batch.column(at).to_pylist():
                if text:
                    parts, done = [], 0
                    for start, _, end, _ in find_secrets(text, words):
                        if start >= done:
                            parts += [text[done:start], mark]
                        done = max(done, end)
                    text = "".join([*parts, text[done:]]) if parts else text
                texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(redact, docs.schema)
