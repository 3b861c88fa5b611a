"""The prefix trie of conversations by vertical bitmaps.

Within a shard (a block of conversations and a block of positions) an index maps (position, turn) to the bitset of
the conversations that have that turn there. Nodes are found depth first: a node's bitset, intersected with the postings
of the next position, gives its children; what ends there is an end list. Counts are population counts. A node is known by
two 64-bit names, the exclusive-or of the position-bound names of its turns, so shards agree on nodes and
their counts are added up by an aggregate; sums over subtrees follow from one aggregate over (conversation, node) rows.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.frames import global_row_numbers, rolled, ship_with_tasks
from emberlog.session import stage

ship_with_tasks(__name__)

#: A conversation takes up to GRAFT - 1 turns from the first conversation of its block of FAMILY ids.
FAMILY, GRAFT = 5, 9
#: Positions and conversations per shard; a shard holds at most their product of rows.
POSITIONS, CONVERSATIONS = 256, 512
#: Rows per block when a conversation is cut for a join.
CUT = 1024

SHARD_COLUMNS = ("_conv", "_rank", "_pos", "_t1", "_t2", "_n1", "_n2", "_bytes", "_length")
NODE_COLUMNS = ["n1", "n2", "p1", "p2", "depth", "n_convs", "conv_id", "bytes", "shard", "ends"]
NODE_SCHEMA = ", ".join(f"{c} bigint" for c in NODE_COLUMNS[:-1]) + ", ends array<bigint>"


def _placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (_conv, _at from 1, _row, _r1, _r2, _bytes) and conversations (_conv, _first row, _last row)."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    clean = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("_conv"), F.col("turn").alias("_turn"), role.alias("_role"), text.alias("_text")
    )
    names = [F.xxhash64(F.lit(i), F.length("_role"), "_role", "_text").alias(f"_r{i}") for i in (1, 2)]
    order = [F.col("_conv"), F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_text")]
    keep = [F.col("_conv"), *names, F.octet_length("_text").cast("long").alias("_bytes")]
    rows = global_row_numbers(clean, order, "_row", keep)
    convs = stage(rows.groupBy("_conv").agg(F.min("_row").alias("_first"), F.max("_row").alias("_last")), "conversations")
    cuts = convs.select(
        F.col("_conv").alias("_c"), "_first",
        F.explode(F.sequence(F.floor(F.col("_first") / CUT), F.floor(F.col("_last") / CUT))).alias("_cut"),
    )
    met = rows.join(cuts, (F.col("_conv") == F.col("_c")) & (F.floor(F.col("_row") / CUT) == F.col("_cut")))
    return met.withColumn("_at", F.col("_row") - F.col("_first") + 1).drop("_c", "_cut", "_first"), convs


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """_conv, _rank (of the id), _pos, _t1, _t2 (position-bound names of the turn), _bytes, _length of the rebuilt conversations.

    Conversation c begins with the first h turns of conversation c - c % FAMILY, h = crc32(decimal c) % GRAFT, and goes on with its
    own turns after its first h. Every conversation also has a row at position 0, names and bytes 0: the root.
    """
    placed, convs = _placed(turns)
    placed = stage(placed, "placed-turns")
    h = (F.crc32(F.col("_conv").cast("string").cast("binary")) % GRAFT).alias("_h")
    base = (F.col("_conv") - F.pmod("_conv", F.lit(FAMILY))).alias("_base")
    ranked = global_row_numbers(convs, [F.col("_conv")], "_rank").select("*", h, base)
    bases = convs.select(F.col("_conv").alias("_base2"), (F.col("_last") - F.col("_first") + 1).alias("_had"))
    grafts = ranked.join(bases, F.col("_base") == F.col("_base2"), "left").drop("_base2")
    own_rows = F.greatest(F.col("_last") - F.col("_first") + 1 - F.col("_h"), F.lit(0))
    grafts = grafts.withColumn("_m", F.least("_h", F.coalesce("_had", F.lit(0))))
    grafts = stage(grafts.withColumn("_length", F.col("_m") + own_rows), "grafts")
    # At most FAMILY conversations share a base, and GRAFT - 1 of its turns are taken.
    heads = placed.filter(F.col("_at") < GRAFT).withColumnRenamed("_conv", "_from")
    taken = heads.join(grafts, (F.col("_from") == F.col("_base")) & (F.col("_at") <= F.col("_m")))
    cuts = grafts.select(
        F.col("_conv").alias("_c"), "_rank", "_h", "_m", "_length",
        F.explode(F.sequence(F.floor(F.col("_first") / CUT), F.floor(F.col("_last") / CUT))).alias("_cut"),
    )
    own = placed.join(cuts, (F.col("_conv") == F.col("_c")) & (F.floor(F.col("_row") / CUT) == F.col("_cut"))).filter("_at > _h")
    columns = ["_conv", "_rank", "_pos", "_r1", "_r2", "_bytes", "_length"]
    both = taken.withColumn("_pos", F.col("_at")).select(*columns).unionByName(
        own.withColumn("_pos", F.col("_m") + F.col("_at") - F.col("_h")).select(*columns)
    )
    bound = [F.xxhash64(F.lit(i), "_pos", f"_r{i}").alias(f"_t{i}") for i in (1, 2)]
    zero = F.lit(0).cast("long")
    root = grafts.select("_conv", "_rank", zero.alias("_pos"), zero.alias("_t1"), zero.alias("_t2"), zero.alias("_bytes"), "_length")
    return both.select("_conv", "_rank", "_pos", *bound, "_bytes", "_length").unionByName(root)


def _bits(members: np.ndarray, size: int) -> int:
    """A bitset of the given members as an integer."""
    if len(members) == 1:
        return 1 << int(members[0])
    flags = np.zeros(size, np.uint8)
    flags[members] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _bitsets(members: np.ndarray, starts: np.ndarray, size: int) -> list[int]:
    """The bitsets of the runs of members that begin at ``starts``."""
    ends = np.r_[starts[1:], len(members)]
    return [_bits(members[a:b], size) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _members(bits: int) -> list[int]:
    """The members of a bitset, ascending."""
    raw = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


def _shard_nodes(rows: pa.Table) -> pa.Table:
    """The nodes at the positions of one shard, from its rows (columns of SHARD_COLUMNS); depth first from where they enter."""
    c = {n: rows.column(n).to_numpy() for n in SHARD_COLUMNS}
    order = np.lexsort((c["_pos"], c["_conv"]))
    c = {n: v[order] for n, v in c.items()}
    ids, start, of = np.unique(c["_conv"], return_index=True, return_inverse=True)
    low, last = int(c["_pos"].min()), c["_pos"][np.r_[start[1:], len(of)] - 1]
    turn = np.stack([c["_t2"], c["_t1"], c["_pos"]])
    by = np.lexsort(turn)
    new = np.r_[True, (turn[:, by][:, 1:] != turn[:, by][:, :-1]).any(0)]
    posting = np.empty(len(by), np.int64)
    posting[by] = np.cumsum(new) - 1
    bitsets = _bitsets(of[by], np.flatnonzero(new), len(ids))
    first = by[new]
    t1, t2, size = (c[n][first].tolist() for n in ("_t1", "_t2", "_bytes"))

    def at_position(chosen: np.ndarray) -> dict[int, int]:
        """Position -> bitset of the chosen conversations whose last row here is there."""
        return {int(p): _bits(chosen[last[chosen] == p], len(ids)) for p in np.unique(last[chosen])}

    everyone = np.arange(len(ids))
    leaves_here, ends_here = at_position(everyone), at_position(everyone[last == c["_length"][start]])
    entry = np.stack([c["_t1"] ^ c["_n1"], c["_t2"] ^ c["_n2"]])[:, start]
    by = np.lexsort(entry)
    new = np.flatnonzero(np.r_[True, (entry[:, by][:, 1:] != entry[:, by][:, :-1]).any(0)])
    entered = zip(entry[0, by[new]].tolist(), entry[1, by[new]].tolist(), _bitsets(by, new, len(ids)), strict=True)
    stack = [(n1, n2, low - 1, bits) for n1, n2, bits in entered]
    start, posting, ids, found, ends = start.tolist(), posting.tolist(), ids.tolist(), [], []
    while stack:
        n1, n2, at, left = stack.pop()
        left &= ~leaves_here.get(at, 0)
        at += 1
        while left:
            least = (left & -left).bit_length() - 1
            k = posting[start[least] + at - low]
            child = left & bitsets[k]
            left ^= child
            c1, c2 = n1 ^ t1[k], n2 ^ t2[k]
            found.append((c1, c2, n1, n2, at, child.bit_count(), ids[least], size[k]))
            ends.append([ids[i] for i in _members(child & ends_here.get(at, 0))])
            stack.append((c1, c2, at, child))
    columns = [pa.array(column, pa.int64()) for column in zip(*found, strict=True)]
    shard = pa.array(np.full(len(found), c["_rank"][0] // CONVERSATIONS))
    return pa.Table.from_arrays([*columns, shard, pa.array(ends, pa.list_(pa.int64()))], names=NODE_COLUMNS)


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n1, n2, ends ordered by node and shard -> n1, n2, ends_sha256; holds one list at a time."""
    now, digest, out = None, None, ([], [], [])

    def close() -> None:
        for column, value in zip(out, (*now, digest.hexdigest()), strict=True):
            column.append(value)

    for batch in batches:
        for n1, n2, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            text = ",".join(map(str, ends.as_py()))
            if (n1, n2) == now:
                digest.update(f",{text}".encode())
                continue
            if now:
                close()
            now, digest = (n1, n2), hashlib.sha256(text.encode())
        yield pa.RecordBatch.from_arrays(_columns(out), names=["n1", "n2", "ends_sha256"])
        out = ([], [], [])
    if now:
        close()
        yield pa.RecordBatch.from_arrays(_columns(out), names=["n1", "n2", "ends_sha256"])


def _columns(out: tuple[list, list, list]) -> list[pa.Array]:
    return [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]


def prefix_trie(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    Turns go by number (null first), then role and text; null role and text are empty, repeated rows are turns of their own, rows
    without conv_id belong to no conversation. A table without conversations has no nodes. Other columns are not read.
    """
    paths = rolled(
        rebuilt_turns(turns), "_conv", "_pos", POSITIONS, {"_n1": (F.bit_xor, "_t1", 0), "_n2": (F.bit_xor, "_t2", 0)}
    )
    paths = stage(paths, "conversation-paths")
    shards = [F.floor(F.col("_rank") / CONVERSATIONS).alias("_s"), F.floor(F.col("_pos") / POSITIONS).alias("_b")]
    found = stage(paths.groupBy(*shards).applyInArrow(_shard_nodes, NODE_SCHEMA), "shard-nodes")
    merged = found.groupBy("n1", "n2").agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.min("conv_id").alias("conv_id"), F.min("bytes").alias("bytes"),
    )
    merged = stage(merged, "trie-nodes")
    children = merged.filter("depth > 0").groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = merged.join(children, ["n1", "n2"], "left").withColumns(
        {"n_children": F.coalesce("n_children", F.lit(0)), "_leaf": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long"),
         "_saved": (F.col("n_convs") - 1) * F.col("bytes")}
    )
    # The nodes that a conversation is the smallest member of are the end of its path, from _since on.
    nodes = stage(rolled(nodes, "conv_id", "depth", POSITIONS, {"_leaves": (F.sum, "_leaf", 0), "_saves": (F.sum, "_saved", 0)}, back=True), "trie-sums")
    owners = nodes.groupBy(F.col("conv_id").alias("_conv2")).agg(
        F.min("depth").alias("_since"), F.sum("_leaf").alias("_l"), F.sum("_saved").alias("_w"), F.max("depth").alias("_until")
    )
    cuts = owners.select("_conv2", "_since", "_l", "_w", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_until") / CUT))).alias("_cut"))
    met = paths.join(cuts, (F.col("_conv") == F.col("_conv2")) & (F.floor(F.col("_pos") / CUT) == F.col("_cut")) & (F.col("_pos") < F.col("_since")))
    others = met.groupBy(F.col("_n1").alias("n1"), F.col("_n2").alias("n2")).agg(F.sum("_l").alias("_ol"), F.sum("_w").alias("_ow"))
    ended = (
        found.filter(F.size("ends") > 0).select("n1", "n2", "shard", "ends")
        .repartition("n1", "n2").sortWithinPartitions("n1", "n2", "shard").select("n1", "n2", "ends")
        .mapInArrow(_end_hashes, "n1 bigint, n2 bigint, ends_sha256 string")
    )
    parents = merged.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("_parent"))
    whole = nodes.join(others, ["n1", "n2"], "left").join(ended, ["n1", "n2"], "left").join(parents, ["p1", "p2"])
    zero, nothing = F.lit(0), F.lit(hashlib.sha256(b"").hexdigest())
    return whole.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("_parent")).alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("_leaves") + F.coalesce("_ol", zero)).alias("n_leaves"), (F.col("_saves") + F.coalesce("_ow", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


# CRC-32 by its reflected polynomial, bit by bit.
_CRC_SQL = (
    "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), "
    "lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
)
TRIE_SQL = f"""
WITH placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS at_
  FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (SELECT conv_id, count(*) AS n, {_CRC_SQL} % {GRAFT} AS h FROM placed GROUP BY conv_id
), convs AS (
  SELECT s.conv_id, s.h, b.conv_id AS base, least(s.h, coalesce(b.n, 0)) AS m
  FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.conv_id - s.conv_id % {FAMILY}
), rebuilt AS (
  SELECT c.conv_id, p.at_ AS pos, p.role, p.text FROM convs c JOIN placed p ON p.conv_id = c.base AND p.at_ <= c.m
  UNION ALL
  SELECT c.conv_id, c.m + p.at_ - c.h, p.role, p.text FROM convs c JOIN placed p ON p.conv_id = c.conv_id AND p.at_ > c.h
  UNION ALL
  SELECT conv_id, 0, '', '' FROM convs
), paths AS (
  SELECT conv_id, pos, CASE WHEN pos > 0 THEN octet_length(encode(text)) ELSE 0 END AS bytes, sha256(string_agg(
    CASE WHEN pos > 0 THEN length(role) || ':' || role || length(text) || ':' || text ELSE '' END, '/')
    OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS node,
    count(*) OVER (PARTITION BY conv_id) - 1 AS length
  FROM rebuilt
), links AS (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY pos) AS parent FROM paths
), nodes AS (
  SELECT node, any_value(pos) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
    any_value(bytes) AS bytes, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE pos = length), '') AS ends
  FROM links GROUP BY node
), kids AS (SELECT parent, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), sums AS (
  SELECT p.node, sum((k.n IS NULL)::INTEGER)::BIGINT AS n_leaves, sum((u.n_convs - 1) * u.bytes)::BIGINT AS saved_tokens
  FROM nodes u LEFT JOIN kids k ON k.parent = u.node JOIN paths p ON p.conv_id = u.conv_id AND p.pos <= u.depth GROUP BY p.node
)
SELECT v.conv_id, v.depth, up.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, s.saved_tokens,
  sha256(v.ends) AS ends_sha256
FROM nodes v JOIN sums s USING (node) LEFT JOIN kids k ON k.parent = v.node LEFT JOIN nodes up ON up.node = v.parent
"""
