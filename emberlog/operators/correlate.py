"""Event correlation: neighbour links, groups of linked events and kill-chain alerts.

Events are listed in the order of ``position`` (ascending). Each event is linked to the next 14 of
its address and the next 7 of its tactic, so links grow with the events and never with their pairs.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.constants.kill_chains import (
    ESCALATION_WEIGHT,
    KILL_CHAINS,
    MIN_MATCH,
    SAME_IP_REACH,
    SAME_IP_WEIGHT,
    SAME_TACTIC_REACH,
    SAME_TACTIC_WEIGHT,
    UNLINKED_ADDRESSES,
    KillChain,
)
from emberlog.functions.text import severity_rank
from emberlog.operators.ranking import row_numbers
from emberlog.session import stage

RANK_BLOCK = 65_536
CHUNK = 8_192
#: Events of a cell; all pairs of two cells are made in one task.
CELL = 1_024


def correlation_nodes(events: DataFrame, newest_first: bool = True) -> DataFrame:
    """Nodes with defaults; ``position`` orders the list (newest id first unless told otherwise).

    Events without ``timestamp`` or ``inserted_at`` get empty texts or NULL times.
    """
    order = -F.col("id") if newest_first else F.col("id")
    stamp = F.col("timestamp") if "timestamp" in events.columns else F.lit("")
    inserted = F.col("inserted_at") if "inserted_at" in events.columns else F.lit(None)
    return events.select(
        "id",
        order.alias("position"),
        F.coalesce("source_ip", F.lit("unknown")).alias("source_ip"),
        F.coalesce("severity", F.lit("INFO")).alias("severity"),
        F.coalesce("tactic", F.lit("")).alias("tactic"),
        F.coalesce("technique_id", F.lit("")).alias("technique_id"),
        F.coalesce(F.col("anomaly_score").cast("double"), F.lit(0.0)).alias("anomaly_score"),
        F.substring(F.coalesce("message", F.lit("")), 1, 80).alias("message"),
        F.coalesce(stamp.cast("string"), F.lit("")).alias("timestamp"),
        inserted.cast("timestamp").alias("inserted_at"),
    )


def _linkable(address: Column) -> Column:
    return address.isNotNull() & ~address.isin(*UNLINKED_ADDRESSES)


def _rank_within(
    df: DataFrame, key: str, rank: str, order: Sequence[str] = ("position",), width: int = RANK_BLOCK
) -> DataFrame:
    """Add the 0-based place of a row within its key in the given order.

    Rows are numbered inside (key, block of the first order column) and shifted by the counts of
    the earlier blocks, so one busy key is spread over many tasks. The second step joins on the
    same keys and adds no shuffle of the rows. Rows with a NULL key get no usable rank.
    """
    keyed = df.withColumn("_block", F.floor(F.col(order[0]) / width))
    local = Window.partitionBy(key, "_block").orderBy(*order)
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.filter(F.col(key).isNotNull())
        .groupBy(key, "_block")
        .agg(F.count("*").alias("_n"))
        .select(key, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    return (
        keyed.withColumn("_local", F.row_number().over(local) - 1)
        .join(offsets, [key, "_block"], "left")
        .withColumn(rank, F.col("_local") + F.col("_offset"))
        .drop("_block", "_local", "_offset")
    )


def ranked_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with their place in the address group (``ip_rank``) and tactic group (``tactic_rank``).

    Rows without a group get a key of their own, NULL ranks and so no links.
    """
    keyed = nodes.withColumn("ip_key", F.when(_linkable(F.col("source_ip")), F.col("source_ip"))).withColumn(
        "tactic_key", F.when(F.col("tactic") != "", F.col("tactic"))
    )
    return _rank_within(_rank_within(keyed, "ip_key", "ip_rank"), "tactic_key", "tactic_rank")


def _following(df: DataFrame, key: str, rank: str, reach: int, carried: list[str]) -> DataFrame:
    """Pairs (u, v) of a row and each of the next ``reach`` rows of its key.

    The key's rows are cut into chunks by rank; the first ``reach`` rows of a chunk are also dealt
    to the chunk before, as partners only.
    """
    chunk = F.floor(F.col(rank) / CHUNK)
    borrowed = (F.col(rank) % CHUNK < reach) & (chunk > 0)
    dealt = df.filter(F.col(rank).isNotNull()).withColumn(
        "_chunk", F.explode(F.when(borrowed, F.array(chunk, chunk - 1)).otherwise(F.array(chunk)))
    )
    ahead = Window.partitionBy(key, "_chunk").orderBy(rank).rowsBetween(1, reach)
    partner = F.struct(*[F.col(c) for c in carried])
    return (
        dealt.withColumn("_ahead", F.collect_list(partner).over(ahead))
        .filter(F.col("_chunk") == chunk)
        .select(key, *carried, F.explode("_ahead").alias("_v"))
    )


def _edge(u: Column, v: Column, relation: str, key: Column, weight: float) -> list[Column]:
    return [
        F.least(u, v).alias("u"),
        F.greatest(u, v).alias("v"),
        F.lit(relation).alias("relation"),
        key.alias("key"),
        F.lit(weight).alias("weight"),
    ]


def _share_address_link(a_key: Column, a_rank: Column, b_key: Column, b_rank: Column) -> Column:
    return F.coalesce((a_key == b_key) & (F.abs(a_rank - b_rank) <= SAME_IP_REACH), F.lit(False))


def same_ip_edges(ranked: DataFrame) -> DataFrame:
    """Links to the next 14 events of the address."""
    pairs = _following(ranked, "ip_key", "ip_rank", SAME_IP_REACH, ["id"])
    return pairs.select(
        *_edge(F.col("id"), F.col("_v.id"), "same_ip", F.col("ip_key"), SAME_IP_WEIGHT)
    )


def same_tactic_edges(ranked: DataFrame) -> DataFrame:
    """Links to the next 7 events of the tactic that share no address link already.

    Whether an address link exists follows from the two rows' addresses and ranks: no join needed.
    """
    pairs = _following(
        ranked, "tactic_key", "tactic_rank", SAME_TACTIC_REACH, ["id", "ip_key", "ip_rank"]
    )
    linked = _share_address_link(
        F.col("ip_key"), F.col("ip_rank"), F.col("_v.ip_key"), F.col("_v.ip_rank")
    )
    return pairs.filter(~linked).select(
        *_edge(F.col("id"), F.col("_v.id"), "same_tactic", F.col("tactic_key"), SAME_TACTIC_WEIGHT)
    )


def escalation_edges(ranked: DataFrame) -> DataFrame:
    """Links from the last event of a severity to the first of the next higher one at the address.

    Sorted by severity, an address has at most four rises, so two events per address and severity
    are enough and the aggregation shrinks before the shuffle.
    """
    row = F.struct("id", "ip_rank", "tactic_key", "tactic_rank")
    ends = (
        ranked.filter(F.col("ip_key").isNotNull())
        .groupBy("ip_key", severity_rank(F.col("severity")).alias("level"))
        .agg(F.min_by(row, "position").alias("first"), F.max_by(row, "position").alias("last"))
    )
    by_level = Window.partitionBy("ip_key").orderBy("level")
    rises = ends.withColumn("v", F.lead("first").over(by_level)).filter(F.col("v").isNotNull())
    same_ip = F.abs(F.col("last.ip_rank") - F.col("v.ip_rank")) <= SAME_IP_REACH
    same_tactic = F.coalesce(
        (F.col("last.tactic_key") == F.col("v.tactic_key"))
        & (F.abs(F.col("last.tactic_rank") - F.col("v.tactic_rank")) <= SAME_TACTIC_REACH),
        F.lit(False),
    )
    return rises.filter(~same_ip & ~same_tactic).select(
        *_edge(F.col("last.id"), F.col("v.id"), "severity_escalation", F.col("ip_key"), ESCALATION_WEIGHT)
    )


def correlation_edges(nodes: DataFrame) -> DataFrame:
    """All links, one per pair: address before tactic before escalation."""
    ranked = stage(
        ranked_nodes(nodes.select("id", "position", "source_ip", "severity", "tactic")),
        "ranked-nodes",
    )
    return (
        same_ip_edges(ranked)
        .unionByName(same_tactic_edges(ranked))
        .unionByName(escalation_edges(ranked))
    )


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return (
        edges.groupBy("relation").agg(F.count("*").alias("n_edges")).orderBy(F.desc("n_edges"), "relation")
    )


def _merge_links(links: DataFrame) -> DataFrame:
    """Components of links: each name takes the smallest label around it until none changes.

    Labels also jump to their label's label each round, so long chains shrink quickly. Every round
    is written to the staging folder.
    """
    both = stage(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "links",
    )
    labels = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        around = (
            both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        )
        jump = labels.select(F.col("a").alias("label"), F.col("label").alias("jump"))
        moved = (
            labels.join(around, "a")
            .join(jump, "label", "left")
            .select(
                "a",
                F.least("label", "near", F.coalesce("jump", "label")).alias("label"),
                (F.least("label", "near", F.coalesce("jump", "label")) < F.col("label")).alias("changed"),
            )
        )
        moved = stage(moved, "labels")
        labels = moved.select("a", "label")
        if moved.filter("changed").isEmpty():
            return labels


def _key_table(nodes: DataFrame) -> DataFrame:
    """Events pre-aggregated by address, tactic and technique: all that groups and chains need."""
    return nodes.groupBy("source_ip", "tactic", "technique_id").agg(
        F.count("*").alias("n"),
        F.max("anomaly_score").alias("max_score"),
        F.min(F.struct("position", "id")).alias("first"),
    )


def component_keys(nodes: DataFrame) -> DataFrame:
    """Pre-aggregated rows with the component they belong to.

    Links always chain all events of an address and all events of a tactic, so components follow
    from the distinct (address, tactic) pairs. Tactics joined by an address form short links,
    merged by label passing. Rows with neither a linkable address nor a tactic have no component.
    """
    keys = stage(_key_table(nodes), "correlation-keys")
    ip = F.when(_linkable(F.col("source_ip")), F.col("source_ip"))
    keyed = keys.withColumn("ip_key", ip)
    tactics = keyed.filter(F.col("tactic") != "")
    anchor = tactics.filter(F.col("ip_key").isNotNull()).groupBy("ip_key").agg(
        F.min("tactic").alias("anchor")
    )
    links = stage(
        tactics.join(anchor, "ip_key").select(F.col("anchor").alias("a"), F.col("tactic").alias("b")).distinct(),
        "tactic-links",
    )
    labels = _merge_links(links)

    tactic_label = labels.select(F.col("a").alias("tactic"), F.col("label").alias("tactic_label"))
    anchor_label = labels.select(F.col("a").alias("anchor"), F.col("label").alias("ip_label"))
    by_tactic = keyed.join(tactic_label, "tactic", "left").join(
        anchor.join(anchor_label, "anchor", "left").drop("anchor"), "ip_key", "left"
    )
    component = F.coalesce(
        F.concat(F.lit("tactic:"), F.coalesce("tactic_label", F.when(F.col("tactic") != "", F.col("tactic")))),
        F.concat(F.lit("tactic:"), F.col("ip_label")),
        F.concat(F.lit("ip:"), F.col("ip_key")),
    )
    return by_tactic.withColumn("component", component).filter(F.col("component").isNotNull()).select(
        "component", "source_ip", "tactic", "technique_id", "n", "max_score", "first"
    )


def _first_values(keys: DataFrame, column: str, top: int, excluded: str, output: str) -> DataFrame:
    """The ``top`` smallest distinct values per component as an array.

    The row limit per component is applied before the shuffle, so a wide component stays small.
    """
    distinct = keys.filter(F.col(column) != excluded).select("component", column).distinct()
    place = F.row_number().over(Window.partitionBy("component").orderBy(column))
    return (
        distinct.withColumn("_place", place)
        .filter(F.col("_place") <= top)
        .groupBy("component")
        .agg(F.array_sort(F.collect_list(column)).alias(output))
    )


def _component_summary(keys: DataFrame, max_ips: int) -> DataFrame:
    totals = (
        keys.groupBy("component")
        .agg(
            F.sum("n").alias("event_count"),
            F.max("max_score").alias("max_score"),
            F.min("first").alias("first"),
        )
        .filter(F.col("event_count") >= 2)
    )
    addresses = _first_values(keys, "source_ip", max_ips, "unknown", "source_ips")
    tactics = (
        keys.filter(F.col("tactic") != "")
        .groupBy("component")
        .agg(F.array_sort(F.collect_set("tactic")).alias("tactics"))
    )
    summary = totals.join(addresses, "component", "left").join(tactics, "component", "left")
    empty = F.array().cast("array<string>")
    return summary.select(
        "component", "event_count", "max_score", "first",
        F.coalesce("source_ips", empty).alias("source_ips"),
        F.coalesce("tactics", empty).alias("tactics"),
    )


def correlated_groups(keys: DataFrame) -> DataFrame:
    """Groups of at least two linked events. ``group_id`` is the id of the group's first event."""
    return _component_summary(keys, 5).select(
        F.col("first.id").alias("group_id"),
        "event_count",
        "source_ips",
        "tactics",
        F.round("max_score", 3).alias("max_score"),
    )


def group_members(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per event of a group: ``group_id``, ``event_id``."""
    groups = (
        keys.groupBy("component")
        .agg(F.sum("n").alias("event_count"), F.min("first").alias("first"))
        .filter(F.col("event_count") >= 2)
        .select("component", F.col("first.id").alias("group_id"))
    )
    lookup = keys.select("source_ip", "tactic", "technique_id", "component").join(groups, "component")
    return nodes.join(lookup, ["source_ip", "tactic", "technique_id"]).select(
        "group_id", F.col("id").alias("event_id")
    )


def top_groups(groups: DataFrame, n: int = 5) -> DataFrame:
    return groups.orderBy(F.desc("event_count"), F.desc("group_id")).limit(n)


def match_chains(
    table: DataFrame,
    tactics_col: str = "tactics",
    chains: Sequence[KillChain] = KILL_CHAINS,
    min_match: float = MIN_MATCH,
    split_tactics: bool = False,
) -> DataFrame:
    """One row per input row and chain whose tactics are present to at least ``min_match``.

    Composite tactics ("A / B") count as themselves unless ``split_tactics``.
    """
    chain_rows = F.array(
        *[
            F.struct(
                F.lit(order).alias("chain_order"),
                F.lit(chain.name).alias("chain_name"),
                F.lit(chain.severity).alias("chain_severity"),
                F.lit(chain.description).alias("description"),
                F.array(*[F.lit(t) for t in chain.tactics]).alias("required"),
            )
            for order, chain in enumerate(chains)
        ]
    )
    present = F.col(tactics_col)
    if split_tactics:
        present = F.flatten(F.transform(present, lambda t: F.split(t, " / ")))
    matched = F.array_intersect(F.col("required"), present)
    share = F.size("tactics_found") / F.size("required")
    return (
        table.filter(F.size(tactics_col) > 0)
        .withColumn("_chain", F.explode(chain_rows))
        .select(*table.columns, "_chain.*")
        .withColumn("tactics_found", F.array_sort(matched))
        .withColumn("match_share", share)
        .filter(F.col("match_share") >= min_match)
    )


def kill_chains(
    keys: DataFrame,
    chains: Sequence[KillChain] = KILL_CHAINS,
    min_match: float = MIN_MATCH,
    split_tactics: bool = False,
) -> DataFrame:
    """Kill-chain alerts, one per chain: the component whose first event comes first wins."""
    matched = match_chains(
        _component_summary(keys, 3), "tactics", chains, min_match, split_tactics
    )
    techniques = _first_values(keys, "technique_id", 5, "", "techniques")
    first_wins = Window.partitionBy("chain_name").orderBy("first")
    leader = F.coalesce(F.try_element_at("source_ips", F.lit(1)), F.lit("unknown"))
    return (
        matched.withColumn("_place", F.row_number().over(first_wins))
        .filter(F.col("_place") == 1)
        .join(techniques, "component", "left")
        .select(
            "chain_name",
            F.col("chain_severity").alias("severity"),
            "description",
            F.bround(F.col("match_share") * 100, 0).cast("int").alias("match_percent"),
            "event_count",
            "source_ips",
            "tactics_found",
            F.coalesce("techniques", F.array().cast("array<string>")).alias("techniques"),
            F.concat(
                F.lit("🚨 KILL CHAIN: "), F.col("chain_name"), F.lit(" — "),
                F.col("event_count").cast("string"), F.lit(" events from "), leader,
            ).alias("alert"),
        )
    )


def graph_nodes(nodes: DataFrame) -> DataFrame:
    """Node list of the graph export."""
    return nodes.select(
        "id",
        F.col("source_ip").alias("label"),
        F.col("anomaly_score").alias("score"),
        "severity",
        F.col("technique_id").alias("technique"),
        "tactic",
        F.substring("message", 1, 60).alias("message"),
    )


def graph_edges(edges: DataFrame) -> DataFrame:
    """Edge list of the graph export."""
    return edges.select(F.col("u").alias("source"), F.col("v").alias("target"), "relation", "weight")


def graph_summary(nodes: DataFrame, edges: DataFrame, groups: DataFrame, chains: DataFrame) -> DataFrame:
    """Counts of the graph export in one row."""
    return nodes.agg(F.count("*").alias("node_count")).select(
        "node_count",
        edges.agg(F.count("*")).scalar().alias("edge_count"),
        groups.agg(F.count("*")).scalar().alias("correlated_groups"),
        chains.agg(F.count("*")).scalar().alias("kill_chain_count"),
    )


def newest_graph(events: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graph export over the newest ``limit`` events: node list, edge list and the row of counts."""
    nodes = stage(correlation_nodes(events.orderBy(F.desc("id")).limit(limit)), "newest-nodes")
    edges = correlation_edges(nodes)
    keys = component_keys(nodes)
    counts = graph_summary(nodes, edges, correlated_groups(keys), kill_chains(keys))
    return graph_nodes(nodes), graph_edges(edges), counts


def kill_chain_scan(events: DataFrame, limit: int = 200) -> DataFrame:
    """Alerts over the newest ``limit`` events with the number of events scanned and of alerts."""
    newest = stage(events.orderBy(F.desc("id")).limit(limit), "newest-events")
    scanned = newest.agg(F.count("*")).scalar()
    alerts = kill_chains(component_keys(correlation_nodes(newest))).withColumn("events_scanned", scanned)
    # A window over all alerts: ``limit`` events give few.
    return alerts.withColumn("count", F.count("*").over(Window.partitionBy()))


# --- documented 5-minute mode -------------------------------------------------------------------


def _pairs_in_time(ranked: DataFrame, span: int) -> DataFrame:
    """All pairs of an address at most ``span`` microseconds apart: ``ip_key``, ``id`` and ``_v.id`` of the later row.

    Time is cut into steps of ``span`` and a busy step into cells of successive ranks. Only pairs of cells that are near enough
    in time meet, each by a key of its own, so a burst of one address is spread over the tasks. Rows without time have no pair.
    """
    step = max(span, 1)
    placed = ranked.filter(F.col("micros").isNotNull()).select(
        "ip_key", "id", "micros", "rank",
        (F.col("micros") - F.pmod(F.col("micros"), F.lit(step))).alias("step"),
        F.floor(F.col("rank") / CELL).alias("cell"),
    )
    cells = placed.groupBy("ip_key", "step", "cell").agg(
        F.count("*").alias("n"), F.min("micros").alias("first"), F.max("micros").alias("last")
    )
    earlier = cells.select("ip_key", *[F.col(c).alias(f"{c}_1") for c in ("step", "cell", "n", "last")])
    later = cells.select(
        "ip_key", F.explode(F.array(F.col("step"), F.col("step") - step)).alias("step_1"),
        *[F.col(c).alias(f"{c}_2") for c in ("step", "cell", "first")],
    )
    after = (F.col("step_2") > F.col("step_1")) | (F.col("cell_2") > F.col("cell_1"))
    near = F.col("first_2") - F.col("last_1") <= span
    keys = ["ip_key", "step_1", "cell_1", "step_2", "cell_2"]
    met = stage(
        earlier.join(later, ["ip_key", "step_1"])
        .filter((after & near) | ((F.col("step_2") == F.col("step_1")) & (F.col("cell_2") == F.col("cell_1")) & (F.col("n_1") > 1)))
        .select(*keys),
        "cell-pairs",
    )

    def rows(side: str) -> DataFrame:
        own = placed.select("ip_key", *[F.col(c).alias(f"{c}_{side}") for c in ("step", "cell", "id", "micros", "rank")])
        return own.join(met, ["ip_key", f"step_{side}", f"cell_{side}"])

    return (
        rows("1").join(rows("2"), keys)
        .filter((F.col("rank_2") > F.col("rank_1")) & (F.col("micros_2") - F.col("micros_1") <= span))
        .select("ip_key", F.col("id_1").alias("id"), F.struct(F.col("id_2").alias("id")).alias("_v"))
    )


def timed_ip_edges(
    events: DataFrame, ts_col: str = "event_ts", window_minutes: int = 5, reach: int | None = SAME_IP_REACH
) -> DataFrame:
    """Address links in time order that are at most ``window_minutes`` apart.

    ``reach`` None links all such events, as many as there are pairs; a number links only the next ``reach`` events of each,
    which keeps every pair of successive events linked and the links linear. Events are numbered once over all addresses by
    range partitions, so a burst of one address is spread over the tasks like any rows.
    """
    span = int(window_minutes * 60_000_000)
    micros = F.unix_micros(F.col(ts_col).cast("timestamp"))
    nodes = events.filter(_linkable(F.col("source_ip"))).select(
        "id", micros.alias("micros"), F.col("source_ip").alias("ip_key")
    )
    # Successive events of an address have successive numbers, wherever its first one falls.
    ranked = row_numbers(nodes, [F.col("ip_key"), F.col("micros"), F.col("id")], "rank")
    if reach is None:
        pairs = _pairs_in_time(ranked, span)
    else:
        pairs = _following(ranked, "ip_key", "rank", reach, ["id", "micros"]).filter(F.col("_v.micros") - F.col("micros") <= span)
    return pairs.select(*_edge(F.col("id"), F.col("_v.id"), "same_ip_in_time", F.col("ip_key"), SAME_IP_WEIGHT))


def address_sessions(
    events: DataFrame, ts_col: str = "event_ts", gap_minutes: int = 5, stream: bool = False
) -> DataFrame:
    """Sessions of an address: events less than ``gap_minutes`` apart, with tactics and counts.

    In batch, events are first merged per address and second, so a busy address brings at most one
    row per second to the session step. On a stream, set a watermark on ``ts_col`` first.
    """
    ts = F.col(ts_col).cast("timestamp")
    tactic = F.when(F.col("tactic") != "", F.col("tactic"))
    rows = events.filter(_linkable(F.col("source_ip")))
    if stream:
        return (
            rows.groupBy("source_ip", F.session_window(F.col(ts_col), f"{gap_minutes} minutes").alias("w"))
            .agg(
                F.count("*").alias("event_count"),
                F.array_sort(F.collect_set(tactic)).alias("tactics"),
                F.min(ts_col).alias("first_ts"),
                F.max(ts_col).alias("last_ts"),
            )
            .select("source_ip", "first_ts", "last_ts", "event_count", "tactics")
        )
    per_second = rows.groupBy("source_ip", F.unix_seconds(ts).alias("second")).agg(
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.count("*").alias("n"),
        F.collect_set(tactic).alias("tactics"),
    )
    return _stitch_sessions(per_second, gap_minutes)


def _stitch_sessions(moments: DataFrame, gap_minutes: int) -> DataFrame:
    """Sessions are cut per address and day, then joined over midnight by their ends."""
    gap = gap_minutes * 60_000_000

    def opens(previous_end: str) -> Column:
        silence = F.unix_micros("first_ts") - F.unix_micros(previous_end)
        return F.col(previous_end).isNull() | (silence >= gap)

    def all_tactics() -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list("tactics")))).alias("tactics")

    in_day = Window.partitionBy("source_ip", "day").orderBy("second")
    local = (
        moments.withColumn("day", F.floor(F.col("second") / 86_400))
        .withColumn("before", F.lag("last_ts").over(in_day))
        .withColumn("local", F.sum(opens("before").cast("int")).over(in_day))
        .groupBy("source_ip", "day", "local")
        .agg(
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
            F.sum("n").alias("n"),
            all_tactics(),
        )
    )
    over_time = Window.partitionBy("source_ip").orderBy("first_ts")
    opened = local.withColumn("before", F.lag("last_ts").over(over_time)).withColumn(
        "opened_at", F.when(opens("before"), F.col("first_ts"))
    )
    start = F.last("opened_at", ignorenulls=True).over(
        over_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        opened.withColumn("session_start", start)
        .groupBy("source_ip", "session_start")
        .agg(F.max("last_ts").alias("last_ts"), F.sum("n").alias("event_count"), all_tactics())
        .select("source_ip", F.col("session_start").alias("first_ts"), "last_ts", "event_count", "tactics")
    )


def session_chains(sessions: DataFrame, chains: Sequence[KillChain] = KILL_CHAINS,
                   min_match: float = MIN_MATCH, split_tactics: bool = False) -> DataFrame:
    """Kill chains present within one address session."""
    return match_chains(sessions, "tactics", chains, min_match, split_tactics).select(
        "source_ip", "first_ts", "last_ts", "event_count", "chain_name",
        F.col("chain_severity").alias("severity"),
        F.bround(F.col("match_share") * 100, 0).cast("int").alias("match_percent"),
        "tactics_found",
    )


def ordered_chains(events: DataFrame, ts_col: str = "event_ts",
                   chains: Sequence[KillChain] = KILL_CHAINS) -> DataFrame:
    """Addresses whose first events of a chain's tactics occur in the chain's order, all present."""
    firsts = (
        events.filter(_linkable(F.col("source_ip")) & (F.col("tactic") != ""))
        .groupBy("source_ip", "tactic")
        .agg(F.min(ts_col).alias("first_ts"))
        .groupBy("source_ip")
        .agg(F.map_from_entries(F.collect_list(F.struct("tactic", "first_ts"))).alias("firsts"))
    )
    chain_rows = []
    for chain in chains:
        times = F.array(*[F.try_element_at("firsts", F.lit(t)) for t in chain.tactics])
        chain_rows.append(F.struct(F.lit(chain.name).alias("chain_name"), times.alias("times")))
    return (
        firsts.withColumn("_c", F.explode(F.array(*chain_rows)))
        .select("source_ip", "_c.*")
        .filter(
            ~F.exists("times", lambda t: t.isNull()) & (F.col("times") == F.array_sort("times"))
        )
        .select(
            "source_ip", "chain_name",
            F.col("times")[0].alias("first_ts"),
            F.try_element_at("times", F.lit(-1)).alias("last_ts"),
        )
    )
