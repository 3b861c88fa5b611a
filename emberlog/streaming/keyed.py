"""Per-address state on streams: features over the events so far, and kill chains in order.

State lives in the RocksDB store of the streaming query. Rows of one address are worked on in order within a trigger, so bound
a trigger's rows (``maxFilesPerTrigger``); idle addresses are dropped by a timer.
"""

import sys
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberlog.constants.kill_chains import KILL_CHAINS, KillChain
from emberlog.functions.numbers import python_round
from emberlog.operators.correlate import _linkable
from emberlog.operators.features import ROLLING_ROWS

# Task functions travel with their code, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE_HOURS = 24 * 90
CHAIN_HOURS = 24


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which arbitrary state needs; the session's setting comes back."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def _all_rows(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """The trigger's rows of one key, in order; Arrow may deliver them in several frames."""
    return pd.concat(list(rows), ignore_index=True).sort_values(list(order), kind="stable", ignore_index=True)


class _Expiring(StatefulProcessor):
    """Drops the state of a key that had no event for ``hours`` before the watermark."""

    hours: float

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "at bigint")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def keep_until(self, latest_ms: int) -> None:
        """Move the timer behind the latest event."""
        wanted = latest_ms + int(self.hours * 3_600_000)
        if self.until.exists():
            earlier = self.until.get()[0]
            if earlier >= wanted:
                return
            self.handle.deleteTimer(earlier)
        self.handle.registerTimer(wanted)
        self.until.update((wanted,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.until.exists() and self.until.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.forget()
            self.until.clear()
        return iter([])

    def close(self) -> None:
        pass


class AddressTotals(_Expiring):
    """Count, severe count and the last positions of an address; one output row per event."""

    def __init__(self, hours: float, rolling: int):
        self.hours, self.rolling = hours, rolling

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "n bigint, severe bigint, places array<bigint>")

    def forget(self) -> None:
        self.totals.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = _all_rows(rows, "seq")
        n, severe, places = self.totals.get() if self.totals.exists() else (0, 0, [])
        places, out = list(places), []
        for seq, is_severe in zip(table["seq"].tolist(), table["is_severe"].tolist(), strict=True):
            n, severe = n + 1, severe + int(is_severe)
            places = [p for p in places if p >= seq - self.rolling]
            out.append((seq, key[0], n, severe, len(places)))
            places.append(seq)
        self.totals.update((n, severe, places))
        if (latest := int(table["at_ms"].max())) > 0:
            self.keep_until(latest)
        yield pd.DataFrame(out, columns=["seq", "source_ip", "ip_event_count", "ip_severe_count", "rolling_event_rate"])


def stream_features(
    events: DataFrame, ts_col: str = "event_ts", idle_hours: float = IDLE_HOURS, rolling: int = ROLLING_ROWS
) -> DataFrame:
    """seq, source_ip, ip_event_count, ip_fail_rate, rolling_event_rate of every event, over the events up to it.

    Events need ``seq`` (rising from trigger to trigger), ``source_ip``, ``severity`` and a time; rows without address are an
    address of their own, rows without time are never late. An address is forgotten when it had no event for ``idle_hours`` of
    event time, and events that come later than that are dropped. Start the query within ``keyed_state``.
    """
    at = F.coalesce(F.unix_millis(F.col(ts_col).cast("timestamp")), F.lit(0))
    severe = F.coalesce(F.col("severity").isin("HIGH", "CRITICAL"), F.lit(False))
    kept = events.withWatermark(ts_col, f"{int(idle_hours)} hours").select(ts_col, "source_ip", "seq", severe.alias("is_severe"), at.alias("at_ms"))
    counted = kept.groupBy("source_ip").transformWithStateInPandas(
        AddressTotals(idle_hours, rolling),
        "seq bigint, source_ip string, ip_event_count bigint, ip_severe_count bigint, rolling_event_rate bigint",
        outputMode="append", timeMode="EventTime",
    )
    rate = python_round(F.col("ip_severe_count") / F.col("ip_event_count"), 4)
    return counted.select("seq", "source_ip", "ip_event_count", rate.alias("ip_fail_rate"), "rolling_event_rate")


class ChainMachine(_Expiring):
    """How far an address is along each chain: a step per tactic in order, each within ``hours`` of the step before."""

    def __init__(self, hours: float, chains: Sequence[KillChain]):
        self.hours, self.chains = hours, [(c.name, c.severity, tuple(c.tactics)) for c in chains]

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.steps = handle.getMapState("steps", "chain string", "step int, first_us bigint, last_us bigint")

    def forget(self) -> None:
        self.steps.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table, out = _all_rows(rows, "at_us", "seq"), []
        reach = int(self.hours * 3_600_000_000)
        for name, severity, tactics in self.chains:
            step, first, last = self.steps.getValue((name,)) if self.steps.containsKey((name,)) else (0, 0, 0)
            before = step
            for tactic, at, seq in zip(table["tactic"], table["at_us"].tolist(), table["seq"].tolist(), strict=True):
                if step and at - last > reach:
                    step = 0
                if tactic == tactics[step]:
                    first, last, step = (at if step == 0 else first), at, step + 1
                elif tactic == tactics[0] and step == 1:
                    first = last = at
                if step == len(tactics):
                    out.append((key[0], name, severity, first, last, seq))
                    step = 0
            if step:
                self.steps.updateValue((name,), (step, first, last))
            elif before:
                self.steps.removeKey((name,))
        self.keep_until(int(table["at_us"].max()) // 1000)
        yield pd.DataFrame(out, columns=["source_ip", "chain_name", "severity", "first_us", "last_us", "seq"])


_CHAIN_SCHEMA = "source_ip string, chain_name string, severity string, first_us bigint, last_us bigint, seq bigint"


def ordered_chain_stream(
    events: DataFrame, ts_col: str = "event_ts", hours: float = CHAIN_HOURS, chains: Sequence[KillChain] = KILL_CHAINS, delay: str = "2 minutes"
) -> DataFrame:
    """source_ip, chain_name, severity, first_us, last_us, seq: every time an address completes a chain's tactics in order.

    Each tactic must follow within ``hours`` of the one before; a first tactic seen again while waiting for the second starts anew, and
    a completed chain starts anew. Events of a trigger are taken in the order of time, then ``seq``; those of earlier triggers
    count as earlier. Events without tactic, address or time are left out. Start the query within ``keyed_state``.
    """
    known = {t for c in chains for t in c.tactics}
    at = F.unix_micros(F.col(ts_col).cast("timestamp"))
    wanted = F.col("tactic").isin(*sorted(known)) & _linkable(F.col("source_ip")) & F.col(ts_col).isNotNull()
    kept = events.filter(wanted).withWatermark(ts_col, delay).select(ts_col, "source_ip", "tactic", "seq", at.alias("at_us"))
    return kept.groupBy("source_ip").transformWithStateInPandas(
        ChainMachine(hours, chains), _CHAIN_SCHEMA, outputMode="append", timeMode="EventTime"
    )
