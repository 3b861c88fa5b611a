"""Headline timings: prints one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS] (default 8). Each step runs on
staged inputs, so a step's time is its own work; ``end_to_end`` runs all steps from the raw lines.
Every step runs once on the smallest data first, so that class loading is not part of the figures;
steps below LONG_STEP seconds run twice and the faster run counts.
"""

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from catalog import base  # noqa: E402
from emberlog.operators import correlate, detect, queries, triage  # noqa: E402
from emberlog.operators.features import build_features  # noqa: E402
from emberlog.operators.forest import fit_and_score  # noqa: E402
from emberlog.operators.lof import NEIGHBOURS, _vectors, find_neighbours, lof_detector  # noqa: E402
from emberlog.operators.normalize import normalize_lines  # noqa: E402
from emberlog.operators.quantiles import exact_quantiles  # noqa: E402
from emberlog.operators.tagging import tag_events  # noqa: E402
from emberlog.plans.batch import analyse_events, run_ensemble  # noqa: E402
from emberlog.schema import FEATURE_COLUMNS  # noqa: E402
from emberlog.session import build_session, stage  # noqa: E402

REPEATS = 2
LONG_STEP = 6.0
LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def drain(*frames):
    for frame in frames:
        frame.write.format("noop").mode("overwrite").save()


def steps(spark, sf_dir):
    """Name -> timed action; the inputs are staged on the way."""
    lines = stage(base.lines(spark, sf_dir).select("seq", "event_ts", "line"), "lines")
    parsed = stage(normalize_lines(lines), "parsed")
    narrow = parsed.drop("event_ts")
    features = stage(build_features(narrow), "features")
    events = base.stored_events(spark, sf_dir)
    nodes = stage(correlate.correlation_nodes(events), "nodes")
    lineitem = base.even_table(spark, sf_dir, "lineitem", *LINE_COLUMNS)
    yield "parse", lines, lambda: drain(normalize_lines(lines))
    yield "features", parsed, lambda: drain(build_features(narrow))
    yield "tagging_with_parse", lines, lambda: drain(tag_events(normalize_lines(lines)))
    yield "two_vote_ensemble", features, lambda: drain(detect.two_vote_ensemble(features, FEATURE_COLUMNS))
    yield "isolation_forest", features, lambda: drain(fit_and_score(features, FEATURE_COLUMNS)[0])
    yield "local_outlier_factor", features, lambda: drain(lof_detector(features, FEATURE_COLUMNS))
    yield "three_detector_ensemble", features, lambda: drain(run_ensemble(features)[0])
    yield "table_queries", events, lambda: drain(
        queries.recent_events(events), queries.metrics(events), queries.anomalies(events, 20), queries.top_ips(events, 5)
    )
    yield "correlation_edges", nodes, lambda: drain(correlate.correlation_edges(nodes))
    yield "kill_chains", nodes, lambda: drain(correlate.kill_chains(correlate.component_keys(nodes)))
    yield "sessions", events, lambda: drain(correlate.address_sessions(events))
    yield "triage", events, lambda: drain(triage.triage(events))
    yield "lineitem_zscore", lineitem, lambda: drain(detect.zscore_detector(lineitem, LINE_COLUMNS))
    yield "lineitem_quartiles", lineitem, lambda: drain(exact_quantiles(lineitem, LINE_COLUMNS, [0.25, 0.75]))

    def end_to_end():
        events = stage(analyse_events(normalize_lines(lines).drop("event_ts")).events, "all-events")
        nodes = correlate.correlation_nodes(events)
        drain(correlate.correlation_edges(nodes), correlate.kill_chains(correlate.component_keys(nodes)))

    yield "end_to_end", lines, end_to_end


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = set(sys.argv[1:])
    scratch = tempfile.mkdtemp(prefix="emberlog-bench-")
    spark = build_session(
        "bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__checkpoint__dir=scratch,
    )
    spark.sparkContext.setLogLevel("ERROR")
    smallest = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(smallest) and smallest != sf_dir:
        for name, _, action in steps(spark, smallest):
            if name != "end_to_end" and (not only or name in only):
                action()
    shares = {}
    if not only:
        # How the outlier factor's work grows: share of all pairs of vectors that are compared.
        for place in dict.fromkeys((os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01"), sf_dir)):
            if os.path.isdir(place):
                numeric = base.features(spark, place).select(*[F.col(c).cast("double").alias(c) for c in FEATURE_COLUMNS])
                shares[os.path.basename(place.rstrip("/"))] = round(find_neighbours(_vectors(numeric, FEATURE_COLUMNS), NEIGHBOURS).share, 4)
    timings, rows = {}, {}
    for name, source, action in steps(spark, sf_dir):
        if only and name not in only:
            continue
        best = float("inf")
        for _ in range(REPEATS):
            start = time.time()
            action()
            best = min(best, time.time() - start)
            if best > LONG_STEP:
                break
        timings[name] = round(best, 3)
        rows[name] = source.agg(F.count("*")).first()[0]
    spark.stop()
    shutil.rmtree(scratch, ignore_errors=True)
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "rows_per_second": {name: round(rows[name] / timings[name]) for name in timings},
        "outlier_factor_pair_share": shares,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
