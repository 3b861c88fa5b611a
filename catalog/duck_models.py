"""SQL counterparts of the trained detectors (DuckDB dialect)."""

from emberlog.operators.forest import PATH_UNITS, POOL, SAMPLE, SEED, SPAN, TREES
from emberlog.operators.lof import NEIGHBOURS

_EULER = 0.5772156649015329
#: Levels of a tree over SAMPLE rows.
_LEVELS = (SAMPLE - 1).bit_length()


def _settled(value: str) -> str:
    return f"CAST(format('{{:.12g}}', coalesce({value}, 0.0)) AS DOUBLE)"


def standardised(name: str, source: str, columns: list[str], keep: str) -> str:
    """CTE ``name``: kept columns and ``zs``, the list of standardised values."""
    stats = ", ".join(f"{_settled(f'avg({c})')} AS m{i}, {_settled(f'stddev_pop({c})')} AS s{i}" for i, c in enumerate(columns))
    values = ", ".join(
        f"(coalesce(CAST({c} AS DOUBLE), 0.0) - m{i}) / (CASE WHEN s{i} = 0 THEN 1.0 ELSE s{i} END)" for i, c in enumerate(columns)
    )
    return (
        f"{name}_stats AS MATERIALIZED (SELECT {stats}, count(*) AS n FROM {source}), "
        f"{name} AS MATERIALIZED (SELECT {keep}, [{values}] AS zs, n FROM {source}, {name}_stats)"
    )


def _draw(*parts: str) -> str:
    text = " || '|' || ".join(f"({p})" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)"


def _average_path(n: str) -> str:
    return f"CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} <= 2 THEN 1.0 ELSE 2.0 * (ln({n} - 1.0) + {_EULER}) - 2.0 * ({n} - 1.0) / {n} END"


def forest(source: str, key: str, columns: list[str], contamination: float, seed: int = SEED) -> str:
    """CTEs up to ``forest`` (key, raw score, low, high, cut): trees grown level by level, then every vector walks them."""
    dims = range(1, len(columns) + 1)
    lows, highs = (", ".join(f"{f}(zs[{i}])" for i in dims) for f in ("min", "max"))
    parts = [
        standardised("fz", source, columns, f"{key} AS k"),
        f"fpool AS MATERIALIZED (SELECT * FROM fz WHERE {_draw(str(seed + 1), 'k')} < floor(least(1.0, {POOL}.0 / n) * {SPAN}))",
        f"""f0 AS MATERIALIZED (SELECT tree, 1 AS node, zs FROM (
            SELECT tree, zs, row_number() OVER (PARTITION BY tree ORDER BY {_draw(str(seed), 'tree', 'k')}, k) AS place
            FROM fpool, range({TREES}) AS t(tree)) WHERE place <= {SAMPLE}),
        fsize AS MATERIALIZED (SELECT tree, count(*) AS rows_, ceil(log2(greatest(count(*), 2))) AS deepest FROM f0 GROUP BY tree)""",
    ]
    for level in range(_LEVELS + 1):
        parts.append(f"""
        g{level} AS MATERIALIZED (SELECT *, [i FOR i IN range(1, {len(columns) + 1}) IF hi[i] > lo[i]] AS varied FROM (
            SELECT tree, node, count(*) AS n, [{lows}] AS lo, [{highs}] AS hi FROM f{level} GROUP BY tree, node)),
        h{level} AS MATERIALIZED (SELECT tree, node, feature, lo[feature] + {_draw(str(seed), 'tree', 'node', "'threshold'")} / {SPAN}.0 * (hi[feature] - lo[feature]) AS threshold,
            CASE WHEN feature IS NULL THEN round_even(({level} + {_average_path('n')}) * {PATH_UNITS}, 0) / {PATH_UNITS} END AS path
          FROM (SELECT g.*, CASE WHEN n > 1 AND len(varied) > 0 AND {level} < deepest
              THEN varied[1 + CAST(floor({_draw(str(seed), 'tree', 'node', "'feature'")} / {SPAN}.0 * len(varied)) AS INT)] END AS feature
            FROM g{level} g JOIN fsize USING (tree))),
        f{level + 1} AS MATERIALIZED (SELECT tree, node * 2 + CAST(zs[feature] > threshold AS INT) AS node, zs
          FROM f{level} JOIN h{level} USING (tree, node) WHERE feature IS NOT NULL)""")
    parts.append("fv AS MATERIALIZED (SELECT zs, row_number() OVER () AS vid FROM (SELECT DISTINCT zs FROM fz))")
    parts.append(f"w0 AS (SELECT vid, zs, tree, 1 AS node FROM fv, range({TREES}) AS t(tree))")
    for level in range(_LEVELS + 1):
        parts.append(f"""w{level + 1} AS (SELECT vid, zs, tree, CASE WHEN path IS NULL THEN node * 2 + CAST(zs[feature] > threshold AS INT) END AS node, path
          FROM (SELECT vid, zs, tree, node FROM w{level} WHERE node IS NOT NULL) JOIN h{level} USING (tree, node))""")
    ends = " UNION ALL ".join(f"SELECT vid, path FROM w{level + 1} WHERE path IS NOT NULL" for level in range(_LEVELS + 1))
    parts.append(f"""fraw AS MATERIALIZED (SELECT vid, pow(2, -(sum(path) / {TREES}) / (SELECT {_average_path('rows_')} FROM fsize WHERE tree = 0)) AS raw
        FROM ({ends}) GROUP BY vid)""")
    parts.append("frows AS MATERIALIZED (SELECT k, raw FROM fz JOIN fv USING (zs) JOIN fraw USING (vid))")
    parts.append(f"""forest AS MATERIALIZED (SELECT k, if_raw, round_even(CASE WHEN high > low THEN (if_raw - low) / (high - low) ELSE 0.0 END, 4) AS if_score,
        if_raw > cut AS if_flag FROM (SELECT k, raw AS if_raw FROM frows),
        (SELECT min(raw) AS low, max(raw) AS high, quantile_cont(raw, {1.0 - contamination}) AS cut FROM frows))""")
    return ", ".join(parts)


def outlier_factor(source: str, key: str, columns: list[str], contamination: float) -> str:
    """CTEs up to ``factor`` (key, lof_score, lof_flag): all pairs of different vectors."""
    apart = " + ".join(f"(a.zs[{i}] - b.zs[{i}]) * (a.zs[{i}] - b.zs[{i}])" for i in range(1, len(columns) + 1))
    by_value = ", ".join(f"zs[{i}]" for i in range(1, len(columns) + 1))
    return ", ".join([
        standardised("lz", source, columns, f"{key} AS k"),
        f"lv AS MATERIALIZED (SELECT zs, row_number() OVER (ORDER BY {by_value}) AS vid, mult, n FROM (SELECT zs, count(*) AS mult, any_value(n) AS n FROM lz GROUP BY zs))",
        f"lk AS MATERIALIZED (SELECT least({NEIGHBOURS}, any_value(n) - 1) AS k FROM lv)",
        f"""lnear AS MATERIALIZED (SELECT vid, near.d AS d, near.vid AS near, near.mult - CAST(near.vid = vid AS INT) AS mult FROM (
            SELECT a.vid, unnest(min({{'d': sqrt({apart}), 'vid': b.vid, 'mult': b.mult}}, {NEIGHBOURS + 1})) AS near FROM lv a, lv b GROUP BY a.vid))""",
        """lw AS MATERIALIZED (SELECT vid, near, d, least(mult, k - before) AS weight, k FROM (
            SELECT *, sum(mult) OVER (PARTITION BY vid ORDER BY d, near) - mult AS before FROM lnear WHERE mult > 0), lk WHERE before < k)""",
        "lkd AS MATERIALIZED (SELECT vid AS near, max(d) AS kd FROM lw GROUP BY vid)",
        "ld AS MATERIALIZED (SELECT vid, 1 / (sum(weight * greatest(d, kd)) / any_value(k) + 1e-10) AS density FROM lw JOIN lkd USING (near) GROUP BY vid)",
        """lraw AS MATERIALIZED (SELECT w.vid, sum(w.weight * o.density) / any_value(w.k) / any_value(s.density) AS raw
            FROM lw w JOIN ld o ON o.vid = w.near JOIN ld s ON s.vid = w.vid GROUP BY w.vid)""",
        "lrows AS MATERIALIZED (SELECT lz.k, raw FROM lz JOIN lv USING (zs) JOIN lraw USING (vid))",
        f"""factor AS MATERIALIZED (SELECT k, round_even(CASE WHEN high > low THEN (raw - low) / (high - low) ELSE 0.0 END, 4) AS lof_score, raw > cut AS lof_flag
            FROM lrows, (SELECT min(raw) AS low, max(raw) AS high, quantile_cont(raw, {1.0 - contamination}) AS cut FROM lrows))""",
    ])


#: CTE ``voted``: the three votes over forest, factor and zs.
VOTED = """voted AS MATERIALIZED (SELECT *, CASE votes WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' ELSE 'NONE' END AS confidence,
    votes >= 2 AS is_anomaly, votes AS detector_votes FROM (
  SELECT z.seq, if_flag, lof_flag, max_z > 2.5 AS zscore_flag, severity_score,
    CAST(if_flag AS INT) + CAST(lof_flag AS INT) + CAST(max_z > 2.5 AS INT) AS votes,
    round_even(least(greatest(0.4 * if_score + 0.4 * lof_score, 0.0), 1.0), 4) AS anomaly_score
  FROM zs z JOIN forest f ON f.k = z.seq JOIN factor l ON l.k = z.seq))"""
