"""Line-log and export-record sources with a dense row number."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.functions.text import strip_space
from emberlog.operators.normalize import normalize_export_records, normalize_lines, with_event_time

# Where a new export record starts.
RECORD_SEPARATOR = "Event["
RECORD_START = r"^\d+\]:"
RECORD_SPLIT = r"Event\[\d+\]:"

# Share of anomalies expected per source selection.
CONTAMINATION = {"sample": 0.1, "real": 0.05, "combined": 0.05}


def _existing(spark: SparkSession, paths: list[str]) -> list[tuple[int, str]]:
    """Rank and full name of all that the listed paths and patterns name; what does not exist is left out."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    found = []
    for rank, path in enumerate(paths):
        place = jvm.org.apache.hadoop.fs.Path(path)
        for status in place.getFileSystem(conf).globStatus(place) or []:
            found.append((rank, status.getPath().toUri().toString()))
    return found


def _read_existing(spark: SparkSession, paths: list[str], column: str, **options) -> tuple[DataFrame, DataFrame]:
    """Text rows of all paths that exist, read at once, with their place in the files; and rank and name of the paths."""
    roots = _existing(spark, paths)
    named = spark.createDataFrame(roots, "_rank int, _root string")
    if not roots:
        return spark.createDataFrame([], f"{column} string, _file string, _start long"), named
    jvm = spark._jvm
    # A plain path again, so that names with blanks or signs are found.
    names = sorted({jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(root)).toString() for _, root in roots})
    frame = spark.read.text(names, **options)
    rows = frame.select(
        F.make_valid_utf8("value").alias(column),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
    )
    return rows, named


def _in_paths(blocks: DataFrame, roots: DataFrame) -> DataFrame:
    """The blocks with the rank of the path that names their file or a folder above it, once for each such path."""
    bare = F.regexp_replace("_file", "^file:/+", "file:/")
    parts = F.split(bare, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    plain = roots.select("_rank", F.regexp_replace(F.regexp_replace("_root", "^file:/+", "file:/"), "/$", "").alias("_root"))
    return blocks.withColumn("_root", F.explode(above)).join(plain, "_root").drop("_root")


def _with_seq(rows: DataFrame, roots: DataFrame, seq_col: str) -> DataFrame:
    """Number the rows 0, 1, 2 … in path, file and line order without a global sort.

    Rows are counted per file block; the running sum of the counts is each block's offset. Within
    a block, rows keep the order of Spark's own increasing id. Paths are matched with blocks, not with
    rows; a file that two paths name is numbered once for each. ``_leads`` marks the first row of a file.
    """
    block = ["_file", "_start"]
    marked = rows.withColumn("_mid", F.monotonically_increasing_id())
    counted = marked.groupBy(*block).agg(F.count("*").alias("_n"), F.min("_mid").alias("_first"))
    blocks = _in_paths(counted, roots)
    in_file = Window.partitionBy("_rank", "_file").orderBy("_start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    files = blocks.groupBy("_rank", "_file").agg(F.sum("_n").alias("_total"))
    before_file = Window.partitionBy("_rank").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    before_path = Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    paths = files.groupBy("_rank").agg(F.sum("_total").alias("_total"))
    path_offset = paths.select("_rank", F.coalesce(F.sum("_total").over(before_path), F.lit(0)).alias("_a"))
    file_offset = files.select(
        "_rank", "_file", F.coalesce(F.sum("_total").over(before_file), F.lit(0)).alias("_b")
    )
    offsets = (
        blocks.withColumn("_c", F.coalesce(F.sum("_n").over(in_file), F.lit(0)))
        .join(file_offset, ["_rank", "_file"])
        .join(path_offset, "_rank")
        .select(*block, "_first", "_c", (F.col("_a") + F.col("_b") + F.col("_c")).alias("_offset"))
    )
    return (
        marked.join(offsets, block)
        .withColumn(seq_col, F.col("_offset") + F.col("_mid") - F.col("_first"))
        .withColumn("_leads", (F.col("_c") == 0) & (F.col("_mid") == F.col("_first")))
        .drop("_mid", "_first", "_offset", "_c", *block)
    )


def read_lines(spark: SparkSession, paths: str | list[str], seq_col: str = "seq") -> DataFrame:
    """Log lines (``seq``, ``line``): stripped, without blank and ``#`` lines, in file order.

    Paths that do not exist are skipped.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    rows, roots = _read_existing(spark, listed, "line")
    rows = rows.withColumn("line", strip_space(F.col("line")))
    rows = rows.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    return _with_seq(rows, roots, seq_col).select(seq_col, "line")


def read_export_records(
    spark: SparkSession, paths: str | list[str], whole_files: bool = False, seq_col: str = "seq", block: int = 65_536
) -> DataFrame:
    """Multi-line export records (``seq``, ``record``), one per ``Event[n]:`` marker.

    The default splits large files between tasks. A separator that is not a marker (``Event[`` in a
    description) is put back: only such rows are regrouped, numbered in blocks of ``block`` pieces, so that one
    file of many such rows is worked on in many tasks.
    ``whole_files=True`` reads each file as one row instead, for small files.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    if whole_files:
        rows, roots = _read_existing(spark, listed, "text", wholetext=True)
        pieces = rows.withColumn("record", F.explode(F.split("text", RECORD_SPLIT))).drop("text")
        pieces = pieces.filter((strip_space(F.col("record")) != ""))
        return _with_seq(pieces, roots, seq_col).select(seq_col, "record")

    rows, roots = _read_existing(spark, listed, "piece", lineSep=RECORD_SEPARATOR)
    # What a file has before its first marker is a record too, so every file begins with a start.
    numbered = _with_seq(rows, roots, "_piece")
    is_start = F.col("_leads") | F.col("piece").rlike(RECORD_START)
    starts = numbered.filter(is_start).withColumn(
        "record", F.when(F.col("_leads"), F.col("piece")).otherwise(F.regexp_replace("piece", RECORD_START, ""))
    )
    # Runs of continuation rows: numbered among themselves block by block, a run keeps one distance to the piece
    # numbers. The row before a run is the record that it belongs to; only a record's own rows come together.
    loose = densify(numbered.filter(~is_start).withColumn("_dense", F.col("_piece")), "_dense", block)
    tails = (
        loose.groupBy((F.col("_piece") - F.col("_dense")).alias("_run"))
        .agg(
            (F.min("_piece") - 1).alias("_piece"),
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("_piece", "piece"))),
                    lambda row: F.concat(F.lit(RECORD_SEPARATOR), row["piece"]),
                ),
                "",
            ).alias("_tail"),
        )
        .select("_piece", "_tail")
    )
    joined = starts.join(tails, "_piece", "left").select(
        F.col("_piece").alias(seq_col), F.concat("record", F.coalesce("_tail", F.lit(""))).alias("record")
    )
    return joined.filter(strip_space(F.col("record")) != "")


def read_sources(
    spark: SparkSession,
    mode: str,
    line_paths: list[str] = (),
    export_paths: list[str] = (),
    profile: str = "A",
    assumed_year: int | None = None,
) -> DataFrame:
    """Parsed events of a source selection with a dense ``seq``; nothing stored is deleted.

    ``sample`` reads line logs, ``real`` export records, ``combined`` the lines first and then the
    records. With ``assumed_year`` (that of texts without a year), ``event_ts`` is read from the text too.
    """
    if mode not in CONTAMINATION:
        raise ValueError(f"mode must be one of {sorted(CONTAMINATION)}, not {mode!r}")

    def timed(events: DataFrame) -> DataFrame:
        return events if assumed_year is None else with_event_time(events, assumed_year)

    lines = normalize_lines(read_lines(spark, list(line_paths)))
    if mode == "sample":
        return timed(lines)
    records = normalize_export_records(
        read_export_records(spark, list(export_paths)), profile=profile
    )
    dense = densify(records)
    if mode == "real":
        return timed(dense)
    n_lines = lines.agg(F.count("*")).scalar()
    return timed(lines.unionByName(dense.withColumn("seq", F.col("seq") + n_lines)))


def densify(rows: DataFrame, seq_col: str = "seq", block: int = 65_536) -> DataFrame:
    """Close the gaps in an increasing row number: counts per block give each block's offset."""
    marked = rows.withColumn("_block", F.floor(F.col(seq_col) / block))
    counts = marked.groupBy("_block").agg(F.count("*").alias("_n"))
    # Two levels keep the running sums short: blocks within a group of blocks, then groups.
    group = F.floor(F.col("_block") / 1024)
    within = Window.partitionBy("_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    grouped = counts.withColumn("_group", group)
    totals = grouped.groupBy("_group").agg(F.sum("_n").alias("_total"))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    group_offset = totals.select("_group", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_a"))
    offsets = grouped.withColumn("_b", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(
        group_offset, "_group"
    )
    place = F.row_number().over(Window.partitionBy("_block").orderBy(seq_col)) - 1
    return (
        marked.withColumn("_place", place)
        .join(offsets.select("_block", (F.col("_a") + F.col("_b")).alias("_offset")), "_block")
        .withColumn(seq_col, F.col("_offset") + F.col("_place"))
        .drop("_block", "_place", "_offset")
    )
