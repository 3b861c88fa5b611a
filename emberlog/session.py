"""Session settings and staged tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession

# Generated methods above 8000 bytes are never compiled to machine code by the JVM; below this
# limit Spark splits wide projections into smaller methods instead.
_RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in _RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "emberlog", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on.

    Keyword arguments override them; ``__`` stands for the dot in a setting's name.
    """
    settings = {
        **_RUNTIME_SETTINGS,
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables.

    ``spark.checkpoint.dir``, else the context's checkpoint folder, else a folder below the warehouse. A
    warehouse on the driver's own disk serves local masters only: executors elsewhere would not see it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
    if checkpoint.isDefined():
        return checkpoint.get().rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    on_disk = warehouse.startswith(("file:", "/"))
    if on_disk and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/emberlog-stage"


def new_stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the staging folder."""
    return f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Nothing reads a staged table's shuffle files again; else they stay until the driver happens to collect its garbage.
_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage and survives lost executors; later readers prune columns and push filters. Shuffle files of the write
    are removed when it ends. The path is added to ``made``, for ``discard``.
    """
    spark = df.sparkSession
    path = new_stage_path(spark, name)
    before = spark.conf.get(_REMOVE_SHUFFLES, None)
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_REMOVE_SHUFFLES)
        else:
            spark.conf.set(_REMOVE_SHUFFLES, before)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, made: list[str]) -> None:
    """Delete staged tables, by the paths that ``stage`` gave; no frame that is still to be run may read them."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in made:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    made.clear()
