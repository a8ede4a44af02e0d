"""Session helpers: runtime SQL settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Only runtime-settable SQL options; sizing (executors, memory, shuffle
# partitions) belongs to whoever starts the session.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where a later aggregate wanted its partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Keyed state with several variables, timers and expiry needs this store; it keeps state out of the heap as well.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


# HotSpot never compiles methods of more than 8000 bytes, as scores and filters on them in one stage give; such
# stages run operator by operator instead.
_SMALL_METHODS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def configure(spark: SparkSession, small_methods: bool = False) -> SparkSession:
    """Apply the runtime SQL settings every operator relies on; ``small_methods`` suits long chains of expressions."""
    for key, value in (_RUNTIME | (_SMALL_METHODS if small_methods else {})).items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "voxrill", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder that ``spark.checkpoint.dir`` names.

    Where the session names none, a private folder serves a single-machine session; on a cluster
    that would lose data silently, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="voxrill-")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, codec: str | None = None, conf: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    For a small result that is costly to make and read several times: it is
    computed once, survives lost executors, and readers still prune columns.
    ``codec`` compresses it otherwise than the session does; ``conf`` holds while it is written.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, "table")
    before = {key: spark.conf.get(key, None) for key in conf or {}}
    try:
        for key, value in (conf or {}).items():
            spark.conf.set(key, value)
        df.write.parquet(path, compression=codec)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return df.sparkSession.read.schema(df.schema).parquet(path)
