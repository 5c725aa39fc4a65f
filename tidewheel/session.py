"""Session builder and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def build_session(name: str = "tidewheel", **conf: str) -> SparkSession:
    """UTC, adaptive execution, last-wins maps and the RocksDB state store; conf overrides."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | conf
    builder = SparkSession.builder.appName(name)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode without it, an own one."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tidewheel-")
    return _own[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, under the application's own folder there."""
    return f"{shared_dir(spark)}/tidewheel/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def drop_shared(spark: SparkSession) -> None:
    """Deletes all that this application has put in the shared folder. Frames that still read from it end here."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidewheel/{spark.sparkContext.applicationId}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def column(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(base: str, taken: list[str]) -> str:
    """A column name that clashes with none of taken, whatever its case."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
