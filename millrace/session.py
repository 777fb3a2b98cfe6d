"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_test_dirs: dict[str, str] = {}


def build_session(master: str | None = None, app_name: str = "millrace", **conf) -> SparkSession:
    """A session with the settings the library relies on; a cluster keeps its own sizes."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true",
        # state on executor disks instead of in their heap
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. Only a local session may fall back to a temporary one."""
    configured = spark.conf.get(_CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_KEY} to a folder shared by all executors")
    if context.applicationId not in _test_dirs:
        _test_dirs[context.applicationId] = tempfile.mkdtemp(prefix="millrace-")
    return _test_dirs[context.applicationId]


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/millrace/{app}/{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors,
    and lets later passes read only the columns they need."""
    spark = df.sparkSession
    path = path or work_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a staged table once the result that needed it is written."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def path_bytes(spark: SparkSession, path: str) -> int:
    """Size of all files below a path."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(jvm_path).getLength()


def list_directories(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """(path, modification time in seconds) of the folders directly in ``path``."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(jvm_path):
        return []
    found = files.listStatus(jvm_path)
    return [(s.getPath().toString(), s.getModificationTime() / 1000) for s in found if s.isDirectory()]

