"""Session construction and the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


#: Paths that this driver has written with ``materialize``, and the table read from each.
_written: dict[str, weakref.ref] = {}
#: The folder of a session without a shared one.
_own = ""


def local_session(cores: str = "*", partitions: int = 8, name: str = "chatloom") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary folder serves sessions
    whose driver and executors are one process (tests); a cluster must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        global _own
        _own = where = _own or tempfile.mkdtemp(prefix="chatloom-")
    return where.rstrip("/")


def local_path(spark: SparkSession, path: str) -> str | None:
    """``path`` as Python opens it where it lies in the file system that the driver and all executors
    mount (``file:``); None in any other store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and
    survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[path] = weakref.ref(out)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)
    _written.pop(path, None)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned, once all that reads them is written itself."""
    for path, table in list(_written.items()):
        if any(table() is t for t in tables):
            _delete(tables[0].sparkSession, path)


def written() -> set[str]:
    """Paths of the tables that are held so far, for ``discard_since``."""
    return set(_written)


def discard_since(spark: SparkSession, before: set[str], *keep: DataFrame) -> None:
    """Delete the tables that ``materialize`` wrote after ``before``, but for those to ``keep``."""
    for path, table in list(_written.items()):
        if path not in before and not any(table() is t for t in keep):
            _delete(spark, path)


def clear_materialized(spark: SparkSession, *keep: DataFrame) -> None:
    """Delete the tables that ``materialize`` wrote, but for those to ``keep``, once no result
    is read from them any more."""
    discard_since(spark, set(), *keep)
