"""Session helpers: table access and durable cuts of lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` if the session names one.

    Only a session without that setting (tests, a laptop) gets a temporary folder,
    which a cluster therefore never uses.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="gleanery-")
        atexit.register(shutil.rmtree, path, True)
        _own_dirs[app] = path
        spark.sparkContext.setCheckpointDir(path)
    return _own_dirs[app]


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts the lineage and is compressed and columnar: later stages read only the columns they need. The table outlives an
    executor.
    """
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(spark: SparkSession, path: str) -> tuple[object, object]:
    """The Hadoop file system a path lives on, and the path for it; whatever the scheme, so that state is found wherever it is kept."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there; a file system that cannot be reached is an error, not an absence."""
    fs, p = filesystem(spark, path)
    return bool(fs.exists(p))


def children(spark: SparkSession, path: str) -> list[str]:
    """Full paths of what a folder holds, sorted; none if it is absent."""
    fs, p = filesystem(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A Parquet table that may not have been written yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file as a whole; None if it is absent."""
    fs, p = filesystem(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, replaced as a whole: written beside and moved over, so that no reader sees half of one."""
    fs, p = filesystem(spark, path)
    jvm = spark._jvm
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
        stream.hsync()
    finally:
        stream.close()
    if not fs.rename(beside, p):  # file systems that do not replace
        fs.delete(p, False)
        if not fs.rename(beside, p):
            raise OSError(f"{path} could not be replaced")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores: a scan of fewer splits than that, as of one small file, is dealt out before costly work on its rows.

    Only where rows are worked on depends on the size, never which.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= min(cores, 64) else df.repartition(cores)


def drawn(df: DataFrame, key: Column, most: int) -> DataFrame:
    """About ``most`` rows of ``df``, or more, by a hash of ``key``: every row if there are fewer.

    Rows are counted first and a threshold on the hash does the drawing where they lie, so that no task sees more than its share; a
    rounding up of four deviations makes fewer than ``most`` unlikely. Equal keys are drawn together.
    """
    n = df.count()
    if n <= most:
        return df
    share = min(1.0, (most + 4 * most**0.5) / n)
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))
