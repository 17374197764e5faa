"""Tables cut from their lineage, and joins whose broadcast is decided by a measured size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a written table is broadcast, from its counted rows and their measured width; a larger one is joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: Bytes that a row takes in a hashed relation beside its values.
ROW_BYTES = 24
_ROOTS: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, of spark.checkpoint.dir. Where the session names none, a local master gets a temporary one; a cluster must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A path below this application's folder, which the file system deletes when the driver's JVM ends."""
    where = shared_dir(spark), spark.sparkContext.applicationId
    if where not in _ROOTS:
        root = f"{where[0]}/ledgerloom/{where[1]}-{uuid.uuid4().hex[:8]}"
        target, files = _path(spark, root)
        files.mkdirs(target)
        files.deleteOnExit(target)
        _ROOTS[where] = root
    return f"{_ROOTS[where]}/{name}-{uuid.uuid4().hex}"


class Cut:
    """A table written once to the shared folder, and removed when told, or when the driver ends.

    rows: its rows; flagged: those with the column `flag` true. Both are counted as it is written; a task that is repeated may count twice, so they
    decide what to skip and what to broadcast, and nothing else.
    """

    def __init__(self, df: DataFrame, name: str, flag: str | None = None):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows"), (F.count_if(F.col(flag)) if flag else F.lit(0)).alias("flagged")).write.option("compression", "zstd").parquet(self.path)
        self.rows, self.flagged = seen.get["rows"], seen.get["flagged"]
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def small(self, *columns: str) -> DataFrame:
        """For the build side of a join: broadcast where the measured bytes allow it, else left to a shuffle join."""
        df = self.df.select(*columns) if columns else self.df
        kinds = {f.name: f.dataType.simpleString() for f in df.schema}
        wide = [F.octet_length(c) if k in ("string", "binary") else 8 * F.size(c) for c, k in kinds.items() if k in ("string", "binary") or k.startswith("array<")]
        fixed = ROW_BYTES + 8 * len(kinds)
        if self.rows * fixed > BROADCAST_BYTES:
            return df
        bytes_ = self.rows * fixed + (df.select(F.sum(sum(wide, F.lit(0)).cast("long"))).first()[0] or 0 if wide else 0)
        return F.broadcast(df) if bytes_ <= BROADCAST_BYTES else df

    def drop(self) -> None:
        target, files = _path(self.spark, self.path)
        files.delete(target, True)


def digest(text):
    """128 bits of SHA-256 as a binary key for a whole text; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def free_name(taken: list[str], name: str) -> str:
    """A column name that clashes with none of the input's, whatever their case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def own(df: DataFrame) -> list[Column]:
    """The columns of df, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
