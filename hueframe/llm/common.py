"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters, for Java, RE2 and Python alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder `sf_dir`, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; `bytes.split` cuts at exactly the six ASCII white-space bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small cuts of an Arrow batch, so that only a few hundred texts are Python strings at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from `spark.checkpoint.dir`.

    Where the setting is empty and Spark runs in local mode, as in tests, a fresh folder of this machine;
    elsewhere an error, since a machine's own folder would lose rows.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Scratch:
    """Tables of one job in the shared folder: `keep` writes them, `clear` removes all but the result's own."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
        self.tables = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """`df` written once to the shared folder and read again: lineage ends there, so a lost executor costs no recomputation."""
        self.tables += 1
        path = f"{self.folder}/{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Removes this job's tables; what reads them must have been stored elsewhere."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """`df` as a table of its own in the shared folder, which stays as long as the folder does."""
    return Scratch(df.sparkSession).keep(df)


#: Rows of one key that one task takes, at least.
KEY_ROWS = 1000


def salted_join(rows: DataFrame, small: DataFrame, key: str, by: str, total: int, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """`rows` joined with `small`, which has one row (key, n, ...) for each key; n is how many of `rows` have the key.

    A key with more than a thousandth of the `total` rows is dealt over several tasks by a hash of the column `by`,
    and its row of `small` is copied for each. Fewer than a thousand keys can be so frequent, so that their
    numbers are broadcast. With `how` "left", rows without a key or a partner stay. `counts` gives (key, n) where `small` is wide.
    """
    bar = max(KEY_ROWS, total // 1000)
    salts = F.when(F.col("n") > bar, F.ceil(F.col("n") / bar)).otherwise(1).cast("int")
    many = (small if counts is None else counts).where(F.col("n") > bar).select(key, salts.alias("salts"))
    salt = F.pmod(F.xxhash64(by), F.when(F.col(key).isNull(), 1000).otherwise(F.coalesce("salts", F.lit(1)))).cast("int")
    left = rows.join(F.broadcast(many), key, "left").withColumn("salt", salt).drop("salts")
    right = small.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.join(right, [key, "salt"], how).drop("salt")
