"""What the operators share: tables written to the cluster's shared folder, and small expressions."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one of our own, on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="inkwell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one run, written as Parquet so that a lost executor costs no recomputation.

    ``drop`` removes a table that nothing reads any more; the rest stays, as lazy results read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.dir = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.dir}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{name}")
            p.getFileSystem(conf).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files of finished steps; it acts on the driver's garbage only."""
    import gc
    import time

    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)
    trim_native(spark)


def trim_native(spark: SparkSession) -> bool:
    """Gives memory that the driver's JVM has freed outside its heap back to the system; whether it could.

    The C library keeps what compiler threads and codecs freed, and in a long run with many plans that adds up. A JVM that
    doesn't know the command (before 17.0.9, or not on Linux) keeps it.
    """
    jvm, java = spark.sparkContext._jvm, spark.sparkContext._gateway
    # by the interface's method, as the class of the server isn't open to reflection
    server = jvm.java.lang.Class.forName("javax.management.MBeanServer")
    (invoke,) = [m for m in server.getMethods() if m.getName() == "invoke"]
    args = java.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        return False
    return True


#: Bits of the bitmap in ``among``; a constant, so what it broadcasts doesn't grow with the data.
BITMAP_BITS = 25


def likely(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` (long hashes) is in the one column of ``wanted``, and a few others.

    A bitmap of at most 2 ** BITMAP_BITS bits is broadcast; where the wanted keys fill it, it lets all rows pass.
    """
    bit = lambda c: F.pmod(F.col(c), F.lit(1 << BITMAP_BITS))
    (name,) = wanted.columns
    words = wanted.select(bit(name).alias("bit")).groupBy(F.expr("shiftright(bit, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("set"))
    marked = df.withColumn("bit", bit(key)).withColumn("word", F.expr("shiftright(bit, 6)"))
    marked = marked.join(F.broadcast(words.select(F.col("word").alias("_word"), F.col("set").alias("_bits"))), F.col("word") == F.col("_word"))
    return marked.filter("(shiftright(_bits, cast(bit & 63 as int)) & 1) = 1").select(*df.columns)


def among(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` (long hashes) is in the one column of ``wanted``, which has no repeats.

    ``likely`` goes first, so that few of the other rows are shuffled to the exact join.
    """
    (name,) = wanted.columns
    # an inner join: the optimizer would push a semi join below the bitmap
    return likely(df, key, wanted).join(wanted.select(F.col(name).alias(key)), key).select(*df.columns)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
