"""Session, shared work folder, lineage cuts and skew helpers used by all operators.

Nothing here depends on the data: every helper behaves alike at every size.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections import OrderedDict
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: Bytes that may be handed to an explicit broadcast after they were measured.
BROADCAST_BYTES = 32 << 20
BROADCAST_ROWS = 100_000
#: Ways into which a hot key is split.
SALT_WAYS = 16

_local_root: str | None = None


def session(app: str = "knowloom", cpus: str | int = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder serves, but only for a local master: on a cluster
    a folder of one machine would lose data with that machine, so that case is an error.
    """
    global _local_root
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="knowloom-")
        atexit.register(_remove_tree, _local_root)
    return "file://" + _local_root


def _remove_tree(path: str) -> None:
    import shutil

    if os.path.isdir(path):
        shutil.rmtree(path, ignore_errors=True)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new name below the application's part of the shared folder."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The table is columnar and compressed, its size is then known to the optimiser, and a plan that
    reads it twice does not compute it twice.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return read_cut(spark, path, df.schema)


def read_cut(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table written below the shared folder, such that :func:`release` can delete it."""
    back = spark.read.schema(schema).parquet(path)
    back._knowloom_path = path
    return back


class Grown:
    """A table below the shared folder that grows by whole appends; :meth:`read` sees what was added so far. Survives lost executors as :func:`cut` does."""

    def __init__(self, first: DataFrame, label: str) -> None:
        self.spark, self.schema, self.path = first.sparkSession, first.schema, shared_path(first.sparkSession, label)
        self.add(first)

    def add(self, rows: DataFrame) -> None:
        rows.select(*self.schema.names).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return read_cut(self.spark, self.path, self.schema)


def release(*dfs: DataFrame | None) -> None:
    """Delete tables made by :func:`cut` that no later step reads."""
    for df in dfs:
        path = getattr(df, "_knowloom_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, df: DataFrame) -> bool:
    """Whether a written table is still there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(df._knowloom_path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def hot_keys(df: DataFrame, keys: list[str], share: int = 200, least: int = 0) -> DataFrame:
    """Key values that hold more than one ``share``-th of all rows, and more than ``least``: at most ``share`` of them, by arithmetic."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total")).scalar()
    return counts.where((F.col("_n") * share > total) & (F.col("_n") > least)).select(*keys)


def measured_bytes(df: DataFrame) -> int:
    """Bytes that the rows of ``df`` take in memory: 16 for each row and field, and those of its texts, binaries and arrays."""
    sized = [F.octet_length(f.name) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    sized += [F.size(f.name) * 16 for f in df.schema.fields if f.dataType.typeName() == "array"]
    each = sum((F.coalesce(c, F.lit(0)) for c in sized), F.lit(16 * (len(df.columns) + 1)))
    return df.agg(F.sum(each.cast("bigint")).alias("bytes")).first()["bytes"] or 0  # one row


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it takes at most ``most`` bytes, as it stands beyond: the same join shuffles then. Reads ``df`` once, so hand in a written table."""
    return F.broadcast(df) if measured_bytes(df) <= most else df


def _is_map(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("map", "variant")


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", ways: int = SALT_WAYS, hot: DataFrame | None = None) -> DataFrame:
    """Equi-join of ``big`` with ``small`` in which the hot keys of ``big`` are spread over ``ways`` partitions.

    ``small`` is expected to be unique by ``keys`` (or nearly so); only its rows of hot keys are repeated,
    ``ways`` times. The set of hot keys is bounded by :func:`hot_keys`, so it is safe to broadcast; ``hot`` gives it where it is known already.
    Works for inner, left, left_semi and left_anti with ``big`` on the left. Null keys never match, as in SQL.
    """
    hot = (hot_keys(big, keys) if hot is None else hot.select(*keys)).withColumn("_hot", F.lit(True))
    # from the row itself, so that a repeated task sends each row the same way
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if not _is_map(big, c)]), F.lit(ways)).cast("int")).otherwise(F.lit(0))
    left = big.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_hot")
    right = (
        small.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))))
        .drop("_hot")
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def sized_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None, small_bytes: int | None = None) -> DataFrame:
    """``big`` joined with the written table ``small``: broadcast if that takes at most BROADCAST_BYTES, salted else."""
    if (measured_bytes(small) if small_bytes is None else small_bytes) <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), keys, how)
    return salted_join(big, small, keys, how, hot=hot)


def java_function(spark: SparkSession, name: str, source: str, returns: DataType) -> None:
    """Register the class in the Java file ``source``, a UDF of Spark's Java interface, as the SQL function ``name``.

    It is compiled by the compiler that Spark's own generated code goes through, so a cluster needs nothing but Spark.
    """
    if spark.catalog.functionExists(name):
        return
    jvm = spark._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
    with open(source, encoding="utf-8") as f:
        compiler.cook(f.read())
    classes = compiler.getBytecodes()
    jar = os.path.join(tempfile.mkdtemp(prefix="knowloom-java-"), f"{name}-{uuid.uuid4().hex}.jar")
    atexit.register(_remove_tree, os.path.dirname(jar))
    with zipfile.ZipFile(jar, "w") as z:
        for c in classes:
            z.writestr(c.replace(".", "/") + ".class", bytes(classes[c]))
    spark.sql(f"ADD JAR '{jar}'")
    made = spark._jsparkSession.sharedState().jarClassLoader().loadClass("knowloom." + os.path.basename(source).removesuffix(".java")).newInstance()
    spark._jsparkSession.udf().register(name, made, spark._jsparkSession.parseDataType(returns.json()))


def with_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are computed once a row, however often later steps and filters use them.

    The optimiser may write an expression out wherever its column is used, also in a filter below; it does not do so through a generator of one row.
    """
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    return df.select("*", one).select(*df.columns, *[F.col("_once")[n].alias(n) for n in columns])


def filled(c: Column | str) -> Column:
    """True where a string holds something besides white space."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & c.rlike(r"[^\s\u00a0]")


def clean(spark: SparkSession) -> None:
    """Delete everything this application wrote with :func:`cut`, once none of its frames is needed any more."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/{spark.sparkContext.applicationId}")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class FrameCache:
    """Cached frames by name and validator: a frame is made anew when its validator changes, and the least recently used beyond ``most`` go."""

    def __init__(self, most: int = 32) -> None:
        self.most = most
        self._held: OrderedDict[str, tuple[object, DataFrame]] = OrderedDict()

    def get(self, name: str, validator: object, make: Callable[[], DataFrame]) -> DataFrame:
        held = self._held.pop(name, None)
        if held is None or held[0] != validator:
            if held is not None:
                held[1].unpersist()
            held = (validator, make().persist(StorageLevel.MEMORY_AND_DISK))
        self._held[name] = held
        while len(self._held) > self.most:
            self._held.popitem(last=False)[1][1].unpersist()
        return held[1]
