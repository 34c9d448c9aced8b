"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Where the setting is absent and all executors are threads of this process, as in tests, a temporary folder of
    this machine serves, and is recorded in the session.  On a cluster its absence is an error: files in
    a folder of one machine would be lost to the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/marginalia-{label}-{uuid.uuid4().hex}"


#: Tables written by staged and not dropped yet.
_STAGED: list[str] = []
#: A small table has a file for so many shuffle partitions.
PARTITIONS_A_FILE = 32


def staged(df: DataFrame, label: str, small: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: a cut of lineage that
    outlives lost executors and lets later passes prune columns.  It stays until drop_staged.

    small: a table of a few rows a group, which is dealt to few files.  Without Hadoop's native library an
    executor starts three processes for each file, each of which shows the whole memory of the executor as its
    own until it has loaded its program."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    if small:
        df = df.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // PARTITIONS_A_FILE))
    df.write.parquet(path)
    _STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_so_far() -> int:
    return len(_STAGED)


def drop_staged(spark: SparkSession, since: int = 0) -> None:
    """Delete the staged tables, or those after the first since.  For use once every result that
    was computed from them is written elsewhere."""
    drop_paths(spark, _STAGED[since:])


def staged_since(before: int) -> list[str]:
    return _STAGED[before:]


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete these folders; staged tables among them count as dropped."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    gone = set(paths)
    _STAGED[:] = [x for x in _STAGED if x not in gone]


def give_back() -> None:
    """Give memory that this process has freed back to the system.  Spark keeps its Python workers for later
    stages, and Arrow and the C library keep what was freed."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def let(value: Column, body) -> Column:
    """Evaluate value once per row and use it many times in body."""
    return F.transform(F.array(value), body)[0]


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the identifier as text; that of the empty text where it is null."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def code_points(text: Column) -> Column:
    return F.char_length(text)
