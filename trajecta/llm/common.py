"""What the operators share: the shared scratch folder, row-wise Arrow maps and small bounded caches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space as the contracts define it: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or that the session has set.

    Where both are unset a temporary folder is made, but only for a local master: executors of a cluster would each write
    to a disk of their own, so there it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="trajecta-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


#: Paths of the tables that this process has written and not deleted, in order.
_written: list[str] = []


def _folder(spark: SparkSession):
    """The application's own folder in the shared one, and its file system, which deletes it when the driver ends."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/trajecta-{spark.sparkContext.applicationId}")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    return where, fs


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a written Parquet table in the shared folder: lineage ends there and no lost executor takes it along."""
    spark = df.sparkSession
    path = f"{_folder(spark)[0].toString()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], *done: str) -> tuple[DataFrame, str]:
    """What ``make`` gives, saved, and its path; tables written on the way to it, and those in ``done``, are deleted."""
    start = len(_written)
    out = saved(make())
    _, fs = _folder(spark)
    for path in [*_written[start:-1], *done]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)
        _written.remove(path)
    return out, _written[-1]


def arrow_map(df: DataFrame, columns: Sequence[str], schema: str | StructType, rows: Callable[[Iterator[tuple]], Iterable[tuple]], flush: int = 20_000, heavy: int = 8 << 20) -> DataFrame:
    """Applies ``rows`` to the tuples of ``columns`` of each partition; its tuples go back to the JVM in bounded Arrow batches.

    A batch ends after ``flush`` rows or about ``heavy`` bytes of text and binary values, so one task
    never holds more than a few batches, whatever the partition's size.
    """
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    names = [f.name for f in fields]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    yield from zip(*(c.to_pylist() for c in part.columns))

        def batch(kept: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*kept), arrow)], names=names)

        kept: list[tuple] = []
        weight = 0
        for row in rows(each()):
            kept.append(row)
            weight += sum(len(v) for v in row if isinstance(v, (str, bytes)))
            if len(kept) >= flush or weight >= heavy:
                yield batch(kept)
                kept, weight = [], 0
        if kept:
            yield batch(kept)

    return df.select(*columns).mapInArrow(run, fields)


def hashed_sample(df: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    """At most ``n`` rows, those of least hash of ``key``: the same ones whatever the partitions.

    In a large table a hash threshold leaves about half as many rows again, so that no task sorts more than those.
    """
    if (total := df.count()) > 2 * n:
        df = df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * 1.5 * n / total))
    return df.orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 30)), key, *order).limit(n)


class Cache(dict):
    """A dict that makes what is missing. At half its bound it sets what it holds aside and starts anew, taking back what is
    asked for again: a worker's memory stays bounded, and what is frequent stays."""

    def __init__(self, make: Callable, most: int = 200_000):
        super().__init__()
        self.make, self.half, self.aside = make, max(1, most // 2), {}

    def __missing__(self, key):
        if len(self) >= self.half:
            self.aside = dict(self)
            self.clear()
        value = self[key] = self.aside[key] if key in self.aside else self.make(key)
        return value
