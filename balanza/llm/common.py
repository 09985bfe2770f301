"""Shared folders, written tables and small text helpers."""

from __future__ import annotations

import gc
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contracts: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_FALLBACK: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="llm-")
    return _FALLBACK[app]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="llm-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


class Scratch:
    """Tables of one operator call, written as Parquet below the shared folder.

    Writing a table cuts the lineage: what follows reads the files, so that a lost
    executor costs only the tasks it ran.  Tables that no lazy result reads any
    more are removed with ``drop``; the others belong to the returned frame.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
        """Write ``df`` once and return the written table; ``by`` makes one folder for each value."""
        df.write.mode("overwrite").partitionBy(*by).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)

    def tidy(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished jobs: it does so when the driver's JVM collects its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pieces_of(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about ``most_bytes`` of text, so that work arrays stay small.

    A single longer text is a run of its own; no text is cut.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if batch.column(column).nbytes <= most_bytes:
            yield batch
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, size = 0, 0
        for i, n in enumerate(lengths):
            if i > start and size + n > most_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        yield batch.slice(start)


_KEPT: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]) -> object:
    """What this Python worker keeps for its next tasks, such as a model that remembers words; never more than one thing."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Free what tasks of other operators keep in this Python worker; Spark uses a worker again in later stages."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()


class Remembered(dict):
    """Results for short strings that a worker has met; what it holds changes speed only.

    It begins anew at about ``most`` bytes.  Keys of more than ``longest`` characters
    are not kept: their results are worked out each time.
    """

    def __init__(self, most: int = 24 << 20, longest: int = 64):
        super().__init__()
        self.most, self.longest, self.size = most, longest, 0

    def keep(self, key: str, value, value_bytes: int = 32):
        """Keep the value if the key is short, and return it."""
        if len(key) <= self.longest:
            # Key and value objects and their place in the table.
            self.size += sys.getsizeof(key) + value_bytes + 110
            if self.size > self.most:
                self.clear()
                self.size = 0
            self[key] = value
        return value


class Renewed(Remembered):
    """As above, in two halves: where the younger is full it becomes the older one, and what was older is forgotten.

    A caller that keeps again what ``find`` returned does not lose results that are asked for often.
    """

    def __init__(self, most: int = 24 << 20, longest: int = 64):
        super().__init__(most // 2, longest)
        self.before: dict = {}

    def clear(self) -> None:
        self.before = self.copy()
        super().clear()

    def find(self, key: str):
        """What is known of the key in either half, or None."""
        value = self.get(key)
        return self.before.get(key) if value is None else value


def same_columns(docs: DataFrame, df: DataFrame) -> DataFrame:
    """``df`` with exactly the columns of ``docs``, in their order."""
    return df.select(*docs.columns)
