"""What the operators share: tables, scratch folders and fixed text rules."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: blank and tab to carriage return, no other.
WS_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
WS_BYTES = b" \t\n\x0b\x0c\r"

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="fragmenta-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one where that is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        found = _own_dir()
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the process ends."""
    path = f"{scratch_dir(spark)}/fragmenta-{uuid.uuid4().hex}/{name}"
    _made.append((spark, path.rpartition("/")[0]))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file:").replace("//", "/", 1), ignore_errors=True)
        else:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for entry in _made:
        _delete(*entry)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path.rpartition("/")[0]
    return out


@contextlib.contextmanager
def without_shuffle_files(spark: SparkSession):
    """While it holds, shuffle files go as soon as their query has ended, instead of when the driver happens to collect its garbage.

    For steps whose tables are materialized: a DataFrame that is run again is computed again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def free(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more."""
    for df in tables:
        for entry in [x for x in _made if x[1] == getattr(df, "_written", None)]:
            _delete(*entry)
            _made.remove(entry)


def fresh(name: str, taken) -> str:
    """The name, with as many _ behind it as no taken name (in any case) needs."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name


def aside(docs: DataFrame, names) -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns of these names called otherwise, and how to call them back."""
    lower = {x.lower() for x in names}
    out: dict[str, str] = {}
    for c in docs.columns:
        if c.lower() in lower:
            out[fresh(f"{c}_", {*docs.columns, *names, *out})] = c
    return docs.withColumnsRenamed({v: k for k, v in out.items()}), out


def n_words(text: Column) -> Column:
    """Runs of other characters than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold kept for testing; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def text_slices(column: pa.Array, most: int = 1_000_000):
    """(begin, end, texts) of a column of texts, of about `most` bytes together; a longer text stands alone.

    Only one slice at a time is made into Python's strings. What a batch has freed goes back to the system: workers live on, and else keep
    what the largest batch took.
    """
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > most:
            yield begin, i, column.slice(begin, i - begin).to_pylist()
            begin, total = i, 0
        total += n
    if begin < len(column):
        yield begin, len(column), column.slice(begin).to_pylist()
    give_back()


def give_back() -> None:
    """Returns freed memory of Arrow and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
