"""Shared plumbing: spooled tables, row ids, shipping code to executors, Arrow mapping."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space, and tab to carriage return.  ``bytes.split()`` splits on exactly these.
BLANKS = " \t\n\x0b\f\r"

#: Maps A-Z to a-z on UTF-8 bytes and nothing else.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_shipped: set[str] = set()
_own_dir: dict[str, str] = {}
#: Folders that ``spool`` wrote and nothing has deleted yet, in order.
_spooled: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.  Where it is unset, a local session gets a temporary
    one; on a cluster that is an error, for a driver's folder holds nothing of what executors write."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="wideleaf-")
    return _own_dir[app]


def spool_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/wideleaf/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str) -> None:
    """A writer holds a row group in memory: of texts, smaller ones than Parquet's own 128 MiB will do."""
    df.write.option("parquet.block.size", 32 << 20).option("compression", "zstd").parquet(path)


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = spool_path(df.sparkSession, name)
    write(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._wideleaf_path = path
    _spooled.append(path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def unspool(df: DataFrame) -> None:
    """Delete what ``spool`` wrote, once nothing reads it any more."""
    if path := getattr(df, "_wideleaf_path", None):
        delete(df.sparkSession, path)
        if path in _spooled:
            _spooled.remove(path)


@contextmanager
def sweeping(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what was spooled inside: for jobs whose result is written by then."""
    before = set(_spooled)
    try:
        yield
    finally:
        for path in [p for p in _spooled if p not in before]:
            delete(spark, path)
            _spooled.remove(path)


#: A sieve has 2**SIEVE_BITS bits, in bitmaps of 2**15 (what a bitmap of Spark's holds): 8 MiB.
SIEVE_BITS = 26


def sieved(left: DataFrame, right: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """``left`` with ``flag``: false only where no row of ``right`` has the key.  ``right``'s keys are hashed to bits, at most 2048 rows of
    4 KiB, which are broadcast: so few rows that have no partner need to be shuffled."""
    place = F.shiftrightunsigned(F.xxhash64(*keys), 64 - SIEVE_BITS)
    bits = right.select(place.alias("p")).groupBy(F.shiftright("p", 15).alias("_bucket")).agg(F.bitmap_construct_agg(F.col("p") % (1 << 15)).alias("_bits"))
    inside = place % (1 << 15)
    placed = left.withColumns({"_bucket": F.shiftright(place, 15), "_inside": inside}).join(F.broadcast(bits), "_bucket", "left")
    byte = "cast(conv(hex(substring(_bits, cast(_inside div 8 as int) + 1, 1)), 16, 10) as int)"
    return placed.withColumn(flag, F.expr(f"coalesce(shiftright({byte}, cast(_inside % 8 as int)) & 1 = 1, false)")).drop("_bucket", "_inside", "_bits")


def attach(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", *, weight: str = "n", cost: Column | None = None, most: int = 1024) -> DataFrame:
    """``left`` joined with ``right``, a table with one row for each key and in ``weight`` how many rows of ``left`` have it.

    ``right`` is broadcast only if it has ``most`` rows or fewer (or its rows cost no more together).  Beyond, rows of ``left``
    that a sieve tells to have no partner stay where they are; keys that hold a 4096th of the rows or more, which are 4096
    at most, are broadcast, so that none of them ends up in one task; and only the others are shuffled, in the same way at
    any size.  Both tables are read
    more than once and must not change between: spool them first."""
    size, total = right.agg(F.coalesce(F.sum(F.lit(1) if cost is None else cost), F.lit(0)), F.coalesce(F.sum(weight), F.lit(0))).first()
    if size <= most:
        return left.join(F.broadcast(right), keys, how)
    limit = total / 4096
    hot = right.where(F.col(weight) >= limit)
    told = sieved(left, right, keys, "_maybe")
    maybe = told.where("_maybe").drop("_maybe")
    parts = [
        maybe.join(F.broadcast(hot), keys, "left_semi" if how == "left_semi" else "inner"),
        maybe.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(weight) < limit).hint("merge"), keys, how),
    ]
    if how == "left":
        alone = told.where("not _maybe").drop("_maybe")
        parts.append(alone.select(*[F.lit(None).cast(right.schema[c].dataType).alias(c) if c not in left.columns else F.col(f"`{c}`") for c in parts[1].columns]))
    return reduce(DataFrame.unionByName, parts)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, and keep Arrow batches small in bytes."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    if top.is_dir():
        target = Path(tempfile.mkdtemp(prefix="wideleaf-")) / "wideleaf_package.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent).as_posix())
        spark.sparkContext.addPyFile(str(target))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) == 10000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b") in ("67108864b", "67108864"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    _shipped.add(app)


def release() -> None:
    """Give freed memory back to the system.  Workers outlive their tasks, and what they keep counts beside the next stage's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        release()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def row_id() -> Column:
    """An id per row; stable over retries for files and spooled tables, whose splits keep their order."""
    return F.monotonically_increasing_id()


def packed(df: DataFrame, *, name: str = "row") -> DataFrame:
    """All columns of ``df`` in one struct, so that no column that we add can clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)) if df.columns else df.select(F.struct(F.lit(None).alias("none")).alias(name))


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, sorted."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
