"""What the training-data operators share: tables, shared storage, batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; longer texts are handled alone.
SLICE_BYTES = 1_500_000


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for an application: their Python need not have it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parent.parent
    if package.suffix == ".zip" or not package.is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="riskmart-")) / f"{package.name}-package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset one in the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate").rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/riskmart-{what}-{uuid.uuid4().hex}"


_scratch: list[list[tuple[SparkSession, str]]] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end what materialise() has written within, but for what is to be kept: for callers who write the result before that."""
    _scratch.append([])
    try:
        yield
    finally:
        for spark, path in _scratch.pop():
            delete(spark, path)


def materialise(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again. A lost executor then costs one stage, not the whole job."""
    spark = df.sparkSession
    path = new_path(spark, what)
    if _scratch and not keep:
        _scratch[-1].append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._riskmart_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote, once nothing reads it any more."""
    path = getattr(df, "_riskmart_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def as_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id long, text string): all that an operator needs, whatever else and under whatever names df has; columns in carry come along as carry_<name>."""
    ship(df.sparkSession)
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"), *[df[c].alias(f"carry_{c}") for c in carry])


#: A key is hot if it has more than this share of all rows; there are fewer than HOT_KEYS such keys, so their names can be broadcast.
HOT_KEYS, _LEAST_HOT = 10_000, 64


def join_to_keys(left: DataFrame, right: DataFrame, on: str | list[str], total: int, how_many: str = "n_left") -> DataFrame:
    """left joined with right, which has one row for each key, and in how_many the number of its rows in left (total in all).

    A hot key's rows are dealt over as many parts as it has hot shares, and its row in right is repeated for each. So a key that has a third of all rows is in
    no one task, whatever adaptive execution does. Only names of hot keys (not their rows) are broadcast, and always the most frequent one, so that the plan is
    the same whether it is hot or not. Both should be written tables: left is dealt by its order, and of right Spark then knows the size.
    """
    on = [on] if isinstance(on, str) else on
    limit = max(_LEAST_HOT, total // HOT_KEYS)
    parts = F.ceil(F.col(how_many) / limit).cast("int")
    hot = right.where(F.col(how_many) > limit).select(*on, parts.alias("_parts"))
    hot = hot.unionByName(right.orderBy(F.desc(how_many), *on).limit(1).select(*on, parts.alias("_parts"))).distinct()
    spread = right.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop(how_many)
    dealt = left.join(F.broadcast(hot), on, "left").withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    return dealt.join(spread, [*on, "_part"]).drop("_part")


def free_name(columns: list[str], wanted: str) -> str:
    """wanted, or with underscores in front what none of the columns is called (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def held_out(col: str = "doc_id"):
    """The rows that no model learns from: crc32 of the id as text, modulo 4, is 2. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def slices(batches: Iterator[pa.RecordBatch], col: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Pieces of each batch with at most `most` bytes of text (or one row), and their texts with nulls as empty."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(col)).cast(pa.large_string()), "")
        ends = np.cumsum(np.asarray(pc.binary_length(texts)))
        at = 0
        while at < batch.num_rows:
            used = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, used + most, "right")))
            yield batch.slice(at, to - at), texts.slice(at, to - at)
            at = to
    _give_back()


def _give_back() -> None:
    """Return freed memory to the system: a worker lives on and would hold what one task has used."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a large_string array and the n + 1 offsets of its texts in them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def crc32(ids: np.ndarray) -> int:
    """Of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
