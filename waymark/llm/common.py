"""What the corpus operators share: words, hashes, batches and tables in the shared folder."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch that goes to Python: whole texts, so few of them.
BATCH_ROWS = 512

#: The bytes that separate words: space and \t to \r. ``bytes.split()`` splits at exactly these.
SPACES = b" \t\n\r\x0b\x0c"

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
ROLL = np.uint64(0xD6E8FEB86659FD93)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def python_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see (spark.checkpoint.dir); the warehouse only where it is unset."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here, and lost executors lose nothing.

    The table stays until :func:`discard`; those that a result still reads go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/waymark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that :func:`cut` wrote; nothing that is still to run may read them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (a bijection), so that near values get far hashes."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each window of ``n`` words, or of those that begin at ``at``; empty if there are fewer words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy() if at is None else hashes[at]
    for k in range(1, n):
        out *= ROLL
        out += hashes[k : k + m] if at is None else hashes[at + k]
    return mix(out)


def texts(column) -> list[str]:
    """The texts of an Arrow column, null as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def schemas(ddl: str):
    """The Spark and the Arrow schema of ``ddl``; needs a session, so it is called on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(ddl)
    return kind, to_arrow_schema(kind)


def record(schema, columns):
    """An Arrow batch of ``schema`` from arrays or lists."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def map_texts(df: DataFrame, id_col: str, text: str, fields: str, make) -> DataFrame:
    """``id_col`` and the columns ``fields``, for each row. ``make()``, called in the worker, gives a function from a text to a tuple.

    Only these two columns of ``df`` are read, so others may have any names. A batch of rows is in memory at once.
    """
    python_batches(df.sparkSession)
    kind, arrow = schemas(f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {fields}")

    def run(batches):
        f = make()
        for batch in batches:
            rows = [f(t) for t in texts(batch.column(1))]
            yield record(arrow, [batch.column(0), *(zip(*rows) if rows else [[]] * (len(arrow) - 1))])

    return df.select(id_col, text).mapInArrow(run, kind)


def keep_rows(df: DataFrame, text: str, make) -> DataFrame:
    """The rows of ``df`` whose text makes ``make()``'s function true, all columns as they were."""
    import pyarrow as pa

    python_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches):
        f = make()
        for batch in batches:
            yield batch.filter(pa.array([bool(f(t)) for t in texts(batch.column(at))], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def bitmap(df: DataFrame, key: str, bits: int) -> np.ndarray:
    """A filter of ``2**bits`` bits, whatever the number of rows: those of the first ``bits`` of the hashes in ``key`` are set."""
    from pyspark.sql import functions as F

    at = f"shiftrightunsigned(`{key}`, {64 - bits})"
    rows = df.select(F.expr(f"cast(shiftright({at}, 6) as int)").alias("at"), F.expr(f"shiftleft(1L, cast({at} & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def in_bitmap(filter_bits: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether each hash may be among those of :func:`bitmap`; never false for one that is."""
    at = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (filter_bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


#: A filter has eight bits or more for each thing in it, and at most so many as a power of 2 (32 MB).
MOST_BITS = 28


def filter_of(df: DataFrame, key: str, rows: int | None = None) -> tuple[np.ndarray, int]:
    """A bit filter of the hashes in ``key`` that grows with the number of rows, and its bits as a power of 2. False hits grow beyond the bound.

    ``df`` is a written table, or ``rows`` is at least its number of rows.
    """
    bits = min(MOST_BITS, max(12, (8 * (df.count() if rows is None else rows)).bit_length()))
    return bitmap(df, key, bits), bits


def may_hold(held: tuple[np.ndarray, int], hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter; never false for one that is."""
    return in_bitmap(held[0], hashes.view(np.uint64), held[1])
