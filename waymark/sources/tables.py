"""Loading address files, mapping their columns, and keeping indexes as folders of Parquet tables."""

from __future__ import annotations

import re
import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.errors import InvalidIndexError, SourceError

#: Logical columns of an address table, in order, and their types.
ADDRESS_COLUMNS = {"addr_id": "int", "ADDRESS_LABEL": "string", "ADDRESS_SITE_NAME": "string", "LOCALITY_NAME": "string", "POSTCODE": "string", "STATE": "string", "LATITUDE": "float", "LONGITUDE": "float"}


def read_addresses(spark: SparkSession, path: str, sep: str = ",", schema: str | None = None) -> DataFrame:
    """A file or folder by its extension: Parquet, or text with a header and separator (csv, psv, txt). ``schema`` saves inferring types."""
    kind = PurePosixPath(path.rstrip("/")).suffix.lower()
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind in (".csv", ".psv", ".txt", ".tsv"):
        sep = {".psv": "|", ".tsv": "\t"}.get(kind, sep)
        reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    raise SourceError(f"can't load files of kind {kind or 'unknown'!r}: {path}")


def map_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The logical columns from the source's columns; the values of ``mapping`` are columns or SQL expressions, absent ones null."""
    have = {k.lower(): v for k, v in mapping.items()}
    out = []
    for name, kind in ADDRESS_COLUMNS.items():
        source = have.get(name.lower())
        c = F.lit(None) if source is None else F.expr(source)
        out.append(c.cast(kind).alias(name))
    return df.select(*out)


def load_addresses(spark: SparkSession, path: str, mapping: dict[str, str], states: list[str] | None = None, sep: str = ",", state_column: str = "state") -> DataFrame:
    """The address table of a file; with ``states``, only rows whose column ``state_column`` of the source is one of them."""
    df = read_addresses(spark, path, sep)
    if states:
        df = df.where(F.col(state_column).isin(list(states)))
    return map_columns(df, mapping)


#: Columns of the Australian national address file, by logical column. Fixed values.
NATIONAL = {"addr_id": "ADDRESS_DETAIL_PID", "address_label": "ADDRESS_LABEL", "address_site_name": "ADDRESS_SITE_NAME", "locality_name": "LOCALITY_NAME", "postcode": "POSTCODE", "state": "STATE", "latitude": "LATITUDE", "longitude": "LONGITUDE"}


def load_national(spark: SparkSession, path: str, states: list[str] | None = None) -> DataFrame:
    """The address table of a national file, or of a folder of them, separated by pipes; of ``states``, VIC where none are given."""
    schema = ", ".join(f"{c} {ADDRESS_COLUMNS[k if k == 'addr_id' else k.upper()]}" for k, c in NATIONAL.items())
    reader = spark.read.option("header", True).option("sep", "|").option("quote", '"').option("escape", '"').option("enforceSchema", False)
    return map_columns(reader.schema(schema).csv(path).where(F.col("STATE").isin(states or ["VIC"])), NATIONAL)


def input_table(spark: SparkSession, addresses, ids=None) -> DataFrame:
    """(address_id, address) from a DataFrame, a list, a tuple, a text, or an array or series; ids default to 1, 2, ..."""
    if isinstance(addresses, DataFrame):
        return addresses.select("address_id", "address")
    if isinstance(addresses, str):
        addresses = [addresses]
    values = [None if a is None else str(a) for a in list(addresses)]
    ids = list(ids) if ids is not None else range(1, len(values) + 1)
    rows = [(int(i), a) for i, a in zip(ids, values, strict=True)]
    return spark.createDataFrame(rows, "address_id bigint, address string")


def with_row_ids(df: DataFrame, name: str = "row_num") -> DataFrame:
    """With ids 0, 1, ... in the order of the rows: ids within partitions, moved by the counts of those before. The driver gets a count per partition."""
    spark = df.sparkSession
    tagged = df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    counts = sorted(tagged.groupBy("_part").count().collect())
    start, before = [], 0
    for part, n in counts:
        start.append((part, before))
        before += n
    first = F.broadcast(spark.createDataFrame(start, "_part int, _first bigint"))
    place = F.col("_first") + F.col("_at") - F.shiftleft(F.col("_part").cast("bigint"), 33)
    return tagged.join(first, "_part").withColumn(name, place).select(*df.columns, name)


def tidy_to_parquet(spark: SparkSession, path: str, out: str, required: list[str], sep: str = ",") -> DataFrame:
    """Writes the required columns of a file with a row id as Parquet; a missing column is an error."""
    df = read_addresses(spark, path, sep)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise SourceError(f"columns {missing} are missing in {path}")
    with_row_ids(df.select(*required)).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def table_name(path: str) -> str:
    """The table that a file stands for: its name without extension and without a state prefix such as ``VIC_``, and without a ``_psv`` suffix."""
    stem = PurePosixPath(path).stem
    return re.sub(r"_psv$", "", re.sub(r"^[A-Z]{2,3}_", "", stem), flags=re.I).lower()


def register_files(spark: SparkSession, paths: list[str], sep: str = "|") -> list[str]:
    """Temporary views of files by their names; files of the same table are one view."""
    groups: dict[str, list[str]] = {}
    for p in paths:
        groups.setdefault(table_name(p), []).append(p)
    for name, files in groups.items():
        df = read_addresses(spark, files[0], sep)
        for p in files[1:]:
            df = df.unionByName(read_addresses(spark, p, sep), allowMissingColumns=True)
        df.createOrReplaceTempView(name)
    return sorted(groups)


def create_view_from_text(spark: SparkSession, name: str, query: str) -> None:
    """A temporary view from the text of a query."""
    spark.sql(query).createOrReplaceTempView(name)


def drop_views(spark: SparkSession) -> None:
    """Drops all temporary views."""
    for t in spark.catalog.listTables():
        if t.isTemporary:
            spark.catalog.dropTempView(t.name)


# An index is a folder of Parquet tables.

_SAFE = re.compile(r"[A-Za-z0-9_./:\-=@+ ]+")
_SCHEMES = ("file", "hdfs", "viewfs", "s3", "s3a", "gs", "abfs", "abfss", "wasbs")


def index_path(name: str, root: str | None = None) -> str:
    """The folder of an index: a path or URI as it is, else a name under ``root``. Other characters and schemes are refused."""
    if not name or not _SAFE.fullmatch(name) or ".." in name.split("/"):
        raise InvalidIndexError(f"not an allowed index path: {name!r}")
    scheme = re.match(r"([A-Za-z0-9+]+)://", name)
    if scheme and scheme[1].lower() not in _SCHEMES:
        raise InvalidIndexError(f"not an allowed kind of store: {scheme[1]!r}")
    return name if scheme or "/" in name or root is None else f"{root.rstrip('/')}/{name}"


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, folder: str) -> bool:
    path, fs = _path(spark, folder)
    return fs.exists(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a folder that all executors share and read again, so it is computed once and lost executors lose nothing.

    The folder is the one in spark.checkpoint.dir, or the warehouse where that is unset. The table goes when the application ends.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{shared.rstrip('/')}/waymark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path, fs = _path(spark, folder)
    fs.deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


def list_indexes(spark: SparkSession, root: str) -> list[str]:
    """Names of the indexes under ``root``."""
    path, fs = _path(spark, root)
    if not fs.exists(path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "addresses")))


def remove_index(spark: SparkSession, name: str, root: str) -> bool:
    """Deletes an index; false if there is none."""
    path, fs = _path(spark, index_path(name, root))
    return fs.delete(path, True) if fs.exists(path) else False


def export_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes tables as Parquet folders side by side."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def import_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of an exported folder."""
    path, fs = _path(spark, folder)
    if not fs.exists(path):
        raise InvalidIndexError(f"no index at {folder}")
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())
    return {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}") for n in names if not n.startswith(("_", "."))}
