"""The library's face: build an index from a configuration, match against it, cascade, and look up points."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.errors import GeocodeError, InvalidIndexError
from waymark.operators import index as ix
from waymark.operators import match as mt
from waymark.operators import nearest as nr
from waymark.operators import results as rs
from waymark.plans.pipeline import read_only
from waymark.sources import tables

INDEXES = ("standard", "bigram", "skipphrase", "soundex", "trigram")
#: The largest frequency that any matcher of an index uses.
CAPS = {"standard": 1000, "bigram": 1000, "skipphrase": 1000, "soundex": 20_000, "trigram": 10_000}


@dataclass
class BuildConfig:
    """What to build: a source file with its mapping, and the indexes of the index called ``name``."""

    name: str
    path: str
    mapping: dict[str, str]
    indexes: list[str] = field(default_factory=lambda: ["standard"])
    states: list[str] | None = None
    sep: str = ","
    normalise_reference: bool = False

    @classmethod
    def from_dict(cls, d: dict) -> BuildConfig:
        """From the sections data (db_name, folder, filepath, sep), geocoder (matchers, states) and schema."""
        data, coder = d.get("data", {}), d.get("geocoder", {})
        folder, file = data.get("folder"), data["filepath"]
        path = f"{folder.rstrip('/')}/{file}" if folder and not file.startswith("/") and "://" not in file else file
        return cls(data["db_name"], path, dict(d["schema"]), list(coder.get("matchers") or ["standard"]), coder.get("states") or None, data.get("sep") or ",")

    @classmethod
    def from_yaml(cls, path: str) -> BuildConfig:
        try:
            import yaml
        except ImportError:
            return cls.from_dict(_plain_yaml(Path(path).read_text(encoding="utf-8")))
        return cls.from_dict(yaml.safe_load(Path(path).read_text(encoding="utf-8")))


def _plain_yaml(text: str) -> dict:
    """Mappings of two levels with scalars and lists, all that a configuration needs."""

    def scalar(v):
        v = v.strip()
        if v.startswith("[") and v.endswith("]"):
            return [scalar(x) for x in v[1:-1].split(",") if x.strip()]
        return v.strip("'\"") if v not in ("", "null", "~") else None

    out: dict = {}
    section = key = None
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#") or line.strip() == "---":
            continue
        body = line.strip()
        if body.startswith("- "):
            if not isinstance(out[section].get(key), list):
                out[section][key] = []
            out[section][key].append(scalar(body[2:]))
        elif line[0] not in " \t":
            section, _, value = body.partition(":")
            out[section] = scalar(value) or {}
        else:
            key, _, value = body.partition(":")
            out[section][key] = scalar(value)
    return out


def build_index(spark: SparkSession, config: BuildConfig, root: str, addresses: DataFrame | None = None) -> str:
    """Writes an index's tables under ``root`` and gives its folder. Posting rows are sorted by phrase, so lookups skip files by their statistics."""
    unknown = set(config.indexes) - set(INDEXES)
    if unknown:
        raise GeocodeError(f"unknown indexes {sorted(unknown)}")
    folder = tables.index_path(config.name, root)
    if addresses is None:
        addresses = tables.load_addresses(spark, config.path, config.mapping, config.states, config.sep)
    ix.addresses_with_detail(addresses, config.normalise_reference).write.mode("overwrite").parquet(f"{folder}/addresses")
    detail = spark.read.parquet(f"{folder}/addresses")
    for name in config.indexes:
        if name == "trigram":
            postings, key = ix.trigram_phrases(ix.phrase_table(detail, "standard")), "trigramphrase"
        else:
            postings, key = ix.phrase_table(detail, name), "tokenphrase"
        kept = ix.capped_postings(postings, key, CAPS[name])
        counts = kept.groupBy(key).agg(F.count(F.lit(1)).alias("frequency"))
        out = kept.join(counts, key).select(F.col(key).alias("key"), "addr_id", "frequency")
        out.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{folder}/{name}_index")
    return folder


class Matcher:
    """Matches against an index; usable as a context manager."""

    def __init__(self, spark: SparkSession, index: str, how: str = "standard", threshold: float = 0.5, root: str | None = None):
        self.spark, self.how, self.threshold = spark, how, threshold
        self._check(how)
        self.folder = tables.index_path(index, root)
        if not tables.exists(spark, f"{self.folder}/addresses"):
            raise InvalidIndexError(f"no index at {self.folder}")
        self.detail = spark.read.parquet(f"{self.folder}/addresses")

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    @staticmethod
    def _check(how):
        if how not in mt.CATALOGUE:
            raise GeocodeError(f"how is {how!r}, not one of {sorted(mt.CATALOGUE)}")

    def postings(self, spec: mt.MatchSpec) -> DataFrame:
        path = f"{self.folder}/{mt.INDEX[spec.phrases]}_index"
        if not tables.exists(self.spark, path):
            raise InvalidIndexError(f"the index has no table {path.rsplit('/', 1)[1]}")
        return self.spark.read.parquet(path).where(F.col("frequency") < spec.cap).select("key", "addr_id")

    def match(self, inputs: DataFrame, top_n: int = 1, how: str | None = None, neighbours: DataFrame | None = None) -> DataFrame:
        """DataFrame in, DataFrame out; lazy."""
        how = how or self.how
        self._check(how)
        if top_n < 1:
            raise GeocodeError("top_n must be 1 or more")
        spec = mt.CATALOGUE[how]
        return mt.match(inputs, self.detail, self.postings(spec), spec, top_n, neighbours)

    def geocode(self, addresses, top_n: int = 1, address_ids=None, how: str | None = None) -> list[dict]:
        """A list in, a list of dicts out, by input and best first."""
        if not isinstance(addresses, (DataFrame, str)) and len(addresses) == 0:
            raise GeocodeError("no addresses")
        if address_ids is not None and len(address_ids) != len(addresses):
            raise GeocodeError("as many ids as addresses are needed")
        inputs = tables.input_table(self.spark, addresses, address_ids)
        return [r.asDict(recursive=True) for r in rs.ordered(self.match(inputs, top_n, how)).collect()]

    def reverse_geocode(self, points: DataFrame) -> DataFrame:
        """The nearest address of each point (query_id, latitude, longitude)."""
        found = nr.nearest(points, self.detail.select("addr_id", F.col("LATITUDE").alias("latitude"), F.col("LONGITUDE").alias("longitude")))
        return found.join(self.detail.select("addr_id", F.col("ADDRESS_LABEL").alias("address"), "suburb", F.col("POSTCODE").alias("postcode"), "LATITUDE", "LONGITUDE"), "addr_id")

    def query(self, sql: str) -> DataFrame:
        """A reading query over the index's tables as views."""
        for name, df in tables.import_tables(self.spark, self.folder).items():
            df.createOrReplaceTempView(name)
        return read_only(self.spark, sql)


class MatcherPipeline:
    """Matchers one after another, each for what those before left below their thresholds."""

    def __init__(self, matchers: list[Matcher], query_types: list[str] | None = None):
        if query_types and len(query_types) != len(matchers):
            raise ValueError("as many query types as matchers are needed")
        self.set_matchers(matchers, query_types)

    def set_matchers(self, matchers: list[Matcher], query_types: list[str] | None = None) -> None:
        self.matchers, self.query_types = list(matchers), query_types or [m.how for m in matchers]

    def match(self, inputs: DataFrame, cut=lambda df: tables.written(df, "cascade")) -> DataFrame:
        """Each matcher's results are written once by ``cut``; None computes them anew wherever they are needed."""
        steps = [(lambda df, m=m, how=how: m.match(df, how=how), m.threshold) for m, how in zip(self.matchers, self.query_types)]
        return rs.cascade(inputs, steps, cut)

    def geocode(self, addresses, address_ids=None) -> list[dict]:
        inputs = tables.input_table(self.matchers[0].spark, addresses, address_ids)
        return [r.asDict(recursive=True) for r in rs.ordered(self.match(inputs)).collect()]


def run_benchmark(matcher: Matcher, pairs: DataFrame, how: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, summary) of pairs (address_id, input_address, expected_address)."""
    inputs = pairs.select("address_id", F.col("input_address").alias("address"))
    rows = rs.judged(matcher.match(inputs, how=how), pairs.select("address_id", "expected_address"))
    return rows, rs.accuracy(rows)


def write_benchmark(rows: DataFrame, path: str) -> None:
    """The judged rows as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)
