import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from waymark.errors import GeocodeError, InvalidIndexError, SourceError
from waymark.functions.text import LETTERS
from waymark.matcher import BuildConfig, Matcher, MatcherPipeline, build_index, run_benchmark, write_benchmark
from waymark.operators import index as ix
from waymark.plans import corpus
from waymark.sources import tables

MAPPING = {"addr_id": "nr", "address_label": "opis", "locality_name": "powiat", "postcode": "kod", "state": "woj", "latitude": "szer", "longitude": "dl"}
STREETS = ["Wałowa", "Tadeusza Kościuszki", "Ąę Źródlana", "3 Maja", "Łódzka-Nowa"]


def polish_rows():
    return [(i, f"{STREETS[i % 5]} {i % 13 + 1}{'abc'[i % 3] if i % 2 else ''} Żary", "żarski", "68-200", "lubuskie", 51.6 + i / 1000, 15.1) for i in range(60)] + [(60, "Wałowa Żary", "żarski", "68-200", "lubuskie", 51.0, 15.0)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("indexes"))
    config = BuildConfig("derived", "", {}, ["standard", "bigram", "skipphrase", "soundex", "trigram"])
    build_index(spark, config, root, corpus.addresses(spark, "/root/testdata/sf0.001"))
    return root


def test_loading_and_index_of_accented_addresses(spark, tmp_path):
    columns = "nr int, opis string, powiat string, kod string, woj string, szer double, dl double"
    spark.createDataFrame(polish_rows(), columns).coalesce(1).write.option("header", True).csv(f"{tmp_path}/a.csv")
    loaded = tables.load_addresses(spark, f"{tmp_path}/a.csv", MAPPING)
    assert loaded.columns == list(tables.ADDRESS_COLUMNS) and loaded.count() == 61
    assert dict(loaded.dtypes)["POSTCODE"] == "string" and dict(loaded.dtypes)["LATITUDE"] == "float"
    detail = ix.addresses_with_detail(loaded)
    assert detail.columns == ["addr_id", "addr", "numeric_tokens", "ADDRESS_LABEL", "suburb", "POSTCODE", "LATITUDE", "LONGITUDE", "STATE"]
    assert detail.count() == 60  # one has no numeric token
    want = []
    for r in detail.collect():
        clean = re.sub(f"[^A-Z0-9{LETTERS}]+", " ", re.sub(r"[\-.,;:_()!]+", " ", r.ADDRESS_LABEL.upper()))
        t = clean.split(" ")
        want += [(r.addr_id, f"{a} {b}") for a, b in zip(t, t[1:])] + [(r.addr_id, f"{a} {b}") for a, b in zip(t, t[2:]) if a.isdigit()]
    table = ix.phrase_table(detail)
    assert Counter(tuple(r) for r in table.collect()) == Counter(want)
    assert ix.invert(table).count() == len({p for _, p in want})


def test_reference_is_found_by_itself(spark, index):
    with Matcher(spark, "derived", root=index) as m:
        label = m.detail.orderBy("addr_id").first()
        got = m.geocode([label.ADDRESS_LABEL], address_ids=[7])
        assert got[0]["address_id"] == 7 and got[0]["address_id2"] == label.addr_id and got[0]["similarity"] == 1.0
        assert len(m.geocode(["no such place"])) == 1 and m.geocode(["no such place"])[0]["address_matched"] is None
        assert len({r["address_id2"] for r in m.geocode(label.ADDRESS_LABEL, top_n=3)}) == 3


@pytest.mark.parametrize("how", ["standard", "skipphrase", "trigram", "soundex", "bigram", "winkler"])
def test_every_matcher(spark, index, how):
    m = Matcher(spark, "derived", how, root=index)
    inputs = corpus.inputs(spark, "/root/testdata/sf0.001").limit(20)
    assert m.match(inputs).select("address_id").distinct().count() == 20


def test_errors(spark, index):
    with pytest.raises(GeocodeError):
        Matcher(spark, "derived", "guess", root=index)
    with pytest.raises(InvalidIndexError):
        Matcher(spark, "absent", root=index)
    for bad in ("../x", "a;b", "duckdb://x", ""):
        with pytest.raises(InvalidIndexError):
            tables.index_path(bad, index)
    m = Matcher(spark, "derived", root=index)
    with pytest.raises(GeocodeError):
        m.geocode([])
    with pytest.raises(SourceError):
        tables.read_addresses(spark, "x.xlsx")
    with pytest.raises(ValueError):
        m.query("DROP TABLE addresses")
    assert m.query("SELECT count(*) AS n FROM addresses").first().n == m.detail.count()


def test_cascade_and_benchmark(spark, index, tmp_path):
    inputs = corpus.inputs(spark, "/root/testdata/sf0.001")
    one = Matcher(spark, "derived", "standard", 0.95, index)
    two = Matcher(spark, "derived", "trigram", 0.3, index)
    both = MatcherPipeline([one, two]).match(inputs)
    assert both.count() == inputs.count() == both.select("address_id").distinct().count()
    with pytest.raises(ValueError):
        MatcherPipeline([one, two], ["standard"])
    pairs = inputs.join(one.detail.select((F.col("addr_id") + 1).alias("address_id"), F.col("addr").alias("expected_address")), "address_id").withColumnRenamed("address", "input_address")
    rows, summary = run_benchmark(one, pairs)
    s = summary.first()
    assert s.total == s.matched + s.unmatched == inputs.count() and s.match_rate > 0.5
    write_benchmark(rows, f"{tmp_path}/rows")
    assert spark.read.option("header", True).csv(f"{tmp_path}/rows").count() == s.total


def test_reverse(spark, index):
    m = Matcher(spark, "derived", root=index)
    points = m.detail.select(F.col("addr_id").alias("query_id"), F.col("LATITUDE").alias("latitude"), F.col("LONGITUDE").alias("longitude"))
    assert m.reverse_geocode(points).where("distance > 1e-6").count() == 0


def test_catalogue(spark, index):
    assert tables.list_indexes(spark, index) == ["derived"]
    assert not tables.remove_index(spark, "absent", index)
    frames = tables.import_tables(spark, f"{index}/derived")
    assert set(frames) == {"addresses", "standard_index", "bigram_index", "skipphrase_index", "soundex_index", "trigram_index"}


def test_row_ids_and_names(spark, tmp_path):
    df = tables.with_row_ids(spark.range(0, 1000, 1, 7))
    assert df.where("row_num != id").count() == 0
    assert tables.table_name("/x/VIC_ADDRESS_DETAIL_psv.psv") == "address_detail"
    spark.createDataFrame([(1, "a|b")], "k int, v string").write.option("header", True).option("sep", "|").csv(f"{tmp_path}/NSW_T_psv.psv")
    assert tables.register_files(spark, [f"{tmp_path}/NSW_T_psv.psv"]) == ["t"]
    assert spark.table("t").first().v == "a|b"
    tables.drop_views(spark)


def test_configuration(tmp_path):
    (tmp_path / "c.yml").write_text("data:\n  db_name: x\n  folder: /d\n  filepath: a.csv\n  sep: '|'\ngeocoder:\n  matchers: [standard, trigram]\n  states:\n    - VIC\nschema:\n  addr_id: id\n  address_label: label\n")
    c = BuildConfig.from_yaml(str(tmp_path / "c.yml"))
    assert (c.name, c.path, c.sep, c.indexes, c.states, c.mapping) == ("x", "/d/a.csv", "|", ["standard", "trigram"], ["VIC"], {"addr_id": "id", "address_label": "label"})
