"""Loading by state, tidying, exporting, removing, views, and the command line."""

import pytest
from pyspark.sql import functions as F

from waymark import __main__ as cli
from waymark.errors import SourceError
from waymark.functions.similarity import soundex
from waymark.matcher import Matcher
from waymark.operators import index as ix
from waymark.operators import match as mt
from waymark.operators import nearest as nr
from waymark.plans import corpus
from waymark.sources import tables

ROWS = [(f"{i}", f"{i + 1} High St Town {i % 3}", "", f"Town {i % 3}", "3000", ("VIC", "NSW", "VIC")[i % 3], -37.0 - i / 100, 145.0 + i / 50) for i in range(30)]
COLUMNS = "ADDRESS_DETAIL_PID string, ADDRESS_LABEL string, ADDRESS_SITE_NAME string, LOCALITY_NAME string, POSTCODE string, STATE string, LATITUDE double, LONGITUDE double"


@pytest.fixture
def file(spark, tmp_path):
    spark.createDataFrame(ROWS, COLUMNS).coalesce(1).write.option("header", True).option("sep", "|").csv(f"{tmp_path}/a.psv")
    return f"{tmp_path}/a.psv"


def test_states(spark, file):
    got = tables.load_addresses(spark, file, tables.NATIONAL, ["NSW"], state_column="STATE")
    assert {r.addr_id for r in got.collect()} == {int(r[0]) for r in ROWS if r[5] == "NSW"}
    assert tables.load_addresses(spark, file, tables.NATIONAL).count() == 30
    assert {r.addr_id for r in tables.load_national(spark, file).collect()} == {int(r[0]) for r in ROWS if r[5] == "VIC"}
    both = tables.load_national(spark, file, ["VIC", "NSW"])
    assert both.count() == 30 and both.columns == list(tables.ADDRESS_COLUMNS)


def test_tidy_and_tables(spark, file, tmp_path):
    tidy = tables.tidy_to_parquet(spark, file, f"{tmp_path}/t", ["ADDRESS_LABEL", "STATE"], "|")
    assert sorted(r.row_num for r in tidy.collect()) == list(range(30)) and tidy.columns == ["ADDRESS_LABEL", "STATE", "row_num"]
    with pytest.raises(SourceError):
        tables.tidy_to_parquet(spark, file, f"{tmp_path}/u", ["ADDRESS_LABEL", "NOT_THERE"], "|")
    tables.export_tables({"one": tidy, "two": spark.range(3)}, f"{tmp_path}/e")
    back = tables.import_tables(spark, f"{tmp_path}/e")
    assert set(back) == {"one", "two"} and back["two"].count() == 3 and back["one"].count() == 30
    back["two"].createOrReplaceTempView("two")
    tables.create_view_from_text(spark, "big", "SELECT id FROM two WHERE id > 1")
    assert [r.id for r in spark.table("big").collect()] == [2]
    tables.drop_views(spark)
    assert not [t for t in spark.catalog.listTables() if t.isTemporary]


def test_written(spark):
    df = tables.written(spark.range(5).withColumn("r", F.rand()), "t")
    assert df.collect() == df.collect() and "/waymark-t-" in df.inputFiles()[0]


def test_command_line(spark, file, tmp_path, capsys):
    config = tmp_path / "c.yml"
    config.write_text(f"data:\n  db_name: town\n  filepath: {file}\n  sep: '|'\ngeocoder:\n  matchers: [standard]\nschema:\n" + "".join(f"  {k}: {v}\n" for k, v in tables.NATIONAL.items()))
    run = lambda *args: cli.main(["--root", str(tmp_path / "root"), *args])
    assert run("build", str(config)) == 0 and run("list") == 0
    assert "town" in capsys.readouterr().out.splitlines()
    spark.createDataFrame([("5 high st town 1",), ("nowhere",)], "address string").coalesce(1).write.option("header", True).csv(f"{tmp_path}/in.csv")
    assert run("geocode", "town", f"{tmp_path}/in.csv", f"{tmp_path}/out") == 0
    got = {r.input_address: r.address_id2 for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"5 HIGH ST TOWN 1": 4, "NOWHERE": None}
    spark.createDataFrame([(1, -37.101, 145.21)], "query_id int, latitude double, longitude double").coalesce(1).write.option("header", True).csv(f"{tmp_path}/p.csv")
    assert run("reverse", "town", f"{tmp_path}/p.csv", f"{tmp_path}/near") == 0
    assert [r.addr_id for r in spark.read.parquet(f"{tmp_path}/near").collect()] == [10]
    spark.createDataFrame([("5 high st town 1", "5 HIGH ST TOWN 1"), ("6 high st town 2", "wrong")], "input_address string, best_match string").coalesce(1).write.option("header", True).csv(f"{tmp_path}/b.csv")
    assert run("benchmark", "town", f"{tmp_path}/b.csv", "--output", f"{tmp_path}/judged") == 0
    assert "'match_rate': 0.5" in capsys.readouterr().out and spark.read.option("header", True).csv(f"{tmp_path}/judged").count() == 2
    # An index is replaced by building it again, and removed once.
    before = Matcher(spark, "town", root=str(tmp_path / "root")).detail.count()
    assert run("build", str(config)) == 0 and Matcher(spark, "town", root=str(tmp_path / "root")).detail.count() == before == 30
    assert run("remove", "town") == 0 and run("remove", "town") == 1 and tables.list_indexes(spark, str(tmp_path / "root")) == []
    with pytest.raises(SystemExit):
        cli.main(["--root", "x"])


def test_soundex(spark):
    """Codes by the rule: equal codes that stand together count once, also across H and W, but not across vowels."""
    words = {"ROBERT": "R163", "RUPERT": "R163", "ASHCRAFT": "A261", "TYMCZAK": "T522", "PFISTER": "P236", "LEE": "L000", "": "", "12A": "12A", "HONEYMAN": "H555"}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.s for r in df.select("w", soundex(F.col("w")).alias("s")).collect()} == words


def test_repeated_ids_join_by_id(spark):
    """per_row=False takes the tokens of all rows of an id and address, and an id that repeats multiplies."""
    df = spark.createDataFrame([(1, "1 A St", "T", "1", "S", 0.0, 0.0), (1, "1 A St", "T", "1", "S", 0.0, 0.0), (2, "2 B St", "T", "1", "S", 0.0, 0.0), (3, "no number", "T", "1", "S", 0.0, 0.0)], "addr_id int, ADDRESS_LABEL string, LOCALITY_NAME string, POSTCODE string, STATE string, LATITUDE double, LONGITUDE double")
    assert sorted((r.addr_id, tuple(r.numeric_tokens)) for r in ix.addresses_with_detail(df, per_row=False).collect()) == [(1, ("1", "1")), (1, ("1", "1")), (2, ("2",))]
    assert ix.addresses_with_detail(df).count() == 3
    table = spark.createDataFrame([(1, "AB CD"), (1, "AB CD"), (2, "AB CD")], "addr_id int, tokenphrase string")
    assert ix.trigram_phrases(table).count() * 2 == ix.trigram_phrases(table, distinct_per_phrase=True).count() * 3


def test_neighbours_put_the_place_in(spark):
    folder = "/root/testdata/sf0.001"
    spaced = lambda df, *names: df.withColumns({c: F.translate(c, "_", " ") for c in names})
    detail = spaced(ix.addresses_with_detail(corpus.addresses(spark, folder)), "suburb")
    places = spaced(corpus.neighbours(spark, folder), "suburb_name", "neighbour_suburb_state_postcode")
    postings = ix.capped_postings(ix.phrase_table(detail), "tokenphrase", 1000).selectExpr("tokenphrase AS key", "addr_id")
    rows = mt.match(corpus.inputs(spark, folder), detail, postings, "standard", 5, places).where("address_id2 IS NOT NULL").collect()
    moved = [r for r in rows if r.neighbouring_suburb_correction]
    near = {(r.suburb_name, r.neighbour_suburb_state_postcode): r.state_name for r in places.collect()}
    wrong = []
    for r in rows:
        own = [f"{r.suburb} {state} {r.postcode}" for (suburb, _), state in near.items() if suburb == r.suburb]
        others = {r.address_matched.replace(own[0], n) for (suburb, n) in near if suburb == r.suburb}
        if r.address_matched_ns not in others or (r.address_matched_ns != r.address_matched) != r.neighbouring_suburb_correction:
            wrong.append((r.address_matched, r.address_matched_ns, r.suburb, r.postcode, r.neighbouring_suburb_correction))
    assert moved and not wrong, wrong[:5]


def test_nearest_against_all(spark):
    """Clusters, far queries, equal points and ties, against every distance."""
    import random

    rng = random.Random(4)
    points = [(i, rng.gauss(10, 0.01), rng.gauss(20, 0.01)) for i in range(300)] + [(1000 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(100)]
    points += [(2000, 50.0, 50.0), (1999, 50.0, 50.0), (2001, 50.0, 52.0), (3000, None, 1.0)]
    queries = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)] + [(100, 50.0, 51.0), (101, 10.0, 20.0), (102, 1e4, -1e4), (103, None, None), (104, 50.0, 50.0)]
    p = spark.createDataFrame(points, "addr_id int, latitude double, longitude double")
    q = spark.createDataFrame(queries, "query_id int, latitude double, longitude double")
    got = {r.query_id: r.addr_id for r in nr.nearest(q, p).collect()}
    want = {i: min((((x - b) ** 2 + (y - a) ** 2), k) for k, a, b in points if a is not None)[1] for i, y, x in queries if y is not None}
    assert got == want
    assert nr.nearest(q, p.limit(0)).count() == 0 and nr.nearest(q.limit(0), p).count() == 0
    one = {r.addr_id for r in nr.nearest(q, p.where("addr_id = 5")).collect()}
    assert one == {5}
