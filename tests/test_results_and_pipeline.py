import pytest
from pyspark.sql import functions as F

from waymark.functions import phrases, text
from waymark.operators import results as rs
from waymark.plans.pipeline import Pipeline, Step, read_only
from waymark.streaming.match_stream import match_stream


@pytest.fixture
def found(spark):
    rows = [(1, 10, 0.9), (1, 11, 0.9), (2, 12, None), (3, 13, float("nan")), (3, 14, 0.2)]
    return spark.createDataFrame(rows, "address_id int, address_id2 int, similarity double")


def test_split(found):
    good, bad = rs.split_matched(found, 0.5)
    assert good.count() == 2 and bad.count() == 3


def test_order_and_first(found):
    assert [r.address_id2 for r in rs.ordered(found).collect()][2:] == [12, 14, 13]
    assert sorted(r.address_id2 for r in rs.one_each(found).collect()) == [10, 12, 14]


def test_truth(spark, found):
    results = found.withColumn("address_matched", F.lit(" Main st "))
    truth = spark.createDataFrame([(1, "MAIN ST"), (2, " "), (3, "other")], "address_id int, correct_match string")
    got = {(r.address_id, r.address_id2): r.correct for r in rs.answers_with_truth(results, truth).collect()}
    assert got[1, 10] is True and got[2, 12] is None and got[3, 14] is False


def test_pipeline(spark):
    p = Pipeline([Step("a", "SELECT id, id * 2 AS d FROM {src}", {"src": "numbers"})])
    p.add(Step("b", "SELECT sum(d) AS s FROM {a}", {"a": "a"}))
    assert p.run(spark, {"numbers": spark.range(5)}).first().s == 20
    assert "WITH a AS" in p.sql()
    with pytest.raises(ValueError):
        p.add(Step("a", "SELECT 1"))
    with pytest.raises(ValueError):
        Step("c", "SELECT * FROM {x}")
    assert len(p.remove("b").steps) == 1
    with pytest.raises(KeyError):
        p.remove("b")
    seen = []
    p.add(Step("first", lambda: seen.append(1), direct=True))
    p.run(spark, {"numbers": spark.range(2)})
    assert seen == [1]


def test_read_only(spark):
    assert read_only(spark, " with x as (select 1 as a) select * from x").count() == 1
    for bad in ("insert into t values (1)", "create table t as select 1", "set a=b"):
        with pytest.raises(ValueError):
            read_only(spark, bad)


def test_cleaning(spark):
    one = lambda f, s: spark.createDataFrame([(s,)], "s string").select(f(F.col("s"))).first()[0]
    assert one(text.clean_input, " 12b  Bolesławiec-Œuvre ß ") == "12B BOLESLAWIEC OEUVRE SS"
    assert one(text.clean_reference, "3/45 main  st, x-y") == "3/45 MAIN ST  X Y"
    assert one(text.numeric_tokens_input, "12AB 7") == ["12A", "7"] and one(text.numeric_tokens_input, "AB") is None
    assert one(lambda c: phrases.standard(F.split(c, " ")), "12 MAIN ST") == ["12 MAIN", "MAIN ST", "12 ST"]
    assert one(lambda c: phrases.bigrams(F.split(c, " ")), "MAIN") == [] and one(lambda c: phrases.skips(F.split(c, " ")), "A B") == []
    assert one(text.clean_input, None) is None


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "address_id int, address string").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("address_id int, address string").parquet(f"{tmp_path}/in")
    match_stream(source, lambda df: df.withColumn("address_matched", F.upper("address")), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
