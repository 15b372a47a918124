import pytest
from pyspark.sql import functions as F

from cellmend.config import Config
from cellmend.functions.text import embed, similarity
from cellmend.operators.detect import ErrorsLoaderDetector
from cellmend.sources import tables
from cellmend.sources.workspace import Workspace


def test_csv_is_text_with_missing_values(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('Name,City,Empty,Key\n"  New, ""York"" ",NA,,1\nÅngström\x1c,n/a,NULL,2\n   ,none,,3\n')
    df = tables.read_csv(spark, str(path), na_values=["none"], exclude=("Key",))
    assert df.columns == ["Name", "City", "Key"] or df.columns == ["Name", "Key"]
    rows = {r["Key"]: r["Name"] for r in df.collect()}
    assert rows == {"1": 'new, "york"', "2": "ångström", "3": ""}  # white space alone is a value


def test_columns_without_values_go_but_not_from_empty_tables(spark):
    df = spark.createDataFrame([("a", None), ("b", None)], "x string, y string")
    assert tables.drop_null_columns(df).columns == ["x"]
    assert tables.drop_null_columns(df.limit(0)).columns == ["x", "y"]


def test_tids_are_contiguous_and_in_order(spark):
    df = spark.range(1000).repartition(7).withColumn("v", F.col("id").cast("string")).select("v")
    rows = tables.with_tids(df).collect()
    assert sorted(r["_tid_"] for r in rows) == list(range(1000))


def test_entity_column_gives_tids(spark):
    assert {r["_tid_"] for r in tables.with_tids(spark.createDataFrame([("7", "a"), ("9", "b")], "k string, v string"), "k").collect()} == {7, 9}
    named = tables.with_tids(spark.createDataFrame([("q", "a"), ("b", "b"), ("q", "c")], "k string, v string"), "k").collect()
    assert {(r["_tid_"], r["v"]) for r in named} == {(1, "a"), (0, "b"), (1, "c")}


def test_known_errors_need_their_schema(spark):
    good = spark.createDataFrame([(1, "attr1"), (1, "attr2"), (2, "attr1"), (3, "attr2")], "_tid_ int, attribute string")
    assert tables.known_errors(good).count() == 4
    with pytest.raises(ValueError, match="The loaded errors table does not match the expected schema"):
        tables.known_errors(good.withColumnRenamed("attribute", "invalid_column"))


def test_known_errors_from_csv_and_table(spark, tmp_path):
    path = tmp_path / "errors.csv"
    path.write_text("id,attr\n1,City\n3,Zip\n")
    want = {(1, "City"), (3, "Zip")}
    assert {tuple(r) for r in ErrorsLoaderDetector.from_csv(spark, str(path), "id", "attr").detect().collect()} == want
    spark.createDataFrame([(1, "City"), (3, "Zip")], "id long, attr string").createOrReplaceTempView("known")
    assert {tuple(r) for r in ErrorsLoaderDetector.from_table(spark, "known", id_col="id", attr_col="attr").detect().collect()} == want
    with pytest.raises(ValueError, match="does not match the expected schema"):
        ErrorsLoaderDetector.from_csv(spark, str(path))


def test_kept_tables_are_cut_from_their_lineage(spark):
    work = Workspace(spark, "test")
    df = work.keep(spark.range(5).withColumn("x", F.col("id") * 2), "a")
    assert "Range" not in df._jdf.queryExecution().analyzed().toString() and sorted(r["x"] for r in df.collect()) == [0, 2, 4, 6, 8]
    work.close()
    with pytest.raises(Exception):
        spark.read.parquet(f"{work.path}/a").count()


def test_constraint_file(spark, tmp_path):
    path = tmp_path / "dc.txt"
    path.write_text("# note\n\nt1&EQ(t1.a,'x')  \n")
    assert tables.constraint_lines(spark, str(path)) == ["t1&EQ(t1.a,'x')"]


def test_ground_truth_drops_rows_without_value(spark):
    df = spark.createDataFrame([("1", "a", " X "), ("2", "a", "NA"), ("3", "b", None)], "t string, a string, v string")
    assert [tuple(r) for r in tables.ground_truth(df, "t", "a", "v").collect()] == [(1, "a", "x")]


def test_sql_source_and_store(spark, tmp_path):
    assert tables.read_sql(spark, "two", "SELECT 2 AS n").first()[0] == 2
    assert tables.store(spark.table("two"), "kept", str(tmp_path / "kept")).first()[0] == 2
    assert tables.read_table(spark, "kept").first()[0] == 2


def test_similarity():
    assert similarity("", "") == 1.0 and similarity("abc", "") == 0.0
    assert similarity("kitten", "sitting") == pytest.approx(2 * 4 / 13)


def test_embedding_is_stable_and_near_for_similar_texts():
    a, b, c = embed("birmingham"), embed("birminghxm"), embed("zzz")
    assert abs(a @ a - 1) < 1e-9 and a @ b > a @ c and (embed("birmingham") == a).all()


def test_settings_are_typed(monkeypatch):
    monkeypatch.setenv("CELLMEND_EPOCHS", "3")
    monkeypatch.setenv("CELLMEND_VERBOSE", "true")
    c = Config.of(learning_rate="0.5")
    assert (c.epochs, c.verbose, c.learning_rate) == (3, True, 0.5)
    assert Config.of(epochs=4).epochs == 4
    with pytest.raises(TypeError):
        Config.of(nothing=1)
