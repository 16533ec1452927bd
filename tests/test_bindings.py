"""Tables of many rows are not sent to the driver, however small their files are."""

from fieldpulse.plans import queries
from fieldpulse.sources import bindings


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def folder(spark, tmp_path):
    for name, rows, schema in (
            ("orders", [(1, "1-URGENT", "2020-01-01", 5000.0)], "o_orderkey long, o_orderpriority string, o_orderdate string, o_totalprice double"),
            ("lineitem", [(1, 1, 1, 1, 3.0), (1, 2, 1, 2, 3.0)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"),
            ("part", [(1, "one", "Brand#1", "small"), (2, "two", "Brand#2", "small")], "p_partkey long, p_name string, p_brand string, p_type string"),
            ("supplier", [(1, "S")], "s_suppkey long, s_name string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_parts_are_joined_by_merging_when_they_are_many(spark, tmp_path, monkeypatch):
    place = folder(spark, tmp_path)

    def joins():
        names = bindings.commerce(spark, place, names=True).authorships
        members = queries._brand_membership(spark, place).join(spark.createDataFrame([("A1",)], "author_id string"), "author_id")
        assert sorted(r.author_name for r in names.select("author_name").collect()) == ["one", "two"]
        assert [r.community_id for r in members.collect()] == [1]
        return [plan(x).count("SortMergeJoin") for x in (names, members)]

    assert joins() == [0, 0]
    monkeypatch.setattr(bindings, "BROADCAST_ROWS", 1)
    assert joins() == [1, 1]
