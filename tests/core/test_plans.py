"""Joins whose sides are larger than Spark takes them for."""

from driftloom.operators import palette
from driftloom.plans import registry


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_exploded_texts_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([(k, k % 50, "Brand#1") for k in range(1, 30)], "p_partkey int, p_size int, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    assert "BroadcastHashJoin" not in plan(registry.QUERIES["d12_file_rows"](spark, str(tmp_path)))


def test_postings_of_titles_are_not_broadcast(spark, monkeypatch):
    seen = []
    kept = palette.materialise
    monkeypatch.setattr(palette, "materialise", lambda df, label: (seen.append(plan(df)), kept(df, label))[1])
    got = palette.best_titles(spark.createDataFrame([("al",), ("ph",)], "query string"), spark.createDataFrame([(1, "alpha"), (2, "delta")], "id int, title string"))
    assert sorted((r.query, r.id) for r in got.collect()) == [("al", 1), ("ph", 1)]
    assert "part#" in seen[0] and "SortMergeJoin [c#" in seen[0]
