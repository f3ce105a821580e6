import json

from siftworks.sources import files


def test_files(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"item_id": "u", "correct_decision": "keep", "correct_tags": ["evals"]}]))
    got = files.labelled(spark, str(tmp_path / "l.json")).first()
    assert (got.item_id, got.correct_tags, got.notes) == ("u", ["evals"], None)
    df = spark.createDataFrame([("n", 1.5)], "node string, cost double")
    for _ in range(2):
        files.append_csv(df, f"{tmp_path}/c")
    assert spark.read.csv(f"{tmp_path}/c", header=True).count() == 2
    files.dump_json(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").first().cost == 1.5


def test_completions_are_asked_for_by_url(spark, tmp_path):
    spark.createDataFrame([(f"u{i}", i % 2 == 0) for i in range(50)], "url string, checked boolean").write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    got = files.asked(table, ["u1", "u2", "zzz"])
    assert sorted(map(tuple, got.collect())) == [("u1", False), ("u2", True)]
    assert "PushedFilters: [In(url" in got._jdf.queryExecution().toString() and files.asked(table, []).count() == 0
