from __future__ import annotations

import json

from pyspark.sql import functions as F

from parley.sources import records, reports


def test_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "a", "n": 1}\n\n{"id": "b"}\nnot json\n{"id": "a", "n": 3}\n')
    got = records.read_lines(spark, str(p), "id string, n bigint", {"n": 0})
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("a", 3), ("b", 0)]
    last = records.read_keyed(spark, str(p), "id string, n bigint", "id")
    assert sorted(map(str, map(tuple, last.collect()))) == ["('a', 3)", "('b', None)"]


def test_documents_by_path(spark, tmp_path):
    for s, i, t in (("x", "2", '{"v": 1}'), ("x", "10", '{"v": 2}'), ("y", "1", "broken")):
        (tmp_path / s / i).mkdir(parents=True)
        (tmp_path / s / i / "out.json").write_text(t)
    got = records.read_documents(spark, f"{tmp_path}/*/*/out.json", "v bigint", r"/(?P<subset>\w+)/(?P<sid>\d+)/out\.json")
    rows = [tuple(r) for r in got.orderBy("subset", F.col("sid").cast("int")).collect()]
    assert rows == [("x", "2", 1), ("x", "10", 2)]


def test_summaries(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"lang": "en", "rows": [{"model": "a", "v": 1.5}, {"model": "b", "v": None}]}, indent=1))
    got = records.read_summaries(spark, f"{tmp_path}/*.json", "lang string, rows array<struct<model:string,v:double>>")
    assert sorted(map(str, map(tuple, got.collect()))) == ["('en', 'a', 1.5)", "('en', 'b', None)"]


def test_parts_are_replaced(spark, tmp_path):
    path = f"{tmp_path}/t"
    records.write_records(spark.createDataFrame([(1, "a"), (2, "b")], "v int, task string"), path, ["task"])
    records.replace_part(spark.createDataFrame([(3, "b")], "v int, task string"), path, "task")
    rows = spark.read.parquet(path)
    assert sorted((r["v"], r["task"]) for r in rows.collect()) == [(1, "a"), (3, "b")]
    more = spark.createDataFrame([(1,), (9,)], "v int")
    assert [r["v"] for r in records.still_to_do(more, rows, "v").collect()] == [9]


def test_manifest_ignores_order(spark):
    a = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "i int, t string")
    one, two = records.manifest(a).first(), records.manifest(a.orderBy(F.desc("i")).repartition(7)).first()
    assert one == two and one["n"] == 50
    assert records.manifest(a.where("i > 0")).first()["digest"] != one["digest"]


def test_settings_and_reports(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"thresholds": {"c": 0.5}}',), ("no",)], "t string")
    assert [r[0] for r in df.select(records.settings(F.col("t"))).collect()] == [{"a": 1.0}, {"c": 0.5}, None]
    rep = spark.createDataFrame([("TOR: 0.25\n latency = 1.5\n",)], "t string")
    assert rep.select(records.metrics_of(F.col("t"), ["TOR", "latency", "other"])).first()[0] == {"TOR": 0.25, "latency": 1.5, "other": None}


def test_malformed_documents_are_null_rows(spark, tmp_path):
    for i, t in (("1", '{"v": 1}'), ("2", "broken"), ("3", "")):
        (tmp_path / i).mkdir()
        (tmp_path / i / "a.json").write_text(t)
    got = records.read_documents(spark, f"{tmp_path}/*/a.json", "v bigint", r"/(?P<sid>\d+)/a\.json", malformed=True)
    assert sorted(map(str, map(tuple, got.collect()))) == ["('1', 1)", "('2', None)"]


def test_scenarios_of_both_layouts(spark, tmp_path):
    for path, text in (("x/2", '{"v": 1}'), ("x/10", '{"v": 2}'), ("x/1", "broken"), ("x/odd", '{"v": 3}'), ("y/y/7", '{"v": 4}'), ("y/8", '{"v": 5}'), ("z/1", '{"v": 6}')):
        (tmp_path / path).mkdir(parents=True)
        (tmp_path / path / "in.json").write_text(text)
    (tmp_path / "x/2/other.json").write_text('{"v": 9}')
    read = lambda **k: sorted((r["subset"], r["sid"], r["place"], r["v"]) for r in records.read_scenarios(spark, str(tmp_path), "in.json", "v bigint", **k).collect())
    assert read() == [("x", 2, 1, 1), ("x", 10, 2, 2), ("y", 7, 1, 4), ("z", 1, 1, 6)]
    assert read(subsets=["x", "z"], limits={"x": 1}) == [("x", 2, 1, 1), ("z", 1, 1, 6)]


def test_splits_and_side_arrays(spark, tmp_path):
    rows = spark.createDataFrame([(i, [0.5] * (i % 3)) for i in range(10)], "id bigint, logits array<double>")
    records.write_split(rows, f"{tmp_path}/t", F.when(F.col("id") < 3, "eval").otherwise("train"), {"twice": F.concat("logits", "logits")})
    got = records.read_split(spark, f"{tmp_path}/t", "eval")
    assert sorted((r["id"], len(r["logits"]), len(r["twice"])) for r in got.collect()) == [(0, 0, 0), (1, 1, 2), (2, 2, 4)]
    assert "PartitionFilters: [isnotnull(split" in got._jdf.queryExecution().toString()


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.12345, 3, True), ("a|x", None, 1, None), ("c", float("nan"), 2, False)], "name string, rate double, n bigint, ok boolean")
    text = reports.markdown(df, ["name"], percent=("rate",), titles={"n": "N"})
    assert text.splitlines() == ["| name | rate | N | ok |", "|---|---:|---:|---|", "| a\\|x | – | 1 | – |", "| b | 12.3% | 3 | yes |", "| c | – | 2 | no |"]
    reports.write_report([("One", text), ("Two", "none\n")], f"file://{tmp_path}/r.md", spark)
    assert (tmp_path / "r.md").read_text().startswith("## One\n\n| name") and "## Two" in (tmp_path / "r.md").read_text()
    wide = reports.pivoted(spark.createDataFrame([("m", "x", 1.0), ("m", "y", 2.0), ("k", "x", 3.0)], "model string, task string, v double"), "model", "task", "v", ["x", "y"])
    assert sorted(map(str, map(tuple, wide.collect()))) == ["('k', 3.0, None)", "('m', 1.0, 2.0)"]
    two = reports.deltas(wide, wide.withColumn("x", F.col("x") + 1), "model", ["x"])
    assert sorted(r["x_delta"] for r in two.collect()) == [-1.0, -1.0]
