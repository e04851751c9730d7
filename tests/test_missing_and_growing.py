"""NaN, NULL keys, appended files, long lists and repeated ordinals."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import anomaly, tagging
from ledgerlens.sources import patterns, tables
from ledgerlens.streaming.monitor import published_findings, run_monitor


def months(n, account="a", odd=None):
    return [(account, dt.date(2020 + i // 12, i % 12 + 1, 1), odd.get(i, 100.0 + i % 3) if odd else 100.0 + i % 3) for i in range(n)]


SERIES = "account string, month date, revenue double"


def test_nan_is_missing(spark):
    rows = months(14, odd={8: float("nan"), 12: 500.0})
    nan, null = (spark.createDataFrame([(a, m, None if v != v and clean else v) for a, m, v in rows], SERIES) for clean in (False, True))
    for split in (None, 7):
        run = lambda df: sorted(map(tuple, anomaly.anomaly_series(df, split_rows=split).collect()), key=str)
        assert run(nan) == run(null)
        assert [r[1] for r in run(nan) if r[10] != "NORMAL"] == [rows[12][1]]
        flag = lambda df: sorted(map(tuple, anomaly.metric_flag(df, "revenue", ["account"], split_rows=split).collect()))
        assert flag(nan) == flag(null)


def test_split_keeps_null_keys(spark):
    df = spark.createDataFrame(months(24) + months(24, None, {20: 900.0}), SERIES)
    plain = sorted(map(tuple, anomaly.anomaly_series(df).collect()), key=str)
    split = sorted(map(tuple, anomaly.anomaly_series(df, split_rows=8).collect()), key=str)
    assert len(split) == 48 and [r[:3] + r[7:8] + r[10:11] for r in split] == [r[:3] + r[7:8] + r[10:11] for r in plain]
    floored = lambda s: anomaly.floored_baseline_flag(df, "revenue", ["account"], split_rows=s).count()
    assert floored(8) == floored(None) > 0


def test_null_findings_are_published_once(spark):
    report = spark.createDataFrame([(None, "2020-01", "SPIKE"), ("a", None, "DROP")], "account string, month string, anomaly_type string")
    assert anomaly.new_findings(report, report).count() == 0
    assert anomaly.new_findings(report, report.limit(0)).count() == 2


def test_appended_files_are_seen(spark, tmp_path):
    folder = str(tmp_path)
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(5)], tables.DECLARED["region"])
    rows.write.parquet(f"{folder}/region.parquet")
    assert tables.read_table(spark, folder, "region").count() == 5
    rows.write.mode("append").parquet(f"{folder}/region.parquet")
    assert tables.read_table(spark, folder, "region").count() == 10


@pytest.mark.parametrize("limit", [512, 0])
def test_one_folding_for_every_list_size(spark, limit):
    listed = spark.createDataFrame([(i + 1, f"Name{i}-", "c", "k") for i in range(600)] + [(601, "ƛ", "c", "k"), (602, "İx", "c", "k")],
                                   patterns.PATTERNS)
    some = listed if not limit else listed.where("ordinal > 300")
    texts = spark.createDataFrame([(1, "zz NAME599- name400-"), (2, "Ƛ"), (3, "none"), (4, None), (5, "i̇x"), (6, "")], "id int, text string")
    got = {r["id"]: r["pattern"] for r in tagging.tag_patterns(texts, some, case_chain_limit=limit).collect()}
    folded = {r["id"]: r["t"] for r in texts.select("id", F.lower("text").alias("t")).collect()}
    names = some.orderBy("ordinal").select("name", F.lower("name").alias("low")).collect()
    assert got == {i: next((n["name"] for n in names if t is not None and n["low"] in t), "") for i, t in folded.items()}
    plan = tagging.tag_patterns(texts, some, case_chain_limit=limit)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_ordinals_of_several_documents(spark, tmp_path):
    for k, names in enumerate((["curl/", "Wget/"], ["GPT", "Wget/1"])):
        (tmp_path / f"{k}.json").write_text(json.dumps({"user_agents": [{"name": n} for n in names]}))
    listed = patterns.read_pattern_list(spark, str(tmp_path))
    assert [(r["ordinal"], r["name"]) for r in listed.orderBy("ordinal").collect()] == [(1, "curl/"), (2, "Wget/"), (3, "GPT"), (4, "Wget/1")]
    texts = spark.createDataFrame([(1, "wget/1.2 gpt")], "id int, text string")
    assert [r["pattern"] for r in tagging.tag_patterns(texts, listed).collect()] == ["Wget/"]
    with pytest.raises(ValueError):
        tagging.tag_patterns(texts, listed.union(listed))


def test_monitors_with_equal_folder_names(spark, tmp_path):
    df = spark.createDataFrame(months(14, None, {12: 900.0}), "account string, month date, revenue double")
    for k in ("x", "y"):
        df.write.parquet(str(tmp_path / k / "in"))
        for _ in range(2):
            run_monitor(spark, str(tmp_path / k / "in"), str(tmp_path / k / "out"))
        assert published_findings(spark, str(tmp_path / k / "out")).where("account IS NULL").count() == 1
