import json

import pytest
from pyspark.sql import functions as F

import analyze
from verdigris.functions import report
from verdigris.operators import protocol as P
from verdigris.sources import driver_tables as D
from verdigris.sources import store

SF = "/root/testdata/sf0.001"


def test_options():
    for wrong in ([], ["--paired", "x", "--ordinal"], ["--paired", "x", "--n-boot", "9"], ["--version", "v"], ["--paired", "x", "--exclude-severity", "sever"]):
        with pytest.raises(SystemExit):
            analyze.options(wrong)
    a = analyze.options(["--paired", "x.parquet", "--exclude-severity", " Severe", "none"])
    assert a.exclude_severity == ["none", "severe"] and not a.ordinal and a.k == 2 and a.min_n == 3
    assert analyze.options(["--version", "v", "--config", "c"]).ordinal


def write_store(spark, root):
    grades = ["none", "minimal", "slight", "moderate", "severe"]
    runs, scores, metrics = [], [], []
    for c in ("tile", "wood"):
        for b in range(5):
            for s in ("real", "all"):
                run = f"{c}{b}{s}"
                runs.append((run, "FINISHED", "x", None, {"set_name": s, "category": c, "version": "v1"}, {"backbone": f"b{b}", "seed": "0", "data_num_train_samples": "4"}))
                metrics += [(run, q, 0.5 + b / 20, 20, 10) for q in ("all",)]
                scores += [(run, f"{i}", "p", "k", int(i % 5 > 0), "m", float((i * (b + 2)) % 23), "accept", grades[i % 5] if s == "all" else "real", "ok", "", "0.5") for i in range(40)]
    spark.createDataFrame(runs, "run_id string, status string, artifact_uri string, start_time timestamp, tags map<string,string>, params map<string,string>").write.parquet(f"{root}/runs.parquet")
    columns = "sample_id,image_path,class_name,label,mask_path,score,scorer,severity,mask_status,reward_score,defect_area_frac"
    import pathlib

    import pandas as pd

    for run in {m[0] for m in metrics}:
        folder = pathlib.Path(root) / "predictions" / run
        folder.mkdir(parents=True)
        (folder / "scores.csv").write_text("\n".join([columns, *[",".join(map(str, x[1:])) for x in scores if x[0] == run]]) + "\n")
        (pathlib.Path(root) / "metrics").mkdir(exist_ok=True)
        pd.DataFrame([m[1:] for m in metrics if m[0] == run], columns=["query", "image_auroc", "n_samples", "n_defect_samples"]).to_parquet(pathlib.Path(root) / "metrics" / f"{run}.parquet")


def test_store_to_tables(spark, tmp_path, capsys):
    root = str(tmp_path / "store")
    write_store(spark, root)
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"queries": {"all": {"all": None, "severe": {"expr": "severity == 'severe'", "keep_good": True}}, "real": {"all": None}}}))
    analyze.main(["--version", "v1", "--store", root, "--config", str(config), "--out", str(tmp_path / "out"), "--report-metric", "image_auroc", "--min-level-n", "1"])
    got = capsys.readouterr()
    assert "populations are decidable" in got.err or "noise floor is unknown" in got.err
    assert "image_auroc" in got.out
    out = str(tmp_path / "out" / "v1")
    assert spark.read.parquet(f"{out}/selection").where("n = 5").count() > 0 and spark.read.parquet(f"{out}/severity_check").count() == 20
    assert json.loads("\n".join(r[0] for r in spark.read.text(f"{out}/run_config").collect()))["min_level_n"] == 1
    assert "begin{table}" in "".join(r[0] for r in spark.read.text(f"{out}/selected_summary_tex").collect())
    with pytest.raises(ValueError, match="differs"):
        analyze.main(["--version", "v1", "--store", root, "--config", str(config), "--out", str(tmp_path / "o2"), "--image-metrics", "stored"])
    plain = store.load_paired_metrics(spark, "v1", root)
    assert plain.count() == 10
    runs = store.load_runs(spark, root, "v1")
    more = runs.select("run_id").unionByName(spark.createDataFrame([("gone",)], "run_id string"))
    with pytest.warns(UserWarning, match="1 of 21"):
        assert store.run_scores(more, root).select("run_id").distinct().count() == 20
    with pytest.raises(FileNotFoundError, match="no metrics"):
        store.run_metrics(more, root, on_missing="raise")
    with pytest.raises(ValueError, match="no finished runs"):
        store.load_runs(spark, root, "v9")
    with pytest.raises(ValueError, match="no store"):
        store.store_root(spark)


def test_paired_with_intervals(spark, tmp_path):
    D.paired(spark, SF).where("metric = 'aupro' AND category IN ('ASIA', 'EUROPE')").write.parquet(str(tmp_path / "p.parquet"))
    analyze.main(["--paired", str(tmp_path / "p.parquet"), "--out", str(tmp_path), "--pool-training-sets", "--n-boot", "20", "--seed", "1", "--report-metric", "aupro", "--select-by", "fixed", "aupro@all", "oracle"])
    r = spark.read.parquet(str(tmp_path / "p" / "selection")).where("regret_ci_hi IS NOT NULL").first()
    assert r["regret_ci_lo"] <= r["regret_ci_hi"]


def test_spans_and_predictions(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"ts": 2.0, "name": "x", "dur_ms": 1}\n\n{"ts": 1.0, "name": "y"}\n')
    (tmp_path / "nvidia-smi.jsonl").write_text('{"ts": 0.5, "gpus": [{"index": 0, "util_gpu": 50.0}]}\n')
    assert [r["name"] for r in store.read_spans(spark, str(tmp_path)).collect()] == ["y", "x"] and store.read_gpu_ticks(spark, str(tmp_path)).first()["gpus"][0]["util_gpu"] == 50.0
    assert store.read_spans(spark, str(tmp_path / "none")).count() == 0 and store.read_gpu_ticks(spark, str(tmp_path / "none")).count() == 0
    rows = spark.createDataFrame([("r1", "s1", 0.5, [0.1, 0.2])], "run_id string, sample_id string, score double, anomaly_map array<double>")
    store.write_predictions(rows, str(tmp_path / "o"), anomaly_maps=True)
    assert spark.read.parquet(str(tmp_path / "o" / "anomaly_maps")).count() == 1 and not (tmp_path / "o" / "predictions" / "run_id=r1" / "x").exists()


def test_protocol(spark):
    with pytest.raises(ValueError, match="blank"):
        P.negative_prompts(spark.createDataFrame([("p",)], "prompt string"), " ")
    checks = spark.createDataFrame([("a", 1, 4, []), ("b", 2, 7, ["7 prompts, expected 8"])], "category string, n_modes int, n_prompts int, failures array<string>")
    text = P.validation_report(checks, title="Run")
    assert "2 categories, 11 prompts, 1 failing" in text and "- 7 prompts, expected 8" in text
    plan = spark.createDataFrame([("a", " ", ["s"], "t", "p"), ("b", "wood", ["s"], "t", "p")], "category string, description string, samples array<string>, taxonomy string, prompts string")
    calls = {r["category"]: [json.loads(c) for c in r["calls"]] for r in P.build_calls(plan, benchmark="visa").collect()}
    assert "category_description" not in calls["a"][0]["args"] and calls["b"][0]["args"]["category_description"] == "wood" and calls["a"][1]["depends_on"] == 1
    files = spark.createDataFrame([("a",)] * 5, "category string")
    assert P.count_sources(files, 3).first()["n_sources"] == 3 and P.count_sources(files).first()["n_sources"] == 5
    assert P.stage_samples(spark.createDataFrame([("a", 0, "x/1.png", 5)], "category string, place int, path string, length long"), spark.createDataFrame([("a", "00_1.png", 5)], "category string, target string, length long"), restage=True).select(F.col("action")).first()[0] == "copy"
    assert report.latex_head("image_auroc@all") == r"\shortstack{image\_auroc\\@all}" and report.latex_head("fixed") == "fixed" and report.latex_head("x@y", {"x@y": "X"}) == "X"
