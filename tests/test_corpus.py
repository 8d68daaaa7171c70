import json

import pytest
from pyspark.sql import functions as F

from verdigris.functions import report
from verdigris.operators import corpus as K
from verdigris.operators import planning as L
from verdigris.operators import selected as W
from verdigris.sources import readers as R
from verdigris.streaming import spans as ST


def test_manifests(spark, tmp_path):
    root = tmp_path / "corpus"
    (root / "a").mkdir(parents=True)
    (root / "old_backup").mkdir()
    rows = [{"image_id": "1", "scorer": "Accept", "vlm_decision": "reject"}, {"image_id": "2", "scorer": None, "vlm_decision": "accept"}, {"image_id": "3", "vlm_decision": "ACCEPT"}]
    (root / "a" / "generation_manifest_x.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    (root / "old_backup" / "generation_manifest_x.jsonl").write_text(json.dumps({"image_id": "9"}))
    got = {r["image_id"]: r["verdict"] for r in R.read_manifests(spark, str(root), recursive=True).collect()}
    assert got == {"1": "accept", "2": None, "3": "accept"}
    assert R.read_manifests(spark, str(tmp_path / "none")).count() == 0


def test_run_files(spark, tmp_path):
    for run in ("r1", "r2"):
        spark.range(2).selectExpr("'all' AS query", "double('NaN') AS image_auroc").coalesce(1).toPandas().to_parquet(tmp_path / f"{run}.parquet")
    got = R.read_run_metrics(spark, str(tmp_path / "*.parquet"))
    assert {r["run_id"] for r in got.collect()} == {"r1", "r2"} and got.where("image_auroc IS NOT NULL").count() == 0
    runs = spark.createDataFrame([("r1",), ("r9",)], "run_id string")
    assert [r["run_id"] for r in R.missing_runs(runs, got).collect()] == ["r9"]


def test_scores_csv(spark, tmp_path):
    (tmp_path / "run7").mkdir()
    (tmp_path / "run7" / "scores.csv").write_text("sample_id,image_path,class_name,label,mask_path,score,scorer,severity,mask_status,reward_score,defect_area_frac\n1,a/b.png,x,1,,0.5,accept,severe,ok,,0.0\n")
    r = R.read_scores(spark, str(tmp_path / "*" / "*.csv")).first()
    assert (r["run_id"], r["score"], r["reward_score"], r["defect_area_frac"], r["mask_path"]) == ("run7", 0.5, None, 0.0, None)


def test_prompts_and_pools(spark, tmp_path):
    (tmp_path / "tile.json").write_text(json.dumps({"generation_prompts": [{"mode": "crack", "stage": "severe", "prompt": "p"}, {"mode": "crack", "stage": "slight", "prompt": "q"}]}, indent=1))
    assert {(r["category"], r["stage"]) for r in R.read_prompts(spark, str(tmp_path / "tile.json")).collect()} == {("tile", "severe"), ("tile", "slight")}
    (tmp_path / "bad.json").write_text(json.dumps({"generation_prompts": [{"mode": "crack"}]}))
    with pytest.raises(Exception, match="incomplete prompt"):
        R.read_prompts(spark, str(tmp_path / "bad.json")).collect()
    R.write_pools(spark.createDataFrame([(1, "b"), (0, "a"), (0, "c")], "seed int, frame string"), str(tmp_path / "pools"), 2)
    pools = R.read_pools(spark, str(tmp_path / "pools"))
    assert sorted(r["frame"] for r in R.pool_for_seed(pools, 0).collect()) == ["a", "c"]
    with pytest.raises(KeyError):
        R.pool_for_seed(pools, 5)
    assert R.read_pools(spark, str(tmp_path / "nothing")) is None


def test_jobs_resume(spark):
    sources = spark.createDataFrame([("tile", "s1"), ("tile", "s2")], "category string, source string")
    prompts = spark.createDataFrame([("tile", "crack", "severe"), ("tile", "crack", "minimal")], "category string, mode string, stage string")
    jobs = K.build_jobs(sources, prompts, base_seed=5, num_per_source=3, crops=2)
    assert jobs.count() == 24
    r = jobs.where("source = 's2' AND crop = 1 AND stage = 'severe' AND attempt = 2").first()
    assert r["seed"] == 5 + 1_000_000 + 1_000 + 2 and r["stem"] == "s2__crop1__crack__severe__2"
    done = spark.createDataFrame([("s2__crop1", "crack", "severe", 2, "", None)], "roi_id string, class string, severity string, attempt_index int, region_mode string, region_stage string")
    assert K.filter_completed_continue(jobs, done).count() == 23
    assert K.filter_completed(jobs, jobs.limit(0).select(F.lit("x").alias("image_id")), "run").count() == 24


def test_leaks(spark):
    sources = spark.createDataFrame([("f01__crop2",), ("f07",)], "stem string")
    train = spark.createDataFrame([("f01",)], "frame string")
    assert [r["stem"] for r in K.contamination(sources, train, source_col="stem", train_col="frame").collect()] == ["f01__crop2"]
    with pytest.raises(Exception, match="no group"):
        K.contamination(sources, train, source_col="stem", train_col="frame", group_pattern=r"^(x\d+)").collect()


def test_samples_under_the_cap_stay_whole(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.5), (3, None)], "sample_id long, defect_area_frac double")
    assert K.sample_defects(df, 5, seed=1).count() == 3
    assert K.sample_defects(df, 1, seed=1).count() == 1 and K.sample_defects_numpy(df, 1, seed=1, category="c").count() == 1


def test_negatives(spark):
    df = spark.createDataFrame([(["scratch", "No Scratch", " a  b ", ""],), ([],)], "n array<string>").select(K.normalize_negatives(F.col("n")).alias("n"))
    assert [r["n"] for r in df.collect()] == [["no scratch", "no a b"], []]


def test_planning(spark):
    assert L.flatten_overlay({"a": {"b": 1, "c": {"d": 2}}}) == [("a.b", 1), ("a.c.d", 2)]
    assert L.normalize_override({"crop.size": 5}, category="x") == {"cropping": {"size": 5}}
    with pytest.raises(KeyError):
        L.normalize_override({"nope": 1}, category="x")
    stages = spark.createDataFrame([("c", "m", s, f"a {s} crack", "the rim", ["dust"]) for s in ("minimal", "slight", "moderate", "severe")] + [("c", "n", "slight", "x", None, None)], "category string, mode string, stage string, description string, region string, negatives array<string>")
    got = L.compile_prompts(stages, suffix="Photo.").collect()
    assert len(got) == 4 and got[0]["prompt"].endswith("Only on the rim. Constraints: no dust. Photo.")
    assert [r["mode"] for r in L.skipped_modes(stages).collect()] == ["n"]
    files = spark.createDataFrame([("tile/test/good/1.png",), ("tile/test/crack/2.png",), ("tile/ground_truth/crack/2.png",), ("tile/readme.txt",)], "path string")
    r = L.scan_categories(files).first()
    assert (r["category"], r["n_defect"], r["n_good"], r["samples"]) == ("tile", 1, 1, ["tile/test/crack/2.png"])


def test_selectors():
    assert W.parse_selector("aupro").label == "aupro@all" and W.parse_selector("x@severe").query == "severe" and W.parse_selector("oracle").kind == "oracle"
    with pytest.raises(ValueError, match="names no metric"):
        W.parse_selector("@all")


def test_report():
    rows = [{"category": c, "metric": "aupro", "selector": s, "value": v} for c, s, v in (("a", "x", 0.5), ("a", "y", 0.7004), ("a", "oracle", 0.9), ("b", "x", None), ("b", "y", 0.1))]
    text = report.latex_table(rows, digits=3)
    assert r"\textbf{0.700}" in text and r"\underline{0.500}" in text and r"\textbf{0.900}" not in text and "mean" in text
    assert report.number(-0.0001, 3) == "0.000" and report.escape_latex("a_b%") == r"a\_b\%"
    assert "--" in report.format_table(rows)


def test_streams(spark):
    df = spark.createDataFrame([(i, f"2024-01-01 {i % 3:02d}:10:00", "n", 2.0) for i in range(30)], "event_id long, ts string, name string, dur_ms double").withColumn("ts", F.to_timestamp("ts"))
    got = {str(r["window_start"]): (r["n"], r["total_ms"]) for r in ST.span_stream(spark, df).collect()}
    assert len(got) == 3 and all(v == (10, 20.0) for v in got.values())
