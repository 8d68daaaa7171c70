
import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.functions import report
from verdigris.functions.exprs import null_safe_join, numbered
from verdigris.operators import blending as B
from verdigris.operators import correlation as C
from verdigris.operators import kernels as I
from verdigris.operators import pixel as X
from verdigris.operators import recompute as R
from verdigris.operators import resume as G
from verdigris.operators import scoring as J
from verdigris.operators import splits as S
from verdigris.operators import vectors as V


def regions(mask):
    """4-connected parts by flooding, as lists of places."""
    left, out = {tuple(p) for p in np.argwhere(mask)}, []
    while left:
        todo = [min(left)]
        part = set(todo)
        while todo:
            y, x = todo.pop()
            for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if q in left and q not in part:
                    part.add(q)
                    todo.append(q)
        left -= part
        out.append(sorted(part))
    return out


def test_image_histograms_against_flooding(spark):
    rng = np.random.default_rng(1)
    images, want = [], {}
    edges = np.linspace(-1, 1, 300)
    for i, (h, w) in enumerate(((7, 9), (1, 30), (12, 1), (6, 6))):
        mask, score = rng.random((h, w)) < 0.55, rng.normal(size=(h, w))
        if i == 3:
            mask[:] = False
        images.append(("r", i, mask.astype(int).ravel().tolist(), score.ravel().tolist(), h, w))
        for y, x in np.ndindex(h, w):
            cell = want.setdefault((i, int(np.searchsorted(edges, score[y, x], side="right"))), [0, 0, 0.0, 0])
            cell[0 if mask[y, x] else 1] += 1
        for part in regions(mask):
            for k, (y, x) in enumerate(part):
                cell = want[i, int(np.searchsorted(edges, score[y, x], side="right"))]
                cell[2] += 1 / len(part)
                cell[3] += k == 0
    frame = spark.createDataFrame(images, "run_id string, image_id long, mask array<int>, score array<double>, height int, width int")
    got = X.image_histograms(frame, spark.createDataFrame([("r", edges.tolist())], "run_id string, edges array<double>")).collect()
    assert len(got) == len(want)
    for r in got:
        assert [r["positive"], r["negative"], pytest.approx(r["region_weight"]), r["n_regions"]] == want[r["image_id"], r["bin"]]
    m = X.pixel_metrics(X.image_histograms(frame, X.image_edges(frame, ["run_id"], 64))).first()
    assert 0 <= m["pixel_auroc"] <= 1 and m["aupro"] is not None
    assert X.image_histograms(frame.limit(0), X.image_edges(frame, ["run_id"], 8)).count() == 0
    bad = frame.withColumn("width", F.col("width") + 1)
    with pytest.raises(Exception, match=r"map of|reshape"):
        X.image_histograms(bad, X.image_edges(frame, ["run_id"], 8)).collect()


def test_noise_level_against_plain_clipping():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 50, 501):
        x = np.concatenate((rng.normal(size=n), rng.normal(6, 1, n // 2)))
        mad = lambda v, c: 1.4826 * np.median(c - v[v <= c])
        level = np.quantile(x, 0.2)
        scale = mad(x, level)
        for _ in range(5):
            kept = x[x <= level + 3 * scale]
            if scale <= 0 or len(kept) < max(1, int(0.15 * len(x))) or mad(kept, np.median(kept)) <= 0:
                break
            level, scale = np.median(kept), mad(kept, np.median(kept))
        assert I.noise_level(x) == pytest.approx((level, scale), abs=1e-9)
    assert I.noise_level(np.array([])) == (0.0, 0.0) and I.noise_level(np.full(9, 3.0)) == (3.0, 0.0)


def test_detrend_takes_off_a_surface_and_keeps_a_spot():
    y, x = np.mgrid[0:40, 0:50]
    drift = np.stack((0.3 * x - 0.1 * y, 0.01 * x * y, 5 + 0.02 * y**2), axis=2).astype(float)
    spot = np.zeros_like(drift)
    spot[10:16, 20:26] = 40
    out = I.detrend(drift + spot, 2)
    assert abs(out[spot == 0]).max() < 1 and out[spot > 0].min() > 38
    valid = np.zeros((40, 50), bool)
    valid[:, :3] = True
    assert np.isfinite(I.detrend(drift, 2, valid=valid)).all()


def test_inversions():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 30, 200):
        x = rng.integers(0, max(1, n // 2) + 1, n).astype(float)
        assert C.inversions(x) == sum(x[i] > x[j] for i in range(n) for j in range(i + 1, n))


def test_numbered(spark):
    rows = [(f"k{i % 37:02d}", i) for i in range(300)] + [(None, 999)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(5)
    got = numbered(df, [F.col("k").asc_nulls_last(), "i"], "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(301)) and [(r["k"], r["i"]) for r in got] == [*sorted(rows[:-1]), rows[-1]]
    assert numbered(df.limit(0), ["k"], "n").count() == 0
    with pytest.raises(ValueError, match="key"):
        null_safe_join(df, df, [])


def test_nearest_neighbours_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(90, 4)), rng.normal(size=(25, 4))
    bank, queries = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>") for m in (x, q))
    want = np.sort(np.linalg.norm(q[:, None] - x[None], axis=2), axis=1)[:, :3].mean(axis=1)
    for limit in (64 << 20, 400):
        monkeypatch.setattr(V, "BANK_BYTES", limit)
        got = {r["id"]: r["score"] for r in V.knn_score(queries, bank).collect()}
        assert len(got) == 25 and all(got[i] == pytest.approx(want[i]) for i in got)
    assert {r["score"] for r in V.knn_score(queries, bank.limit(0)).collect()} == {None} and V.knn_score(queries.limit(0), bank).count() == 0


def test_marks():
    assert report.marks({"a": 0.9004, "b": 0.9001, "c": 0.8, "oracle": 1.0, "d": None}) == {"a": "best", "b": "best", "c": "second"}
    assert report.marks({"a": 1.0, "b": None}) == {} and report.marks({"a": 1.0, "b": 2.0}, higher_is_better=False) == {"a": "best", "b": "second"}


# Recompute path


def scored(spark):
    rng = np.random.default_rng(0)
    grades = ["none", "minimal", "slight", "moderate", "severe"]
    rows = []
    for run in ("s1", "s2", "r1", "r2"):
        for i in range(60):
            g = int(rng.integers(0, 5)) if run[0] == "s" else int(rng.integers(0, 2))
            rows.append((run, i, int(g > 0), float(rng.normal() + g / 2), grades[g] if run[0] == "s" else "real"))
    scores = spark.createDataFrame(rows, "run_id string, sample_id int, label int, score double, severity string")
    runs = spark.createDataFrame([(r, "FINISHED", "real" if r[0] == "r" else "all", "tile", r[1]) for r in ("s1", "s2", "r1", "r2")] + [("s9", "FINISHED", "gone", "tile", "9")], "run_id string, status string, set_name string, category string, param_seed string").withColumn("start_time", F.lit(None).cast("timestamp"))
    return runs, scores


def test_ordinal_paired(spark):
    runs, scores = scored(spark)
    config = {"queries": {"all": {"all": None, "severe": {"expr": "severity == 'severe'", "keep_good": True}}, "real": {"all": None}}}
    records, skipped = R.recompute_severity(runs, scores, config)
    assert {(r["run_id"], r["reason"]) for r in skipped.collect()} == {("s9", "no queries")}
    stored = records.select("run_id", "query", "image_auroc", "image_aupr", "n_samples", "n_defect_samples")
    paired, extra = R.build_ordinal_paired(runs, stored, scores, config, image_metrics="stored", check_tolerance=1e-6)
    assert {r["metric"] for r in paired.select("metric").distinct().collect()} >= {"image_auroc", "severity_cindex", "severity_tau_b"} and extra["severity_check"].count() == 6
    wrong = stored.withColumn("image_auroc", F.col("image_auroc") + 0.1)
    with pytest.raises(ValueError, match="differs"):
        R.build_ordinal_paired(runs, wrong, scores, config, image_metrics="stored")
    fixed, _ = R.build_ordinal_paired(runs, wrong, scores, config)
    key = lambda df: sorted((r["query"], r["metric"], r["synth"] is None, round(r["synth"] or 0, 9)) for r in df.collect())
    assert key(fixed.where("metric = 'image_auroc'")) == key(paired.where("metric = 'image_auroc'"))
    with pytest.raises(ValueError, match="severity grades"):
        R.build_ordinal_paired(runs, stored, scores.withColumn("severity", F.lit("real")), config)
    assert R.add_record(records, records.limit(1), "more").where("query = 'more'").count() == 1
    flat = R.flat_record(records.withColumn("extra", F.create_map(F.lit("fps"), F.lit(2.0))), ["fps"])
    assert flat.columns[0] == "query" and flat.first()["fps"] == 2.0


def test_report_bias(spark):
    rows = [("m", "all", "minimal_accept", c, 0.1 * i, 0.1 * i + (0.3 if c == "a" else 0.05 * (-1) ** i), 10, 5) for c in "ab" for i in range(6)]
    paired = spark.createDataFrame(rows, "metric string, set_name string, query string, category string, real double, synth double, n_samples long, n_defect_samples long")
    text = R.report_bias(C.evaluate_bias(paired))
    assert text.startswith("1 of 2") and "category=a" in text and "+0.300" in text
    assert R.report_bias(C.evaluate_bias(paired.limit(0))) == "no populations with both arms"


# Resumption


def test_layers():
    assert G.resolve_layers("resnet18", None) == ["layer2", "layer3"] and G.resolve_layers("wide_resnet50_2", "one_additional") == ["layer2", "layer3", "layer4"]
    assert G.resolve_layers("dinov2_vits14", "two_additional") == [-3, -2, -1] and G.resolve_layers("dinov3_vitb16", [3]) == [3]
    for wrong in ("three_additional", [1], ["layer9"]):
        with pytest.raises(ValueError):
            G.resolve_layers("resnet18", wrong)


def test_grid(spark):
    rows = [(i, {"version": "v1", "category": c}, {"seed": str(s), "backbone": "resnet18", "layers": "default"}, ["real", "all"]) for i, (c, s) in enumerate((c, s) for c in "ab" for s in (0, 1))]
    configs = spark.createDataFrame(rows, "grid_pos int, tags map<string,string>, params map<string,string>, expected array<string>")
    run = lambda i, name, cat, seed, status, **extra: (i, {"version": "v1", "category": cat, "set_name": name}, {"seed": seed, "backbone": "resnet18", "layers": "['layer2', 'layer3']", "other": None, **extra}, status)
    runs = [run("1", "real", "a", "0", "FINISHED"), run("2", "all", "a", "0", "FINISHED"), run("3", "all", "a", "0", "FAILED"), run("4", "real", "a", "1", "FINISHED"), run("5", "all", "a", "1", "RUNNING"), run("6", "real", "b", "0", "FINISHED", more="x"), ("7", {"version": "v0", "category": "b", "set_name": "real"}, {}, "FAILED")]
    runs = spark.createDataFrame(runs, "run_id string, tags map<string,string>, params map<string,string>, status string")
    left, stale = G.filter_completed_configs(configs, runs)
    assert [r["grid_pos"] for r in left.collect()] == [1, 2, 3] and sorted(r["run_id"] for r in stale.collect()) == ["3", "4"]
    assert G.fetch_runs(runs, configs).count() == 6 and G.declared_tags(configs) == ["category", "version"]
    keyed = G.feature_key(configs.select(F.col("tags")["category"].alias("category"), F.lit("x").alias("root"), F.lit(4).alias("batch")), ["category"], ["root", "batch"])
    assert keyed.select("feature_key").distinct().count() == 2


# Scoring


def test_scoring(spark, tmp_path):
    assert J.parse_names(" a, b ,,") == {"a", "b"} and J.parse_names("") is None and J.parse_names([" x "]) == {"x"} and J.parse_names(None) is None
    got = J.resolve_scoring({"accept_margin": 0.1, "device": "cpu"}, {"scoring": {"accept_margin": "0.5", "noise": 1}}, {"device": None})
    assert got == {"accept_margin": 0.5, "device": "cpu"}
    rows = spark.createDataFrame([(i, "c1" if i % 2 else "c2", "severe" if i % 3 else "minimal", f"crop{i % 4}" if i != 7 else None, "p", None, None, None) for i in range(12)], "image_id int, category string, severity string, crop string, prompt string, scorer string, verdict string, reward_score double")
    scores = spark.createDataFrame([(i, i / 10) for i in range(12) if i != 5], "image_id int, score double")
    noops = spark.createDataFrame([(f"crop{i}", "p", i / 10) for i in range(4)], "crop string, prompt string, score double")
    settings = {"accept_margin": 0.35, "checkpoint": "m"}
    some, told = J.score_manifest(rows, settings, scores=scores, noops=noops, limit=4)
    assert told["pending"] == 12 and told["left"] == 8
    out, told = J.score_manifest(some, settings, scores=scores, noops=noops)
    verdicts = {r["image_id"]: (r["scorer"], r["reward_score"]) for r in out.collect()}
    assert told["left"] == 2 and verdicts[5] == verdicts[7] == (None, None) and verdicts[9] == ("accept", pytest.approx(0.8)) and verdicts[3][0] == "reject"
    again, change = J.score_manifest(out, {"accept_margin": 0.75}, mode="rethreshold")
    assert change["unscored"] == 2 and change["changed"] == sum(1 for v, m in verdicts.values() if m is not None and (m >= 0.75) != (v == "accept")) and "quantiles" in change["report"]
    assert J.score_manifest(out, settings, mode="dry-run")[1]["scored"] == 0
    path = str(tmp_path / "manifest")
    for df in (rows, again):
        J.replace_manifest(df, path)
    kept = spark.read.json(path)
    assert kept.count() == 12 and kept.where("scorer IS NOT NULL").count() == 10 and len(list(tmp_path.iterdir())) == 1


# Splits and overlays


def test_splits(spark, tmp_path):
    frames = spark.createDataFrame([("tile", f"f{i:02d}") for i in range(30)], "category string, frame string")
    split = S.build_split(frames, n_frames=4, seeds=[0, 1], reserved=5).persist()
    info = S.split_info(split, "tile")
    assert info.n_train == 8 and info.n_source == 22 and info.spent_edits == 0 and set(info.pools[0]).isdisjoint(info.pools[1]) and min(sum(info.pools.values(), ())) == "f05"
    with pytest.raises(ValueError, match="fewer than"):
        S.build_split(frames, n_frames=20, seeds=[0, 1])
    recorded = spark.createDataFrame([("tile", 3, ["f00", "f01"])], "category string, seed int, pool array<string>")
    assert S.split_info(S.build_split(frames, n_frames=40, seeds=[1], recorded=recorded), "tile").pools == {3: ("f00", "f01")}
    for pools in ([("tile", 0, ["f01"]), ("tile", 1, ["f01"])], [("tile", 0, ["zz"])]):
        with pytest.raises(Exception, match=r"overlap|missing"):
            S.write_split(frames, spark.createDataFrame(pools, "category string, seed int, pool array<string>")).collect()
    assert S.pool_plan(sweep={"data.num_train_samples": [1, 4], "seed": [5]}) == (4, (5,)) and S.pool_plan(seeds="1, 2", train_frames=3) == (3, (1, 2)) and S.pool_plan() == (8, (42, 6800, 9999))
    assert S.claim_root(spark, str(tmp_path / "new")) == S.claim_root(spark, str(tmp_path / "new"))
    (tmp_path / "theirs").mkdir()
    (tmp_path / "theirs" / "x").write_text("x")
    with pytest.raises(ValueError, match="something else"):
        S.claim_root(spark, str(tmp_path / "theirs"))
    files = spark.createDataFrame([("a/source/1.png",), ("b/other/2.png",)], "path string")
    assert S.categories_with(files, "source") == ["a"]
    with pytest.raises(ValueError, match="no source"):
        S.categories_with(files, "source", ["b"])
    paths = spark.createDataFrame([(f"{i:03d}",) for i in range(50)], "path string")
    drawn = sorted(r["path"] for r in S.legacy_sample(paths, 7, seed=3).collect())
    assert drawn == sorted(f"{i:03d}" for i in np.random.RandomState(3).choice(50, 7, replace=False))


def test_overlays(spark):
    rng = np.random.default_rng(0)
    images = spark.createDataFrame([("tile", f"d/s{i}.png", rng.integers(0, 255, 16 * 20 * 3).tolist(), 16, 20, 3) for i in range(2)], "category string, path string, image array<int>, height int, width int, channels int")
    out = S.generate_overlays(images, rng.integers(0, 255, (2, 8, 8, 3)), 2, seed=5)
    rows = {r["image_id"]: r for r in out.collect()}
    assert set(rows) == {f"s{i}__overlay0{k}" for i in range(2) for k in range(2)}
    for r in rows.values():
        assert r["mask_status"] == ("ok" if sum(r["mask"]) else "no_defect") and r["mask_coverage"] == pytest.approx(sum(r["mask"]) / 320)
    job = S.overlay_jobs(images, 2, seed=5).where("image_id = 's1__overlay01'").first()
    assert int(job["rng_seed"]) == S.overlay_seed(5, "tile", "s1", 1)


# Blending


def test_masks_and_settings(spark):
    mask = np.zeros((30, 40), bool)
    mask[10:14, 10:20] = True
    big = B.grown(mask, 3)
    want = np.zeros_like(mask)
    for y, x in np.argwhere(mask):
        want[max(0, y - 3) : y + 4, max(0, x - 3) : x + 4] = True
    assert (big == want).all() and (B.alpha_support(mask, 4, 2) >= mask).all() and B.inpaint_support(mask, 1, 1).sum() > big.sum()
    record = B.mask_record(mask)
    assert record["mask_status"] == "ok" and record["mask_components"] == 1 and B.mask_record(mask & False)["mask_status"] == "no_defect"
    both = B.with_post_blend(record, {**B.mask_record(mask & False), "trace": [{"k": 1}]})
    assert both["paste_status"] == "ok" and both["mask_status"] == "no_defect" and both["trace"] == [{"k": 1, "pass": "post_blend"}] and both["alpha"] is record["alpha"]
    kept, told = B.accept_refined(mask, mask, radius=2, core=mask, lo=0.0, hi=1.0)
    assert told["effect"] == "unchanged" and told["iou"] == 1 and B.accept_refined(mask, mask, radius=2, core=mask, lo=0.9, hi=1.0)[1]["effect"] == "fallback"
    assert B.place_mask(mask, (5, 5, 45, 35), (50, 60), nearest=True)[15:19, 15:25].all()
    image = np.full((30, 40, 3), 100, np.uint8)
    tinted = B.overlay_mask(image, mask)
    assert (tinted[~mask] == 100).all() and (tinted[mask] != 100).any()
    assert B.extent_ranges({"extent": {"regional": [0.1, 0.2]}, "extent_overrides": {"tile": {"localized": [0, 1]}}}, "tile") == {"localized": (0.0, 1.0), "regional": (0.1, 0.2), "object_scale": (0.1, 0.8)}
    with pytest.raises(KeyError):
        B.mask_params({})


MASKS = {"detrend_degree": 0, "detrend_trim": 0.1, "smooth_px": 1.0, "k_sigma": 4.0, "min_area_px": 9, "dilate_px": 2, "alpha_feather_px": 1, "extent": {"localized": [0, 0.5]}}
BLENDING = {"color_strength": 0.0, "color_sigma_frac": 0.25, "grain_strength": 0.0, "grain_seed": 1}


def test_blending(spark):
    rng = np.random.default_rng(4)
    image = rng.integers(100, 110, (60, 70, 3)).astype(np.uint8)
    box = (10, 10, 50, 50)
    clean = image[10:50, 10:50].copy()
    edit = clean.copy()
    edit[15:25, 15:25] = 220
    got = B.blend_candidate(image, clean, edit, box, blending=BLENDING, masks=MASKS, seed=0, stage="minimal")
    assert got["mask"][16:24, 16:24].all() and got["mask_status"] == "ok" and (got["image"][30:32, 30:32] > 200).all() and (got["image"][:10] == image[:10]).all()
    post = B.blend_candidate(image, clean, edit, box, blending=BLENDING, masks={**MASKS, "post_blend": {"enabled": True}}, seed=0, stage="minimal")
    assert post["paste_status"] == "ok" and post["mask"].any()
    same = B.blend_candidate(image, clean, clean, box, blending=BLENDING, masks=MASKS, seed=0)
    assert same["mask_status"] == "no_defect" and (same["image"] == image).all()
    region = np.zeros((40, 40), bool)
    region[5:15, 5:15] = True
    neg = B.blend_region(image, clean, edit, box, region, blending=BLENDING, masks=MASKS, seed=0)
    assert neg["mask_status"] == "negative" and not neg["mask"].any() and neg["paste_components"] == 1 and neg["region_coverage"] == 0.0625
    assert np.allclose(B.noise_sigma(rng.normal(0, 4, (400, 400, 1))), 4, rtol=0.05)
    flat = np.full((50, 50, 3), 128, np.uint8)
    assert B.noise_sigma(B.match_grain(flat, to := B.to_bytes(128 + rng.normal(0, 5, (50, 50, 3))), seed=1))[0] == pytest.approx(B.noise_sigma(to)[0], rel=0.2)
    assert abs(B.color_match(flat, flat + 20).astype(int) - 148).max() <= 1 and B.border_alpha((5, 9), 2)[2, 4] == 1 and B.border_alpha((5, 9), 2)[0].max() == 0
    row = [(1, "tile", "minimal", 0, list(box), image.ravel().tolist(), 60, 70, clean.ravel().tolist(), edit.ravel().tolist(), 40, 40, 3)]
    frame = spark.createDataFrame(row, "id int, category string, stage string, seed int, box array<int>, image array<int>, image_height int, image_width int, clean array<int>, edit array<int>, height int, width int, channels int")
    r = B.blend_candidates(frame, ["id"], blending=BLENDING, masks=MASKS).first()
    assert r["mask_status"] == "ok" and r["mask"] == got["mask"].ravel().astype(int).tolist()


def test_regions(spark):
    clean = np.full((256, 256, 3), 90, np.uint8)
    clean[:, :100] = 5
    for shape in ("blob", "line", "cluster"):
        sizes = []
        for stage in ("minimal", "severe"):
            spec = B.region_settings({"placement": {"margin_px": 64}}, shape=shape, stage=stage)
            a, b = (B.sample_region(clean, spec, 3) for _ in range(2))
            assert (a["mask"] == b["mask"]).all() and a["inside"] >= 0.5 and a["mask"][:, :80].sum() < a["mask"].sum() / 2
            sizes.append(a["mask"].sum())
        assert sizes[0] < sizes[1]
    assert len(regions(B.sample_region(clean, B.region_settings(None, shape="blob", stage="moderate"), 1)["mask"])) == 1
    assert B.region_settings({"mode_sizes": {"strike": {"severe": {"radius": 9}}}}, shape="blob", stage="severe", mode="strike").sizes == {"radius": 9}
    with pytest.raises(ValueError, match="no size"):
        B.region_settings(None, shape="star", stage="severe")
    with pytest.raises(ValueError, match="nothing is left"):
        B.placement_mask(clean, B.region_settings(None, shape="blob", stage="minimal"), np.zeros((256, 256)))
    ring = np.zeros((9, 9), bool)
    ring[2:7, 2:7] = True
    ring[4, 4] = False
    assert B.filled(ring)[4, 4] and B.filled(ring).sum() == 25
    bar = np.zeros((20, 60), bool)
    bar[8:13, 5:55] = True
    assert 40 <= B.skeleton_length(bar) <= 50 and B.thinned(bar).sum() <= 60
    assert B.drawn_measure({}, shape="cluster", stage="minimal", edge=128, draws=3) > 0
    crops = spark.createDataFrame([(1, clean.ravel().tolist(), 256, 256, 3, "blob", "severe", "m", 5)], "id int, clean array<int>, height int, width int, channels int, shape string, stage string, mode string, seed int")
    assert B.sample_regions(crops, ["id"]).first()["coverage"] > 0


def test_crop_plans(spark):
    for wrong in ({"layout": "grid"}, {"layout": "centers", "crop_size": 3}, {"layout": "x"}, {"crop_size": 0}):
        with pytest.raises(ValueError):
            B.crop_plan(wrong)
    frames = spark.createDataFrame([("a", "1", 200, 100), ("a", "2", 200, 100), ("b", "1", 64, 64)], "category string, path string, width int, height int")
    assert {r["category"]: r["n_crops"] for r in B.crops_per_source(frames, B.crop_plan({"layout": "grid", "crop_size": 64})).collect()} == {"a": 8, "b": 1}
    assert B.crop_plan({"crop_size": 10, "crop_centers": [[5, 5], [7, 9]]}).boxes(frames).count() == 6 and B.crop_plan(None).layout == "full"
