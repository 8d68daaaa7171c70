import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.functions import stats
from verdigris.functions.exprs import passes_gate
from verdigris.operators import correlation as C
from verdigris.operators import detection as T
from verdigris.operators import kernels as I
from verdigris.operators import pixel as X


def test_t_distribution():
    assert stats.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-9)
    assert stats.t_quantile(0.975, 1) == pytest.approx(12.706204736432095, rel=1e-9)
    assert stats.t_two_sided(2.0, 5) == pytest.approx(0.10193947790, abs=1e-9)
    assert stats.kendall_exact(0, 4) == pytest.approx(2 / 24)


def scored(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    grades = np.array(["none", "minimal", "slight", "moderate", "severe"])
    g = rng.integers(0, 5, n)
    s = np.round(rng.normal(size=n) + g / 3, 1)
    return spark.createDataFrame([("r", int(x > 0), float(v), str(grades[x])) for x, v in zip(g, s, strict=True)], "run_id string, label int, score double, severity string"), g, s


def test_concordance_against_pairs(spark):
    df, g, s = scored(spark)
    r = T.severity_concordance(df, ["run_id"]).first()
    up = g[:, None] < g[None, :]
    d = s[None, :] - s[:, None]
    assert r["severity_cindex"] == pytest.approx(((d > 0) + 0.5 * (d == 0))[up].mean())
    t = np.sign(g[None, :] - g[:, None]) * np.sign(d)
    assert r["severity_tau_b"] == pytest.approx(t.sum() / np.sqrt((np.sign(g[None, :] - g[:, None]) != 0).sum() * (d != 0).sum()))
    assert r["n_severity_pairs"] == up.sum()


def test_two_levels_are_auroc(spark):
    df, _, _ = scored(spark)
    two = df.where("severity IN ('none', 'severe')")
    assert T.severity_concordance(two, ["run_id"]).first()["severity_cindex"] == pytest.approx(T.auroc(two, ["run_id"]).first()["image_auroc"])
    assert T.severity_concordance(two, ["run_id"]).first()["severity_cindex_defects"] is None


def test_single_class_and_empty_queries(spark):
    df, _, _ = scored(spark)
    queries = T.make_queries({"all": None, "none": "score > 1000", "bad": "severity == 'severe'"})
    rows = {r["query"]: r for r in T.query_metrics(df, queries).collect()}
    assert rows["none"]["image_auroc"] is None and rows["none"]["n_samples"] == 0 and rows["bad"]["image_auroc"] is None and rows["all"]["image_auroc"] > 0.5
    with pytest.raises(ValueError, match="unknown severity"):
        T.severity_concordance(df, ["run_id"], exclude=["awful"])


def test_expressions():
    assert T.to_sql("a != 0 and b == 'x y'") == "a IS DISTINCT FROM 0 and b = 'x y'"
    with pytest.raises(ValueError, match="only comparisons"):
        T.to_sql("a.str.startswith('x')")
    with pytest.raises(TypeError):
        T.make_queries({"a": 3})


def test_area_gate(spark):
    df = spark.createDataFrame([(0.0,), (None,), (float("nan"),), (0.3,)], "a double")
    assert df.where(passes_gate("a")).count() == 3


def test_split_query(spark):
    df = C.with_severity(spark.createDataFrame([("minimal_accept",), ("all",), ("severe_slight",), ("odd",), ("reject",)], "query string"))
    got = {r["query"]: (r["severity"], r["scorer"]) for r in df.collect()}
    assert got == {"minimal_accept": ("minimal", "accept"), "all": ("all", "all"), "severe_slight": ("severe_slight", "all"), "odd": ("odd", "all"), "reject": ("all", "reject")}


def test_constant_offset_is_bias(spark):
    rows = [("m", "s", "all", "c", float(i), float(i) + 0.1) for i in range(5)]
    df = spark.createDataFrame(rows, "metric string, set_name string, query string, category string, real double, synth double")
    r = C.evaluate_bias(df).first()
    assert r["bias"] == pytest.approx(0.1) and r["bias_sd"] == 0 and r["overestimates"] is True and r["bias_t"] is None


def test_correlation_of_constants(spark):
    df = spark.createDataFrame([("m", "s", "q", "c", 1.0, float(i)) for i in range(5)], "metric string, set_name string, query string, category string, real double, synth double")
    r = C.correlate(df).first()
    assert r["n"] == 5 and r["pearson_r"] is None and r["kendall_tau"] is None and r["synth_range"] == 4


def brute_labels(mask):
    out, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if out[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        out[y, x] = n
        while todo:
            a, b = todo.pop()
            for p in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not out[p]:
                    out[p] = n
                    todo.append(p)
    return out


def test_region_labels():
    rng = np.random.default_rng(0)
    for p in (0.3, 0.5, 0.6, 1.0, 0.0):
        mask = rng.random((17, 23)) < p
        assert np.array_equal(X.label_regions(mask), brute_labels(mask))


def test_pixels_of_one_class(spark):
    df = spark.createDataFrame([("r", 0, i, 0, float(i)) for i in range(20)], "run_id string, image_id long, px long, label int, score double")
    r = X.pixel_metrics(X.pixel_histograms(df, X.score_edges(df, ["run_id"], 4))).first()
    assert r["pixel_auroc"] is None and r["aupro"] is None and r["positive_pixel_rate"] == 0


def test_noise_level_resists_contamination():
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(10, 1, 10000))
    x[:5500] += 40
    level, scale = I.noise_level(x)
    assert abs(level - 10) < 0.5 and abs(scale - 1) < 0.3
    assert I.noise_level(np.zeros(0)) == (0, 0) and I.noise_level(np.ones(9)) == (1, 0)


def test_detrend_removes_a_plane_and_keeps_a_blot():
    y, x = np.mgrid[:64, :64] / 63.0
    plane = np.stack([3 + 2 * x - y] * 3, axis=2)
    blot = np.zeros((64, 64, 3))
    blot[20:30, 20:30] = 50
    got = I.detrend(plane + blot, 2)
    assert np.abs(got[40:, 40:]).max() < 0.5 and got[25, 25, 0] > 45


def test_estimate_mask_finds_the_change():
    rng = np.random.default_rng(2)
    clean = rng.normal(100, 1, (64, 64, 3))
    edit = clean + rng.normal(0, 1, clean.shape)
    edit[10:26, 30:46] += 60
    got = I.estimate_mask(clean, edit, extent=(0.01, 0.5))
    truth = np.zeros((64, 64), bool)
    truth[10:26, 30:46] = True
    assert got["mask_status"] == "ok" and (got["mask"] & truth).sum() / (got["mask"] | truth).sum() > 0.5
    assert I.estimate_mask(clean, clean)["mask_status"] == "no_defect"


def test_filters_keep_constants():
    flat = np.full((20, 30), 7.0)
    assert np.allclose(I.box_mean(flat, 3), 7) and np.allclose(I.gaussian(flat, 2), 7) and np.allclose(I.guided_refine(flat, np.arange(600.0).reshape(20, 30)), 7)
    assert np.allclose(I.resize_bilinear(flat, (7, 11)), 7)


def test_perlin_is_seeded_and_bounded():
    a, b = (I.perlin_mask(50, 70, np.random.default_rng(3))[0] for _ in range(2))
    assert np.array_equal(a, b) and a.shape == (50, 70)
    noise = I.perlin((64, 64), (4, 4), np.random.default_rng(0))
    assert abs(noise).max() <= 1.5 and noise.std() > 0.1
    got = I.overlay_nonzero(np.zeros((40, 40, 3), np.uint8), np.full((40, 40, 3), 200, np.uint8), np.random.default_rng(5))
    assert (got["mask_status"] == "ok") == bool(got["mask"].any()) and not got["image"][~got["mask"]].any()


def test_crops_cover_the_frame(spark):
    df = spark.createDataFrame([(500, 300), (96, 96), (99, 200)], "width int, height int")
    for r in I.grid_boxes(df, 96, 0.25).groupBy("width", "height").agg(F.min("x0").alias("a"), F.max("x1").alias("b"), F.max("y1").alias("c")).collect():
        assert r["b"] <= r["width"] and r["c"] == r["height"] and (r["width"] == 99 or (r["a"] == 0 and r["b"] == r["width"]))


def test_estimate_masks_frame(spark):
    rng = np.random.default_rng(2)
    clean = rng.normal(100, 1, (32, 32, 3))
    edit = clean.copy()
    edit[8:18, 8:18] += 60
    df = spark.createDataFrame([("a", clean.ravel().tolist(), edit.ravel().tolist(), 32, 32, 3), ("b", clean.ravel().tolist(), clean.ravel().tolist(), 32, 32, 3)], "image string, clean array<double>, edit array<double>, height int, width int, channels int")
    got = {r["image"]: r for r in I.estimate_masks(df, ["image"]).collect()}
    assert got["b"]["mask_status"] == "no_defect" and got["a"]["mask_components"] >= 1 and sum(got["a"]["mask"]) >= 100
    masks = spark.createDataFrame([(got["a"]["mask"],)], "m array<int>").select(X.defect_area_fraction(F.col("m")).alias("f"), I.binary_iou(F.col("m"), F.col("m")).alias("i")).first()
    assert masks["f"] == pytest.approx(sum(got["a"]["mask"]) / 1024, abs=1e-6) and masks["i"] == 1
    regions = X.region_labels_2d(spark.createDataFrame([("a", got["a"]["mask"], 32, 32)], "image string, mask array<int>, height int, width int"), ["image"])
    assert regions.agg(F.sum("size")).first()[0] == sum(got["a"]["mask"])
