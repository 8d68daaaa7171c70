import corpus_pipeline
from tests.llm.helpers import DOCS, docs, empty, words
from verdigris.llm import bpe, common, packing


def test_pipeline(spark, tmp_path):
    import random

    rng = random.Random(6)
    passage = words(rng, 80)
    more = [(2000 + i, words(rng, 60) + (" " + passage if i % 3 == 0 else ""), "en", "s", 1, "x", 1, "y", 0.5, "z") for i in range(30)]
    frame = docs(spark, extra=more)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    seen = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = [seen.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, str(tmp_path))
        assert out.columns == frame.columns, name
        path = str(tmp_path / name)
        out.write.parquet(path)
        seen = spark.read.parquet(path)
        sizes.append(seen.count())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[4] == sizes[3]
    left = [r["text"] for r in seen.collect()]
    assert sum(passage in (t or "") for t in left) == 1
    last = corpus_pipeline.STAGES[-1][1](spark, seen, str(tmp_path)).collect()
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda rows: sorted(((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows), key=str)
    assert key(last) == key(run) and packing.CAPACITY == 4096 and bpe.KEPT > 0


def test_pipeline_without_rows(spark):
    seen = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        seen = stage(spark, seen, "")
        assert seen.count() == 0


def test_cutting_texts_without_repeats(spark):
    """Passages just short of a repeat: suffix dedup has collections without a repeated window and leaves all rows as they are."""
    import random

    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = []
    for i in range(40):
        shared = letters(95)
        rows += [(10 * i + k, letters(150) + "01"[k] + shared + "23"[k] + letters(150), "en", "s", 1, "x", 1, "y", 0.5, "z") for k in range(2)]
    left = corpus_pipeline.cut_repeats(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == [r[:2] for r in rows]


def test_stages_let_executors_collect_garbage(spark, monkeypatch):
    """Each stage asks first, and the request reaches the JVM that runs tasks (here the session's own)."""
    beans = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName())
    before = beans()
    common.collect_garbage(spark)
    assert beans() > before
    asked = []
    monkeypatch.setattr(corpus_pipeline, "collect_garbage", asked.append)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, empty(spark), "")
    assert asked == [spark] * 5
