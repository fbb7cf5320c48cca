"""The stages of the pipeline, each on its own input, and the whole."""

from collections import Counter

import corpus_pipeline
from tests.llm.test_documents import labelled

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    docs, labels = labelled(200)
    clean = [(i, t) for i, t in docs if i % 4]
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(i, t, "en", "s", len(t)) for i, t in docs]
    rows += [(500, clean[0][1], "en", "s", 1), (501, f"so {item} it is", "en", "s", 1), (502, "my token=abcdefgh12 here", None, None, None), (503, None, None, None, None), (504, "", None, None, None), rows[1], (None, f"{item} of no id", None, None, None), (None, "clean words of no id", None, None, None)]
    d = str(tmp_path)
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"file://{d}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"file://{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{d}/benchmark.parquet")
    kept = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, d)
        kept.write.parquet(f"file://{d}/{name}")
        kept = spark.read.parquet(f"{d}/{name}")
        seen[name] = kept
        if name != "packing":
            assert kept.columns == corpus_pipeline.COLUMNS
    ids = lambda name: {r.doc_id for r in seen[name].select("doc_id").collect()}
    toxic = {i for i, y in labels if y}
    assert len(toxic & ids("toxicity")) <= 1 and {i for i, _ in clean} | {None, 500, 501, 502, 503, 504} <= ids("toxicity")
    assert ids("near_dedup") == ids("toxicity") - {500} and seen["near_dedup"].count() == len(ids("near_dedup")) + 1
    assert ids("decontamination") == ids("near_dedup") - {501}
    assert [r.text for r in seen["decontamination"].filter("doc_id is null").collect()] == ["clean words of no id"]
    texts = {r.doc_id: r.text for r in seen["secrets"].collect()}
    assert set(texts) == ids("decontamination") and texts[502] == "my [REDACTED] here" and texts[503] is None
    assert ids("packing") == ids("decontamination")
    whole = Counter(r.doc_id for r in corpus_pipeline.run(spark, d).collect())
    assert whole == Counter(r.doc_id for r in seen["packing"].collect())


def test_stages_of_nothing(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{d}/benchmark.parquet")
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, d).count() == 0


def test_near_copies_of_four_fifths_go(spark):
    words = [f"w{i}" for i in range(104)]
    other = [*words[:50], "x", *words[51:75], "y", *words[76:]]  # 90 of 110 shingles are shared: 0.818
    less = [f"v{i}" for i in range(104)]
    apart = [w + "z" if i in (20, 50, 80) else w for i, w in enumerate(less)]  # 85 of 115: 0.739
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate((words, other, less, apart))]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, COLUMNS), "")
    assert {r.doc_id for r in kept.collect()} == {0, 2, 3}
