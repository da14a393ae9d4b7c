import random

import corpus_pipeline as P


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(80))
    clean = [(text("etaoinshr"), "aa") for _ in range(60)] + [(text("éèçuxoam"), "bb") for _ in range(60)]
    near = [(clean[3][0] + " extra", "aa"), (clean[4][0], "aa")]
    junk = [(" ".join(f"{w}%%%" for w in text("etaoinshr").split()), "aa") for _ in range(10)] + [("short", "aa"), (None, None)]
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate(clean + near + junk)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [k for k, _ in P.STAGES] == ["quality rules", "language ID", "n-gram Jaccard join", "best-fit packing"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "best-fit packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left.append(sorted({r["doc_id"] for r in docs.select("doc_id").collect()}))
    assert left == [list(range(122)), list(range(122)), list(range(120)), list(range(120))]
    assert P.run(spark, str(tmp_path)).count() == docs.count()
