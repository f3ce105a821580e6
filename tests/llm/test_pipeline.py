"""The pipeline's stages on a small planted corpus."""

import numpy as np

import corpus_pipeline

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_effect(spark, tmp_path):
    r = np.random.default_rng(0)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    say = lambda n: " ".join(words[i] for i in r.integers(0, 300, n))
    test = say(15)
    rows = [(i, say(150), "en", f"s{i % 3}", 0) for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "s0", 0) for i in range(10)]  # copies
    rows += [(300 + i, say(100) + " " + test + " " + say(20), "en", "s1", 0) for i in range(5)]  # leaks
    rows += [(400 + i, "again " * 100, "en", "s1", 0) for i in range(5)] + [(500, None, None, None, None), (501, "few words", "en", "s2", 0)]  # junk
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, test)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "decontamination", "mixing", "token records"]
    docs = corpus_pipeline.documents(spark, str(tmp_path))
    left = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        left.append({x.doc_id for x in docs.select("doc_id").collect()})
    clean = set(range(120))
    assert left[0] == clean | set(range(200, 210)) | set(range(300, 305))
    assert left[1] == clean | set(range(300, 305))
    assert left[2] == clean
    assert left[3] <= clean and left[4] == left[3]
    got, again = ({tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()} for _ in range(2))
    assert got == again == {tuple(x) for x in docs.select("doc_id", "start", "n_tokens", "ids_crc32").collect()}
