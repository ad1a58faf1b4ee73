"""Rows that share a labelled id, and rows without one."""

from stridemill.llm import quality_forest, toxicity


def text(k, bad):
    return " ".join(f"{'#' if bad and i % 2 else ''}word{k * 7 + i}" for i in range(80))


def test_a_labelled_id_with_very_many_rows_is_learned_from_once(spark, monkeypatch):
    docs = [(k, text(k, k % 4 == 0)) for k in range(200)]
    many = docs + [(0, text(0, True))] * 5000 + [(None, text(3, True))] * 50
    labels = spark.createDataFrame([(k, 0 if k % 4 == 0 else 1) for k in range(200)], "doc_id long, quality int")
    seen = []
    learned = quality_forest.learned
    monkeypatch.setattr(quality_forest, "learned", lambda c, bad, *a, **b: seen.append(len(c)) or learned(c, bad, *a, **b))
    schema = "doc_id long, text string"
    one = quality_forest.fit(spark.createDataFrame(docs, schema), labels)
    other = quality_forest.fit(spark.createDataFrame(many, schema).repartition(4), labels)
    assert seen == [200, 200]
    rows = [sorted(map(tuple, quality_forest.judge(spark.createDataFrame(docs, schema), v).collect())) for v in (one, other)]
    assert rows[0] == rows[1]


def test_rows_without_an_id_are_held_out(spark):
    lexicon = toxicity.Lexicon({})
    got = toxicity.score(spark.createDataFrame([(None, "x"), (1, None)], "doc_id long, text string"), lexicon).collect()
    assert {r["doc_id"]: r["held_out"] for r in got} == {None: True, 1: __import__("zlib").crc32(b"1") % 3 == 1}


def test_texts_that_share_an_id_are_no_duplicates(spark):
    import corpus_pipeline

    words = lambda k: " ".join(f"w{k * 100 + i}" for i in range(60))
    rows = [(1, words(1), "a"), (1, words(2), "b"), (1, words(2), "b"), (2, words(2), "c"), (2, words(3) + " more", "d"), (3, words(3), "e"), (4, words(4), "f"), (4, None, "g"), (None, words(1), "h"), (5, "", "i")]
    docs = spark.createDataFrame([(k, t, v, 0) for k, t, v in rows], "doc_id long, text string, key string, number int").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.select("doc_id", "text", "key").collect()), key=repr) == sorted(
        [(1, words(1), "a"), (1, words(2), "b"), (2, words(3) + " more", "d"), (4, words(4), "f"), (4, None, "g"), (None, words(1), "h")], key=repr
    )
