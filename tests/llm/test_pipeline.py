"""The pipeline on a small folder of tables."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rnd = random.Random(6)
    parts = ["the", "ing", "tion", "her", "and", "of"]
    rows, labels = [], []
    for i in range(160):
        words = ["".join(rnd.choices(parts, k=rnd.randint(1, 3))) for _ in range(60)]
        bad = i % 5 == 0
        rows.append([i, " ".join(w + "$$$" if bad else w for w in words), "en", "s", 0, "kept", "dotted"])
        labels.append((i, int(not bad)))
    rows[1][1] += " write to ann@site.org"
    rows[2][1] = rows[1][1]
    rows[3][1] = None
    rows[4][1] = "12 34 !!"
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, `a.b` string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r for r in now.collect()}
    assert not {3, 4} & kept["language_id"].keys() and len(kept["language_id"]) == 158
    assert len(kept["quality"].keys() & set(range(0, 160, 5))) <= 2 and len(kept["quality"]) >= 122
    assert 1 in kept["near_duplicates"] and 2 not in kept["near_duplicates"]
    assert kept["personal_data"][1]["text"].endswith("write to <EMAIL>")
    assert kept["personal_data"][1]["n_chars"] == len(kept["personal_data"][1]["text"]) and kept["personal_data"][1]["score"] == "kept" and kept["personal_data"][1]["a.b"] == "dotted"
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(packed.doc_id) == kept["personal_data"].keys()
    again = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, again, str(tmp_path)).count() == 0


def test_near_duplicates_by_similarity(spark, tmp_path):
    """Of a text and copies with one to three of 150 words changed one stays; one with thirty changed stays too."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefgh", k=6))
    rows, want = [], set()
    for i in range(0, 300, 10):
        base = [word() for _ in range(150)]
        for k in range(4):
            words = list(base)
            for at in rnd.sample(range(150), k):
                words[at] = word()
            rows.append((i + k, " ".join(words), 0))
        far = list(base)
        for at in rnd.sample(range(150), 30):
            far[at] = word()
        rows.append((i + 9, " ".join(far), 0))
        want |= {i, i + 9}
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert want <= got and len(got - want) <= 4


def test_near_duplicates_keep_a_row_of_each_group(spark, tmp_path):
    rnd = random.Random(8)
    a, b, c, d = (" ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(80)) for _ in range(4))
    rows = [(1, a), (5, a), (None, a), (None, b), (None, c), (None, c), (5, d), (5, d)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in out.collect())) == sorted([(1, a), (0, b), (0, c), (5, d)])
