"""Stages on documents with further columns, whose names the operators use inside, and with null and repeated rows."""

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, score double, id long, fp long, component_id long, __text string, c0 string, row int, n_chars long, quality int, __rank string, __qt int, key int, rank int, id2 int"


def table(spark):
    words = " ".join(f"word{i}" for i in range(80))
    rows = [(i, t, 0.5, 9, 9, 9, "t", "c", 1, 3, 4, "r", 5, 6, 7, 8) for i, t in [(1, words), (2, words), (3, words + " more"), (4, None), (5, ""), (None, "lone text"), (None, None), (6, "other " * 60), (6, "other " * 60)]]
    return spark.createDataFrame(rows, SCHEMA)


def labels(spark, folder):
    spark.createDataFrame([(1, 0), (3, 1), (None, 1), (6, None)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_further_columns_pass_through(spark, tmp_path):
    docs, sf = table(spark), labels(spark, tmp_path)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert (r.score, r.id, r.fp, r.component_id, r["__text"], r.c0, r.row, r.quality, r["__rank"], r["__qt"], r.key, r["rank"]) == (0.5, 9, 9, 9, "t", "c", 1, 4, "r", 5, 6, 7), name
        empty = stage(spark, docs.limit(0), sf)
        assert empty.columns == docs.columns and empty.collect() == [], name


def test_one_of_each_group_and_all_without_an_id(spark, tmp_path):
    out = cp.near_duplicates(spark, table(spark), labels(spark, tmp_path)).collect()
    ids = [r.doc_id for r in out]
    assert ids.count(None) == 2 and len({i for i in ids if i is not None}) == len([i for i in ids if i is not None])
    assert 1 in ids and 2 not in ids and ids.count(6) == 1


def test_packing_reads_id_and_text_alone(spark, tmp_path):
    out = cp.pack(spark, table(spark), labels(spark, tmp_path)).collect()
    assert {r.doc_id for r in out} == {1, 2, 3, 4, 5, 6, None}
    assert all(0 <= r.offset and r.offset + r.length <= 1024 for r in out)


def test_rows_that_repeat_an_id_with_other_texts_stay(spark, tmp_path):
    words = [" ".join(f"{k}{i}" for i in range(80)) for k in ("river", "stone", "garden")]
    rows = [(7, words[0]), (7, words[1]), (7, words[1]), (7, None), (8, words[0]), (9, words[2]), (9, words[1])]
    docs = spark.createDataFrame([(i, t, 0.0, 1, 1, 1, "", "", 1, 1, 1, "", 1, 1, 1, 1) for i, t in rows], SCHEMA)
    out = cp.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted([(7, words[0]), (7, words[1]), (7, None), (9, words[2])], key=repr)
