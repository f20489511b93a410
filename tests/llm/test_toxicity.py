import random
import zlib

from tidemark.llm import toxicity_kn as kn

SCHEMA = "doc_id long, text string, score string, toxic int"


def corpus(n=300):
    rng = random.Random(5)
    plain = ["river", "stone", "walks", "green", "evening", "letters", "garden", "quiet"]
    rows = []
    for i in range(n):
        words = rng.choices(plain, k=rng.randrange(20, 80))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "vex" + "".join(rng.choices("abcdef", k=3)))
        rows.append((i, " ".join(words), "x", int(toxic)))
    return rows


def test_unseen_variants_of_rare_expressions_are_found(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    model = kn.fit(kn.train_rows(docs), kn.train_rows(docs.select("doc_id", "toxic")))
    held = [r for r in kn.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 40 and sum((r.score >= kn.THRESHOLD) != (r.doc_id % 5 == 0) for r in held) <= 1
    again = {r.doc_id: r.score for r in kn.score(docs.repartition(7), model).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in held)


def test_nulls_empty_one_class_and_repeats(spark):
    docs = spark.createDataFrame([(1, None, "a", 0), (2, "", "a", 0), (2, "", "a", 0), (None, "...", "a", 1), (3, "word " * 30000, None, None)], SCHEMA)
    for labels in ([], [(1, None)], [(1, 0), (None, 1)], [(2, 1)]):
        model = kn.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        out = kn.score(docs, model).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert kn.score(docs.limit(0), model).collect() == []


def test_held_out_rows_of_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    rows = kn.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.7 * sum(r.toxic for r in rows) and hit >= 0.8 * sum(r.predicted for r in rows)
