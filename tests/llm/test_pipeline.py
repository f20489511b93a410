import numpy as np
import pytest

import corpus_pipeline as cp
from tidemark.llm import packing, simhash_covering, suffix_dedup, toxicity_kn
from tidemark.llm.quality_rules import judge

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What every stage gets and returns, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        done = spark.read.parquet(f"{folder}/{name}")
        out.append((docs, done))
        docs = done
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert after.columns == stages[0][0].columns and after.count() <= before.count()


def test_quality(stages):
    before, after = stages[0]
    want = {r.doc_id: r.quality.clean_text for r in judge(before).collect() if r.quality.kept}
    assert {k: r.text for k, r in rows(after).items()} == want
    assert all(r.n_chars == len(r.text) for r in rows(after).values())


def test_toxicity(spark, stages):
    before, after = stages[1]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(rows(before)) - set(rows(after))
    clean = [d for d in rows(before) if labels.get(d) == 0]
    assert sum(d in gone for d in clean) <= 0.05 * len(clean)
    assert gone


def test_near_duplicates(stages):
    before, after = stages[2]
    groups = simhash_covering.near_duplicates(before).collect()
    assert set(rows(after)) == {r.component_id for r in groups}


def test_repeated_passages(stages):
    before, after = stages[3]
    old, new = rows(before), rows(after)
    assert set(old) == set(new)
    for r in suffix_dedup.removed_spans(before).collect():
        assert (new[r.doc_id].text == old[r.doc_id].text) == (r.n_removed == 0)


def test_packing(stages):
    before, after = stages[4]
    out = after.collect()
    assert {r.doc_id for r in out} == set(rows(before))
    assert len({r.sequence_id for r in out}) <= 1.02 * packing.lower_bound(np.array([r.length for r in out])) + 1


def test_empty_and_null_rows(spark, tmp_path):
    sf = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    text = "\n".join(f"Line{i} has{i} some{i} words{i} of{i} its{i} own{i}." for i in range(20))
    other = text.replace("some", "other").replace("own", "kind")
    data = [(1, text, "en", "a", 1), (2, text, None, None, None), (2, text, None, None, None), (None, other, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "a", 0)]
    spark.createDataFrame(data, schema).write.parquet(f"{sf}/documents.parquet")
    assert sorted({r.doc_id for r in cp.run(spark, sf).collect()}, key=str) == [1, None]
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert cp.run(spark, empty).collect() == []
