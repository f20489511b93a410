import re

from pyspark.sql import functions as F

from tidemark.llm import quality_rules as q

SCHEMA = "doc_id long, text string, quality string, kept string, n_words int"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = list(zip(words, words[1:], words[2:]))
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= {i, i + 1, i + 2}
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def test_base_counts_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 6000")
    want = {r.doc_id: base(r.text) for r in docs.collect()}
    got = {r.doc_id: tuple(r)[1:7] for r in q.verdicts(docs).collect()}
    assert got == want


def test_edges(spark):
    prose = "\n".join(f"Sentence{i} tells{i} about{i} several{i} other{i} things{i} here{i}." for i in range(20))
    menu = "Home | News | Sport | Weather\n" * 30
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, prose), (4, prose), (5, menu), (6, prose + "\n" + "Home | News | Sport | Weather"), (None, "a b c a b c a b c é"), (7, "word " * 30000)]
    docs = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in q.verdicts(docs).collect()), key=str)
    assert [x[:7] for x in got if x[0] != 7] == sorted(((d, *base(t)) for d, t in rows if d != 7), key=str)
    assert [x[7] for x in got if x[0] in (4, 6)] == [True] * 3 and not any(x[7] for x in got if x[0] in (1, 2, 3, 5, 7))
    long = next(x for x in got if x[0] == 7)
    assert long[1] == 30000 and long[5] == 30000
    cleaned = q.keep_clean(docs)
    assert cleaned.columns == docs.columns
    assert {r.doc_id: r.text for r in cleaned.collect()} == {4: prose, 6: prose}
    assert q.verdicts(docs.limit(0)).collect() == []


def test_clean_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    rows = q.verdicts(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("n_words >= 50").collect()
    clean, junk = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.1 * len(junk)


def test_long_lines_may_mention_boilerplate(spark):
    start = "Read more about the river and its boats"
    lines = [(start + " x" * n)[: q.BOILERPLATE_CHARS - 2 + d] + "." for n, d in ((300, 0), (300, 1), (300, 2))]
    out = spark.createDataFrame([(x,) for x in lines], "line string").select(q.line_passes(F.col("line")), F.length("line")).collect()
    assert [tuple(r) for r in out] == [(False, 299), (True, 300), (True, 301)]
