import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest

from tidemark.llm import chat_format as cf
from tidemark.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn int, role string, text string, own string, seq int, n int"
COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
HARD = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>", "<", "[", "[/INST", "\\", "s>", "<<s>", "[[INST]]", "[\\ROLE]", "é\n\r", "", "[ROLE]x[/ROLE]"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows, added=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c, True].append((turn is not None, turn or 0, role or "", text or ""))
    if added:
        convs[-1, False] = [(True, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))]
    marked = lambda x: len(x) + len(re.findall(r"<\\*/?s>|\[\\*/?(?:INST|ROLE)\]", x))
    out = []
    for (c, _), turns in convs.items():
        turns = sorted(turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        size = sum(marked(t) + (13 if r == "user" else 7 if r == "assistant" else 17 + marked(r)) for *_, r, t in turns)
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss), size))
    return sorted(out, key=repr)


def run(df):
    return sorted((tuple(r) for r in cf.op11_chat_template(df).select(*COLUMNS).collect()), key=repr)


def test_escaping_is_reversed():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices(HARD, k=rng.randrange(6)))
        escaped = cf.MARKS.escape(text)
        assert cf.MARKS.unescape(escaped) == text and not cf.MARKS.plain.search(escaped)
    with pytest.raises(ValueError):
        cf.Marks(["<a", "b<"])


def test_any_turns_are_read_back():
    rng = random.Random(2)
    template = cf.default_template()
    for _ in range(500):
        turns = [{"role": rng.choice(["user", "assistant", "system", "", *HARD]), "text": "".join(rng.choices(HARD, k=rng.randrange(5)))} for _ in range(rng.randrange(6))]
        text, spans = template.render(turns)
        assert list(cf.read_turns(text)) == [(t["role"], t["text"]) for t in turns]
        assert [cf.MARKS.unescape(text[a:b]) for a, b in spans] == [t["text"] for t in turns if t["role"] == "assistant"]


def test_conversations_and_sql(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    want = brute([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    assert run(df) == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    assert sorted((tuple(r) for r in QUERIES["op11_chat_template"](spark, sf).select(*COLUMNS).collect()), key=repr) == want
    assert sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op11_chat_template']})").fetchall(), key=repr) == want


def test_edges_and_conversations_of_many_chunks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "tool", None]), "".join(rng.choices(HARD, k=3))) for c in range(40) for t in range(rng.choice([1, 2, 7]))]
    rows += [(50, t, rng.choice(["user", "assistant"]), f"turn {t} " * rng.randrange(9)) for t in range(600)]  # most of the table
    rows += [(60, None, "user", "b"), (60, None, "user", "a"), (60, 3, None, None), (60, 3, None, None), (None, 1, "user", "no id"), (None, 0, "assistant", "none"), (-1, 0, "user", "own"), (70, 1, "assistant", "long " * 30_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(5)
    monkeypatch.setattr(cf, "CHUNK_BYTES", 400)
    assert run(df) == brute(rows)
    pieces = cf.format_conversations(df.where("conv_id = 50"))
    assert pieces.count() > 20
    together = "".join(r.text for r in sorted(pieces.collect(), key=lambda r: r.seq))
    assert list(cf.read_turns(together)) == [(r[2], r[3]) for r in sorted((x for x in rows if x[0] == 50), key=lambda x: x[1])]
    assert run(df.limit(0)) == brute([])
    assert cf.format_conversations(df.limit(0)).collect() == []
