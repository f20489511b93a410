"""Conversations formatted by a template, and read back from what was formatted.

Turns are dealt to ranges of (conversation, turn) and packed there into chunks of about CHUNK_BYTES,
so that a conversation of any length is many small rows in several tasks. A chunk knows the number of
its first turn and of all turns, which is all that a template asks of the rest; chunks of a
conversation that lies whole inside a range need no exchange for that, and of others only their
sizes are summed. Each chunk is rendered by itself; the texts of a conversation's chunks joined are
the text of the conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregates import totals_before

from .chat_template import Template
from .common import partitions, staged

CHUNK_BYTES = 1 << 20
#: Control strings of the template.
BOS, EOS, INST, INST_END, ROLE, ROLE_END = CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
TEMPLATE = """
{%- for m in messages -%}
  {%- if m.role == 'user' -%} {{ inst }}{{ m.text | escape }}{{ inst_end }}
  {%- elif m.role == 'assistant' -%} {{ bos }}{% generation %}{{ m.text | escape }}{% endgeneration %}{{ eos }}
  {%- else -%} {{ role }}{{ m.role | escape }}{{ role_end }}{{ m.text | escape }}{{ eos }}
  {%- endif -%}
{%- endfor -%}
"""
ADDED = ("user", "assistant"), "</s>[INST] ok [/INST]"
TURNS = "array<struct<role: string, text: string>>"
SPANS = "array<struct<start: long, end: long>>"


class Marks:
    """Escapes control strings inside texts.

    A control string gets a backslash after its first character, and what looks like one so escaped
    gets one more; taking one away restores the text. As first characters stand nowhere else in a
    control string, none can arise where a text and a mark meet.
    """

    def __init__(self, controls: Sequence[str]) -> None:
        heads = {c[0] for c in controls}
        if any(len(c) < 2 or c[1] == "\\" or heads & set(c[1:]) for c in controls):
            raise ValueError("control strings have two characters or more, and their first ones nowhere else")
        self.controls = tuple(controls)
        each = lambda slashes: "|".join(re.escape(c[0]) + slashes + re.escape(c[1:]) for c in controls)
        self.plain, self.inner, self.escaped = re.compile(each("")), re.compile(each(r"\\*")), re.compile(each(r"\\+"))

    def __reduce__(self):
        return Marks, (self.controls,)

    def escape(self, text: str) -> str:
        return self.inner.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(self, text: str) -> str:
        return self.escaped.sub(lambda m: m[0][0] + m[0][2:], text)


MARKS = Marks(CONTROLS)


def default_template() -> Template:
    return Template(TEMPLATE, {"bos": BOS, "eos": EOS, "inst": INST, "inst_end": INST_END, "role": ROLE, "role_end": ROLE_END}, {"escape": MARKS.escape})


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn in what the default template wrote."""
    marks = list(MARKS.plain.finditer(text))
    segment = lambda i: MARKS.unescape(text[marks[i].end() : marks[i + 1].start()])
    i = 0
    while i < len(marks):
        if marks[i][0] == ROLE:
            yield segment(i), segment(i + 1)
            i += 3
        else:
            yield ("user" if marks[i][0] == INST else "assistant"), segment(i)
            i += 2


def packed(table: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, added: Sequence[tuple] = ()) -> DataFrame:
    """(conv_id, own, seq, n, turns, open): turns in order, in chunks; open if the conversation may go on in others.

    seq rises along a conversation. `added` has (conversation, turn, role, text) of conversations
    that the table lacks; they are told from its own by `own`.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = table.select(F.col(conv_col).cast("long").alias("conv_id"), F.lit(True).alias("own"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    if added:
        more = table.sparkSession.createDataFrame(list(added), "conv_id long, turn long, role string, text string")
        rows = rows.unionByName(more.withColumn("own", F.lit(False)))
    spark = table.sparkSession
    order = ["conv_id", "own", F.col("turn").asc_nulls_first()]
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "role", "text")

    def pack(batches):
        from pyspark import TaskContext

        seq, first, key, held, size, cut, waiting = TaskContext.get().partitionId() << 32, True, None, [], 0, False, []

        def chunk():
            nonlocal seq, held, size
            waiting.append({"conv_id": key[0], "own": key[1], "seq": seq, "n": len(held), "turns": held})
            seq, held, size = seq + 1, [], 0

        def release(open_):
            out = pa.RecordBatch.from_pylist([{**c, "open": open_} for c in waiting], schema)
            waiting.clear()
            return out

        for batch in batches:
            done, done_size = [], 0
            for conv_id, own, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "own", "role", "text"))):
                if key is not None and (conv_id, own) != key:
                    chunk()
                    if first or cut:
                        yield release(True)
                    else:
                        done += waiting
                        waiting.clear()
                    first = cut = False
                elif size > CHUNK_BYTES:
                    chunk()
                    cut = True
                    yield release(True)
                key = (conv_id, own)
                held.append({"role": role, "text": text})
                size += len(role) + len(text)
                done_size += len(text)
                if done and done_size > CHUNK_BYTES:
                    yield pa.RecordBatch.from_pylist([{**c, "open": False} for c in done], schema)
                    done, done_size = [], 0
            if done:
                yield pa.RecordBatch.from_pylist([{**c, "open": False} for c in done], schema)
        if key is not None:
            chunk()
            yield release(True)

    turn = pa.struct([("role", pa.string()), ("text", pa.string())])
    schema = pa.schema([("conv_id", pa.int64()), ("own", pa.bool_()), ("seq", pa.int64()), ("n", pa.int64()), ("turns", pa.list_(turn)), ("open", pa.bool_())])
    return dealt.select("conv_id", "own", "role", "text").mapInArrow(pack, f"conv_id long, own boolean, seq long, n long, turns {TURNS}, open boolean")


def format_conversations(table: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", added: Sequence[tuple] = ()) -> DataFrame:
    """(conv_id, own, seq, start, n, n_turns, text, loss): the rendered chunks of every conversation, and the spans of text that are trained on.

    Turns are ordered by turn, null first, ties by role and text; null roles and texts are empty,
    repeated rows are turns of their own, and rows with a null conversation are one conversation,
    whose id is null. A chunk has n of a conversation's n_turns, from number start on; chunks in the
    order of seq make up the conversation, and nearly all have one. Spans count code points of the
    chunk's text. An empty table gives the conversations of `added` only. Other columns aren't read.
    """
    template = template or default_template()
    chunks = staged(packed(table, conv_col, turn_col, role_col, text_col, added), "chunks")
    parts = chunks.where("open").select("conv_id", "own", "seq", "n")
    placed = totals_before(parts, ["seq"], {"start": F.col("n")}, ["conv_id", "own"]).select("conv_id", "own", "seq", "start")
    totals = parts.groupBy("conv_id", "own").agg(F.sum("n").alias("n_turns"))
    sized = placed.alias("p").join(totals.alias("t"), [F.col("p.conv_id").eqNullSafe(F.col("t.conv_id")), F.col("p.own") == F.col("t.own")]).select("p.seq", "start", "n_turns")
    columns = ["conv_id", "own", "seq", "start", "n", "n_turns", "turns"]
    ready = chunks.where("open").join(sized, "seq").select(*columns)  # seq tells the chunks of all conversations apart
    whole = chunks.where("not open").withColumns({"start": F.lit(0).cast("long"), "n_turns": F.col("n")}).select(*columns)

    def render(batches):
        for batch in batches:
            text, loss = [], []
            for start, total, turns in zip(*(batch.column(c).to_pylist() for c in ("start", "n_turns", "turns"))):
                written, spans = template.render(turns, start, total)
                text.append(written)
                loss.append([{"start": a, "end": b} for a, b in spans])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns[:-1]), pa.array(text, pa.string()), pa.array(loss, span)], [*columns[:-1], "text", "loss"])

    return whole.unionByName(ready).mapInArrow(render, f"conv_id long, own boolean, seq long, start long, n long, n_turns long, text string, loss {SPANS}")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, own, seq, n, n_turns, turns binary, loss binary, loss_chars, formatted_chars) of each chunk: its turns as role, line feed, text, line feed, and its unescaped trained text."""

    def read(batches):
        for batch in batches:
            turns, loss, chars = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("loss").to_pylist()):
                found = list(read_turns(text))
                turns.append((len(found), "".join(f"{role}\n{said}\n" for role, said in found).encode()))
                trained = "".join(MARKS.unescape(text[s["start"] : s["end"]]) for s in spans)
                loss.append(trained.encode())
                chars.append((len(trained), len(text)))
            arrays = [pa.array([n for n, _ in turns], pa.int64()), batch.column("n_turns"), pa.array([t for _, t in turns], pa.binary()), pa.array(loss, pa.binary()), *(pa.array(c, pa.int64()) for c in zip(*chars))]
            if turns:
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("own"), batch.column("seq"), *arrays], names)

    names = ["conv_id", "own", "seq", "n", "n_turns", "turns", "loss", "loss_chars", "formatted_chars"]
    return formatted.mapInArrow(read, "conv_id long, own boolean, seq long, n long, n_turns long, turns binary, loss binary, loss_chars long, formatted_chars long")


def digests(chunks: DataFrame) -> DataFrame:
    """A row for each conversation of what read_back gives: its counts and the digests of its turns and trained text.

    A conversation of one chunk is digested where it lies. Chunks of longer ones pass through a task
    in order, as a digest has to; it holds the state of one digest and a chunk.
    """
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    single = chunks.where("n = n_turns").select("conv_id", F.col("n").alias("n_turns"), F.sha2("turns", 256).alias("turns_sha256"), "loss_chars", F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")

    def stream(batches):
        key, state = None, None

        def done():
            n, turns, chars, loss, size = state
            return pa.RecordBatch.from_pylist([dict(zip(columns, (key[0], n, turns.hexdigest(), chars, loss.hexdigest(), size)))], schema)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["conv_id"], row["own"]) != key:
                    if state:
                        yield done()
                    key, state = (row["conv_id"], row["own"]), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1].update(row["turns"])
                state[3].update(row["loss"])
                for i, c in ((0, "n"), (2, "loss_chars"), (4, "formatted_chars")):
                    state[i] += row[c]
        if state:
            yield done()

    schema = pa.schema([(c, pa.string() if c.endswith("sha256") else pa.int64()) for c in columns])
    several = chunks.where("n < n_turns").repartition("conv_id", "own").sortWithinPartitions("conv_id", "own", "seq")
    return single.unionByName(several.mapInArrow(stream, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))


def op11_chat_template(table: DataFrame) -> DataFrame:
    roles, text = ADDED
    return digests(read_back(format_conversations(table, added=[(-1, i, role, text) for i, role in enumerate(roles)])))


ORACLE = r"""
WITH t AS (SELECT conv_id, true AS own, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, false, 0, 'user', '</s>[INST] ok [/INST]'), (-1, false, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?(INST|ROLE)\]')) AS text_chars, length(role) + len(regexp_extract_all(role, '<\\*/?s>|\[\\*/?(INST|ROLE)\]')) AS role_chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 17 + role_chars END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id, own
"""
