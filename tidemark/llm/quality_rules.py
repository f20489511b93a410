"""Line-first quality rules in DataFrame functions only.

Each line with a word is judged by punctuation, navigation and boilerplate rules; failing lines go,
and a document goes too if it fails the base rules (too short, or mostly repeated word windows) or
if the lines that went hold too much of its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Per cent of the characters of a document's lines that may go before the document does.
MAX_LOST_PERCENT = 30
#: Per cent of a line's characters that may be markup symbols, or stand in runs of ! and ?.
MAX_SYMBOL_PERCENT = 5
SYMBOLS = "#*$%&|<>"
#: Characters from which a line is prose that mentions boilerplate words, and not boilerplate.
BOILERPLATE_CHARS = 300
#: How a line of prose ends, and what marks menus and boilerplate.
TERMINAL = r"[.!?;:,…。！？][\"'»“”’)\]]*[\x20\x09-\x0D]*$"
NAVIGATION = r"(?:[|»›>•·][^|»›>•·]{0,40}){3,}"
BOILERPLATE = (
    r"(?i)\b(?:all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|accept (?:all )?cookies|uses cookies|"
    r"subscribe to our|sign up for our|newsletter|click here|read more|share this|follow us|skip to (?:main )?content|"
    r"enable javascript|lorem ipsum|log ?in|sign in)\b"
)


def _array_sum(column: Column) -> Column:
    return F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + x)


def _count_of(text: Column, characters: str) -> Column:
    """How many of the text's characters are among these; most texts have none, and one search tells."""
    found = "[" + "".join("\\" + c for c in characters) + "]"
    return F.when(text.rlike(found), F.length(text) - F.length(F.translate(text, characters, ""))).otherwise(0).cast("long")


def line_passes(line: Column) -> Column:
    """True for a line of prose: ends as one, is no menu or boilerplate, and holds little markup."""
    size = F.length(line)
    marks = _count_of(line, "#*$%&|<>{}=\\~^")
    shouts = F.when(line.rlike("[!?]{2}"), size - F.length(F.regexp_replace(line, r"[!?]{2,}", ""))).otherwise(0)
    return (
        line.rlike(TERMINAL)
        & (100 * marks <= MAX_SYMBOL_PERCENT * size)
        & (100 * shouts <= MAX_SYMBOL_PERCENT * size)
        & ~line.rlike(NAVIGATION)
        & ~((size < BOILERPLATE_CHARS) & line.rlike(BOILERPLATE))
    )


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with one struct column `quality` added: the base counts, the verdict and the cleaned text.

    quality has n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars (long),
    base_failed, kept (boolean) and clean_text. Null and wordless texts count as no words and fail.
    Everything is computed within the row, so hot sources, copies and repeated rows change
    nothing, and any other columns pass through (one named `quality` is replaced; helper columns
    start with `__q`). An empty table gives none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.drop("quality").withColumns({"__qt": text, "__qw": words, "__ql": lines})
    w = F.col("__qw")
    windows = F.when(
        F.size(w) >= 3,
        F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0))),
    )
    d = d.withColumns({"__qh": windows, "__qk": F.filter("__ql", line_passes)}).withColumn("__qn", F.size("__qw"))
    repeated = F.size(F.array_distinct("__qh")) < F.size("__qh")
    d = d.withColumn("__qs", F.when(repeated, F.sort_array(F.transform("__qh", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("__qs")
    again = F.filter(s, lambda x, k: F.coalesce(x.h == F.get(s, k + 1).h, F.lit(False)) | (k > 0) & F.coalesce(x.h == F.get(s, F.greatest(k - 1, F.lit(0))).h, F.lit(False)))
    d = d.withColumn("__qp", F.sort_array(F.transform(again, lambda x: x.i)))
    p = F.col("__qp")
    covered = F.coalesce(_array_sum(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))).cast("long"))), F.lit(0).cast("long"))
    d = d.withColumns({"__qr": covered, "__qc": _array_sum(F.transform("__ql", lambda x: F.length(x).cast("long"))), "__qg": _array_sum(F.transform("__qk", lambda x: F.length(x).cast("long"))), "__qz": F.monotonically_increasing_id()})
    n, r, t = F.col("__qn").cast("long"), F.col("__qr"), F.col("__qt")
    failed = (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)
    lost = F.col("__qc") - F.col("__qg")
    # A filter on the verdict must not be pushed below the steps above, where it would repeat them
    # for every array element; a column that isn't deterministic, here always >= 0, holds it back.
    once = F.col("__qz") >= 0
    quality = F.struct(
        n.alias("n_words"),
        F.length(F.array_join("__qw", "")).cast("long").alias("word_chars"),
        _count_of(t, SYMBOLS).alias("n_symbols"),
        (F.size("__ql") - F.size(F.array_distinct("__ql"))).cast("long").alias("n_dup_lines"),
        r.alias("n_repeat_words"),
        lost.alias("lost_chars"),
        failed.alias("base_failed"),
        (once & ~failed & (100 * lost <= MAX_LOST_PERCENT * F.col("__qc"))).alias("kept"),
        F.array_join("__qk", "\n").alias("clean_text"),
    )
    return d.withColumn("quality", quality).drop("__qt", "__qw", "__ql", "__qh", "__qk", "__qn", "__qs", "__qp", "__qr", "__qc", "__qg", "__qz")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base counts and verdict of every row."""
    return judge(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select(
        F.col("id").alias(id_col), *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"))
    )


def keep_clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their cleaned text and its n_chars; other columns as they were, whatever their names."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    kept = judge(docs.select(row, "text")).where("quality.kept")
    new = {"text": F.col("quality.clean_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("quality.clean_text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


#: The same as DuckDB SQL.
ORACLE = rf"""
WITH d AS (SELECT rowid_ AS k, doc_id, coalesce(text, '') AS t FROM (SELECT row_number() OVER () AS rowid_, doc_id, text FROM documents)),
w AS (SELECT k, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x : x <> '') AS w,
      list_filter(string_split(t, chr(10)), lambda x : length(translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) AS l FROM d),
g AS (SELECT k, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w)),
p AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM g) WHERE n > 1),
r AS (SELECT k, CAST(sum(least(3, coalesce(nxt - i, 3))) AS BIGINT) AS n FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM p) GROUP BY k),
ln AS (SELECT k, CAST(coalesce(sum(length(x)), 0) AS BIGINT) AS all_chars, CAST(coalesce(sum(length(x)) FILTER (
        NOT (regexp_matches(x, '[.!?;:,\x{{2026}}\x{{3002}}\x{{FF01}}\x{{FF1F}}]["''\x{{00BB}}\x{{201C}}\x{{201D}}\x{{2019}})\]]*[\x20\x09-\x0D]*$')
        AND 100 * (length(x) - length(translate(x, '#*$%&|<>{{}}=\~^', ''))) <= {MAX_SYMBOL_PERCENT} * length(x)
        AND 100 * (length(x) - length(regexp_replace(x, '[!?]{{2,}}', '', 'g'))) <= {MAX_SYMBOL_PERCENT} * length(x)
        AND NOT regexp_matches(x, '(?:[|\x{{00BB}}\x{{203A}}>\x{{2022}}\x{{00B7}}][^|\x{{00BB}}\x{{203A}}>\x{{2022}}\x{{00B7}}]{{0,40}}){{3,}}')
        AND NOT (length(x) < {BOILERPLATE_CHARS} AND regexp_matches(x, '{BOILERPLATE}')))), 0) AS BIGINT) AS lost
      FROM (SELECT k, unnest(l) AS x FROM w) GROUP BY k),
f AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
      coalesce(r.n, 0) AS n_repeat_words, coalesce(ln.lost, 0) AS lost_chars, coalesce(ln.all_chars, 0) AS all_chars
      FROM w LEFT JOIN r USING (k) LEFT JOIN ln USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * lost_chars <= {MAX_LOST_PERCENT} * all_chars AS kept, lost_chars
FROM f
"""


def op2_line_quality(spark, sf_dir):
    return verdicts(read(spark, sf_dir, "documents"))
