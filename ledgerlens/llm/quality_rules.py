"""Quality rules: a threshold table compiled into one projection of length, symbol, stop-word and line ratios.

``measures`` adds the counts of a text, ``RULES`` is the threshold table (measure, least, most, fewest words that the
rule needs), ``compile_rules`` turns the table into one struct of verdicts. Everything is DataFrame functions on the
text's own row: no shuffle, no user functions.

Repeated words: the windows of five words are hashed to 64 bits and, only where a text has equal windows, sorted with
their positions; a word counts if a window that is found twice or more covers it. The work grows as n log n.

Nulls: a null text has no words and all counts are 0; it fails the base rule (fewer than ten words). Null ids, repeated
rows and empty tables pass through row by row; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import texts

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEATED_PERCENT = 5, 10, 20
#: Common words of the four languages.
STOP_WORDS = (
    "the of and to in a is that it for was on are as with be by this from or an at he his not have but they which you "
    "le la les de des du et en un une que qui dans pour est par sur avec au il pas plus "
    "der die das und den von zu mit sich ist im dem nicht ein eine als auch es an auf für "
    "el los las y del se con una su lo como más o si no al"
).split()
#: (measure, least, most, fewest words for the rule to hold).
RULES: tuple[tuple[str, float | None, float | None, int], ...] = (
    ("chars_per_word", 2.0, 20.0, 0),
    ("symbols_per_word", None, 0.2, 0),
    ("stop_word_share", 0.02, None, 100),
    ("repeated_line_share", None, 0.5, 0),
    ("words_per_line", 1.5, None, 100),
)


def ratio_columns() -> dict[str, Column]:
    """The ratios that the rules may name, from the counts; 0 where there is nothing to divide by."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "chars_per_word": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "stop_word_share": share("n_stop_words", "n_words"),
        "repeated_line_share": share("n_dup_lines", "n_lines"),
        "words_per_line": share("n_words", "n_lines"),
    }


def compile_rules(rules: Sequence[tuple[str, float | None, float | None, int]] = RULES) -> Column:
    """One struct with a boolean per rule: whether a text keeps to it."""
    ratios = ratio_columns()
    out = []
    for name, least, most, fewest in rules:
        ok = F.lit(True)
        if least is not None:
            ok &= ratios[name] >= least
        if most is not None:
            ok &= ratios[name] <= most
        out.append(((F.col("n_words") < fewest) | ok).alias(name))
    return F.struct(*out)


def measures(df: DataFrame) -> DataFrame:
    """``df`` (with a ``text`` column, not null) with its counts; ``text`` is dropped, columns named like the counts are replaced."""
    size = lambda a: F.size(a).cast("long")
    a = df.withColumn("__words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).withColumn("__lines", F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACE, "") != ""))
    windows = F.when(F.size("__words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("__words") - WINDOW + 1), lambda i: F.xxhash64(*(F.get(F.col("__words"), i + k - 1) for k in range(WINDOW)))))
    b = a.withColumn("__windows", F.coalesce(windows, F.array().cast("array<long>")))
    placed = F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    c = b.withColumn("__placed", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), placed))
    near = lambda k: F.get(F.col("__placed"), k)["h"]
    found = F.filter("__placed", lambda x, k: F.coalesce(near(k - 1) == x["h"], F.lit(False)) | F.coalesce(near(k + 1) == x["h"], F.lit(False)))
    d = c.withColumn("__at", F.array_sort(F.transform(found, lambda x: x["i"])))
    covered = F.aggregate(F.transform("__at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__at"), k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x)
    plain = lambda chars: F.length(F.translate("text", chars, ""))
    counts = {
        "n_words": size("__words"),
        "word_chars": plain(SPACE).cast("long"),
        "n_symbols": (F.length("text") - plain(SYMBOLS)).cast("long"),
        "n_lines": size("__lines"),
        "n_dup_lines": size("__lines") - size(F.array_distinct("__lines")),
        "n_stop_words": size(F.filter("__words", lambda w: F.lower(w).isin(*STOP_WORDS))),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }
    helpers = {"text", "__words", "__lines", "__windows", "__placed", "__at"}
    return d.select(*(c for c in df.columns if c not in helpers | set(counts)), *(c.alias(n) for n, c in counts.items()))


def judge_quality(docs: DataFrame, *, rules: Sequence[tuple[str, float | None, float | None, int]] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ``base_failed``, a boolean per rule (``rules``) and ``kept`` of every row."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    judged = measures(texts(docs, id_col, text_col)).withColumns({"base_failed": base, "rules": compile_rules(rules)})
    kept = ~F.col("base_failed")
    for name, *_ in rules:
        kept &= F.col(f"rules.{name}")
    return judged.withColumn("kept", kept)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge all documents."""
    return judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _rule_sql() -> str:
    ratio = {
        "chars_per_word": ("word_chars", "n_words"),
        "symbols_per_word": ("n_symbols", "n_words"),
        "stop_word_share": ("n_stop_words", "n_words"),
        "repeated_line_share": ("n_dup_lines", "n_lines"),
        "words_per_line": ("n_words", "n_lines"),
    }
    out = []
    for name, least, most, fewest in RULES:
        a, b = ratio[name]
        r = f"(CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0 END)"
        out.append(f"(n_words < {fewest} OR (" + " AND ".join([f"{r} >= {least}"] * (least is not None) + [f"{r} <= {most}"] * (most is not None)) + "))")
    return " AND ".join(out)


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), win AS (
  SELECT rid, i, list_slice(words, i, i + 4) AS win FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM win) WHERE c >= 2
), cov AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_filter(words, lambda x: lower(x) IN ({_STOP_SQL}))) AS BIGINT) AS n_stop_words,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)
), b AS (
  SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {_rule_sql()}) AS kept FROM b
"""
