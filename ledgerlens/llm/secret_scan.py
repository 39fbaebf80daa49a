"""Secret scan: three patterns and a battery of randomness tests, all in DataFrame functions.

Base kinds, leftmost and non-overlapping each: ``assign`` (a key word, a separator and a value of 8 or more characters),
``access`` and ``hex``. A match never spans a line break or depends on what stands before it, so positions follow from
splitting the text at the matches: the start of a match is the length of all pieces and matches before it.

``random`` spans come from the battery. A candidate is a run of 20 or more key characters outside the base spans for
which an encoding is inferred (the smallest that holds it): ``hex`` (16 symbols), ``base32`` (32), ``base36`` (36) or
``base64`` (64; letters of both cases, with or without digits); numbers and single-case letters have none. The tested hypothesis is *ordinary text*:

* chi-squared of the symbol counts against the uniform alphabet. For ordinary text it is non-central, with n times the
  excess of its chance of equal symbols; too small a value speaks for a secret, the more so the longer the string is;
* runs of character classes (capitals, small letters, digits, others): ordinary names change their class rarely;
* serial correlation of neighbouring symbols: must look uncorrelated (|r| * sqrt(n) at most ``MAX_SERIAL``), else the
  string is a sequence or a repetition and isn't reported.

The first two are joined by Stouffer's sum to one p value. Each text is one family: its candidates are accepted by the
Benjamini-Hochberg step-up at ``FDR``, weighted by length (weights with a mean of 1), so long strings, for which the
tests have power, get the larger share of the error budget. One text's verdicts don't depend on other texts.

Nulls: a null text is empty and has no spans. Null or repeated ids are scanned row by row; an empty table gives no
rows. Time grows in proportion to a text's length and its spans: no text is too long for the battery or the mask. ``scan`` replaces columns named like those that it adds; ``redact`` keeps all columns but for the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import texts

#: The kinds in their order and their patterns (dropping what is too short is done after matching).
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Whether a text has a candidate that an alphabet may hold: with a digit or letters of both cases.
MIXED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{20})(?:[a-z+/_-]*+[A-Z0-9]|[A-Z+/_-]*+[a-z0-9])"
SYMBOLS = {16: "0123456789abcdef", 32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 36: "abcdefghijklmnopqrstuvwxyz0123456789", 64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: Ordinary text: its chance that two symbols are equal, and that neighbours differ in class.
EQUAL_CHANCE = {16: 0.125, 32: 0.072, 36: 0.066, 64: 0.06}
CHANGE_CHANCE = {16: 0.15, 32: 0.15, 36: 0.15, 64: 0.33}
FDR, MAX_SERIAL = 1e-3, 2.6
MASK = "[SECRET]"
_BLOCK, _PART = 64, 1024
_FOUND = "array<struct<start:int,kind:int,end:int,m:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside another lambda a plain expression would be computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold(a: Column, join: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(a, F.lit(0), join)


def before_each(a: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each element of an int array the elements before it joined from 0 (sums, maxima), by blocks: no quadratic pass."""
    at = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    block = lambda j: F.floor(j / _BLOCK).cast("int")
    blocks = lambda x: F.transform(at(F.ceil(F.size(x) / _BLOCK).cast("int")), lambda b: _fold(F.slice(x, b * _BLOCK + 1, _BLOCK), join))
    carried = lambda t: F.transform(t, lambda _, b: _fold(F.slice(t, F.lit(1), b), join))
    each = lambda x, c: F.transform(x, lambda _, j: join(F.get(c, block(j)), _fold(F.slice(x, block(j) * _BLOCK + 1, j % _BLOCK), join)))
    return let(a, lambda x: let(let(blocks(x), carried), lambda c: each(x, c)))


def _located(text: Column, pattern: str, kind: int) -> Column:
    """The matches of a pattern with their positions (code points, end exclusive); empty, and cheap, where there are none."""
    parts = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    pairs = lambda x: F.zip_with(F.slice(x["p"], F.lit(1), F.size(x["m"])), x["m"], lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("n"), m.alias("m")))
    starts = lambda y: before_each(F.transform(y, lambda e: e["p"] + e["n"]), lambda s, e: s + e)
    span = lambda s, e: F.struct((s + e["p"]).alias("start"), F.lit(kind).alias("kind"), (s + e["p"] + e["n"]).alias("end"), e["m"].alias("m"))
    found = let(let(parts, pairs), lambda y: F.zip_with(starts(y), y, span))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_FOUND))


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def outside(candidates: Column, spans: Column) -> Column:
    """The candidates that overlap no span, both sorted: one pass over all in order, with the furthest end before each and the next start after it."""
    far = 1 << 30
    of_span = lambda x, value: F.when(x["kind"] < KINDS.index("random"), value).otherwise(F.lit(0))
    bare = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["m"].alias("m")))
    every = F.array_sort(F.concat(bare(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit("").alias("m")))), bare(candidates)))
    most = lambda a: before_each(a, lambda m, e: F.greatest(m, e))
    ends = lambda a: most(F.transform(a, lambda x: of_span(x, x["end"])))
    starts = lambda a: F.reverse(most(F.reverse(F.transform(a, lambda x: of_span(x, far - x["start"])))))
    clear = lambda a: F.zip_with(a, F.arrays_zip(ends(a).alias("before"), starts(a).alias("after")), lambda x, y: F.when((x["kind"] == KINDS.index("random")) & (y["before"] <= x["start"]) & (far - y["after"] >= x["end"]), x))
    return F.when((F.size(spans) == 0) | (F.size(candidates) == 0), bare(candidates)).otherwise(let(every, lambda a: F.filter(clear(a), lambda x: x.isNotNull())))


def tail_probability(z: Column) -> Column:
    """The upper tail of the normal distribution, by a continued fraction; 0.5 below 1.5, where no test is decided."""
    fraction = z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 5))))
    return F.when(z < 1.5, 0.5).otherwise(F.exp(-z * z / 2) / (2.5066282746310002 * fraction))


def _tested(found: Column) -> Column:
    """A candidate's battery: n, the inferred alphabet's size (0: none) and the p value."""
    body = F.rtrim(found["m"], F.lit("="))
    same = F.translate(body, "-_", "+/")
    k = (
        F.when(body.rlike("^[0-9a-f]+$") & body.rlike("[a-f]") & body.rlike("[0-9]"), 16)
        .when(body.rlike("^[0-9A-F]+$") & body.rlike("[A-F]") & body.rlike("[0-9]"), 16)
        .when(body.rlike("^[A-Z2-7]+$") & body.rlike("[A-Z]") & body.rlike("[2-7]"), 32)
        .when(body.rlike("^[a-z0-9]+$") & body.rlike("[a-z]") & body.rlike("[0-9]"), 36)
        .when(body.rlike("^[A-Z0-9]+$") & body.rlike("[A-Z]") & body.rlike("[0-9]"), 36)
        .when(body.rlike("[a-z]") & body.rlike("[A-Z]"), 64)
        .otherwise(0)
    )
    return F.struct(found["start"].alias("start"), found["end"].alias("end"), k.alias("k"), same.alias("s"))


def _measured(c: Column) -> Column:
    """Chi-squared, runs and serial correlation of one candidate with an inferred alphabet."""
    n, k = F.length(c["s"]).cast("double"), c["k"].cast("double")
    pick = lambda table: F.when(c["k"] == 16, F.lit(table[16])).when(c["k"] == 32, F.lit(table[32])).when(c["k"] == 36, F.lit(table[36])).otherwise(F.lit(table[64]))
    text = F.when(c["k"].isin(16, 36), F.lower(c["s"])).otherwise(c["s"])
    squares = F.aggregate(F.split(pick(SYMBOLS), ""), F.lit(0.0), lambda s, x: s + F.when(x == "", 0.0).otherwise(F.pow(F.length(text) - F.length(F.replace(text, x, F.lit(""))), 2.0)))
    chi2, excess = k / n * squares - n, k * pick(EQUAL_CHANCE) - 1
    z_chi = (k - 1 + n * excess - chi2) / F.sqrt(2 * (k - 1) + 4 * n * excess)
    classes = F.translate(c["s"], SYMBOLS[64], "A" * 26 + "a" * 26 + "0" * 10 + "++")
    changes = F.length(F.regexp_replace(classes, r"(.)(?=\1)", "")) - 1
    change = pick(CHANGE_CHANCE)
    z_runs = (changes - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change))
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda t, e: t + e)
    codes = F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x: F.instr(pick(SYMBOLS), x).cast("double"))
    off = let(codes, lambda x: let(add(x) / F.size(x), lambda mean: F.transform(x, lambda e: e - mean)))
    lag = lambda x: add(F.zip_with(x, F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: a * F.coalesce(b, F.lit(0.0))))
    serial = let(off, lambda x: let(add(F.transform(x, lambda e: e * e)), lambda power: F.when(power > 0, F.abs(lag(x) / power + 1 / F.size(x)) * F.sqrt(F.size(x))).otherwise(F.lit(99.0))))
    p = F.when(serial <= MAX_SERIAL, tail_probability((z_chi + z_runs) / 1.4142135623730951)).otherwise(F.lit(1.0))
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), n.alias("n"), p.alias("p"))


def scan(docs: DataFrame, *, text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of (start, kind as its place in ``KINDS``, end), by start and kind."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    temp = {x: f"__secret_{x}" for x in ("assign", "found", "measured", "m", "cut")}
    assign = F.filter(_located(t, ASSIGN, 0), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= ASSIGN_LEAST)
    a = docs.withColumn("base_spans", F.array_sort(F.concat(_bare(assign), _bare(_located(t, ACCESS, 1)), _bare(_located(t, HEX, 2)))))
    likely = F.when(t.rlike(MIXED), _located(t, CANDIDATE, 3)).otherwise(F.array().cast(_FOUND))
    mixed = F.filter(likely, lambda x: x["m"].rlike("[A-Za-z]"))
    found = let(mixed, lambda c: F.filter(F.transform(outside(c, F.col("base_spans")), _tested), lambda x: x["k"] > 0))
    b = a.withColumn(temp["found"], found)
    c = b.withColumn(temp["measured"], F.transform(temp["found"], _measured)).withColumn(temp["m"], F.size(temp["found"]))
    total = F.aggregate(temp["measured"], F.lit(0.0), lambda t, x: t + x["n"])
    weigh = lambda x, t: x["p"] * t / (x["n"] * F.size(temp["found"]))
    weighted = let(total, lambda t: F.transform(temp["measured"], lambda x: weigh(x, t)))
    ordered = F.array_sort(weighted)
    cut = F.coalesce(F.array_max(F.filter(F.transform(ordered, lambda q, i: F.when(q * F.col(temp["m"]) <= fdr * (i + 1), q)), lambda q: q.isNotNull())), F.lit(-1.0))
    d = c.withColumn(temp["cut"], F.when(F.col(temp["m"]) > 0, cut).otherwise(F.lit(-1.0)))
    accepted = let(total, lambda t: F.filter(temp["measured"], lambda x: weigh(x, t) <= F.col(temp["cut"])))
    more = F.transform(accepted, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    spans = F.when(F.col(temp["cut"]) >= 0, F.array_sort(F.concat("base_spans", more))).otherwise(F.col("base_spans"))
    return d.withColumn("spans", spans).drop(*temp.values())


def redact(docs: DataFrame, *, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with every span of its text replaced by ``mask`` (overlapping spans by one); a null text stays null."""
    row = "__secret_row"
    bare = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), F.col(text_col).alias("text"))
    ends = lambda spans: F.transform(spans, lambda x: x["end"])
    a = scan(bare)
    # Parts of _PART characters first: taking a substring costs its distance from the string's start.
    parts, block = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_PART}}}"), F.lit(0)), lambda n: F.floor(n / _PART).cast("int")

    def between(c: Column, start: Column, end: Column) -> Column:
        first, last = block(start), block(end - 1)
        across = F.concat(F.substring(F.get(c, first), start % _PART + 1, F.lit(_PART)), F.array_join(F.slice(c, first + 2, last - first - 1), ""), F.substring(F.get(c, last), F.lit(1), (end - 1) % _PART + 1))
        return F.when(start >= end, "").when(first == last, F.substring(F.get(c, first), start % _PART + 1, end - start)).otherwise(across)

    piece = lambda c, x, last: F.when(x["start"] >= last, F.concat(between(c, last, x["start"]), F.lit(mask))).otherwise(F.lit(""))
    lasts = before_each(ends(F.col("spans")), lambda m, e: F.greatest(m, e))
    pieces = lambda c: F.array_join(F.zip_with("spans", lasts, lambda x, last: piece(c, x, last)), "")
    masked = let(parts, lambda c: F.concat(pieces(c), between(c, F.array_max(ends(F.col("spans"))), F.length("text"))))
    text = F.when(F.size("spans") > 0, masked).otherwise(F.col("text"))
    return a.select(*(text.alias(c) if c == text_col else F.col(row)[c].alias(c) for c in docs.columns))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan all documents."""
    found = scan(texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
