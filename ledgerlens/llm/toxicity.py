"""Toxicity: noisy-channel deobfuscation, then a linear score of the restored words.

1. ``fit_letters``: a character trigram model, counted over every whole text of the corpus (at most 64**3 counts).
2. ``Channel.restore``: a suspicious token (letters with other characters, leet signs at its ends too, or a doubled
   letter; also a run of three or more single characters, punctuation beside them aside) becomes a lattice: letters
   stand for themselves, leetspeak characters for the letters that they resemble, separators may go, a repeated letter
   may go (at little cost where it is tripled or three letters of the token are repeated). Viterbi's best path under the
   trigram model and the channel's costs is the restored text.
3. A word's features are the word and its beginnings of four to seven letters. ``fit`` picks features by chi-squared and
   fits a logistic regression with counts as log(1 + n), on at most ``MAX_LABELLED`` labelled documents (those with the
   smallest hash of the id; rows of the held-out fold never).
4. ``score_toxicity`` scores every document; ``reject_toxic`` keeps the rows below the threshold, with all their columns.

Nulls: a null text is empty and gets the score of a text without features; null or repeated ids are scored row by row;
labels that are null are left out, of several labels for one id the largest counts. Without labelled rows of both kinds
all scores are 0. An empty table gives no rows. ``score_toxicity`` leaves other columns out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import ship, stored, texts
from ledgerlens.llm.memos import memo

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
MAX_LABELLED, FEATURES, LEAST_DOCS = 8000, 4096, 3
PREFIXES = (4, 5, 6, 7)
#: The model's letters (code = place + 1; all else is 0, a border) and what leetspeak characters may stand for.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßœš"
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = frozenset(".,-_*~'\"`^:;/\\ ")
SENTENCE = ".,;:?\"'`"  # no leet signs
STRIP = ".,;:!?\"'`()[]{}<>#$%&*|~^_-+=/\\"
LEET_COST, SEPARATOR_COST, REPEAT_COST, DOUBLE_COST, BORDER_COST = -1.0, -0.3, -0.7, -6.0, -8.0
_CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
_TWICE, _RUNS = re.compile(r"(.)\1"), re.compile(r"(.)\1*", re.DOTALL)
MEMO_WORDS = 500_000


def _letter_counts(batches: Iterator) -> Iterator:
    import pyarrow as pa

    from ledgerlens.llm.memos import forget

    forget()
    table = np.zeros(0x250, np.int64)
    for c, i in _CODE.items():
        table[ord(c)] = i
    total = np.zeros(64**3, np.int64)
    for b in batches:
        every = b.column("text").to_pylist()
        for at in range(0, len(every), 128):
            raw = np.frombuffer((" ".join(every[at : at + 128]).lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
            code = np.concatenate([[0, 0], table[np.where(raw < len(table), raw, 0)]])
            first = np.where(code[1:-1] == 0, 0, code[:-2])
            total += np.bincount((first * 64 + code[1:-1]) * 64 + code[2:], minlength=64**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])


def fit_letters(rows: DataFrame) -> np.ndarray:
    """Log probabilities [a, b, c] of a letter c after a and b, smoothed by pairs and single letters."""
    found = rows.select("text").mapInArrow(_letter_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    three = np.zeros(64**3)
    for gram, n in found:
        three[gram] = n
    three = three.reshape(64, 64, 64)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + 64)
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    return np.log((three + 5 * p2) / (three.sum(2, keepdims=True) + 5)).astype(np.float32)


class Channel:
    """Restores obfuscated tokens under a trigram model of letters."""

    def __init__(self, letters: np.ndarray):
        self.logs = letters.tolist()
        self.ways: dict[str, list[tuple[int, str, float]]] = {}

    def _ways(self, ch: str) -> list[tuple[int, str, float]]:
        """What a character may stand for: a letter by its code, a border (0), nothing (-1, it goes)."""
        if ch in _CODE:
            return [(_CODE[ch], ch, 0.0)]
        ways = [(0, " ", BORDER_COST)]
        if ch in SEPARATORS:
            ways.append((-1, "", SEPARATOR_COST))
        return ways + [(_CODE[x], x, LEET_COST) for x in LEET.get(ch, "")]

    def _drops(self, token: str) -> list[float]:
        """What it costs at each place that a repeated letter goes."""
        if not _TWICE.search(token):
            return [DOUBLE_COST] * len(token)
        runs = [x[0] for x in _RUNS.finditer(token)]
        least = 2 if sum(len(x) > 1 and x.isalpha() for x in runs) >= 3 else 3
        return [REPEAT_COST if len(x) >= least else DOUBLE_COST for x in runs for _ in x]

    def restore(self, token: str) -> str:
        """The best path through the token's lattice; borders come out as spaces."""
        logs, ways = self.logs, self.ways
        states: dict[tuple[int, int], tuple[float, int]] = {(0, 0): (0.0, -1)}  # by the last two letters: score, last node
        nodes: list[tuple[int, str]] = []
        for ch, twice in zip(token, self._drops(token), strict=True):
            if ch not in ways:
                ways[ch] = self._ways(ch)
            nxt: dict[tuple[int, int], tuple[float, int]] = {}
            for (a, b), (s, node) in states.items():
                for c, letter, cost in ways[ch]:
                    if c < 0:
                        if (a, b) not in nxt or s + cost > nxt[a, b][0]:
                            nxt[a, b] = (s + cost, node)
                        continue
                    state = (b, c) if c else (0, 0)
                    score = s + cost + (logs[a][b][c] if c or b else 0.0)
                    if state not in nxt or score > nxt[state][0]:
                        nodes.append((node, letter))
                        nxt[state] = (score, len(nodes) - 1)
                    if c == b and c and ((a, b) not in nxt or s + cost + twice > nxt[a, b][0]):
                        nxt[a, b] = (s + cost + twice, node)
            states = nxt
        _, node = max(((s + (logs[a][b][0] if b else 0.0), node) for (a, b), (s, node) in states.items()), default=(0.0, -1))
        out = []
        while node >= 0:
            node, letter = nodes[node]
            out.append(letter)
        return "".join(reversed(out))


def suspicious(core: str) -> bool:
    """Whether a token (without punctuation around it, but with leet signs) may hide a word."""
    if core.isalpha():
        return bool(_TWICE.search(core))
    return any(c.isalpha() for c in core)


def restored_words(token: str, channel: Channel) -> list[str]:
    """The words that a lower-case token stands for: itself, or its parts and what the channel restores."""
    core, signs = token.strip(STRIP), token.strip(SENTENCE)
    if not core:
        return []
    if not suspicious(signs):
        return [core] if core.isalpha() else []
    plain = [w for w in re.split(r"[^\w]+|[\d_]+", core) if w]
    return list(dict.fromkeys(plain + [w for x in dict.fromkeys((signs, core)) for w in channel.restore(x).split()]))


def _spaced(tokens: list[str]) -> Iterator[str]:
    """Runs of three or more tokens of one character each (punctuation beside it aside), joined by spaces."""
    start, tokens = None, [t if len(t) == 1 else t.strip(STRIP) or t for t in tokens]
    for i, t in enumerate([*tokens, "  "]):
        if len(t) == 1:
            start = i if start is None else start
        elif start is not None:
            if i - start >= 3:
                yield " ".join(tokens[start:i])
            start = None


def features_of(words: list[str]) -> list[str]:
    return [x for w in words for x in (w, *(f"^{w[:k]}" for k in PREFIXES if len(w) >= k))]


class Reader:
    """Counts the known features (or, without a list of them, all) of texts; tokens are memoised."""

    def __init__(self, letters: np.ndarray, known: dict[str, int] | None):
        self.channel, self.known, self.memo = Channel(letters), known, {}

    def _of(self, token: str) -> tuple | None:
        found = features_of(restored_words(token, self.channel))
        if self.known is not None:
            found = [self.known[x] for x in found if x in self.known]
        return tuple(found) or None

    def counts(self, text: str) -> dict:
        tokens, known, out = text.lower().split(), self.memo, {}
        try:
            hits = list(filter(None, map(known.__getitem__, tokens)))
        except KeyError:
            new = {t: self._of(t) for t in set(tokens) if t not in known}
            full = len(known) + len(new) > MEMO_WORDS
            known.update(new)
            hits = list(filter(None, map(known.__getitem__, tokens)))
            if full:
                for t in new:
                    del known[t]
        hits += filter(None, map(self._of, _spaced(tokens)))
        for found in hits:
            for x in found:
                out[x] = out.get(x, 0) + 1
        return out


def _reader(shared) -> Reader:
    """This worker's reader for a broadcast model."""
    return memo("toxicity", shared.value["key"], lambda: Reader(shared.value["letters"], shared.value["known"]))


def _all_features(shared):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        read = _reader(shared)
        for b in batches:
            for at in range(0, b.num_rows, 32):
                part = b.slice(at, 32)
                rows = [(i, y, x) for i, y, t in zip(part.column("row").to_pylist(), part.column("y").to_pylist(), part.column("text").to_pylist()) for x in read.counts(t)]
                cols = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["row", "y", "feature"])

    return run


def _known_features(shared):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        read = _reader(shared)
        for b in batches:
            found = [read.counts(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([list(x) for x in found], pa.list_(pa.int32())), pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))], names=["y", "features", "counts"])

    return run


def logistic(rows: list[tuple[int, list[int], list[float]]], width: int, *, l2: float = 0.3, steps: int = 400) -> tuple[np.ndarray, float]:
    """A ridge-penalised logistic regression by accelerated gradient steps on sparse rows (label, features, values)."""
    y = np.array([r[0] for r in rows], float)
    at = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    col, val = np.array([x for r in rows for x in r[1]], np.int64), np.array([x for r in rows for x in r[2]], float)
    w, b = np.zeros(width), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    size = np.bincount(at, weights=val**2, minlength=len(rows)).max(initial=1) + 1
    rate, (vw, vb), (lw, lb) = 4.0 / (size * max(1, 0.02 * len(rows))), (w, b), (w, b)
    for t in range(steps):
        z = np.bincount(at, weights=vw[col] * val, minlength=len(y)) + vb
        g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        w, b = vw - rate * (np.bincount(col, weights=g[at] * val, minlength=width) + l2 * vw), vb - rate * g.sum()
        vw, vb = w + t / (t + 3) * (w - lw), b + t / (t + 3) * (b - lb)
        lw, lb = w, b
    return w, b


def fit(rows: DataFrame, labels: DataFrame, letters: np.ndarray, *, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, max_labelled: int = MAX_LABELLED, features: int = FEATURES) -> tuple[dict[str, int], np.ndarray, float]:
    """Features with their numbers, weights and the bias, from labelled rows outside the held-out fold."""
    spark = rows.sparkSession
    chosen = (
        labels.where(F.col(label).isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % folds != held_out))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id")
        .limit(max_labelled)
    )
    sample = stored(rows.join(F.broadcast(stored(chosen, "labels")), "doc_id").withColumn("row", F.monotonically_increasing_id()).repartition(24, "row"), "sample")
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < positive < n:
        return {}, np.zeros(0), -math.inf
    shared = spark.sparkContext.broadcast({"letters": letters, "known": None, "key": _next_key()})
    found = sample.mapInArrow(_all_features(shared), "row long, y int, feature string")
    a, m = F.col("a").cast("double"), F.col("m").cast("double")
    gap = a * n - m * positive
    chi2 = gap * gap * n / (m * (n - m) * positive * (n - positive) + 1e-9)
    best = found.groupBy("feature").agg(F.sum("y").alias("a"), F.count("*").alias("m")).where(F.col("m") >= LEAST_DOCS).orderBy(chi2.desc(), "feature").limit(features).select("feature").collect()
    known = {r.feature: i for i, r in enumerate(best)}
    shared = spark.sparkContext.broadcast({"letters": letters, "known": known, "key": _next_key()})
    data = [(y, f, np.log1p(c).tolist()) for y, f, c in sample.orderBy("row").mapInArrow(_known_features(shared), "y int, features array<int>, counts array<int>").collect()]
    return known, *logistic(data, len(known))


def _next_key() -> str:
    import uuid

    return uuid.uuid4().hex


def scorer(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, max_labelled: int = MAX_LABELLED) -> Callable[[Column], Column]:
    """Fit the letters' model and the classifier on ``docs``; gives a function from a text column to its score."""
    spark = docs.sparkSession
    ship(spark)
    rows = texts(docs, id_col, text_col)
    letters = fit_letters(rows)
    known, weights, bias = fit(rows, labels, letters, label=label, folds=folds, held_out=held_out, max_labelled=max_labelled)
    shared = spark.sparkContext.broadcast({"letters": letters, "known": known, "weights": weights.tolist(), "bias": bias, "key": _next_key()})

    @F.pandas_udf("double")
    def score(some: pd.Series) -> pd.Series:
        read, w, b = _reader(shared), shared.value["weights"], shared.value["bias"]
        z = (b + sum(w[i] * math.log1p(n) for i, n in read.counts(t).items()) for t in some)
        return pd.Series([1 / (1 + math.exp(-max(min(x, 40.0), -40.0))) if x > -math.inf else 0.0 for x in z], dtype=float)

    return lambda text: score(F.coalesce(text, F.lit("")))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, score`` of every row of ``docs``."""
    score = scorer(docs, labels, id_col=id_col, text_col=text_col, **options)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), score(F.col(text_col)).alias("score"))


def reject_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, unchanged, whose score is below the threshold."""
    return docs.where(scorer(docs, labels, text_col=text_col, **options)(F.col(text_col)) < threshold)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents; ``held_out`` marks the fold that training never saw."""
    scored = score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
