"""Quality classifier: attention-based multiple-instance learning (documents are bags of passages).

``passages`` cuts each whole text at line ends and every ``PASSAGE_BYTES`` bytes of a line and describes every passage by
numbers: shares of character classes, word counts and lengths, repetition inside it and of it, and its words, their first
four and their last three bytes, hashed with signs into ``HASHED`` columns. The network encodes each passage (one tanh
layer), weighs it by gated attention (softmax over a document of w.(tanh(V h) * sigmoid(U h))) and scores the weighted sum;
all weights are learned together, from document labels only, by Adam on the driver, on at most ``max_labelled`` labelled
documents (those with the smallest hash of the id, whatever their length; rows of the held-out fold never), of each at most
``training_passages`` passages, drawn evenly from its whole text. Every passage of every document is scored; a passage's
numbers depend on its own text only, so scores don't depend on how rows are dealt. Working memory beside a text's bytes and
words is about a kilobyte per passage.

Nulls: a null text is empty; a text without words is one passage of zeros and so gets a score, too. Null or repeated ids
are scored row by row; null labels are left out, of several labels for one id the largest counts. Without labelled rows
of both kinds all scores are 0.5. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import ship, stored, texts

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
MAX_LABELLED, TRAINING_PASSAGES, PASSAGE_BYTES, PART_BYTES = 6000, 64, 600, 1 << 19
HIDDEN, ATTENTION, HASHED = 16, 8, 256
#: Character classes by byte: each string's characters are one class; letters of other scripts are one by their high bytes.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", ".,", "!", "?;:", "#", "*", "$", "%", "&", "|", "<>", "\"'`", "()[]{}", "-_/\\+=~^@")
_CLASS = np.full(256, len(CLASSES) + 1, np.int64)
for _i, _chars in enumerate(CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _i
_CLASS[10] = 3
_CLASS[128:] = len(CLASSES)
WIDTH = len(CLASSES) + 2 + 6 + HASHED


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int, last: bool) -> np.ndarray:
    """Each word's first (or last) n bytes as one number, shorter words whole."""
    out = np.full(len(starts), n + (8 if last else 0), np.uint64)
    for k in range(n):
        at = ends - 1 - k if last else starts + k
        inside = (at >= starts) & (at < ends)
        out = out * np.uint64(257) + np.where(inside, data[np.clip(at, 0, len(data) - 1)], 256).astype(np.uint64)
    return out


def passages(some: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The passages' numbers (one row each) and how many passages each text has."""
    from ledgerlens.llm.shingles import mix, words_of

    data, offsets, starts, ends, words = words_of(some)
    cased = np.frombuffer(b"\n".join(t.encode("utf-8", "surrogatepass") for t in some) + b"\n", np.uint8)
    lines = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
    of_line = -(-np.diff(lines) // PASSAGE_BYTES)
    at = np.repeat(lines[:-1], of_line) + PASSAGE_BYTES * (np.arange(of_line.sum()) - np.repeat(np.cumsum(of_line) - of_line, of_line))
    bounds, n = np.concatenate([at, [len(data)]]), len(at)
    text_of = np.searchsorted(offsets, at, "right") - 1
    word_at = np.searchsorted(starts, bounds)
    n_words = np.diff(word_at)
    prints, x, k, i = np.zeros(n, np.uint64), np.zeros((n, WIDTH), np.float32), len(CLASSES) + 2, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + PART_BYTES, "right")) - 1)
        own, size, p = n_words[i:j], np.diff(bounds[i : j + 1]), j - i
        counts = np.bincount(np.repeat(np.arange(p), size) * k + _CLASS[cased[bounds[i] : bounds[j]]], minlength=p * k).reshape(p, k)
        part = slice(word_at[i], word_at[j])
        w, of = words[part], np.repeat(np.arange(p), own)
        before = np.concatenate([np.zeros(1, np.uint64), w])[:-1]
        before[np.cumsum(own)[:-1][own[1:] > 0]] = 0  # a passage's first word has none before it
        again = w == before
        _, first = np.unique(w ^ mix(of.astype(np.uint64)), return_index=True)
        filled = np.flatnonzero(own)
        prints[i + filled] = np.add.reduceat(mix(w * np.uint64(3) + before), (np.cumsum(own) - own)[filled]) if len(filled) else 0
        m = np.maximum(own, 1)
        more = (np.log1p(own) / 5, np.bincount(of, weights=ends[part] - starts[part], minlength=p) / m / 10, np.bincount(of, weights=again, minlength=p) / m, 1 - np.bincount(of[first], minlength=p) / m, np.zeros(p), np.log1p(size) / 7)
        hashed = np.zeros(p * HASHED)
        for grams in (w, _grams(data, starts[part], ends[part], 4, False), _grams(data, starts[part], ends[part], 3, True)):
            h = mix(grams)
            hashed += np.bincount(of * HASHED + (h >> np.uint64(56)).astype(np.int64) % HASHED, weights=(h & np.uint64(1)).astype(float) * 2 - 1, minlength=p * HASHED)
        x[i:j, :k], x[i:j, -HASHED:] = counts / size[:, None], hashed.reshape(p, HASHED) / np.sqrt(3 * m)[:, None]
        for c, column in enumerate(more):
            x[i:j, k + c] = column
        i = j
    pick = np.flatnonzero(n_words)
    # Whether the text has had the same passage before.
    _, first = np.unique(prints[pick] ^ mix(text_of[pick].astype(np.uint64) + np.uint64(1 << 40)), return_index=True)
    x[:, k + 4] = 1
    x[pick[first], k + 4] = 0
    sizes = np.bincount(text_of[pick], minlength=len(some))
    x = x[pick] if len(pick) < n else x
    if (sizes == 0).any():  # texts without words: one passage of zeros, in its text's place
        return np.insert(x, np.cumsum(sizes)[sizes == 0], 0, axis=0), np.maximum(sizes, 1)
    return x, sizes


class Network:
    """The encoder, the gated attention and the scorer; ``parts`` holds the weights."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts

    @classmethod
    def new(cls, seed: int = 3) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b))
        return cls({"w": draw(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "v": draw(HIDDEN, ATTENTION), "u": draw(HIDDEN, ATTENTION), "a": draw(ATTENTION, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "d": np.zeros(1)})

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> tuple:
        p = self.parts
        first = np.cumsum(sizes) - sizes
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        s = (t * g) @ p["a"]
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, first), sizes))
        weight = e / np.repeat(np.add.reduceat(e, first), sizes)
        z = np.add.reduceat(weight[:, None] * h, first)
        return 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -40, 40))), first, h, t, g, weight, z

    def gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, share: np.ndarray) -> dict[str, np.ndarray]:
        p = self.parts
        s, first, h, t, g, weight, z = self.forward(x, sizes)
        err = (s - y) * share
        dz = err[:, None] * p["c"]
        each = np.repeat(dz, sizes, axis=0)
        gain = (each * h).sum(1)
        ds = weight * (gain - np.repeat(np.add.reduceat(weight * gain, first), sizes))
        dt, dg = ds[:, None] * p["a"] * g * (1 - t * t), ds[:, None] * p["a"] * t * g * (1 - g)
        dh = (weight[:, None] * each + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
        return {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ ds, "c": z.T @ err, "d": err.sum(keepdims=True)}

    def train(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, *, epochs: int = 60, batch: int = 256, rate: float = 0.01, decay: float = 1e-3, seed: int = 5) -> None:
        r, first = np.random.default_rng(seed), np.cumsum(sizes) - sizes
        m1, m2, t = {k: np.zeros_like(v) for k, v in self.parts.items()}, {k: np.zeros_like(v) for k, v in self.parts.items()}, 0
        for epoch in range(epochs):
            order = r.permutation(len(y))
            for a in range(0, len(y), batch):
                some = order[a : a + batch]
                rows = np.concatenate([np.arange(first[i], first[i] + sizes[i]) for i in some])
                grads, t = self.gradients(x[rows], sizes[some], y[some], np.full(len(some), 1 / len(some))), t + 1
                for k, g in grads.items():
                    g = g + decay * self.parts[k] * (k not in "bd")
                    m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.999 * m2[k] + 0.001 * g * g
                    self.parts[k] = self.parts[k] - rate * (1 - epoch / epochs) * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)


def _slices(every: list[str], most: int = 500_000) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(every):
        size += len(t)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(every):
        yield at, len(every)


def _described(most: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            every = b.column("text").to_pylist()
            for a, z in _slices(every):
                x, sizes = passages(every[a:z])
                drawn = [x[e - n : e][np.unique(np.linspace(0, n - 1, min(n, most)).astype(int))] for n, e in zip(sizes, np.cumsum(sizes))]
                yield pa.RecordBatch.from_arrays([b.column("y").slice(a, z - a), pa.array([d.astype(np.float16).tobytes() for d in drawn], pa.binary())], names=["y", "passages"])

    return run


def fit(rows: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, max_labelled: int = MAX_LABELLED, training_passages: int = TRAINING_PASSAGES) -> dict[str, np.ndarray] | None:
    """The network's weights (with the passages' mean and spread) from labelled rows; None without both kinds."""
    chosen = (
        labels.where(F.col(label).isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % folds != held_out))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id")
        .limit(max_labelled)
    )
    # At most max_labelled small rows are broadcast; as ids may be repeated in the documents, these are bounded once more.
    joined = rows.join(F.broadcast(stored(chosen, "labels")), "doc_id").select("doc_id", "y", "text", F.xxhash64("text").alias("h"))
    sample = stored(joined.dropDuplicates(["doc_id", "h"]), "sample")
    bounded = stored(sample.select("doc_id", "h").orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id", "h").limit(max_labelled), "chosen")
    found = sample.join(F.broadcast(bounded), ["doc_id", "h"]).repartition(24, "doc_id").orderBy("doc_id", "h").select("y", "text").mapInArrow(_described(training_passages), "y int, passages binary").collect()
    y = np.array([r.y for r in found], float)
    if not 0 < y.sum() < len(y):
        return None
    each = [np.frombuffer(r.passages, np.float16).reshape(-1, WIDTH) for r in found]
    x, sizes = np.concatenate(each).astype(np.float32), np.array([len(e) for e in each])
    mean, spread = x.mean(0, dtype=float).astype(np.float32), (x.std(0, dtype=float) + 0.02).astype(np.float32)
    x -= mean
    x /= spread
    net = Network.new()
    net.train(x, sizes, y)
    return net.parts | {"mean": mean, "spread": spread}


def _scored(weights: dict[str, np.ndarray] | None):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        net = weights and Network({k: v for k, v in weights.items() if k not in ("mean", "spread")})
        for b in batches:
            every = b.column("text").to_pylist()
            for a, z in _slices(every):
                s = np.full(z - a, 0.5)
                if net:
                    x, sizes = passages(every[a:z])
                    s = net.forward((x - weights["mean"]) / weights["spread"], sizes)[0]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(a, z - a), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, max_labelled: int = MAX_LABELLED, training_passages: int = TRAINING_PASSAGES) -> DataFrame:
    """``doc_id, score`` of every row of ``docs``, after fitting on the labelled ones."""
    ship(docs.sparkSession)
    rows = texts(docs, id_col, text_col)
    weights = fit(rows, labels, label=label, folds=folds, held_out=held_out, max_labelled=max_labelled, training_passages=training_passages)
    return rows.mapInArrow(_scored(weights), "doc_id long, score double")


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents; ``held_out`` marks the fold that training never saw."""
    scored = score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
