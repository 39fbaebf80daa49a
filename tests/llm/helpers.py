"""Odd inputs and brute-force counterparts."""

import itertools
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "Lorem ipsum dolor sit amet, consectetur elit. " * 4000
#: Columns whose names the operators use themselves.
EXTRA = ["score", "component_id", "sequence_id", "spans", "base_spans", "key", "bucket", "epoch", "epochs", "words", "length", "piece", "row", "y", "label", "rank", "domain", "n_tokens", "kept", "a", "b", "value"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


def odd_docs(spark, empty=False):
    """Nulls everywhere, empty, blank and very long texts, repeated rows, clashing extra columns."""
    text = "The quick brown fox jumps over the lazy dog while Ünïcode naps; token = abcdefgh12 and more words follow here."
    rows = [(1, text, "en", "src1"), (2, text, "en", "src1"), (2, text, "en", "src1"), (3, None, None, None), (4, "", "de", "src2"), (5, " \n\t ", "de", None), (6, LONG, "en", "src0"), (None, text, None, "src0"), (7, "one two", "fr", "odd"), (8, "x" * 70000, "es", "src3")]
    full = [(*r, None if r[1] is None else len(r[1]), *([None] * len(EXTRA))) for r in rows]
    return spark.createDataFrame([] if empty else full, SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def shingles(text):
    w = words(text.translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(docs, percent=85):
    """Component of each id, by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = {}
    for i, s in sets.items():
        for g in s:
            having.setdefault(g, []).append(i)
    for a, b in {p for v in having.values() for p in itertools.combinations(sorted(v), 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}
