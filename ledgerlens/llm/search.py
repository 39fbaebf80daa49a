"""Exact top-k search: BM25 over an inverted index in shards, with block-max WAND pruning, merged under global statistics.

``build_index`` deals documents into shards and writes one row per shard: sorted term hashes with their document
frequencies, postings (local document, count) by term, the same postings by document (``forward``), lengths and ids.
Documents of a shard with equal words are one local document with several ids, so copies cost one posting each term.

``search`` takes queries in blocks of about ``BLOCK_TERMS`` terms (and ``BLOCK_QUERIES`` queries), so that what is broadcast is bounded. The document
frequencies of their terms are summed over all shards first: every shard scores with the same statistics. Shards are
searched in waves of growing size; after each the k-th best (score, id) of a query so far is its *cut*, which all later
shards get: they return only rows that beat it, whatever the number of shards or of equal copies.

Within a shard similar queries run together as block-max WAND does, over whole lists instead of single cursors:

* pivot: terms stand by their frequency in the shard; only the lists of those before the pivot (rarer than ``FREQUENT``) are walked;
* blocks: documents are ordered by groups of similar ones and by length, and blocks of ``BLOCK_DOCS`` are bounded by what the
  walked lists gave and the block maxima of the terms behind the pivot; blocks that can't reach a query's cut are skipped;
* for the queries that a block is left for, the terms behind the pivot are added as one matrix product; what then may still
  reach the cut is scored in full from its forward list.

Bounds and sums are of 32 bits and compared with a slack of all their roundings, so rounding never drops a document; a score is
always of 64 bits and summed in the order of the terms, so it is the same number in every shard. A query's terms count once each;
equal scores go by the smaller id.

Terms are words of ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, as 64-bit hashes. Nulls: a null text has no terms and is never
found; a null id can't be named and is left out of the index. Repeated rows are separate documents and found each; the query
document itself (by id) isn't among its results. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import new_path, ship, stored, texts

K1, B, TOP = 1.2, 0.75, 10
SHARD_CHARS, BLOCK_DOCS, BLOCK_TERMS, BLOCK_QUERIES, QUERY_EVERY = 16_000_000, 64, 4_000_000, 100_000, 50
#: The first wave's shards, and how many times all before it a wave has.
WAVE, GROWTH = 1, 1
#: Groups of similar documents and of similar queries, told by so many of the most frequent terms.
GROUPS, GROUP_TERMS = 12, 256
#: Frequent terms are in this share of a shard's documents; this many numbers at most.
FREQUENT, DENSE = 0.03, 16_000_000
#: Queries and their terms searched at once, and postings added at once.
TOGETHER, TOGETHER_TERMS, PART = 512, 250_000, 100_000
#: The least score that counts as one in 32 bits, and the relative size of a rounding.
LEAST, ROUNDING = 1e-30, 2.0**-24
ARRAYS = {"terms": np.uint64, "frequencies": np.int64, "offsets": np.int64, "docs": np.int32, "counts": np.int32, "forward": np.int32, "lengths": np.int32, "id_offsets": np.int64, "ids": np.int64}
INDEX = ", ".join(f"{c} binary" for c in ARRAYS) + ", n_words long, n_texts long, wave int"


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of n each, one after the other."""
    return np.repeat(first - _starts(n), n) + np.arange(n.sum())


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true marks start and end."""
    steps = np.diff(marks.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def _term_counts(some: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) in order of text and term; and each text's number of words."""
    from ledgerlens.llm.shingles import words_of

    _, offsets, starts, _, words = words_of(some)
    text = np.searchsorted(offsets, starts, "right") - 1
    order = np.lexsort((words, text))
    text, words = text[order], words[order]
    first = _changes(text, words)
    return text[first], words[first], np.diff(np.concatenate([first, [len(words)]])), np.bincount(text, minlength=len(some))


def _slices(every: list[str], most: int = 500_000) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(every):
        size += len(t)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(every):
        yield at, len(every)


def wave_of(shard: int) -> int:
    """Waves have WAVE shards, then GROWTH times all before."""
    wave, upto = 0, WAVE
    while shard >= upto:
        wave, upto = wave + 1, upto * (1 + GROWTH)
    return wave


def _prints(text: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """128 bits of each text's terms and their counts."""
    from ledgerlens.llm.shingles import mix

    out, first = np.zeros((n, 2), np.uint64), _changes(text)
    for i in range(2 if len(text) else 0):
        out[text[first], i] = np.add.reduceat(mix(term * np.uint64(2 * i + 3) + count.astype(np.uint64)), first)
    return out


def _arrays(postings: list[np.ndarray], length: np.ndarray, prints: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
    """A shard's arrays from its postings (text, term, count), in this order, and its texts' lengths, prints and ids."""
    # Texts with equal prints are one local document, numbered as its first text comes.
    order = np.lexsort((np.arange(len(ids)), prints[:, 1], prints[:, 0]))
    runs = _changes(prints[order, 0], prints[order, 1])
    heads = order[runs]
    number = np.empty(len(runs), np.int32)
    number[np.argsort(heads)] = np.arange(len(runs), dtype=np.int32)
    doc = np.empty(len(ids), np.int32)
    doc[order] = np.repeat(number, np.diff(np.concatenate([runs, [len(ids)]])))
    heads.sort()
    copies = np.bincount(doc, minlength=len(runs))
    by_doc = np.lexsort((ids, doc))
    text, term, count = postings
    postings.clear()
    if len(runs) < len(ids):
        own = np.zeros(len(ids), bool)
        own[heads] = True
        own = own[text]
        text, term, count = text[own], term[own], count[own]
    d = doc[text]
    del text
    back = np.argsort(term, kind="stable").astype(np.int32)
    term, d, count = term[back], d[back], count[back]
    forward = np.empty(len(back), np.int32)
    forward[back] = np.arange(len(back), dtype=np.int32)
    first = _changes(term)
    return {"terms": term[first], "frequencies": np.add.reduceat(copies[d], first) if len(first) else first, "offsets": np.concatenate([first, [len(term)]]), "docs": d, "counts": count, "forward": forward, "lengths": length[heads], "id_offsets": np.concatenate([[0], np.cumsum(copies)]), "ids": ids[by_doc]}


def _index_shard(batches: Iterator) -> Iterator:
    import pyarrow as pa
    from pyspark import TaskContext

    from ledgerlens.llm.memos import forget

    forget()
    docs, terms, counts, lengths, prints, ids, n = [], [], [], [], [], [], 0
    for b in batches:
        every, own = b.column("text").to_pylist(), b.column("doc_id").to_numpy(zero_copy_only=False)
        for a, z in _slices(every):
            text, term, count, length = _term_counts(every[a:z])
            docs.append((text + n).astype(np.int32))
            terms.append(term)
            counts.append(count.astype(np.int32))
            lengths.append(length.astype(np.int32))
            prints.append(_prints(text, term, count, z - a))
            ids.append(own[a:z].astype(np.int64))
            n += z - a
    if n:
        length, postings = np.concatenate(lengths), []
        for parts in (docs, terms, counts):
            postings.append(np.concatenate(parts))
            parts.clear()
        made = _arrays(postings, length, np.concatenate(prints), np.concatenate(ids))
        row = []
        for c, t in ARRAYS.items():
            data = np.ascontiguousarray(made.pop(c), t)
            row.append(pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, data.nbytes], np.int32)), pa.py_buffer(data)]))
        more = [pa.array([int(length.sum())], pa.int64()), pa.array([int((length > 0).sum())], pa.int64()), pa.array([wave_of(TaskContext.get().partitionId())], pa.int32())]
        yield pa.RecordBatch.from_arrays([*row, *more], names=[*ARRAYS, "n_words", "n_texts", "wave"])


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """The index of all rows, written in folders by wave: one row per shard, of about ``shard_chars`` characters each."""
    spark = docs.sparkSession
    ship(spark)
    rows = texts(docs, id_col, text_col).where("doc_id is not null")
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    dealt = rows.repartition(max(1, -(-chars // shard_chars)), F.xxhash64("doc_id", "text"))
    path = new_path(spark, "index")
    dealt.mapInArrow(_index_shard, INDEX).write.partitionBy("wave").parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def _groups(rows: np.ndarray, most: int, rounds: int = 8) -> np.ndarray:
    """A group of each of some documents with similar rows, by k-means on the cosine."""
    rows = rows - rows.mean(axis=0)
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), np.float32(1e-9))
    centres = rows[np.linspace(0, len(rows) - 1, most).astype(int)]
    for _ in range(rounds):
        group = np.argmax(rows @ centres.T, axis=1)
        for g in np.unique(group).tolist():
            centre = rows[group == g].mean(axis=0)
            centres[g] = centre / max(float(np.linalg.norm(centre)), 1e-9)
    return np.unique(group, return_inverse=True)[1]


class Shard:
    """One shard, ready for queries under the global mean length."""

    def __init__(self, row: dict[str, bytes], mean_length: float):
        read = lambda c: np.frombuffer(row[c], ARRAYS[c])
        self.terms, self.offsets, self.forward, self.id_offsets, self.ids = (read(c) for c in ("terms", "offsets", "forward", "id_offsets", "ids"))
        docs, c, lengths = read("docs"), read("counts").astype(float), read("lengths")
        self.n, sizes = len(lengths), np.diff(self.offsets)
        self.impact = c * (K1 + 1) / (c + (K1 * (1 - B + B * lengths / mean_length))[docs])
        del c
        self.term = np.repeat(np.arange(len(self.terms), dtype=np.int32), sizes)
        self.forward_offsets = np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=self.n))])
        self.weight, self.by_id = np.zeros(len(self.terms)), np.sort(self.ids)
        # Columns: documents by groups of similar ones and by length, so that those of a block are alike.
        common = np.argsort(-sizes, kind="stable")
        rows = np.zeros((self.n, min(len(common), GROUP_TERMS)), np.float32)
        for i, (a, z) in enumerate(zip(self.offsets[common[:GROUP_TERMS]].tolist(), self.offsets[common[:GROUP_TERMS] + 1].tolist())):
            rows[docs[a:z], i] = 1
        self.doc = np.lexsort((lengths, _groups(rows, min(GROUPS, self.n)))) if self.n else np.zeros(0, np.int64)
        del rows
        column = np.empty(self.n, np.int32)
        column[self.doc] = np.arange(self.n, dtype=np.int32)
        self.column, self.impact32 = column[docs], self.impact.astype(np.float32)
        # Frequent terms: their impacts by column, and the largest of each block.
        rows = common[: int(np.count_nonzero(sizes >= self.n * FREQUENT))][: max(DENSE // max(self.n, 1), 1)]
        self.slot = np.full(len(self.terms), -1, np.int32)
        self.slot[rows] = np.arange(len(rows), dtype=np.int32)
        self.dense = np.zeros((self.n, len(rows)), np.float32)
        for i, (a, z) in enumerate(zip(self.offsets[rows].tolist(), self.offsets[rows + 1].tolist())):
            self.dense[self.column[a:z], i] = self.impact32[a:z]
        self.blocks = np.arange(0, self.n, BLOCK_DOCS)
        self.block_most = np.maximum.reduceat(self.dense, self.blocks, axis=0) if self.n else self.dense

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Full scores of some documents (with terms) under the weights set for a query, each summed in the order of its terms."""
        a = self.forward_offsets[docs]
        size = self.forward_offsets[docs + 1] - a
        at = self.forward[_spread(a, size)]
        return np.add.reduceat(self.weight[self.term[at]] * self.impact[at], _starts(size)) if len(at) else np.zeros(0)

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Where sorted terms stand in this shard; -1: nowhere."""
        at = np.searchsorted(self.terms, terms)
        return np.where((at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms), at, -1) if len(self.terms) else np.full(len(terms), -1)

    def top(self, terms: np.ndarray, idf: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows (ids, scores) for a query's sorted terms and their weights, without those named ``skip``."""
        return self.best(self.places(terms), idf, np.array([0, len(terms)]), k, [skip], np.zeros(1), np.zeros(1, np.int64))[0]

    def best(self, at: np.ndarray, idf: np.ndarray, offsets: np.ndarray, k: int, skip: list[int], least: np.ndarray, last: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """``top`` of some queries by the places of their terms; with a cut (score in ``least``, id in ``last``; score 0: none) only rows that beat it."""
        n, out = len(skip), [(np.zeros(0, np.int64), np.zeros(0))] * len(skip)
        if not self.n:
            return out
        there = np.flatnonzero(at >= 0)
        query = np.repeat(np.arange(n), np.diff(offsets))[there]
        offsets = np.searchsorted(query, np.arange(n + 1))
        at, idf = at[there], idf[there]
        # A sum of 32-bit numbers is off by so many roundings at most, and two of them may be compared.
        error = 2 * ROUNDING * (np.diff(offsets) + 10)
        slot = self.slot[at]
        rare = np.flatnonzero(slot < 0)
        sums = self._rare(query[rare], at[rare], idf[rare].astype(np.float32), n)
        frequent = np.flatnonzero(slot >= 0)
        weights = np.zeros((n, self.dense.shape[1]), np.float32)
        weights[query[frequent], slot[frequent]] = idf[frequent]
        most = np.maximum.reduceat(sums, self.blocks, axis=1) + weights @ self.block_most.T
        alive = most >= np.maximum(least * (1 - error), LEAST).astype(np.float32)[:, None]
        asked = np.count_nonzero(alive, axis=0)
        # Blocks left for most queries are added for all, those side by side at once.
        for first, z in zip(*(x.tolist() for x in _runs(asked > n // 2))):
            cells = slice(first * BLOCK_DOCS, z * BLOCK_DOCS)
            sums[:, cells] += weights @ self.dense[cells].T
        for block in np.flatnonzero((asked > 0) & (asked <= n // 2)).tolist():
            cells, some = slice(block * BLOCK_DOCS, (block + 1) * BLOCK_DOCS), np.flatnonzero(alive[:, block])
            sums[some, cells] += weights[some] @ self.dense[cells].T
        # Rows that are skipped may be among the best.
        enough = k + np.searchsorted(self.by_id, skip, "right") - np.searchsorted(self.by_id, skip)
        bar = least.copy()
        for i in np.flatnonzero((least <= 0) & (enough <= self.n)).tolist():
            bar[i] = np.partition(sums[i], self.n - enough[i])[self.n - enough[i]]
        near = np.flatnonzero(sums >= np.maximum(bar * (1 - error), LEAST).astype(np.float32)[:, None])
        whose, near = near // self.n, self.doc[near % self.n]
        ends = np.searchsorted(whose, np.arange(n + 1)).tolist()
        for i in np.unique(whose).tolist():
            mine = slice(offsets[i], offsets[i + 1])
            self.weight[at[mine]] = idf[mine]
            alive = near[ends[i] : ends[i + 1]]
            s = self.scores(alive)
            self.weight[at[mine]] = 0.0
            if len(s) > enough[i]:
                kept = s >= np.partition(s, len(s) - enough[i])[len(s) - enough[i]]
                alive, s = alive[kept], s[kept]
            first = self.id_offsets[alive]
            size = np.minimum(self.id_offsets[alive + 1] - first, enough[i])
            ids, s = self.ids[_spread(first, size)], np.repeat(s, size)
            keep = ids != skip[i]
            if least[i] > 0:
                keep &= (s > least[i]) | (s == least[i]) & (ids < last[i])
            ids, s = ids[keep], s[keep]
            order = np.lexsort((ids, -s))[:k]
            out[i] = ids[order], s[order]
        return out

    def _rare(self, query: np.ndarray, at: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
        """What terms add by their lists to each of n queries' scores, by column."""
        sums, first, size = np.zeros((n, self.n), np.float32), self.offsets[at], self.offsets[at + 1] - self.offsets[at]
        flat, row, upto, a = sums.reshape(-1), query * self.n, np.cumsum(size), 0
        while a < len(at):
            z = max(int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PART, "right")), a + 1)
            spread = _spread(first[a:z], size[a:z])
            np.add.at(flat, np.repeat(row[a:z], size[a:z]) + self.column[spread], np.repeat(idf[a:z], size[a:z]) * self.impact32[spread])
            a = z
        return sums


def _frequencies(shared):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        wanted = shared.value
        for b in batches:
            for terms, n in zip(b.column("terms"), b.column("frequencies")):
                terms, n = np.frombuffer(terms.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.int64)
                at = np.searchsorted(terms, wanted)
                there = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == wanted) if len(terms) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n[at[there]])], names=["place", "n"])

    return run


def _together(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Queries that are searched at once, from and to."""
    a, n = 0, len(offsets) - 1
    while a < n:
        z = min(max(int(np.searchsorted(offsets, offsets[a] + TOGETHER_TERMS, "right")) - 1, a + 1), a + TOGETHER, n)
        yield a, z
        a = z


def _search(queries, cuts, k: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from ledgerlens.llm.memos import forget

        forget()
        q, (scores, last) = queries.value, cuts.value
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard({c: b.column(c)[i].as_buffer() for c in ARRAYS}, q["mean_length"])
                at, found, offsets = shard.places(q["wanted"]), [], q["offsets"]
                for a, z in _together(offsets):
                    terms = q["terms"][offsets[a] : offsets[z]]
                    best = shard.best(at[terms], q["idf"][terms], offsets[a : z + 1] - offsets[a], k, q["ids"][a:z], scores[a:z], last[a:z])
                    found += [(qid, *x) for qid, x in zip(q["ids"][a:z], best)]
                n = [len(ids) for _, ids, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([x[0] for x in found], n).astype(np.int64)), pa.array(np.concatenate([np.zeros(0, np.int64), *(x[1] for x in found)])), pa.array(np.concatenate([np.zeros(0), *(x[2] for x in found)]))], names=["query_id", "doc_id", "score"]
                )
                del shard

    return run


def _query_terms(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        found = [np.unique(_term_counts([t])[1]).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.binary())], names=["query_id", "terms"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def _merged(k: int, n: int, *parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[tuple, tuple]:
    """The k best (query, score, id) rows of each of n queries, and each query's k-th best (score, id); score 0: not k yet."""
    query, score, ids = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids, -score, query))
    query, score, ids = query[order], score[order], ids[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    cuts = np.zeros(n), np.zeros(n, np.int64)
    for cut, of in zip(cuts, (score, ids)):
        cut[query[rank == k - 1]] = of[rank == k - 1]
    return tuple(x[rank < k] for x in (query, score, ids)), cuts


def search(index: DataFrame, queries: DataFrame, *, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", block_terms: int = BLOCK_TERMS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, doc_id, score``: each query's k best documents of the index. Queries without an id are left out; of several with one id, one is asked."""
    spark = index.sparkSession
    ship(spark)
    sc, empty = spark.sparkContext, (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    stats = index.groupBy("wave").agg(F.sum("n_words").alias("words"), F.sum("n_texts").alias("n")).collect()
    words, n = sum(r.words for r in stats), sum(r.n for r in stats)
    asked = stored(texts(queries, id_col, text_col).where("doc_id is not null").mapInArrow(_query_terms, "query_id long, terms binary").groupBy("query_id").agg(F.min("terms").alias("terms")), "queries")
    size = asked.agg(F.coalesce(F.sum(F.length("terms")), F.lit(0)), F.count("query_id")).first()
    blocks = max(1, -(-size[0] // (8 * block_terms)), -(-size[1] // block_queries))
    root, schema = new_path(spark, "found"), "query_id long, doc_id long, score double"
    spark.createDataFrame([], schema).write.parquet(f"{root}/block=-1/wave=-1")
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).orderBy("query_id").collect()
        if not mine or not words:
            continue
        each = [np.frombuffer(r.terms, np.uint64) for r in mine]
        wanted, terms = np.unique(np.concatenate(each), return_inverse=True)
        counted = index.select("terms", "frequencies").mapInArrow(_frequencies(sc.broadcast(wanted)), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
        df = np.zeros(len(wanted))
        df[counted["place"].to_numpy()] = counted["n"].to_numpy()
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        ids, offsets = np.array([r.query_id for r in mine], np.int64), np.cumsum([0, *map(len, each)])
        # Similar queries stand together, by their number of terms.
        queried = np.repeat(np.arange(len(ids)), np.diff(offsets))
        place = np.full(len(wanted), -1)
        place[np.argsort(-np.bincount(terms, minlength=len(wanted)), kind="stable")[:GROUP_TERMS]] = np.arange(min(len(wanted), GROUP_TERMS))
        rows, common = np.zeros((len(ids), GROUP_TERMS), np.float32), place[terms]
        rows[queried[common >= 0], common[common >= 0]] = 1
        order = np.lexsort((np.diff(offsets), _groups(rows, min(GROUPS, len(ids)))))
        del rows
        terms = terms[_spread(offsets[:-1][order], np.diff(offsets)[order])].astype(np.int32)
        offsets = np.concatenate([[0], np.cumsum(np.diff(offsets)[order])])
        shared = sc.broadcast({"ids": ids[order].tolist(), "offsets": offsets, "terms": terms, "idf": idf, "wanted": wanted, "mean_length": words / n})
        best, cuts = _merged(k, len(ids), empty)
        for wave in sorted(r.wave for r in stats):
            path = f"{root}/block={block}/wave={wave}"
            index.where(F.col("wave") == wave).mapInArrow(_search(shared, sc.broadcast(tuple(x[order] for x in cuts)), k), schema).write.parquet(path)
            more = _ranked(spark.read.schema(schema).parquet(path), k).select("query_id", "score", "doc_id").toPandas()
            best, cuts = _merged(k, len(ids), best, (np.searchsorted(ids, more["query_id"].to_numpy()), more["score"].to_numpy(), more["doc_id"].to_numpy()))
        shared.unpersist()
    return _ranked(spark.read.schema(schema).parquet(root), k)


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 50 as a query (its whole text) against all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(build_index(docs), docs.where(F.col("doc_id") % QUERY_EVERY == 0))
