"""Best-fit packing with large-item matching: documents into sequences of at most ``capacity`` tokens.

What a packing needs of a corpus is how many pieces there are of each length: at most ``capacity`` numbers,
whatever the corpus. ``plan`` packs that histogram on the driver, in whole groups of like bins:

1. lengths above a third of the capacity: at most two fit into a bin. Greedy matching, the longest first, each with
   the longest partner that still fits;
2. all others, the longest first: best fit, into the smallest gap that holds them; a new bin where there is none.

The plan names, for each length, intervals of ranks with their bins. Each piece then finds its bin from its length
and its rank among the pieces of this length. Ranks are counted within (length, salt) and shifted by the counts of
the lower salts, so a length that a third of all pieces have is still counted by many tasks.

Every document gets its end id and is cut only if longer than the capacity; all pieces but its last are full then.
Nulls: a null text is empty (one piece with the end id); null or repeated ``doc_id`` values stay separate rows, as
each row is packed by itself. An empty table gives no pieces. Other columns are left out.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import ship, stored, texts

CAPACITY, END_ID, SALTS = 2048, 0, 128
HELPERS = ("__pack_row", "__pack_salt", "__pack_rank")
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from ledgerlens.llm.encoding import encoder, parts
        from ledgerlens.llm.memos import trim

        enc, tail, step = encoder(path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for whole in batches:
            for part in parts(whole):
                rows: list[tuple] = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), enc.encode(part.column("text"))):
                    ids += tail
                    rows += [(doc, k, k * capacity, min(step, len(ids) - k * step) // 4, ids[k * step : (k + 1) * step]) for k in range(-(-len(ids) // step))]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "piece", "start", "length", "ids"])
        trim()

    return run


def encode_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's pieces with their ids (little-endian unsigned 32-bit)."""
    ship(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(_cut(tokenizer_path, capacity, end_id), PIECES)


def plan(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length, intervals of ranks: (first rank, first bin, pieces of this length in each bin, offset in the bin).

    Bins are numbered from 0. Work and result are bounded by the capacity, not by the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("a piece is empty or longer than the capacity")
    out: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in left}
    used = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # by the tokens left: (first bin, number of bins)
    order: list[int] = []  # the gaps, ascending
    bins = 0

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, n))

    def put(n: int, first: int, n_bins: int, each: int, offset: int) -> None:
        out[n].append((used[n], first, each, offset))
        used[n] += n_bins * each
        left[n] -= n_bins * each

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        k = bisect.bisect_right(large, capacity - a) - 1
        if k < 0 or large[k] == a and left[a] == 1:
            partner, n = (large[k - 1], 1) if k > 0 else (None, left[a])
        else:
            partner = large[k]
            n = left[a] // 2 if partner == a else min(left[a], left[partner])
        if partner == a:
            put(a, bins, n, 2, 0)
            free(capacity - 2 * a, bins, n)
        else:
            put(a, bins, n, 1, 0)
            if partner is not None:
                put(partner, bins, n, 1, a)
            free(capacity - a - (partner or 0), bins, n)
        bins += n
        large = [n for n in large if left[n]]
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect.bisect_left(order, n)
            if k == len(order):
                each = min(capacity // n, left[n])
                n_bins = left[n] // each
                put(n, bins, n_bins, each, 0)
                free(capacity - each * n, bins, n_bins)
                bins += n_bins
                continue
            gap = order[k]
            first, n_bins = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[k]
            each = min(gap // n, left[n])
            whole = min(n_bins, left[n] // each)
            put(n, first, whole, each, capacity - gap)
            free(gap - each * n, first, whole)
            free(gap, first + whole, n_bins - whole)
    return out


def _place(base: np.ndarray, starts: np.ndarray, firsts: np.ndarray, each: np.ndarray, offsets: np.ndarray, before: np.ndarray):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from ledgerlens.llm.memos import forget

        forget()
        for b in batches:
            n, salt, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", *HELPERS[1:]))
            at = before[n] + base[n, salt] + rank
            i = np.searchsorted(starts, at, "right") - 1
            k = at - starts[i]
            more = {"sequence_id": firsts[i] + k // each[i], "offset": offsets[i] + k % each[i] * n}
            keep = [c for c in b.schema.names if c not in HELPERS]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *map(pa.array, more.values())], names=[*keep, *more])

    return run


def place(pieces: DataFrame, *, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """Give each row of ``pieces`` (a ``length`` from 1 to ``capacity`` and any other columns; those named ``sequence_id`` or ``offset`` are replaced) its ``sequence_id`` and ``offset``.

    ``pieces`` is written to the shared folder first, so ranks stay the same if a task runs again. To the driver come
    the counts by (length, salt): at most ``capacity * salts`` small rows.
    """
    spark = pieces.sparkSession
    ship(spark)
    row, salt, rank = HELPERS
    pieces = pieces.drop("sequence_id", "offset")
    kept = stored(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    salted = kept.withColumn(salt, F.pmod(F.xxhash64(row), F.lit(salts)).cast("int"))
    counts = np.zeros((capacity + 1, salts), np.int64)
    for n, part, c in salted.groupBy("length", salt).agg(F.count(F.lit(1))).collect():
        counts[n, part] = c
    totals = counts.sum(1)
    before = np.cumsum(totals) - totals
    rows = sorted((int(before[n]) + first, *rest) for n, parts in plan({int(n): int(totals[n]) for n in np.flatnonzero(totals)}, capacity).items() for first, *rest in parts)
    table = [np.array(c, np.int64) for c in zip(*rows)] or [np.zeros(1, np.int64)] * 4
    place_in_part = F.row_number().over(Window.partitionBy("length", salt).orderBy(row)) - 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, `offset` long"
    return salted.withColumn(rank, place_in_part.cast("long")).drop(row).mapInArrow(_place(np.cumsum(counts, 1) - counts, *table, before), schema)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents; per piece its place and the checksum of its ids."""
    import public_tokenizers

    pieces = encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return place(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
