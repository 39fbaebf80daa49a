"""Near-duplicates by b-bit MinHash: bands for candidates, packed low bits for estimates, full sets for confirmation.

1. ``sketch``: per document its number of shingles, a 128-bit fingerprint of its shingle set, band keys of as many
   minima each as the threshold allows (``banding``), and the lowest ``BITS`` bits of all ``HASHES`` minima packed into
   longs. Written to the shared folder.
2. Documents with equal sets collapse to their smallest id (map-side minimum), so copies never meet pairwise.
3. In ``STARS`` turns every representative is paired with one leader of its buckets that isn't in its component yet (a
   star per bucket, not all pairs; of several leaders the one with which it shares most bands). The packed bits give a
   collision-corrected similarity by bit counts; pairs clearly below the threshold go (``margin`` is over five standard
   deviations). The others are confirmed on the full sets, recomputed from the whole texts.
4. Buckets that still hold several components are dealt into blocks of about ``BLOCK`` members and ``BLOCK_SHINGLES``
   shingles at most, and block meets block: rows grow with members times blocks, pairs are never rows, and a meeting's
   texts are bounded however long they are. Meetings are spread over tasks by the pairs that they have to look at. Within
   one, bit counts rule out what they can; the members that remain get their texts and the remaining pairs are confirmed on
   the full sets. Pairs within one component need no test, so a group of copies, once found, isn't compared again.
5. Components over the confirmed links. ``component_id`` is the smallest id, ``kept`` says whether a document is it.

A link at the threshold is missed by the bands with a chance of at most ``MISSED``: (1 - 0.85**6)**30 = 7e-7 at 85 percent,
(1 - 0.8**5)**36 = 6e-7 at 80.

Nulls: a null text is empty; documents without words have no shingles and stay alone. A null id can't be named by a
component: its row has a null ``component_id`` and is kept. Rows with the same id are one node and get the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import ship, stored, texts
from ledgerlens.llm.graph import components

PERCENT, HASHES, BITS, MARGIN, MISSED, STARS, BLOCK, BLOCK_SHINGLES = 85, 180, 4, 0.15, 1e-6, 2, 256, 1_000_000
WORDS = -(-HASHES * BITS // 64)
#: A list of ids up to this many (16 MB) is broadcast; longer ones are joined by a shuffle.
BROADCAST_IDS = 2_000_000
BATCH_CHARS = 400_000
#: A leader's pairs are dealt over so many parts; pairs that a task of meetings looks at.
SALTS, TASK_PAIRS = 256, 20_000_000
SKETCH = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, packed array<long>"


def banding(percent: int) -> tuple[int, int]:
    """Bands and minima per band: the longest bands that miss a link at the threshold with a chance of at most MISSED."""
    fits = [r for r in range(1, HASHES + 1) if HASHES % r == 0 and (1 - (percent / 100) ** r) ** (HASHES // r) <= MISSED]
    rows = max(fits, default=1)
    return HASHES // rows, rows


def margin(percent: int) -> float:
    """How far below the threshold an estimate may lie: MARGIN at PERCENT, as many standard deviations where they are wider."""
    match = lambda p: p / 100 + (1 - p / 100) / (1 << BITS)
    deviation = lambda p: (match(p) * (1 - match(p))) ** 0.5
    return MARGIN * max(1.0, deviation(percent) / deviation(PERCENT))


def _slices(texts_: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BATCH_CHARS characters."""
    at, size = 0, 0
    for i, t in enumerate(texts_):
        size += len(t) + 50
        if size >= BATCH_CHARS:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts_):
        yield at, len(texts_)


def _sketches(percent: int):
    n_bands, n_rows = banding(percent)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from ledgerlens.llm.memos import forget
        from ledgerlens.llm.shingles import minima, mix, shingle_sets

        forget()

        per_word = 64 // BITS
        for b in batches:
            every = b.column("text").to_pylist()
            for a, z in _slices(every):
                sets = shingle_sets(every[a:z])
                n = np.array([len(s) for s in sets], np.int64)
                full = [s for s in sets if len(s)]
                bands, packed, prints = np.zeros((0, n_bands), np.uint64), np.zeros((0, WORDS), np.uint64), np.zeros((2, len(sets)), np.uint64)
                if full:
                    low = minima(full, HASHES)
                    key = np.zeros((len(full), n_bands), np.uint64) + np.arange(n_bands, dtype=np.uint64)
                    for r in range(n_rows):
                        key = mix(key * np.uint64(0x100000001B3) + low[:, r::n_rows])
                    bands = key
                    bits = np.zeros((len(full), WORDS * per_word), np.uint64)
                    bits[:, :HASHES] = mix(low) & np.uint64((1 << BITS) - 1)
                    packed = np.bitwise_or.reduce(bits.reshape(-1, WORDS, per_word) << (np.arange(per_word, dtype=np.uint64) * np.uint64(BITS)), axis=2)
                    first = np.cumsum([0, *(len(s) for s in full[:-1])])
                    joined = np.concatenate(full)
                    for i in range(2):
                        prints[i, n > 0] = np.add.reduceat(mix(joined ^ np.uint64(0x5851F42D4C957F2D + i)), first)
                lists = lambda m, width: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, width, 0))]), pa.int32()), pa.array(m.reshape(-1).view(np.int64)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(a, z - a), pa.array(n), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), lists(np.ascontiguousarray(bands), n_bands), lists(np.ascontiguousarray(packed), WORDS)],
                    names=["doc_id", "n_shingles", "f1", "f2", "bands", "packed"],
                )

    return run


def sketch(docs: DataFrame, *, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sketches of all rows (see the module's text)."""
    ship(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(_sketches(percent), SKETCH)


def estimate(a: str, b: str) -> Column:
    """The similarity of two packed sketches, corrected for minima that differ but share their low bits."""
    ones = int("1" * (64 // BITS), 16) if BITS == 4 else None
    total = F.lit(0)
    for i in range(WORDS):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        total = total + F.bit_count(any_bit.bitwiseAND(F.lit(ones)))
    chance = 1 / (1 << BITS)
    return (1 - total / HASHES - chance) / (1 - chance)


def _confirm(percent: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from ledgerlens.llm.memos import forget
        from ledgerlens.llm.shingles import common, shingle_sets

        forget()
        last: dict[int, np.ndarray] = {}  # the sets of the ids just seen on the left, which come in runs
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                p = batch.slice(at, 64)
                left, right = p.column("a").to_pylist(), p.column("b").to_pylist()
                new = {i: t for i, t in zip(left, p.column("a_text").to_pylist()) if i not in last}
                sets = shingle_sets([*new.values(), *p.column("b_text").to_pylist()])
                mine = dict(zip(new, sets)) | {i: last[i] for i in left if i in last}
                keep = []
                for i, s in zip(left, sets[len(new) :]):
                    both = common(mine[i], s)
                    keep.append(both > 0 and 100 * both >= percent * (len(mine[i]) + len(s) - both))
                last = {left[-1]: mine[left[-1]]}
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)[keep]) for x in (left, right)], names=["a", "b"])

    return run


def _whole_groups(batches: Iterator) -> Iterator:
    """Tables of whole (band, i, j) groups from rows sorted by these; only the last group of a batch waits for the next."""
    import pyarrow as pa

    waiting = None
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([b])])
        keys = [table.column(c).to_numpy() for c in ("band", "i", "j")]
        other = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
        at = int(other[-1]) + 1 if len(other) else 0
        if at:
            yield table.slice(0, at).combine_chunks()
        waiting = table.slice(at).combine_chunks()
    if waiting is not None:
        yield waiting


def _meetings(table, least: float, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row numbers) of a table of whole groups that the bit counts can't rule out: all groups step by step, never a group's pairs at once.

    Pairs of one component need no test, and a pair that shares several bands is only looked at in its first one.
    """
    values = lambda c, width, t: table.column(c).combine_chunks().flatten().to_numpy().view(t).reshape(-1, width)
    packed, n_bands = values("packed", WORDS, np.uint64), banding(percent)[0]
    bands = values("bands", n_bands, np.int64)
    band, i, j, own, ids, comp, n = (table.column(c).to_numpy() for c in ("band", "i", "j", "own", "id", "id_c", "n_shingles"))
    head = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    sizes = np.diff(np.concatenate([head, [len(band)]]))
    after = np.repeat(head + sizes, sizes)  # where each row's group ends
    ones, chance, found, a, d = np.uint64(int("1" * (64 // BITS), 16)), 1 / (1 << BITS), [], np.arange(len(band)), 0
    while len(a):
        d += 1
        a = a[a + d < after[a]]
        p, q = a, a + d
        ok = ((i[p] == j[p]) | (own[p] != own[q])) & (comp[p] != comp[q]) & (ids[p] != ids[q])
        p, q = p[ok], q[ok]
        ok = 100 * np.minimum(n[p], n[q]) >= percent * np.maximum(n[p], n[q])
        p, q = p[ok], q[ok]
        x = packed[p] ^ packed[q]
        differ = np.bitwise_count((x | x >> np.uint64(1) | x >> np.uint64(2) | x >> np.uint64(3)) & ones).sum(1, dtype=np.int64)
        near = (1 - differ / HASHES - chance) / (1 - chance) >= least
        p, q = p[near], q[near]
        first = bands[p, (bands[p] == bands[q]).argmax(1)] == band[p]
        found.append((p[first], q[first]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _survivors(least: float, percent: int):
    def run(batches: Iterator) -> Iterator:
        from ledgerlens.llm.memos import forget

        forget()
        for table in _whole_groups(batches):
            p, q = _meetings(table, least, percent)
            if len(p):
                yield from table.take(np.unique(np.concatenate([p, q]))).select(["band", "i", "j", "own", "id", "id_c"]).combine_chunks().to_batches()

    return run


def _confirmed(least: float, percent: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from ledgerlens.llm.memos import forget
        from ledgerlens.llm.shingles import common, shingle_sets

        forget()
        for table in _whole_groups(batches):
            p, q = _meetings(table, least, percent)
            rows = np.unique(np.concatenate([p, q]))
            every = table.column("text").take(rows).to_pylist()
            sets = dict(zip(rows.tolist(), (s for a, z in _slices(every) for s in shingle_sets(every[a:z]))))
            keep = []
            for x, y in zip(p.tolist(), q.tolist()):
                both = common(sets[x], sets[y])
                keep.append(100 * both >= percent * (len(sets[x]) + len(sets[y]) - both))
            ids, keep = table.column("id").to_numpy(), np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([pa.array(ids[p[keep]]), pa.array(ids[q[keep]])], names=["a", "b"])

    return run


def with_ids(rows: DataFrame, ids: DataFrame, how: str, on: str = "doc_id") -> DataFrame:
    """``rows`` semi- or anti-joined by an id: a list of ids is broadcast up to BROADCAST_IDS, shuffled beyond."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


def confirm(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full shingle sets, from the whole texts, are similar enough; written."""
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    own = with_ids(rows, ids, "left_semi")
    # A leader may be in a third of all pairs: its text goes to the parts that its pairs are dealt over.
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    left = salted.select("a", "salt").distinct().join(own.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a")
    right = salted.join(own.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b")
    both = right.join(left, ["a", "salt"])
    return stored(both.select("a", "b", "a_text", "b_text").mapInArrow(_confirm(percent), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs`` (see the module's text)."""
    rows = texts(docs, id_col, text_col)
    sketches = stored(sketch(rows, percent=percent), "sketches")
    print_ = ["n_shingles", "f1", "f2"]
    named = sketches.where("n_shingles > 0 and doc_id is not null")
    reps = stored(named.groupBy(*print_).agg(F.min(F.struct("doc_id", "bands", "packed")).alias("x")).select(*print_, F.col("x.doc_id").alias("id"), "x.bands", "x.packed"), "representatives")
    least = percent / 100 - margin(percent)
    similar = lambda a, b, n, m: (estimate(a, b) >= least) & (100 * F.least(n, m) >= percent * F.greatest(n, m))

    # Only bands that two representatives share can link anything.
    every = reps.select("id", F.explode("bands").alias("band"))
    shared_bands = stored(every.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "bands")
    buckets = stored(with_ids(every, shared_bands, "left_semi", "band"), "buckets")
    side = lambda x: reps.select(F.col("id").alias(x), F.col("packed").alias(f"{x}_packed"), F.col("n_shingles").alias(f"{x}_n"))
    comps, links, tested = None, None, None

    def grouped(x: DataFrame, name: str) -> DataFrame:
        if comps is None:
            return x.withColumn(f"{name}_c", F.col(name))
        c = comps.select(F.col("id").alias(name), F.col("component").alias(f"{name}_c"))
        return x.join(c, name, "left").withColumn(f"{name}_c", F.coalesce(f"{name}_c", name))

    for turn in range(STARS):
        members = grouped(buckets, "id")
        # A bucket's leader: at first its smallest id, later some member of its largest component, another one each turn.
        order = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
        heads = members.groupBy("band", "id_c").agg(F.count("*").alias("n"), F.min_by("id", order).alias("a"))
        of_band = F.min(F.struct("id_c", "a")) if turn == 0 else F.max(F.struct("n", "id_c", "a"))
        heads = heads.groupBy("band").agg(of_band.alias("x"), F.sum("n").alias("all"), F.max("n").alias("most")).where("all > most").select("band", F.col("x.a").alias("a"), F.col("x.id_c").alias("a_c"))
        shared = members.join(heads, "band").where("id_c <> a_c").groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("n"))
        if tested is not None:
            shared = shared.join(tested, ["a", "b"], "left_anti")
        # One leader per document and turn: the one with which it shares most bands.
        best = shared.groupBy("b").agg(F.max(F.struct("n", F.negative("a").alias("a"))).alias("x")).select(F.negative("x.a").alias("a"), "b")
        best = stored(best, "stars")
        tested = best if tested is None else tested.unionByName(best)
        near = best.join(side("a"), "a").join(side("b"), "b").where(similar("a_packed", "b_packed", F.col("a_n"), F.col("b_n")))
        found = confirm(near, rows, percent)
        links = found if links is None else links.unionByName(found)
        comps = stored(components(links), "groups")

    members = grouped(buckets, "id")
    sizes = members.join(reps.select("id", "n_shingles"), "id").groupBy("band", "id_c").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).groupBy("band").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.sum("s").alias("s"))
    several = stored(sizes.where("all > most").select("band", "all", F.ceil(F.greatest(F.col("all") / BLOCK, F.least(F.col("s") / BLOCK_SHINGLES, "all"))).cast("int").alias("blocks")), "several")
    pairs = several.agg(F.coalesce(F.sum(F.col("all").cast("double") * F.col("all")), F.lit(0.0))).first()[0] / 2
    tasks = int(min(max(pairs / TASK_PAIRS, docs.sparkSession.sparkContext.defaultParallelism), 100_000))
    own = members.join(several, "band").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = own.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "id_c").join(reps.select("id", "packed", "bands", "n_shingles"), "id")
    # Whole groups come together in a task, in order; many small ones are looked at at once.
    dealt = lambda x: x.repartition(tasks, "band", "i", "j").sortWithinPartitions("band", "i", "j", "id")
    keys = "band long, i int, j int, own int, id long, id_c long"
    near = stored(dealt(met).mapInArrow(_survivors(least, percent), keys), "near")
    ids = stored(near.select(F.col("id").alias("doc_id")).distinct(), "ids")
    with_text = near.join(reps.select("id", "packed", "bands", "n_shingles"), "id").join(with_ids(rows, ids, "left_semi").withColumnRenamed("doc_id", "id"), "id")
    more = stored(dealt(with_text).mapInArrow(_confirmed(least, percent), "a long, b long"), "links")
    links = links.unionByName(more)
    comps = stored(components(links), "groups")

    named_groups = grouped(reps.select(*print_, "id"), "id").select(*print_, F.col("id_c").alias("component_id"))
    alone = sketches.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    grouped_rows = named.select("doc_id", *print_).join(named_groups, print_).select("doc_id", "n_shingles", "component_id")
    return grouped_rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, *, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, with all its columns; of repeated rows (same id and text) one stays, too."""
    dropped = stored(near_duplicates(docs, percent=percent, id_col=id_col, text_col=text_col).where(~F.col("kept")).select("doc_id").distinct(), "dropped")
    named = lambda x: x.select(F.col("doc_id").alias(id_col))
    left = with_ids(docs, named(dropped), "left_anti", id_col)
    repeated = stored(left.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).count().where("count > 1").select("doc_id"), "repeated")
    once = with_ids(left, named(repeated), "left_semi", id_col).dropDuplicates([id_col, text_col])
    return with_ids(left, named(repeated), "left_anti", id_col).unionByName(once) if repeated.head(1) else left


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs that share a shingle: for small tables only.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM w UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.id),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN m ON m.id = w.doc_id
"""
