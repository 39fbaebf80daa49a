"""Near-duplicates and components against brute force, and the whole pipeline."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import near_dedup as D
from ledgerlens.llm.graph import components
from ledgerlens.llm.secret_scan import MASK
from ledgerlens.llm.shingles import minima, mix, shingle_sets
from tests.llm.helpers import groups, odd_docs, shingles


def check(got, docs):
    comp, n = groups(docs)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (n[r.doc_id], comp[r.doc_id], comp[r.doc_id] == r.doc_id)


def test_whole_table(spark, sf_dir, duck):
    docs = duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    got = D.op10_near_dedup(spark, sf_dir).collect()
    assert len(got) == len(docs)
    check(got, docs)


def test_family_at_the_threshold(spark):
    """Copies with one to three edits each, many pairs just above and below the threshold."""
    r = random.Random(6)
    base = [f"w{i}" for i in range(130)]
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(1, 3)):
            w[r.randrange(len(w))] = f"edit{r.random()}"
        docs.append((i * 3, " ".join(w)))
    docs += [(i * 3 + 1, docs[i][1].upper()) for i in range(0, 150, 7)] + [(999, ""), (998, "a b"), (997, "A  b\n")]
    r.shuffle(docs)
    check(D.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


def test_stage_links_from_80_percent(spark, duck):
    """Copies whose similarity lies between 0.80 and 0.85, and the whole small table."""
    r = random.Random(9)
    docs = []
    for i in range(60):
        w = [f"t{i}w{j}" for j in range(100)]
        edited = list(w)
        for at in r.sample(range(2, 98), r.randint(1, 3)):
            edited[at] = f"edit{r.random()}"
        docs += [(10 * i, " ".join(w)), (10 * i + 1, " ".join(edited))]
    docs += [(10_000 + i, t) for i, t in duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()]
    kept = {i: {x for x, c in groups(docs, i)[0].items() if x == c} for i in (80, 85)}
    assert len(kept[80]) < len(kept[85]) - 10
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {x.doc_id for x in got.collect()} == kept[80]


def test_bands_and_margin_follow_the_threshold():
    assert D.banding(85) == (30, 6) and D.margin(85) == D.MARGIN and D.banding(80) == (36, 5)
    for percent in range(10, 101):
        bands, rows = D.banding(percent)
        assert bands * rows == D.HASHES and (1 - (percent / 100) ** rows) ** bands <= D.MISSED
    match = 0.8 + 0.2 / 16
    assert D.margin(80) >= 5 * (match * (1 - match) / D.HASHES) ** 0.5 * 16 / 15


def test_sets_and_estimates():
    texts = ["", "a", "A\tb", "a b c d e", "a b c d e f a b c d e", "É é x y z w \x0b v"]
    assert [len(s) for s in shingle_sets(texts)] == [len(shingles(t)) for t in texts]
    assert [s.tolist() for s in shingle_sets(texts)] == [s.tolist() for t in texts for s in shingle_sets([t])]
    r = np.random.default_rng(1)
    x = mix(r.integers(0, 1 << 62, 1000, dtype=np.uint64))
    low = minima([np.sort(x[:900]), np.sort(x[100:])], 2000)
    assert abs((low[0] == low[1]).mean() - 0.8) < 0.05


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in parent if x not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd(spark):
    got = D.near_duplicates(odd_docs(spark)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.component_id, r.kept))
    assert len(got) == 10 and by[2] == [(1, False)] * 2 and by[None] == [(None, True)] and by[3] == [(3, True)]
    kept = D.drop_near_duplicates(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
    assert D.near_duplicates(odd_docs(spark, empty=True)).count() == 0 and D.drop_near_duplicates(odd_docs(spark, empty=True)).count() == 0
    twice = odd_docs(spark).where("doc_id = 7")
    assert D.drop_near_duplicates(twice.unionByName(twice)).count() == 1


def stages(spark, docs, sf_dir, tmp_path):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], sf_dir).write.parquet(str(tmp_path / name))
        out.append(spark.read.parquet(str(tmp_path / name)))
    return out


def test_pipeline_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw, clean, single, masked, mixed, packed = stages(spark, docs, sf_dir, tmp_path)
    assert all(x.columns == docs.columns for x in (clean, single, masked, mixed))
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 0").collect()}
    gone = {r.doc_id for r in raw.select("doc_id").subtract(clean.select("doc_id")).collect()}
    assert gone and len(gone & toxic) <= 3
    comp, _ = groups([(r.doc_id, r.text or "") for r in clean.collect()])
    assert {r.doc_id for r in single.collect()} == {i for i, c in comp.items() if i == c}
    before, after = ({r.doc_id: r for r in x.collect()} for x in (single, masked))
    assert before.keys() == after.keys()
    changed = [i for i in before if before[i].text != after[i].text]
    assert changed and all(MASK in after[i].text and after[i].n_chars == len(after[i].text) for i in changed)
    assert {r.doc_id for r in mixed.collect()} <= before.keys()
    pieces = packed.toPandas()
    assert (pieces.groupby("sequence_id").length.sum() <= 2048).all()
    assert len(pieces[pieces.piece == 0]) == mixed.count()


def test_pipeline_odd(spark, sf_dir, tmp_path):
    out = stages(spark, odd_docs(spark), sf_dir, tmp_path / "a")
    assert out[1].count() == 10 and out[2].count() == 8 and out[-1].count() >= 1
    assert stages(spark, odd_docs(spark, empty=True), sf_dir, tmp_path / "b")[-1].count() == 0


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.where(F.col("sequence_id").isNull()).count() == 0 and got.count() > 0
