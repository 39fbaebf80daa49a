"""Cleaning, checks, ranking, metrics, artifacts, sources: guards and small known answers."""

import datetime as dt
import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import analysis as N
from ledgerlens.operators import artifacts as A
from ledgerlens.operators import cleaning as C
from ledgerlens.operators import metrics as M
from ledgerlens.operators import models as L
from ledgerlens.operators import ranking as R
from ledgerlens.operators import validate as V
from ledgerlens.plans import catalogue, testmap
from ledgerlens.sources import tables as T


def raw(spark, **over):
    row = {"id": 1, "date": "2015-03-01 08:15:00", "client_id": 7, "card_id": 70, "merchant_id": 5, "amount": "$-77.00", "mcc": "5411", "errors": "Bad CVV,Bad PIN"} | over
    return spark.createDataFrame([tuple(row.values())], "id long, date string, client_id long, card_id long, merchant_id long, amount string, mcc string, errors string")


def test_clean(spark):
    r = C.clean_transactions(raw(spark), spark.createDataFrame([(1, 1)], "id long, fraud int")).first()
    assert (r.amount, r.is_refund, r.has_error, r.err_bad_cvv, r.err_bad_pin, r.err_bad_zipcode, r.tx_hour, r.weekday, r.fraud) == (-77.0, 1, 1, 1, 1, 0, 8, 6, 1)
    assert C.clean_transactions(raw(spark, errors=None), None).first().has_error == 0
    assert C.clean_transactions(raw(spark, errors=""), None).first().has_error == 1
    assert C.clean_transactions(raw(spark, mcc=None), None).first().mcc == "<NA>"
    assert C.numeric_mcc(raw(spark, mcc="x1")).first().mcc == "<NA>"
    with pytest.raises(Exception, match="doesn't parse"):
        C.clean_transactions(raw(spark, date="03/01/2015"), None).collect()
    with pytest.raises(KeyError):
        C.clean_transactions(raw(spark).drop("mcc"), None)


def test_enrich_guards(spark, sf_dir):
    tx, u, k = testmap.transactions(spark, sf_dir).limit(50), testmap.users(spark, sf_dir), testmap.cards(spark, sf_dir)
    assert C.enrich(tx, u, k).count() <= 50
    with pytest.raises(ValueError, match="unique"):
        C.enrich(tx, u.unionByName(u), k)
    with pytest.raises(Exception, match="MM/YYYY"):
        C.enrich(tx, u, k.where("false")).collect()
    with pytest.raises(Exception, match="YES nor NO"):
        C.enrich(tx, u, k.withColumn("has_chip", F.lit("?"))).select("has_chip").collect()


def test_checks(spark):
    df = spark.createDataFrame([(1, None)], "user_id long, cardid long")
    assert V.rename_keys(df).columns == ["client_id", "card_id"]
    with pytest.raises(KeyError):
        V.rename_keys(df.drop("cardid"))
    with pytest.raises(ValueError):
        V.assert_no_nulls(df, ["cardid"])
    with pytest.raises(ValueError):
        V.assert_same_columns(df, df.drop("cardid"))
    V.assert_same_columns(df, df.select("cardid", "user_id"), ordered=False)
    assert V.column_report(df, ["user_id", "x"]) == {"missing": ["x"], "extra": ["cardid"], "ordered": True}
    assert V.keep_columns(df, {"cardid", "zz"}).columns == ["cardid"]
    assert V.conform(df, {"user_id": "int"}).dtypes == [("user_id", "int")]
    assert V.split_columns(df.select("user_id", F.lit(1).alias("fraud"), F.lit(2).alias("id")))[0] == ["user_id"]


def test_scalars(spark):
    one = spark.range(1)
    pick = lambda e: one.select(e.alias("x")).first().x
    assert pick(S.clipped(F.lit(None).cast("int"))) is None and pick(S.clipped(F.lit(-3))) == 0
    assert pick(S.finite(F.lit(float("inf")))) == 0 and pick(S.finite(F.lit(float("nan")))) == 0
    assert pick(S.parsed_month(F.lit("13/2020"))) is None and pick(S.parsed_month(F.lit("02/2020"))) == 2020 * 12 + 2
    assert abs(pick(S.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) - 20015.09) < 0.1
    assert S.grid(0, 1, 3) == [0, 0.5, 1] and pick(S.number_or_null(F.lit("a"))) is None


def test_quantiles_are_exact(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=1000), np.zeros(700)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    qs = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    assert np.allclose(R.quantiles(df, "v", qs), np.quantile(x, qs))
    assert R.quantiles(spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double"), "v", [0.9]) == [pytest.approx(3.7)]
    assert R.quantiles(df.where("false"), "v", [0.5]) == [None]


def test_metrics(spark):
    df = spark.createDataFrame([(i, y, s) for i, (y, s) in enumerate(zip([1, 0, 1, 0, 0], [0.9, 0.8, 0.8, 0.3, 0.1]))], "id long, label int, score double")
    m = M.rank_metrics(df).first()
    assert m.prauc == pytest.approx(0.833333, abs=1e-6) and m.auc == pytest.approx(0.916667, abs=1e-6)
    t = M.topk(df, [0.4, 0.01]).orderBy("k").collect()
    assert [(r.k, r.precision, r.recall) for r in t] == [(1, 1.0, 0.5), (2, 0.5, 0.5)]
    swept = M.sweep(df, [0.2, 0.6])
    assert M.best_under_recall(swept, 1.1).count() == 0
    assert M.operating_point(swept, 1.1).first().chosen_by == "max_recall_in_grid"
    assert M.pr_point(df, 0.6).first().threshold == 0.8
    assert M.gate(df, 0.8).count() == 3
    assert M.class_weight(df).first().weight == 1.5


@pytest.mark.parametrize("name, fit", [("model_logit_scores", "fit_logit"), ("model_tree_metrics", "fit_trees")])
def test_model_queries_fit_with_the_operators_defaults(name, fit, spark, sf_dir, monkeypatch):
    asked = []
    monkeypatch.setattr(L, fit, lambda train, features, f=getattr(L, fit), **options: asked.append(options) or f(train, features, **options))
    assert catalogue.QUERIES[name](spark, sf_dir).count() and asked == [{}]


def test_artifacts(spark, tmp_path):
    rows = [(i, "a" if i < 30 else "b", 1 if i < 20 else 0, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, mcc string, fraud int, log_abs_amount double")
    fitted = A.fit(df, least=10, times=3.0)
    assert fitted["highrisk_mcc"] == ["a"] and fitted["high_amount_thr"] == pytest.approx(89.1) and fitted["base_rate"] == 0.2
    path = str(tmp_path / "x" / "a.json")
    T.save_artifacts(fitted, path)
    assert T.load_artifacts(path) == fitted
    with pytest.raises(ValueError):
        A.risky_by_quantile(df, least=1000)


def test_split_and_sampling(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0), dt.datetime(2024, 1, 1 + i % 28)) for i in range(500)], "id long, fraud int, date timestamp_ntz")
    n = {(r.fraud, r.is_train): r["count"] for r in N.stratified_split(df, "fraud").groupBy("fraud", "is_train").count().collect()}
    assert n == {(0, 1): 360, (0, 0): 90, (1, 1): 40, (1, 0): 10}
    assert N.rebalanced(df, over=3, under=0.0).count() == 150
    a, b = N.chronological_split(df, "2024-01-10 00:00:00")
    assert a.count() + b.count() == 500 and a.agg(F.max("date")).first()[0] < b.agg(F.min("date")).first()[0]


def test_labels_of_many_documents(spark, tmp_path):
    """All documents of a file count: one a line, one or more over many lines, with blank lines; a cut one is an error."""
    document = lambda *ids, **how: json.dumps({"about": {"of": "} {"}, "target": {str(i): "Yes" if i % 2 else "No" for i in ids}}, **how)
    folder = tmp_path / "all labels"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(document(i, i + 1) for i in range(0, 40, 2)) + "\n\n")
    (folder / "b.json").write_text(document(40, 41, indent=1))
    (folder / "c.json").write_text(document(42, 43, indent=1) + "\n" + document(44) + document(45, indent=1))
    (folder / "d.json").write_text("")
    want = [(i, i % 2) for i in range(46)]
    assert sorted((r.id, r.fraud) for r in T.read_labels(spark, str(folder)).collect()) == want
    (folder / "e.json").write_text(document(46) + "\n" + document(47)[:-3])
    with pytest.raises(Exception, match="(?i)malformed"):
        T.read_labels(spark, str(folder)).collect()


def test_label_map_scan_in_one_partition(spark):
    """All maps in one file, as AQE writes them when they are small."""
    from ledgerlens.plans.operator_queries import QUERIES as queries

    sf_dir = "/root/testdata/sf0.01"
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        got = queries["label_map_scan"](spark, sf_dir).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_label_map_scan_of_odd_events(spark, sf_dir, tmp_path):
    """Ids repeated with one answer and with two, over a map's size; missing ids; props without an answer."""
    import duckdb

    from ledgerlens.plans import operator_queries as O

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    props = F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 5 == 1, "{}").when(F.col("event_id") % 5 == 2, '{"k": null}').otherwise(F.col("props"))
    ids = F.when(F.col("event_id") % 3 == 0, F.lit(None)).when(F.col("event_id") % 3 == 1, -7).otherwise(F.col("event_id"))
    odd = e.unionByName(e).unionByName(e.withColumn("props", F.lit('{"k": 99}'))).unionByName(e.withColumn("props", props)).unionByName(e.withColumn("event_id", ids))
    odd.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = Counter(con.execute(O.SQL["label_map_scan"]).fetchall())
    assert {(0, None), (None, 0), (None, 1), (-7, 0), (-7, 1)} <= set(want)
    assert Counter(map(tuple, O.QUERIES["label_map_scan"](spark, str(tmp_path)).collect())) == want


def test_labels_as_they_are(spark, tmp_path):
    """Every entry of one object or several, or one row per id."""
    path = tmp_path / "labels.json"
    path.write_text('{"target": {"1": "No", "1": "Yes", "2": null,\n" 3 ": "?", "": "Yes"}}\n{"target": {"1": "No"}}')
    got = Counter(map(tuple, T.read_labels(spark, str(path), as_is=True).collect()))
    assert got == Counter({(1, 0): 2, (1, 1): 1, (2, None): 1, (3, 0): 1, (None, 1): 1})
    path.write_text('{"target": {"1": "No", "1": "Yes", "2": null}}\n{"target": {"1": "No"}}')
    assert sorted(map(tuple, T.read_labels(spark, str(path)).collect())) == [(1, 1), (2, 0)]


def test_sources(spark, tmp_path):
    labels = tmp_path / "labels.json"
    labels.write_text(json.dumps({"target": {"1001": "No", "1002": "Yes", "1003": "?"}}))
    assert sorted((r.id, r.fraud) for r in T.read_labels(spark, str(labels)).collect()) == [(1001, 0), (1002, 1), (1003, 0)]
    (tmp_path / "c.csv").write_text("id,v\n1,2\n")
    assert T.read_csv(spark, str(tmp_path / "c.csv"), "id int, v int").first().v == 2
    df = spark.range(3).withColumn("score", F.lit(0.5))
    T.write_scores(df, str(tmp_path / "s"))
    T.write_csv(df, str(tmp_path / "m"))
    T.write_parquet(df, str(tmp_path / "p"))
    assert T.read_parquet(spark, str(tmp_path / "s"), str(tmp_path / "p")).count() == 6


def test_topk_of_equal_scores_and_odd_scores(spark):
    """One score for all: the first by id, in no one task's ranking; and scores that are missing."""
    df = spark.range(20_000).select("id", (F.col("id") % 100 == 0).cast("int").alias("label"), F.lit(0.5).alias("score"))
    got = M.topk(df, [0.001, 0.5, 1.0]).orderBy("k").collect()
    assert [(r.k, round(r.precision * r.k)) for r in got] == [(20, 1), (10_000, 100), (20_000, 200)]
    assert M.topk(df.where("false"), [0.1]).count() == 0
    odd = spark.createDataFrame([(1, 1, 0.9), (2, 0, None), (3, 1, float("nan")), (4, 0, 0.1)], "id long, label int, score double")
    r = M.at_thresholds(odd, spark.createDataFrame([(0.5,), (0.1,)], "threshold double")).orderBy("threshold").collect()
    assert [(x.alerts, x.tp) for x in r] == [(3, 2), (2, 2)]


@pytest.fixture(scope="module")
def learnable(spark):
    r = np.random.default_rng(4)
    rows = [(i, int(a + 0.3 * e > 0.8), float(a), float(b), "uvw"[i % 3] if i % 10 else None) for i, (a, b, e) in enumerate(r.normal(size=(600, 3)).tolist())]
    df = spark.createDataFrame(rows, "id long, fraud int, a double, b double, c string")
    return L.prepared(df.where("id < 400"), ["a", "b"]), L.prepared(df.where("id >= 400"), ["a", "b"]), df


def test_early_stopping_search_and_ablation(learnable):
    train, valid, _ = learnable
    both = train.withColumn("held", F.lit(False)).unionByName(valid.withColumn("held", F.lit(True)))
    stopped = L.fit_trees(both, ["a", "b"], validation="held", maxIter=12, maxDepth=2)
    assert 1 <= stopped.stages[-1].getNumTrees <= 12 and M.rank_metrics(L.score(stopped, valid)).first().auc > 0.9
    space = {"maxDepth": [1, 2], "maxIter": [2, 4]}
    model, log = L.random_search(train, valid, ["a", "b"], space, trials=3, seed=7)
    again = L.random_search(train, valid, ["a", "b"], space, trials=3, seed=7)[1]
    assert log == again and len(log) == 3 and all(x["maxDepth"] in (1, 2) for x in log)
    assert M.rank_metrics(L.score(model, valid)).first().prauc == pytest.approx(max(x["value"] for x in log))
    floor = L.random_search(train, valid, ["a", "b"], space, trials=1, min_recall=0.5)[1][0]["value"]
    assert 0 < floor <= 1
    lost = {r.feature: r.loss for r in L.drop_one(train, valid, ["a", "b"], maxIter=3, maxDepth=2).collect()}
    assert lost["a"] > 0.2 > abs(lost["b"])


def test_importances_and_saved_models(spark, learnable, tmp_path):
    train, valid, _ = learnable
    model = L.fit_trees(train, ["a", "b"], maxIter=4, maxDepth=2)
    trees = {r.feature: r.importance for r in L.tree_importance(model, ["a", "b"], valid).collect()}
    masks = {r.feature: r.importance for r in L.masking_importance(model, valid, ["a", "b"]).collect()}
    assert trees["a"] > trees["b"] and masks["a"] > 0.2 > abs(masks["b"]) and sum(trees.values()) == pytest.approx(1)
    T.save_model(model, str(tmp_path / "m"))
    before, after = ({r.id: r.score for r in L.score(m, valid).collect()} for m in (model, T.load_model(str(tmp_path / "m"))))
    assert before == after


def test_encoders(learnable):
    df = learnable[2]
    known = L.with_unknown(df, ["c"])
    assert {r.c for r in known.select("c").distinct().collect()} == {"u", "v", "w", "UNK"}
    hot = L.one_hot(["c"]).fit(known.where("c <> 'w'")).transform(known)
    assert {tuple(r.c_vec.toArray().tolist()) for r in hot.where("c = 'w'").select("c_vec").collect()} == {(0.0, 0.0, 0.0, 1.0, 0.0)} or hot.where("c = 'w'").first().c_vec.toArray()[:3].sum() == 0
    gaps = df.select(F.when(F.col("id") % 4 != 0, F.col("a")).alias("a"))
    filled = L.imputed(["a"]).fit(gaps).transform(gaps)
    assert filled.where(F.col("a_filled").isNull()).count() == 0
    x = np.array([r.features[0] for r in filled.select("features").collect()])
    assert abs(x.mean()) < 1e-9 and x.std(ddof=1) == pytest.approx(1)
    assert L.baseline_frame(df.withColumnRenamed("c", "mcc").withColumn("date", F.lit(1)).withColumn("amount", F.lit(1))).columns == ["fraud", "a", "b", "mcc"]


def test_reading_what_is_not_there(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    for path in (tmp_path / "none", tmp_path / "empty"):
        with pytest.raises(FileNotFoundError):
            T.read_parquet(spark, str(path))


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    """A copy of the tree without both folders: the entry imports, its queries are the engine's own."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse"))
    for gone in (False, True):
        if gone:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.queries().keys()), len(e.queries()), len(e.oracle_sql()))"], cwd=copy, capture_output=True, text=True, timeout=120)
        assert said.returncode == 0, said.stderr[-500:]
        assert said.stdout.split()[1] == str(len(catalogue.QUERIES))
