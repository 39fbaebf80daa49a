"""URL filter, quality model, toxicity and search: held-out accuracy, brute force and odd inputs."""

import re

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import quality_model as Q
from ledgerlens.llm import search as B
from ledgerlens.llm import toxicity as T
from ledgerlens.llm import url_filter as U
from tests.llm.helpers import LOWER, odd_docs, words

LARGE = "/root/testdata/sf0.1"


def test_url_parts_rules_and_odd(spark):
    urls = ["http://A.Net/x", "http://net", "http://net?q", "https://sub.EXAMPLE.net/en/1", "http://example.net/fr/", "http://x.example.com/de/9?a#b", "http://example.org/fr/x", "http://org/fr", "no scheme", None, "", "http://\u0130.net/a", "a://b://c/d", "http://u\nv.net/p\nq?r", "http://xnet/en/"]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, score string")
    got = {r.page_id: r for r in U.judge_urls(df).collect()}
    for i, u in enumerate(urls):
        host, path = U._parts(u or "") if "://" in (u or "") else ("", "")
        fits = [(len(h + p), kind == "block", h + p, kind) for kind, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[2:] if fits else (None, None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, want[0])
        assert got[i].verdict == want[1] if fits else got[i].verdict in ("allow", "block")
    assert got[9].verdict == "allow" and got[1].rule is None and got[0].rule == "net/"
    assert U.judge_urls(df.where("false")).count() == 0


def test_url_model(spark, sf_dir):
    rows = U.op2_url_filter(spark, "/root/testdata/sf0.01").where("rule is null").collect()
    bad = lambda h: any(x in h for x in ("casino", "pills", "bets", "adult", "spam", "ads-"))
    assert np.mean([(r.verdict == "block") == bad(r.host) for r in rows]) > 0.98


def labels(spark, empty=False):
    return spark.createDataFrame([] if empty else [(1, 1, 1), (1, 0, 0), (None, 1, 1), (6, None, None), (7, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality_held_out(spark):
    got = Q.op5_quality_model(spark, LARGE).join(spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id").where("held_out").toPandas()
    for k in (0, 1):
        assert (got[got.quality == k].predicted == k).mean() > 0.9
    assert got.score.between(0, 1).all()


def test_quality_gradients():
    r = np.random.default_rng(0)
    x, sizes, y = r.normal(size=(9, Q.WIDTH)), np.array([2, 3, 4]), np.array([1.0, 0.0, 1.0])
    net = Q.Network.new()
    share = np.full(3, 1 / 3)
    loss = lambda: -(share * (y * np.log(s := net.forward(x, sizes)[0]) + (1 - y) * np.log(1 - s))).sum()
    grads = net.gradients(x, sizes, y, share)
    for k, v in net.parts.items():
        at = tuple(r.integers(0, n) for n in v.shape)
        old, h = v[at], 1e-5
        v[at] = old + h
        up = loss()
        v[at] = old - h
        down = loss()
        v[at] = old
        assert abs((up - down) / (2 * h) - grads[k][at]) < 1e-6


def test_quality_odd(spark):
    for some in (labels(spark), labels(spark, empty=True)):
        got = Q.score_quality(odd_docs(spark), some).collect()
        assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert Q.score_quality(odd_docs(spark, empty=True), labels(spark)).count() == 0


def test_toxicity_held_out(spark):
    got = T.op9_toxicity(spark, LARGE).join(spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got[got.toxic == 0].predicted == 0).mean() > 0.99 and (got[got.toxic == 1].predicted == 1).mean() > 0.88


def test_deobfuscation(spark):
    ch = T.Channel(T.fit_letters(spark.read.parquet(f"{LARGE}/documents.parquet").select("text")))
    for hidden, word in {"1d10t": "idiot", "i.d.i.o.t": "idiot", "iiidiooot": "idiot", "m0r0n": "moron", "st*upid": "stupid", "sc-um": "scum", "tr@sh": "trash", "l0ser": "loser", "p@thet1c": "pathetic", "w0rthl3ss": "worthless", "$tup1d": "stupid"}.items():
        assert word in T.restored_words(hidden, ch), (hidden, T.restored_words(hidden, ch))
    assert list(T._spaced("you i d i o t there a b".split())) == ["i d i o t"] and ch.restore("i d i o t") == "idiot"
    assert T.restored_words("well", ch) == ["well"] and T.restored_words("###", ch) == []


def test_words_behind_leet_signs_doubled_letters_and_punctuation(spark):
    ch = T.Channel(T.fit_letters(spark.read.parquet(f"{LARGE}/documents.parquet").select("text")))
    for hidden, word in {"$tupid": "stupid", "$cum": "scum", "(lown": "clown", "($tupid)": "stupid", "$tupid.": "stupid", "iddioott": "idiot", "mmoorroonn": "moron"}.items():
        assert word in T.restored_words(hidden, ch), (hidden, T.restored_words(hidden, ch))
    for text in ("s c u m.", "\"s c u m\"", "(s c u m)!", "s c u m, and"):
        assert [ch.restore(x) for x in T._spaced(text.split())] == ["scum"]
    for plain in ("well", "letter", "(see", "off)"):
        assert T.restored_words(plain, ch)[0] == plain.strip("()")


def test_toxicity_odd(spark):
    for some in (labels(spark), labels(spark, empty=True)):
        got = T.score_toxicity(odd_docs(spark), some).collect()
        assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    kept = T.reject_toxic(odd_docs(spark), labels(spark, empty=True))
    assert kept.columns == odd_docs(spark).columns and kept.count() == 10
    assert T.score_toxicity(odd_docs(spark, empty=True), labels(spark)).count() == 0


def brute(docs, k):
    """Top k by plain BM25 for every query id divisible by 50."""
    bags = [(i, w) for i, t in docs if (w := words(t.translate(LOWER)))]
    df = {}
    for _, w in bags:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    n, mean = len(bags), sum(len(w) for _, w in bags) / len(bags)
    out = {}
    for q, asked in docs:
        if q % 50 == 0:
            terms, found = set(words(asked.translate(LOWER))), []
            for i, w in bags:
                s = sum(np.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * c * (B.K1 + 1) / (c + B.K1 * (1 - B.B + B.B * len(w) / mean)) for x in terms & set(w) for c in [w.count(x)])
                if s > 0 and i != q:
                    found.append((-round(s, 9), i))
            out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def test_search(spark, sf_dir, duck):
    docs = duck.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()
    want = brute(docs, B.TOP)
    got = B.op7_topk_search(spark, sf_dir).toPandas()
    for q, best in want.items():
        rows = got[got.query_id == q].sort_values("rank")
        assert rows.doc_id.tolist() == [i for i, _ in best] and np.allclose(rows.score, [s for _, s in best])
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    small = B.search(B.build_index(table, shard_chars=60_000), table.where("doc_id % 50 = 0"), block_queries=2).toPandas()
    assert small.sort_values(["query_id", "rank"]).doc_id.tolist() == got.sort_values(["query_id", "rank"]).doc_id.tolist()


def test_search_passes_over_empty_texts(spark):
    """Queries so long that the search ends early, in a short block with empty texts: one between others, one at the end."""
    text = " ".join(f"w{i}" for i in range(400))
    docs = [(i, "" if i in (3, 10) else f"{text} own{i}") for i in range(11)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    index = B.build_index(rows.coalesce(1))
    got = B.search(index, rows.where("doc_id = 0")).toPandas().sort_values("rank")
    best = brute(docs, B.TOP)[0]
    assert got.doc_id.tolist() == [i for i, _ in best] and np.allclose(got.score, [s for _, s in best])
    shard = B.Shard({k: bytes(v) for k, v in index.first().asDict().items()}, 401.0)
    order = shard.ids.tolist()
    assert sorted(order) == list(range(11))
    for k in (5, 10):
        ids, scores = shard.top(shard.terms, np.ones(len(shard.terms)), k, 0)
        assert len(ids) == min(k, 8) and not {3, 10} & set(ids.tolist()) and (scores > 0).all()


def test_search_of_queries_together(spark, monkeypatch):
    """Queries of two vocabularies at once are those alone, with cuts and without, and blocks of the other vocabulary are skipped."""
    r = np.random.default_rng(7)
    word = lambda: int(300 * r.random() ** 3)
    docs = [(i, " ".join(f"{'ab'[i % 2]}{word()}" for _ in range(int(r.integers(1, 200))))) for i in range(900)] + [(900 + i, "the same b1 b2 b3") for i in range(30)]
    index = B.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    row = index.first()
    shard = B.Shard({c: bytes(row[c]) for c in B.ARRAYS}, row.n_words / row.n_texts)
    asked = [*range(0, 900, 50), *range(1, 900, 50), 905]
    idf = np.log(1 + (len(docs) - np.diff(shard.offsets) + 0.5) / (np.diff(shard.offsets) + 0.5))
    at = [shard.places(np.unique(B._term_counts([docs[i][1]])[1])) for i in asked]
    offsets, terms = np.cumsum([0, *map(len, at)]), np.concatenate(at)
    at_once = lambda shard, least, last: shard.best(terms, idf[terms], offsets, 10, asked, least, last)
    n = len(asked)
    got = at_once(shard, np.zeros(n), np.zeros(n, np.int64))
    for i, q in enumerate(asked):
        shard.weight[at[i]] = idf[at[i]]
        scores = shard.scores(np.arange(shard.n))
        shard.weight[at[i]] = 0
        every = sorted((-s, int(d)) for j, s in enumerate(scores) for d in shard.ids[shard.id_offsets[j] : shard.id_offsets[j + 1]] if s > 0 and d != q)
        assert [(-s, d) for d, s in zip(*got[i])] == every[:10]
    least, last = np.array([s[4] for _, s in got]), np.array([d[4] for d, _ in got])
    scored, full = [], B.Shard.scores
    monkeypatch.setattr(B.Shard, "scores", lambda self, docs: scored.append(len(docs)) or full(self, docs))
    monkeypatch.setattr(B, "PART", 50)
    for i, (ids, s) in enumerate(at_once(shard, least, last)):
        assert ids.tolist() == got[i][0][:4].tolist() and s.tolist() == got[i][1][:4].tolist()
    assert sum(scored) <= 6 * n
    # Blocks of the other vocabulary aren't touched: whatever they hold, nothing of them is scored.
    other = np.array([docs[int(shard.ids[shard.id_offsets[d]])][1][0] != "a" for d in shard.doc.tolist()])
    blocks = [b for b in range(0, shard.n - B.BLOCK_DOCS, B.BLOCK_DOCS) if other[b : b + B.BLOCK_DOCS].all()]
    assert len(blocks) > 3
    for b in blocks:
        shard.dense[b : b + B.BLOCK_DOCS] = 1e20
    for a, z, touched in ((0, 18, False), (18, 36, True)):
        scored.clear()
        cut = slice(offsets[a], offsets[z])
        found = shard.best(terms[cut], idf[terms[cut]], offsets[a : z + 1] - offsets[a], 10, asked[a:z], least[a:z], last[a:z])
        assert (sum(scored) > 6 * n) == touched
        assert [ids.tolist() for ids, _ in found] == [ids[:4].tolist() for ids, _ in got[a:z]]


def test_search_odd(spark):
    docs = odd_docs(spark)
    index = B.build_index(docs)
    got = B.search(index, docs).toPandas()
    first = got[got.query_id == 1].sort_values("rank")
    assert first.doc_id.tolist()[:2] == [2, 2] and not got.query_id.isin([3, 4, 5]).any()
    assert B.search(B.build_index(odd_docs(spark, empty=True)), docs).count() == 0
    assert B.search(index, docs.where(F.lit(False))).count() == 0


def test_passages_depend_on_their_own_text_only():
    """Brute force for the counts, and the same numbers alone, between others and over many parts."""
    import random

    r = random.Random(12)
    pick = lambda n: " ".join(r.choice(["Alpha", "beta", "gamma,", "42", "ÜBER", "x" * 700, "\n", "beta beta"]) for _ in range(n))
    some = ["same end\nsame end\nsame end\nsame end", "closing word end", "", " \n ", *(pick(n) for n in (1, 5, 60, 400)), "same end", "y" * 3000, "long text " * 90_000]
    x, sizes = Q.passages(some)
    alone = [Q.passages([t]) for t in some]
    assert sizes.tolist() == [int(s[0]) for _, s in alone] and np.array_equal(x, np.concatenate([a for a, _ in alone]))
    at = 0
    for t, n in zip(some, sizes.tolist()):
        cut = [line[k : k + Q.PASSAGE_BYTES] for line in (t + "\n").encode().splitlines(keepends=True) for k in range(0, len(line), Q.PASSAGE_BYTES)]
        starts = np.cumsum([0, *map(len, cut)])
        n_words = [sum(1 for i in range(a, z) if (t + "\n").encode()[i : i + 1] not in b" \n" and (i == 0 or t.encode()[i - 1 : i] in b" \n")) for a, z in zip(starts[:-1], starts[1:])] if len(t) < 5000 else []
        if n_words:
            want = [np.log1p(w) / 5 for w in n_words if w] or [0.0]
            assert np.allclose(x[at : at + n, Q.WIDTH - Q.HASHED - 6], want) and n == len(want)
        at += n
    seen = Q.WIDTH - Q.HASHED - 2
    assert x[:4, seen].tolist() == [0, 1, 1, 1] and x[4, seen] == 0


def test_quality_scores_do_not_depend_on_partitions(spark, sf_dir):
    docs, some = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = [{r.doc_id: r.score for r in Q.score_quality(docs.repartition(n), some).collect()} for n in (1, 7, 211)]
    assert all(np.allclose([g[i] for i in got[0]], list(got[0].values()), rtol=0, atol=1e-6) for g in got[1:])


def test_quality_fits_on_long_texts_and_a_bounded_sample(spark):
    rows = spark.createDataFrame([(i, ("bad !!! " if i % 2 else "fine words, ") * (40_000 if i < 4 else 30)) for i in range(40)] * 2, "doc_id long, text string")
    some = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in Q.score_quality(rows, some, max_labelled=20, training_passages=5).collect()}
    assert all((s >= 0.5) == (i % 2 == 0) for i, s in got.items())


def test_url_training_table(spark):
    rows = U.default_training()
    by_label = U.held_out_accuracy(rows)
    assert by_label[0] > 0.9 and by_label[1] > 0.7
    table = spark.createDataFrame([*rows, (None, 1), ("http://x.org/", None)], "url string, label int")
    assert sorted(U.labelled(table)) == sorted(rows)
    pages = spark.createDataFrame([(1, "http://free-casino.example.com/x"), (2, "http://village-school.example.com/x")], "page_id long, url string")
    assert [r.verdict for r in U.judge_urls(pages, training=table).orderBy("page_id").collect()] == ["block", "allow"]
    for bad in (table.where("label = 1"), table.where("false")):
        try:
            U.labelled(bad)
            raise AssertionError
        except ValueError:
            pass
    try:
        U.labelled(table, max_training=10)
        raise AssertionError
    except ValueError:
        pass


def test_restore_against_all_paths():
    """The decoder's path is the best of all paths through the lattice, listed one by one."""
    rng = np.random.default_rng(5)
    codes = {c: i + 1 for i, c in enumerate(T.LETTERS)}
    letters = np.log(rng.dirichlet(np.full(64, 0.3), (64, 64)) + 1e-5).astype(np.float32)
    logs = letters.astype(float)

    def paths(token, drops):
        """(text, score) of every way to read the token."""
        found = [("", 0, 0, 0.0)]
        for ch, drop in zip(token, drops, strict=True):
            nxt = []
            for text, a, b, s in found:
                options = [(ch, 0.0)] if ch in codes else [(x, T.LEET_COST) for x in T.LEET.get(ch, "")]
                if ch not in codes:
                    nxt.append((text + " ", 0, 0, s + T.BORDER_COST + (logs[a, b, 0] if b else 0.0)))
                if ch in T.SEPARATORS:
                    nxt.append((text, a, b, s + T.SEPARATOR_COST))
                for x, cost in options:
                    nxt.append((text + x, b, codes[x], s + cost + logs[a, b, codes[x]]))
                    if codes[x] == b:
                        nxt.append((text, a, b, s + cost + drop))
            found = nxt
        return {(t, round(s + (logs[a, b, 0] if b else 0.0), 6)) for t, a, b, s in found}

    for _ in range(400):
        token = "".join(rng.choice(list("abos01!.-"), rng.integers(1, 9)))
        drops = []
        for run in (m[0] for m in re.finditer(r"(.)\1*", token)):
            drops += [len(run)] * len(run)
        repeated = sum(len(m[0]) > 1 and m[0].isalpha() for m in re.finditer(r"(.)\1*", token))
        least = 2 if repeated >= 3 else 3
        every = paths(token, [T.REPEAT_COST if n >= least else T.DOUBLE_COST for n in drops])
        best = max(s for _, s in every)
        assert T.Channel(letters).restore(token) in {t for t, s in every if s >= best - 1e-4}, token
