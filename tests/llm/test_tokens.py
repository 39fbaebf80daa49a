"""Encoding, packing and token files against the library's own results."""

import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import encoding
from ledgerlens.llm.encoding import WordEncoder
from ledgerlens.llm.packing import encode_pieces, op1_best_fit_packing, place, plan
from ledgerlens.llm.token_files import look_up, op4_token_files, read_token_files, write_token_files
from tests.llm.helpers import LONG, odd_docs

PATH = public_tokenizers.path("word_bpe_49k.json")
ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_memoised_ids_are_the_librarys(plain, duck):
    odd = ["", "A.B, c'd don't DON'T.", "İstanbul ΣΑΣ ß ﬁ", "h\u0331 H\u0331 e\u0301 E\u0301.", "a<|endoftext|>b <|ENDOFTEXT|>", "x\u00a0y\u2003z\u3000w", "12,345.67%", "日本語 テキスト, ok!!", "naïve.,!? ''' \"q\"", "\x1c\x85a b", LONG[:5000], "🙂🙂 a🙂b"]
    some = odd + [t or "" for (t,) in duck.execute("SELECT text FROM documents").fetchall()]
    e = WordEncoder(PATH)
    for _ in range(2):  # the second time from the memo
        for text, ids in zip(some, e.encode(some)):
            assert np.frombuffer(ids, "<u4").tolist() == plain(text), text[:80]


def test_plan_is_tight_and_complete():
    r = random.Random(4)
    for capacity, n in ((10, 200), (100, 3000), (2048, 5000)):
        counts = {}
        for _ in range(n):
            k = min(capacity, max(1, int(r.paretovariate(0.8) * capacity / 40)))
            counts[k] = counts.get(k, 0) + 1
        bins = {}
        for length, parts in plan(counts, capacity).items():
            ends = sorted(p[0] for p in parts) + [counts[length]]
            for (first, start, each, offset), end in zip(sorted(parts), ends[1:]):
                for i in range(first, end):
                    bins.setdefault(start + (i - first) // each, []).append((offset + (i - first) % each * length, length))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        large = sum(c for k, c in counts.items() if 2 * k > capacity)
        assert len(bins) <= max(-(-sum(k * c for k, c in counts.items()) // capacity), large) * 1.02 + 1
    with pytest.raises(ValueError):
        plan({11: 1}, 10)


def test_packing(spark, sf_dir, duck, plain):
    got = op1_best_fit_packing(spark, sf_dir).toPandas()
    texts = dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    for doc, rows in got.groupby("doc_id"):
        ids, rows = [*plain(texts.pop(doc)), 0], rows.sort_values("piece")
        assert rows.start.tolist() == [2048 * k for k in range(-(-len(ids) // 2048))] and rows.piece.tolist() == list(range(len(rows)))
        assert [crc(ids[s : s + n]) for s, n in zip(rows.start, rows.length)] == rows.ids_crc32.tolist() and rows.length.sum() == len(ids)
    assert not texts
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == (rows.length.cumsum() - rows.length).tolist() and rows.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1


def test_packing_odd(spark):
    got = place(encode_pieces(odd_docs(spark), PATH).drop("ids")).toPandas()
    assert sorted(got[got.piece == 0].doc_id.fillna(-1).tolist()) == [-1, 1, 2, 2, 3, 4, 5, 6, 7, 8]
    assert got[got.doc_id.isin([3, 4, 5])].length.tolist() == [1, 1, 1]
    assert place(encode_pieces(odd_docs(spark, empty=True), PATH).drop("ids")).count() == 0


def test_token_files(spark, sf_dir, duck, plain):
    got = op4_token_files(spark, sf_dir).orderBy("doc_id").collect()
    at = 0
    for row, (doc, text) in zip(got, duck.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall(), strict=True):
        ids = [*plain(text), 2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc, at, len(ids), crc(ids))
        at += len(ids)


def test_token_files_odd(spark, tmp_path, plain):
    path = str(tmp_path / "t")
    write_token_files(odd_docs(spark), path, PATH)
    rows = read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8] and rows[4].ids == [2]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    found = look_up(spark, path, [7])
    assert found.first().ids == [*plain("one two"), 2]
    assert "doc_id" in found._jdf.queryExecution().toString().split("PushedFilters")[1][:80]
    write_token_files(odd_docs(spark, empty=True), str(tmp_path / "e"), PATH)
    assert read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_files_have_bloom_filters_and_indexes(spark, tmp_path):
    from pyarrow import orc

    path = tmp_path / "t"
    write_token_files(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")), str(path), PATH)
    f = orc.ORCFile(str(next(path.glob("*.orc"))))
    assert f.row_index_stride == 1000 and f.nstripes >= 1


def test_place_keeps_other_columns(spark):
    rows = spark.range(500).select((F.col("id") % 40 + 1).alias("length"), *(F.col("id").alias(c) for c in ("row", "salt", "rank", "sequence_id", "offset", "doc_id", "piece")))
    got = place(rows, capacity=64).toPandas()
    assert got.columns.tolist() == ["length", "row", "salt", "rank", "doc_id", "piece", "sequence_id", "offset"]
    assert got.row.tolist() == got.salt.tolist() == got["rank"].tolist() and len(got) == 500 and (got.groupby("sequence_id").length.sum() <= 64).all()


def test_plan_against_the_best_possible():
    """All ways to fill bins, for small inputs: seldom one bin more, never two."""
    r = random.Random(10)

    def best(sizes, capacity):
        fewest = [len(sizes)]

        def go(i, bins):
            if len(bins) >= fewest[0]:
                return
            if i == len(sizes):
                fewest[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                    go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
            go(i + 1, [*bins, sizes[i]])

        go(0, [])
        return fewest[0]

    more = 0
    for _ in range(150):
        sizes = sorted((r.randint(1, 20) for _ in range(r.randint(1, 8))), reverse=True)
        parts = plan({n: sizes.count(n) for n in sizes}, 20)
        bins = {start + (k - first) // each for n, p in parts.items() for (first, start, each, _), end in zip(sorted(p), [*(x[0] for x in sorted(p)[1:]), sizes.count(n)]) for k in range(first, end)}
        over = len(bins) - best(sizes, 20)
        assert over in (0, 1)
        more += over
    assert more <= 5


def test_files_hold_bloom_filters(spark, tmp_path):
    """The filter is read, not only written: its streams are there, and an id that no row has reads no row group."""
    path = tmp_path / "t"
    write_token_files(spark.range(30_000).select((F.col("id") * 2).alias("doc_id"), F.lit("a b").alias("text")), str(path), PATH)
    jvm = spark.sparkContext._jvm
    conf = jvm.org.apache.hadoop.conf.Configuration()
    for f in path.glob("*.orc"):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        names = list(reader.getSchema().getFieldNames())
        rows = reader.rows()
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            kinds = {(s.getColumn(), str(s.getKind())) for s in (footer.getStreams(i) for i in range(footer.getStreamsCount()))}
            assert (names.index("doc_id") + 1, "BLOOM_FILTER_UTF8") in kinds and (names.index("doc_id") + 1, "ROW_INDEX") in kinds
        rows.close()


def test_words_that_change_when_lowered(plain):
    """Letters that become a letter and a mark, before signs: their ids aren't those of the letters and of the signs."""
    some = ["ABC\u0130. L\u0130L\u0130, x\u0130!", "\u0958. \u0958!! a\u0958.", "\u00c0\u00c9. \u017f; \u0149! \u03a3\u0391\u03a3. \ufb01."]
    e = WordEncoder(PATH)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(some)] == [plain(x) for x in some]


def test_words_of_many_texts_are_encoded_once(plain, monkeypatch):
    """With a full memo, too, the library gets a word once for many texts, and not again for the signs after it."""
    from ledgerlens.llm import encoding

    monkeypatch.setattr(encoding, "MEMO_WORDS", 0)
    e, got, learn = WordEncoder(PATH), [], WordEncoder._learn
    monkeypatch.setattr(WordEncoder, "_learn", lambda self, words: got.append(len(words)) or learn(self, words))
    some = [f"alpha, beta{'.' * (k % 3)} Gamma {'delta' if k % 2 else 'delta!'}" for k in range(400)]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(some)] == [plain(x) for x in some]
    assert 4 <= sum(got) <= 10


def test_parts_of_a_batch(plain, monkeypatch):
    """Slices by rows and by bytes lose no row and give the library's ids, wherever they begin."""
    import pyarrow as pa

    from ledgerlens.llm import encoding

    some = [f"Wört {k}, naïve. " * (k % 7) + ("<|x|>" if k % 11 == 3 else "") + ("e\u0301" if k % 13 == 5 else "") for k in range(300)]
    monkeypatch.setattr(encoding, "PART_BYTES", 2000)
    monkeypatch.setattr(encoding, "PART_ROWS", 40)
    for kind in (pa.string(), pa.large_string()):
        cut = list(encoding.parts(pa.RecordBatch.from_arrays([pa.array(some, kind)], names=["text"])))
        assert max(x.num_rows for x in cut) <= 40 and len(cut) > 8 and [t for x in cut for t in x.column("text").to_pylist()] == some
        e = WordEncoder(PATH)
        assert [np.frombuffer(i, "<u4").tolist() for x in cut for i in e.encode(x.column("text"))] == [plain(x) for x in some]
    assert list(encoding.parts(pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["text"]))) == []


def test_tokenizers_of_another_kind_see_whole_texts(tmp_path):
    """A pre-splitting that keeps the blank before a word: words alone would get other ids."""
    from tokenizers import models, pre_tokenizers

    other = Tokenizer(models.BPE({c: i for i, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}, []))
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    other.save(str(tmp_path / "t.json"))
    some = ["Two words", "", " one", "A.B  c"]
    assert [np.frombuffer(x, "<u4").tolist() for x in WordEncoder(str(tmp_path / "t.json")).encode(some)] == [other.encode(x, add_special_tokens=False).ids for x in some]


_WORKER = """
import random, re, sys
import pyarrow as pa
from pathlib import Path
from ledgerlens.llm.encoding import encoder
from ledgerlens.llm.memos import forget
from ledgerlens.llm.packing import _cut
anon = lambda: int(re.search(r"Anonymous:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) // 1024
most = lambda: int(re.search(r"VmHWM:\\s+(\\d+)", Path("/proc/self/status").read_text())[1]) // 1024
resident = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", Path("/proc/self/status").read_text())[1]) // 1024
rng = random.Random(7)
text = lambda: " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(1200))
batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([text() for _ in range(1000)])], names=["doc_id", "text"])
next(_cut(sys.argv[1], 2048, 0)(iter([batch.slice(0, 1)])))
forget()
before, started = anon(), resident()
Path("/proc/self/clear_refs").write_text("5")
for out in _cut(sys.argv[1], 2048, 0)(iter([batch])):
    assert out.num_rows
print(len(encoder(sys.argv[1]).memo), most() - started)
del out
forget()
print(anon() - before)
"""


def test_a_worker_encodes_in_bounded_memory_and_gives_it_back():
    run = subprocess.run([sys.executable, "-c", _WORKER, PATH], cwd=ROOT, capture_output=True, text=True, check=True)
    words, peak, left = map(int, run.stdout.split())
    assert words <= encoding.MEMO_WORDS + 1
    assert peak < 260, "MB beside the texts, 8 MB"
    assert left < 60, "MB that stay after the task"
