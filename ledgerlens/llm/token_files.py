"""Token-id files: ORC with integer run-length encoding, row indexes and Bloom filters on document ids.

``write_token_files`` encodes every whole text, appends the end id and writes one row per document in ascending
order of ``doc_id``: ``doc_id``, ``ids`` (an int array, which ORC stores run-length encoded), ``n_tokens``,
``shard`` (the number of the file's range) and ``shard_start`` (ids before it in the shard). ORC's own writer
keeps stripes, a row index every ``row_index_stride`` rows and a Bloom filter on ``doc_id``, so that readers split
files by stripes and a look-up by ``doc_id`` skips files, stripes and row groups by their metadata.

The documents are dealt out by ranges of (doc_id, hash of the text), so neither repeated nor null ids form one
large range. Nulls: a null text is empty (only the end id); a null ``doc_id`` sorts first and is kept. Repeated
rows are all written. An empty table gives an empty folder of files with the same schema. Other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import new_path, ship, stored, texts

SCHEMA = "doc_id long, ids array<int>, n_tokens int, shard int, shard_start long"
END_ID = 2


def _encode_range(path: str, end_id: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from ledgerlens.llm.encoding import encoder, parts

        enc, shard, start = encoder(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for part in parts(whole):
                ids, ends = enc.encode_column(part.column("text"))
                n = np.diff(ends, prepend=0).astype(np.int32) + 1
                ids, ends = np.insert(ids, ends, end_id).view("<i4"), np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), lists, pa.array(n, pa.int32()), pa.array(np.full(len(n), shard, np.int32)), pa.array(start + ends[:-1])],
                    names=["doc_id", "ids", "n_tokens", "shard", "shard_start"],
                )
                start += int(ends[-1])

    return run


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = END_ID, stripe_mb: int = 64, row_index_stride: int = 1000, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode ``docs`` and write them as ORC under ``path`` (see the module's text)."""
    ship(docs.sparkSession)
    rows = texts(docs, id_col, text_col)
    tie = F.xxhash64("text").alias("tie")
    dealt = rows.select("doc_id", tie, "text").repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    (
        dealt.mapInArrow(_encode_range(tokenizer_path, end_id), SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(row_index_stride))
        .option("orc.stripe.size", str(stripe_mb << 20))
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``: the ids of all documents before, over all shards.

    One row per shard gives the shards' starts; that table has as many rows as there are files. It is written first, so
    that the planner knows its size and, while it is small, joins it without a shuffle of the ids.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    shards = rows.groupBy("shard").agg(F.max(F.col("shard_start") + F.col("n_tokens")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(stored(shards.select("shard", before.alias("base")), "shards"), "shard").select("doc_id", "ids", "n_tokens", (F.col("base") + F.col("shard_start")).alias("start"))


def look_up(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents; the filter reaches the files' statistics, row indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def _checksums(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    from ledgerlens.llm.memos import forget

    forget()
    for b in batches:
        lists = b.column("ids")
        raw, ends = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), "<i4").tobytes(), 4 * np.cumsum([0, *b.column("n_tokens").to_pylist()])
        crc = [zlib.crc32(raw[a:z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens").cast(pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids as ORC files, read the files back and digest each document's ids."""
    import public_tokenizers

    path = new_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path).mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
