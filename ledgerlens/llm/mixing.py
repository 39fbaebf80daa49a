"""Mixing sources to target weights: hierarchical budgets over a domain-language-source tree, token prefixes of seeded epochs.

1. A table of the leaves (domain, lang, source) with their tokens; a leaf can give ``max_epochs`` times its tokens.
2. The target (``fraction`` of all tokens) goes down the tree by the siblings' weights. A node never gets more than its
   subtree can give: what it can't take is shared among its siblings by weight (water filling within one parent), and
   only what a whole subtree can't take goes to the siblings of its ancestors, as the same rule held one level above.
3. A leaf's budget is so many whole epochs and a rest. The last, partial epoch is the token prefix, in the order of a
   seeded hash of (seed, epoch, doc_id), that fits into the rest. Prefixes are found from sums by hash bucket, then
   within buckets, so a leaf with a third of all rows is spread over 256 groups; the result per leaf is one cut-off key.
4. Every document finds its copies from its leaf's row: whole epochs, and one more if its key is within the cut-off.

Tokens are words of ``[^\\x20\\x09-\\x0D]+``. Documents without any (null or empty text) can't fill a budget and are left
out. Null languages and sources are the leaf named by an empty text; null ids are hashed as an empty text. Repeated
rows share a key, so all or none of them are in a prefix. An empty table gives no rows. All DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD, stored

LEAF = ("domain", "lang", "source")
FRACTION, MAX_EPOCHS, SEED, DOMAINS = 0.8, 2, 11, 4
#: Weights by path in the tree; a path that isn't named weighs 1.
WEIGHTS: dict[tuple[str, ...], float] = {("domain0",): 4.0, ("domain1",): 3.0, ("domain2",): 2.0, ("domain0", "en"): 3.0, ("domain1", "en"): 2.0, ("domain0", "en", "src0"): 2.0}


def default_domain(source: Column) -> Column:
    """A source's domain: the number at its end, by DOMAINS; without one the first."""
    return F.concat(F.lit("domain"), F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int") % DOMAINS, F.lit(0)).cast("string"))


def leaves_of(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """``docs`` with the leaf's three names (as ``__domain``, ``__lang``, ``__source``)."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.withColumns({"__domain": default_domain(source) if domain is None else domain, "__lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "__source": source})


def _weight(path: tuple[str, ...], weights: Mapping[tuple[str, ...], float]) -> Column:
    out = F.lit(1.0)
    for names, w in weights.items():
        if len(names) == len(path):
            hit = F.lit(True)
            for column, name in zip(path, names):
                hit &= F.col(column) == name
            out = F.when(hit, float(w)).otherwise(out)
    return out


def share(nodes: DataFrame, parent: tuple[str, ...], name: str) -> DataFrame:
    """Water filling: each parent's ``budget`` over its nodes by ``weight``, none above its ``cap``; ``budget`` becomes the node's."""
    by = Window.partitionBy(*parent)
    order = by.orderBy(F.col("cap") / F.col("weight"), name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.col("budget") - before) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    a = nodes.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    b = a.withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(by))
    return b.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.greatest(F.col("level"), F.lit(0.0)) * F.col("weight"))).drop("level", "full", "weight")


def budgets(leaves: DataFrame, *, weights: Mapping[tuple[str, ...], float] = WEIGHTS, fraction: float = FRACTION, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``leaves`` (the names and ``tokens``) with each leaf's whole ``epochs`` and the ``rest`` of its budget."""
    base = leaves.withColumn("cap", F.col("tokens").cast("double") * max_epochs)
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * fraction).cast("double").alias("budget")).first().budget
    above = None
    for depth in range(1, len(LEAF) + 1):
        path = LEAF[:depth]
        nodes = base.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(path, weights))
        if above is None:
            nodes = nodes.withColumns({"budget": F.lit(total), "root": F.lit(0)})
            above = share(nodes, ("root",), path[-1]).select(*path, "budget")
        else:
            above = share(nodes.join(above, list(path[:-1])), path[:-1], path[-1]).select(*path, "budget")
    tokens = F.floor(F.col("budget") + 1e-6).cast("long")
    a = leaves.join(above, list(LEAF)).withColumn("budget", F.least(tokens, F.col("tokens") * max_epochs))
    return a.withColumns({"epochs": F.expr("budget div tokens").cast("int"), "rest": F.col("budget") % F.col("tokens")})


def key(epochs: Column, doc_id: Column, seed: int) -> Column:
    """A document's place in the epoch after the whole ones."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), (epochs + 1).cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def cut_offs(counted: DataFrame, *, weights: Mapping[tuple[str, ...], float] = WEIGHTS, fraction: float = FRACTION, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Per leaf its whole ``epochs`` and the last key (``cut``, null: none) of the partial one; ``counted`` has the names, ``doc_id`` and ``n_tokens``."""
    leaves = stored(counted.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    plan = stored(budgets(leaves, weights=weights, fraction=fraction, max_epochs=max_epochs).select(*LEAF, "epochs", "rest"), "budgets")
    keyed = counted.join(plan, list(LEAF)).where("rest > 0").withColumn("key", key(F.col("epochs"), F.col("doc_id"), seed)).withColumn("bucket", F.substring("key", 1, 2))
    sums = keyed.groupBy(*LEAF, "bucket").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("before", before).drop("n")
    within = F.sum("n_tokens").over(Window.partitionBy(*LEAF, "bucket").orderBy("key").rangeBetween(Window.unboundedPreceding, 0))
    cuts = keyed.join(starts, [*LEAF, "bucket"]).withColumn("until", F.col("before") + within).where("until <= rest").groupBy(*LEAF).agg(F.max("key").alias("cut"))
    return stored(plan.join(cuts, list(LEAF), "left").select(*LEAF, "epochs", "cut"), "cuts")


def copies(rows: DataFrame, cuts: DataFrame, *, seed: int = SEED) -> DataFrame:
    """``rows`` (with the names and ``doc_id``), one for each ``epoch`` that they are in."""
    found = rows.join(cuts, list(LEAF))
    n = F.col("epochs") + F.coalesce((key(F.col("epochs"), F.col("doc_id"), seed) <= F.col("cut")).cast("int"), F.lit(0))
    return found.withColumn("__n", n).where("__n > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n", "epochs", "cut")


def counted(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """The names, ``doc_id`` and ``n_tokens`` of every document with tokens."""
    named = leaves_of(docs.select("doc_id", "text", "lang", "source"), domain)
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return named.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__domain").alias("domain"), F.col("__lang").alias("lang"), F.col("__source").alias("source"), n.alias("n_tokens")).where("n_tokens > 0")


def mix_documents(docs: DataFrame, domain: Column | None = None, *, weights: Mapping[tuple[str, ...], float] = WEIGHTS, fraction: float = FRACTION, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` itself, each row as often as its leaf's epochs and prefix have it; the texts are never shuffled."""
    cuts = cut_offs(stored(counted(docs, domain), "counted"), weights=weights, fraction=fraction, max_epochs=max_epochs, seed=seed)
    held = docs.where(F.col("text").rlike(WORD))
    row = leaves_of(held.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), "doc_id", "lang", "source"), domain)
    named = row.select("__row", "doc_id", F.col("__domain").alias("domain"), F.col("__lang").alias("lang"), F.col("__source").alias("source"))
    return copies(named, cuts, seed=seed).select("__row.*")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents the mix takes, in which epochs."""
    rows = stored(counted(spark.read.parquet(f"{sf_dir}/documents.parquet")), "counted")
    return copies(rows, cut_offs(rows)).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def _weight_sql(path: tuple[str, ...]) -> str:
    hits = [(n, w) for n, w in WEIGHTS.items() if len(n) == len(path)]
    return "CASE " + " ".join("WHEN " + " AND ".join(f"{c} = '{v}'" for c, v in zip(path, n)) + f" THEN CAST({w} AS DOUBLE)" for n, w in hits) + " ELSE CAST(1 AS DOUBLE) END"


def _level_sql(depth: int) -> str:
    path, parent = LEAF[:depth], LEAF[: depth - 1]
    name, by = path[-1], "PARTITION BY " + ", ".join(parent) if parent else ""
    up = f"JOIN b{depth - 1} USING ({', '.join(parent)})" if parent else "CROSS JOIN (SELECT floor(sum(tokens) * CAST(" + str(FRACTION) + " AS DOUBLE)) AS budget FROM leaf) t"
    cols = ", ".join(path)
    return f"""
n{depth} AS (SELECT n.*, budget FROM (SELECT {cols}, sum(CAST(tokens AS DOUBLE) * {MAX_EPOCHS}) AS cap, {_weight_sql(path)} AS weight FROM leaf GROUP BY {cols}) n {up}),
l{depth} AS (SELECT *, (budget - coalesce(sum(cap) OVER ({by} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER ({by} ORDER BY cap / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n{depth}),
b{depth} AS (SELECT {cols}, CASE WHEN cap <= level * weight THEN cap ELSE greatest(max(CASE WHEN cap > level * weight THEN level END) OVER ({by}), 0) * weight END AS budget FROM l{depth})"""


SQL = rf"""
WITH d AS (
  SELECT doc_id, 'domain' || CAST(coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INT) % {DOMAINS}, 0) AS VARCHAR) AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM documents
), c AS (SELECT * FROM d WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM c GROUP BY ALL),
{_level_sql(1)},
{_level_sql(2)},
{_level_sql(3)},
p AS (
  SELECT domain, lang, source, CAST(budget // tokens AS INT) AS epochs, budget % tokens AS rest
  FROM (SELECT leaf.*, least(CAST(floor(budget + 1e-6) AS BIGINT), tokens * {MAX_EPOCHS}) AS budget FROM leaf JOIN b3 USING (domain, lang, source))
), k AS (
  SELECT c.*, epochs, rest, md5('{SEED}:' || CAST(epochs + 1 AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM c JOIN p USING (domain, lang, source)
), r AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE UNBOUNDED PRECEDING) AS until FROM k
)
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(1, epochs + 1 + CASE WHEN rest > 0 AND until <= rest THEN 1 ELSE 0 END)) AS INT) AS epoch FROM r
"""
