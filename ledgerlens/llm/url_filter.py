"""URL filter: rules first, then a logistic regression on hashed character n-grams of host and path.

``split_url`` takes the host (A-Z lower-cased) and the path by plain text rules. ``rule_columns`` compiles the rules:
a rule fits its host and all subdomains if the path starts with the rule's path; the longest fitting rule (host and
path together) wins, of equally long ones a blocking one. Where no rule fits, the model decides: weights over
hashed n-grams of host and path, fitted on a small labelled URL table (at most ``max_training`` rows; ``url, label``).
Without a table of the caller's, ``default_training`` makes one from two lists of site names and from invented names, which
ordinary sites often have. ``held_out_accuracy`` fits on some sites of a table and judges the others.

Nulls: a null URL, or one without ``://``, has an empty host and path; with nothing to judge, it is allowed (score 0).
Repeated rows are judged alike; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import LOWER, UPPER, ship

BUCKETS, SIZES, MAX_TRAINING = 1 << 15, (3, 4, 5), 10_000
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The default labelled table: site names by kind, general words, and syllables of invented names.
BLOCKED_SITES = (
    "casino-royal best-casino online-casino-bonus casino-games live-casino poker-slots jackpot-city lucky-slots mega-slots bet-now sports-bets bets-online free-bets big-bet "
    "pills-shop buy-pills cheap-pills diet-pills online-pharmacy cheap-meds viagra-store adult-cams hot-adult adult-dating adult-movies adult-chat xxx-videos x-rated sex-chat "
    "link-farm spam-links spam-farm seo-spam track-ads ads-track ad-tracker ads-network click-ads pixel-track banner-ads popup-ads payday-loans fast-loans quick-cash "
    "free-money get-rich crypto-win replica-watches warez-crack serial-keygen torrent-free malware-drop phish-login"
).split()
ALLOWED_SITES = (
    "news daily-news city-library university open-data weather recipes garden-club history-museum physics-notes python-docs wiki travel-guide "
    "school math-forum book-review health-info local-council science-blog music-theory photo-club bike-repair cooking train-times research-lab "
    "poetry art-gallery film-archive language-course hiking-trails birdwatching chess-club astronomy-today farm-shop tractor-parts winter-sports "
    "theatre weather-maps stories ocean bakery carpenter village-hall lighthouse orchard pottery museum-friends river-cruise "
    "zeitung gemeinde bibliothek wetterdienst kochbuch bahnhof journal mairie musique voyage cuisine jardin periodico ayuntamiento biblioteca montana viaje"
).split()
SYLLABLES = "ba be bri ca cor da del dor e fa fen gar ha hal i ka kel la lin lor ma mer mi na nor o pa per ra ren ro sa sen sol ta tel ther tor u va ver win ya zen".split()
INVENTED, COMBINED = 200, 4
#: Words that go with either kind, so that they tell nothing.
MODIFIERS = "best online free cheap city club shop now live my top world daily club24 hub zone".split()
BLOCKED_WORDS = "casino poker slots bets jackpot roulette pills meds pharmacy viagra adult sex porn xxx cams spam ads popup tracker clicks loans payday warez cracks keygen torrents phishing malware replica".split()
ALLOWED_WORDS = "news library weather recipes garden history physics docs travel school math books health council science music photos bikes cooking trains research poetry gallery films languages hiking birds chess astronomy farm tractors sports maps stories bakery pottery".split()


def default_training() -> list[tuple[str, int]]:
    """Labelled URLs (1: to block) from the two lists and of invented names, on several hosts and paths."""
    r = np.random.default_rng(11)
    invented = ["".join(r.choice(SYLLABLES, n)) for n in r.integers(2, 5, INVENTED)]
    out = []
    def combined(words: Sequence[str]) -> list[str]:
        return [f"{a}-{w}" if i % 2 else f"{w}-{a}" for w in words for i, a in enumerate(r.choice(MODIFIERS, COMBINED, replace=False))]

    for label, sites in ((1, [*BLOCKED_SITES, *combined(BLOCKED_WORDS)]), (0, [*ALLOWED_SITES, *combined(ALLOWED_WORDS), *invented])):
        for k, site in enumerate(sites):
            prefix, end, path = ("", "www.", "m.", "blog.")[k % 4], ("com", "net", "org")[k % 3], ("/en/{}", "/fr/{}/", "/de/{}.html", "/{}")[(k // 2) % 4]
            out += [(f"http://{prefix}{site}.example.{end}{path.format(1000 + 37 * k)}", label), (f"https://{site}.{('org', 'com', 'net')[k % 3]}{path.format(3 * k)}", label)]
    return out


def labelled(training: DataFrame | Sequence[tuple[str, int]] | None, max_training: int = MAX_TRAINING) -> list[tuple[str, int]]:
    """The labelled table as rows; a null URL or label is left out, more than ``max_training`` rows are an error, as is a table without both kinds."""
    if training is None:
        training = default_training()
    elif isinstance(training, DataFrame):
        training = [(r.url, r.label) for r in training.select("url", F.col("label").cast("int").alias("label")).where("url is not null and label in (0, 1)").limit(max_training + 1).collect()]
    rows = sorted(training)
    if len(rows) > max_training:
        raise ValueError(f"the labelled table has more than {max_training} rows")
    if len({y for _, y in rows}) < 2:
        raise ValueError("the labelled table needs rows of both kinds")
    return rows


def held_out_accuracy(training: Sequence[tuple[str, int]], *, folds: int = 5, threshold: float = 0.5) -> dict[int, float]:
    """By label, the share of right verdicts on sites that the fit has not seen: each fold of the sites is judged by a fit on the others."""
    site = lambda u: max(_parts(u)[0].removeprefix("www.").removeprefix("blog.").removeprefix("m.").split("."), key=lambda x: (x != "example", len(x)))
    fold, right = [zlib.crc32(site(u).encode()) % folds for u, _ in training], {0: [], 1: []}
    for f in range(folds):
        weights, bias = fit([t for t, g in zip(training, fold) if g != f])
        mine = [t for t, g in zip(training, fold) if g == f]
        if mine:
            for (_, y), s in zip(mine, score(*zip(*(_parts(u) for u, _ in mine)), weights, bias)):
                right[y].append((s >= threshold) == (y == 1))
    return {y: float(np.mean(x)) for y, x in right.items()}


def split_url(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as ``host/path`` text, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def ngrams(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every hashed n-gram; hosts and paths have separate n-grams, with marks at their ends."""
    fields = [b"\x01" + h.encode() + b"\x02" if h else b"" for h in hosts] + [b"\x03" + p.encode() + b"\x04" if p else b"" for p in paths]
    lengths = np.array([len(f) + 1 for f in fields], np.int64)
    raw = np.frombuffer(b"\x00".join(fields) + b"\x00", np.uint8).astype(np.uint64)
    field = np.repeat(np.arange(len(fields)), lengths)
    breaks = np.cumsum(raw == 0)
    rows, buckets = [], []
    for n in SIZES:
        if len(raw) < n:
            continue
        h = np.full(len(raw) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h * np.uint64(0x100000001B3)) ^ raw[k : len(raw) - n + 1 + k]
        whole = (breaks[n - 1 :] == breaks[: len(breaks) - n + 1]) & (raw[: len(h)] != 0)
        own = field[: len(h)][whole]
        h = (h[whole] * np.uint64(2) + (own >= len(hosts)).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        rows.append(own % len(hosts))
        buckets.append((h >> np.uint64(49)).astype(np.int64) % BUCKETS)
    return (np.concatenate(rows), np.concatenate(buckets)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def score(hosts: Sequence[str], paths: Sequence[str], weights: np.ndarray, bias: float) -> np.ndarray:
    rows, buckets = ngrams(hosts, paths)
    n = np.bincount(rows, minlength=len(hosts))
    z = np.bincount(rows, weights=weights[buckets], minlength=len(hosts)) / np.sqrt(np.maximum(n, 1)) + bias
    return np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -40, 40))), 0.0)


def _parts(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    after = rest[cut:]
    return rest[:cut].translate(str.maketrans(UPPER, LOWER)), after[: min((i for i in map(after.find, "?#") if i >= 0), default=len(after))]


def fit(training: Sequence[tuple[str, int]], *, l2: float = 0.02, steps: int = 400, rate: float = 2.0) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent with momentum on the labelled table; both classes weigh the same."""
    hosts, paths = zip(*(_parts(u) for u, _ in training))
    y = np.array([label for _, label in training], float)
    rows, buckets = ngrams(hosts, paths)
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(y)), 1))
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b, vw, vb = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS), 0.0
    for _ in range(steps):
        z = np.bincount(rows, weights=w[buckets], minlength=len(y)) * scale + b
        g = share * (1 / (1 + np.exp(-z)) - y)
        vw = 0.9 * vw - rate * (np.bincount(buckets, weights=(g * scale)[rows], minlength=BUCKETS) + l2 / len(y) * w)
        vb = 0.9 * vb - rate * 0.1 * g.sum()
        w, b = w + vw, b + vb
    return w, b


def _judge(weights: np.ndarray, bias: float):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            s = score(b.column("host").to_pylist(), b.column("path").to_pylist(), weights, bias) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, "score"])

    return run


def judge_urls(
    pages: DataFrame, *, rules: Sequence[tuple[str, str, str]] = RULES, training: DataFrame | Sequence[tuple[str, int]] | None = None, max_training: int = MAX_TRAINING, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row; ``score`` is the model's, whatever the rules say."""
    ship(pages.sparkSession)
    weights, bias = fit(labelled(training, max_training))
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    scored = rows.mapInArrow(_judge(weights.astype(np.float32), bias), "page_id long, host string, path string, score double")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's URL."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
