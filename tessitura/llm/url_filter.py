"""URL filter: explicit host/path rules first, then a logistic regression on hashed character n-grams.

A rule names a host (with all its subdomains) and a path prefix; the longest
fitting rule decides.  Rules are matched by an equi-join on the host's suffixes,
so a list of millions works like one of five.  Urls without a rule go to the
classifier, which is trained from a small labelled table of hosts and paths.

Defined results: null urls and urls without ``://`` have an empty host and path,
fit no rule and get the classifier's verdict on the empty string; of several
fitting rules of one length the one with the longer host, then the smaller text
wins; repeated pages are judged row by row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, read, register

# The rules of the query, in the order given.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

# The small labelled table (1 = unwanted), host and path as they appear after ``://``.
LABELLED_URLS = (
    ("spam-farm.example.org/en/12", 1), ("www.spam-farm.example.net/offers", 1), ("cheap-pills.example.org/en/450", 1), ("buy-cheap-pills.test/order", 1),
    ("casino-win.example.net/de/7", 1), ("online-casino.test/bonus", 1), ("free-bets.example.net/en/3", 1), ("bets-free.test/odds", 1),
    ("ads-track.example.org/fr/5", 1), ("track-ads.test/click", 1), ("adult-x.example.net/en/8", 1), ("adult-cams.test/xxx", 1),
    ("viagra-pills.test/cheap", 1), ("win-money-casino.test/play", 1), ("link-farm.test/spam", 1), ("seo-spam-links.test/buy", 1),
    ("xxx-adult-videos.test/en/1", 1), ("popup-ads.test/track/9", 1), ("bet-win-free.test/jackpot", 1), ("spam-mailer.test/unsubscribe", 1),
    ("news.example.org/en/12", 0), ("blog.example.net/en/450", 0), ("www.library.test/catalogue/7", 0), ("docs.example.org/fr/3", 0),
    ("wiki.test/en/History", 0), ("university.test/research/paper.html", 0), ("museum.example.net/de/5", 0), ("m.weather.test/forecast", 0),
    ("recipes.example.org/es/8", 0), ("blog.garden.test/2020/05/roses", 0), ("forum.code.test/question/77", 0), ("www.city.test/council/minutes", 0),
    ("theron.example.org/en/300", 0), ("www.thing.example.net/en/41.html", 0), ("tionble.example.org/de/9", 0), ("m.thand.example.net/fr/18", 0),
    ("blog.ther.example.org/en/5?page=2", 0), ("books.test/novel/chapter-3", 0), ("school.test/maths/lesson", 0), ("health.test/advice/sleep", 0),
)
N_FEATURES = 1 << 16


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def ngram_ids(host: str, path: str) -> np.ndarray:
    """Hashed character 3- to 5-grams of ``^host$`` and of the path, kept apart by a prefix."""
    out = set()
    for tag, s in ((b"h", f"^{host}$".encode()), (b"p", path.encode())):
        for n in (3, 4, 5):
            for i in range(len(s) - n + 1):
                out.add(zlib.crc32(tag + s[i : i + n]) % N_FEATURES)
    return np.fromiter(sorted(out), dtype=np.int64, count=len(out))


def fit_logistic(labelled: Iterable[tuple[str, int]], rounds: int = 400, rate: float = 0.5, l2: float = 1e-3) -> np.ndarray:
    """Weights (the last one is the bias) by full gradient descent on the small table."""
    rows = list(labelled)
    feats = [ngram_ids(*_split(u)) for u, _ in rows]
    y = np.array([v for _, v in rows], dtype=np.float64)
    w = np.zeros(N_FEATURES + 1)
    which = np.repeat(np.arange(len(rows)), [len(f) for f in feats]) if rows else np.zeros(0, dtype=np.int64)
    ids = np.concatenate(feats) if rows else np.zeros(0, dtype=np.int64)
    scale = 1.0 / np.sqrt(np.maximum(np.bincount(which, minlength=len(rows)), 1)) if rows else np.zeros(0)
    for _ in range(rounds if rows else 0):
        z = np.bincount(which, weights=w[ids], minlength=len(rows)) * scale + w[-1]
        err = 1 / (1 + np.exp(-z)) - y
        g = np.bincount(ids, weights=(err * scale)[which], minlength=N_FEATURES)
        w[:-1] -= rate * (g + l2 * w[:-1])
        w[-1] -= rate * err.mean()
    return w


def _split(url: str) -> tuple[str, str]:
    host, slash, path = url.partition("/")
    return host, (slash + path).split("?")[0].split("#")[0]


def score_urls(urls: DataFrame, weights: np.ndarray) -> DataFrame:
    """Adds ``p_block`` to a table with columns host and path."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields) + ", p_block double"
    hi, pi = urls.columns.index("host"), urls.columns.index("path")

    def run(batches):
        for b in batches:
            out = np.empty(b.num_rows)
            for i, (h, p) in enumerate(zip(b.column(hi).to_pylist(), b.column(pi).to_pylist())):
                ids = ngram_ids(h or "", p or "")
                z = weights[ids].sum() / np.sqrt(max(len(ids), 1)) + weights[-1]
                out[i] = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "p_block"])

    return urls.mapInArrow(run, schema)


def match_rules(urls: DataFrame, rules: DataFrame, n_rules: int, key: str = "_row") -> DataFrame:
    """Longest fitting rule of each row: key, rule, verdict (rows without one are left out).

    ``rules``: rule (``host/path``), verdict.  Every host suffix is one equi-join key.
    """
    r = rules.where(F.col("rule").isNotNull()).select(
        F.col("rule"), F.col("verdict"), F.substring_index("rule", "/", 1).alias("_suffix"), F.expr("substr(rule, instr(rule, '/'))").alias("_prefix")
    )
    r = checked_broadcast(r, n_rules)
    labels = F.split("host", r"\.", -1)
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    each = urls.where(F.col("host") != "").select(key, "path", F.explode(suffixes).alias("_suffix"))
    fits = each.join(r, "_suffix").where(F.col("path").startswith(F.col("_prefix")))
    best = F.max(F.struct(F.length("rule").alias("a"), F.length("_suffix").alias("b"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict")))
    return fits.groupBy(key).agg(best.alias("_b")).select(key, F.col("_b.rule").alias("rule"), F.col("_b.verdict").alias("verdict"))


def judge_urls(spark: SparkSession, pages: DataFrame, rules=RULES, labelled=LABELLED_URLS) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block for every row of ``pages`` (page_id, url).

    The verdict depends on host and path alone, so each distinct pair is judged
    once and joined back.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    pairs = parts.select("host", "path").distinct().withColumn("_row", F.struct("host", "path"))
    rule_table = spark.createDataFrame(list(rules), "rule string, verdict string")
    matched = match_rules(pairs, rule_table, len(rules)).withColumnRenamed("verdict", "_rule_verdict")
    scored = score_urls(pairs.select("host", "path"), fit_logistic(labelled))
    judged = scored.join(matched.select(F.col("_row.host").alias("host"), F.col("_row.path").alias("path"), "rule", "_rule_verdict"), ["host", "path"], "left")
    verdict = F.coalesce("_rule_verdict", F.when(F.col("p_block") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return parts.join(judged.withColumn("verdict", verdict), ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "p_block")


@register("op9_url_filter")
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge the url of every page."""
    return judge_urls(spark, read(spark, sf_dir, "pages"))
