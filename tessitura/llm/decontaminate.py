"""Benchmark decontamination over a distributed positional inverted index.

The index stores one posting (term, document, position) for every document
token that is a term of the benchmark.  A benchmark window (10 consecutive words
of an item, or the whole of a shorter item) is looked up from its rarest terms:
the postings of the rarest term, moved back by the term's offset in the window,
give the possible starts; they are intersected with the postings of the second
rarest term, moved back likewise; what is left is compared word by word with the
document.  Only DataFrame functions are used.

Everything of the benchmark is broadcast only after its rows were counted; a
larger benchmark is joined by shuffles.  Frequent terms never gather anywhere:
postings are joined on (term, document, position).

Defined results: null and empty texts have no words; an item without words has
no window and one with fewer than 10 is a single window; items with a null id
mark words but are not listed; repeated ids of items count once; repeated
documents are judged row by row; null doc_ids too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize, read, register

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
_NO_ID = -(1 << 63)


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, cut at ASCII characters other than letters and digits."""
    # lower() has a fast path for ASCII, where it is the same as the translation
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(low, SEPARATORS), ""), F.array().cast("array<string>"))


@dataclass
class Windows:
    """Distinct benchmark windows (win, words, n) and the items they come from (win, item_id)."""

    windows: DataFrame
    items: DataFrame
    n_windows: int


@dataclass
class PositionalIndex:
    """Written postings (term, doc, pos) and the terms' collection frequencies (term, freq)."""

    postings: DataFrame
    frequencies: DataFrame
    n_terms: int


def benchmark_windows(benchmark: DataFrame, length: int = WINDOW) -> Windows:
    tokens = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1)))
    each = tokens.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.expr(f"slice(w, i, {length})").alias("words"))
    each = materialize(each.select("item_id", "words", F.sha2(F.array_join("words", " "), 256).alias("win")), "decon-windows")
    distinct = each.dropDuplicates(["win"]).select("win", "words", F.size("words").alias("n"))
    distinct = materialize(distinct, "decon-distinct")
    items = each.where(F.col("item_id").isNotNull()).select("win", "item_id").distinct()
    return Windows(distinct, items, distinct.count())


def build_index(docs: DataFrame, windows: Windows) -> PositionalIndex:
    """One pass over the documents: postings of all benchmark terms, written to the shared folder."""
    vocabulary = materialize(windows.windows.select(F.explode("words").alias("term")).distinct(), "decon-terms")
    n_terms = vocabulary.count()
    tokens = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.posexplode(words(F.col("text"))).alias("pos", "term"))
    postings = materialize(tokens.join(checked_broadcast(vocabulary, n_terms), "term").select("term", "doc", "pos"), "decon-postings")
    frequencies = materialize(postings.groupBy("term").agg(F.count(F.lit(1)).alias("freq")), "decon-freq")
    return PositionalIndex(postings, frequencies, n_terms)


def rarest_terms(windows: Windows, index: PositionalIndex) -> DataFrame:
    """win, n, t1, o1, t2, o2: the two rarest terms and their offsets (t2 null in windows of one word).  Windows with an unseen term go."""
    terms = windows.windows.select("win", "n", F.posexplode("words").alias("off", "term"))
    known = terms.join(checked_broadcast(index.frequencies, index.n_terms), "term")
    ranked = known.groupBy("win", "n").agg(F.array_sort(F.collect_list(F.struct("freq", "off", "term"))).alias("r")).where(F.size("r") == F.col("n"))
    second = F.try_element_at("r", F.lit(2))
    return ranked.select("win", "n", F.col("r")[0]["term"].alias("t1"), F.col("r")[0]["off"].alias("o1"), second["term"].alias("t2"), second["off"].alias("o2"))


def phrase_candidates(windows: Windows, index: PositionalIndex) -> DataFrame:
    """win, doc, start: where the two rarest terms of a window stand at the right distance."""
    plan = materialize(rarest_terms(windows, index), "decon-plan")
    n_plan = plan.count()
    first = index.postings.join(checked_broadcast(plan.withColumnRenamed("t1", "term"), n_plan), "term")
    first = first.select("win", "doc", (F.col("pos") - F.col("o1")).alias("start"), "t2", "o2").where(F.col("start") >= 0)
    single = first.where(F.col("t2").isNull()).select("win", "doc", "start")
    seconds = plan.where(F.col("t2").isNotNull()).select(F.col("t2").alias("term")).distinct()
    second = index.postings.join(checked_broadcast(seconds, n_plan), "term", "left_semi")
    both = first.where(F.col("t2").isNotNull()).withColumn("pos", F.col("start") + F.col("o2")).withColumnRenamed("t2", "term")
    return single.unionByName(both.join(second, ["term", "doc", "pos"], "left_semi").select("win", "doc", "start"))


def proximity_candidates(windows: Windows, index: PositionalIndex, slop: int) -> DataFrame:
    """win, doc, start: every other term of the window stands within ``slop`` words of where the phrase would have it.

    Postings are cut into stretches of ``slop + 1`` positions, so the range
    condition becomes an equi-join on (term, doc, stretch) with three keys a row.
    """
    plan = rarest_terms(windows, index).select("win", "n", "t1", "o1")
    starts = index.postings.join(plan.withColumnRenamed("t1", "term"), "term").select("win", "n", "o1", "doc", (F.col("pos") - F.col("o1")).alias("start"))
    if_all = starts.join(windows.windows.select("win", F.posexplode("words").alias("off", "term")), "win").where(F.col("off") != F.col("o1"))
    width = slop + 1
    want = if_all.withColumn("at", F.col("start") + F.col("off")).withColumn("cell", F.floor(F.col("at") / width))
    want = want.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    have = index.postings.withColumn("cell", F.floor(F.col("pos") / width))
    near = want.join(have, ["term", "doc", "cell"]).where(F.abs(F.col("pos") - F.col("at")) <= slop)
    met = near.groupBy("win", "doc", "start", "n").agg(F.count_distinct("off").alias("met")).where(F.col("met") == F.col("n") - 1)
    return met.select("win", "doc", "start").unionByName(starts.where(F.col("n") == 1).select("win", "doc", "start"))


def _covered(occurrences: Column) -> Column:
    """Number of positions covered by (start, n) intervals sorted by start."""
    zero = F.struct(F.lit(0).cast("int").alias("end"), F.lit(0).cast("long").alias("hit"))

    def step(acc, o):
        stop = (o["start"] + o["n"]).cast("int")
        more = F.greatest(stop - F.greatest(o["start"], acc["end"]), F.lit(0)).cast("long")
        return F.struct(F.greatest(acc["end"], stop).alias("end"), (acc["hit"] + more).alias("hit"))

    return F.aggregate(occurrences, zero, step, lambda a: a["hit"])


def judge_rows(docs: DataFrame, windows: Windows, kept: Column) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): _kept (any columns of the row), _text, n_words, occurrences (start, n, win) in its own text."""
    index = build_index(docs, windows)
    found = phrase_candidates(windows, index).join(checked_broadcast(windows.windows, windows.n_windows), "win")
    by_doc = found.groupBy("doc").agg(F.collect_set(F.struct("start", "n", "win", "words")).alias("cand"))
    keyed = docs.select(kept.alias("_kept"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.col("text").alias("_text"))
    tokens = keyed.join(by_doc, "doc", "left").select("_kept", "_text", words(F.col("_text")).alias("w"), "cand")
    true = F.filter("cand", lambda c: F.slice("w", c["start"] + 1, c["n"]) == c["words"])
    sorted_ = F.array_sort(F.transform(true, lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), c["win"].alias("win"))))
    return tokens.select("_kept", "_text", F.size("w").cast("long").alias("n_words"), F.coalesce(sorted_, F.array().cast("array<struct<start:int,n:int,win:string>>")).alias("occurrences"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` whose own text holds no benchmark window, all columns unchanged."""
    others = [c for c in docs.columns if c != "text"]
    judged = judge_rows(docs, benchmark_windows(benchmark, length), F.struct(*[F.col(f"`{c}`") for c in others]))
    clean = judged.where(F.size("occurrences") == 0)
    return clean.select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_kept.`{c}`") for c in docs.columns])


def find_contamination(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, items (sorted strings), occurrences (start, n, win)."""
    windows = benchmark_windows(benchmark, length)
    hits = judge_rows(docs, windows, F.col("doc_id")).select(F.col("_kept").alias("doc_id"), "n_words", "occurrences")
    hits = materialize(hits.withColumn("_row", F.monotonically_increasing_id()), "decon-hits")
    wins = hits.where(F.size("occurrences") > 0).select("_row", F.explode(F.array_distinct(F.transform("occurrences", lambda o: o["win"]))).alias("win"))
    named = wins.join(windows.items, "win").select("_row", F.col("item_id").cast("string").alias("item")).distinct()
    items = named.groupBy("_row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return hits.join(items, "_row", "left").select(
        "doc_id", "n_words", _covered(F.col("occurrences")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "occurrences"
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM occ GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n_hit, 0)::BIGINT AS n_hit, coalesce(its.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@register("op1_decontaminate", ORACLE)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words in every document."""
    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
