"""Lyrics text and keywords (F-8, S-15, K-1, K-2, A-6, A-7, U-6).

K-1 is TF-IDF over the corpus with DataFrame aggregates: tokens by a Unicode
letter regex, term counts per (doc, word), document frequency per word, and
a top-10 window per document.  Term counts need no shuffle (a document is one
row), and hot words ("the"), the skew key of the df join, meet their
frequency by a broadcast of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._compat import col_of
from ..schemas import KEYWORD_VOCAB_SIZE, KEYWORDS_TOP
from ..session import bounded_broadcast, join_hot_keys, materialize, split_repeats, spread

TOKEN_RE = r"\p{L}{3,}"


def clean_text(c) -> Column:
    """F-8: newlines and no-break spaces become spaces, then trimmed (a newline-only text becomes empty)."""
    return F.trim(F.translate(col_of(c), "\n\u00a0", "  "))


def attach_lyrics(tracks: DataFrame, lyrics: DataFrame, key: str = "track_id", lyrics_dir: str = "lyrics/") -> DataFrame:
    """S-15: ``lyrics_path`` is set for tracks whose cleaned lyrics are non-empty, else null."""
    l = lyrics.select(F.col(key).alias("_lk"), clean_text("text").alias("_clean"))
    j = tracks.join(l, F.col(key) == F.col("_lk"), "left")
    path = F.when(F.length("_clean") > 0, F.concat(F.lit(lyrics_dir), F.col(key).cast("string"), F.lit(".txt")))
    return j.withColumn("lyrics_path", path).drop("_lk", "_clean")


def tokens(c) -> Column:
    """Maximal runs of 3+ Unicode letters of the lower-cased, cleaned text.

    Same tokens as ``regexp_extract_all(text, '\\p{L}{3,}')`` but a split on
    non-letters, which is several times cheaper.
    """
    parts = F.split(F.lower(clean_text(c)), r"[^\p{L}]+")
    return F.filter(parts, lambda w: F.length(w) >= 3)


def count_in_row(listed: DataFrame, words_col: str) -> DataFrame:
    """``(doc, word, tf, doc_len)`` of rows ``(doc, array of words)``: a row's words are sorted and the runs counted, so nothing is shuffled.

    ``explode_outer`` + a null filter instead of ``explode``: the optimizer
    would otherwise infer a ``size(...) > 0`` filter and evaluate the
    tokenizer a second time.
    """
    s = listed.select("doc", F.sort_array(F.coalesce(F.col(words_col), F.array().cast("array<string>"))).alias("_s"))
    begin = F.filter(F.transform("_s", lambda w, i: F.when((i == 0) | (w != F.get("_s", i - 1)), i)), lambda i: i.isNotNull())
    at = s.select("doc", "_s", F.size("_s").alias("doc_len"), begin.alias("_at"))
    runs = F.transform("_at", lambda p, k: F.struct(F.get("_s", p).alias("word"), (F.coalesce(F.get("_at", k + 1), F.col("doc_len")) - p).cast("long").alias("tf")))
    return at.select("doc", "doc_len", F.explode_outer(runs).alias("r")).where(F.col("r").isNotNull()).select("doc", "r.word", "r.tf", "doc_len")


def term_counts(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, word, tf, doc_len)`` over whole texts (every token of every document).

    A document is one row, so its words are counted inside the row; only
    documents whose id comes more than once (or is null) are put together by
    a shuffle.
    """
    count = lambda d: count_in_row(spread(d).select(F.col(doc_col).alias("doc"), tokens(text_col).alias("toks")), "toks")
    once, again = split_repeats(docs.select(doc_col, text_col), doc_col, "repeated-ids")
    if again is None:
        return count(once)
    return count(once).unionByName(count(again).groupBy("doc", "word").agg(F.sum("tf").alias("tf"), F.first("doc_len").alias("doc_len")))


def document_frequencies(terms: DataFrame) -> DataFrame:
    """``(word, df, n_docs)`` of a term-count table: the corpus statistics that K-1 weights need."""
    df = terms.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("n_docs", terms.select(F.countDistinct("doc")).scalar())


def add_frequencies(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Statistics of two disjoint sets of documents together."""
    n = lambda t: F.coalesce(t.select(F.max("n_docs")).scalar(), F.lit(0))
    both = stored.select("word", "df").unionByName(new.select("word", "df")).groupBy("word").agg(F.sum("df").alias("df"))
    return both.withColumn("n_docs", n(stored) + n(new))


def weigh(terms: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Every (document, word) with its weight ``tf/len * ln(N/df)``; the rows of the most frequent words are not shuffled.

    The frequencies are written once, as the frequent and the other words are joined apart (jobs run when this is called).
    """
    j = join_hot_keys(terms, materialize(frequencies, "frequencies"), "word", "df")
    weight = (F.col("tf") / F.col("doc_len")) * F.log(F.col("n_docs") / F.col("df"))
    return j.select("doc", "word", weight.alias("weight"))


def top_keywords(scored: DataFrame, doc_col: str = "doc_id", top: int = KEYWORDS_TOP) -> DataFrame:
    """K-1 cut: per document the ``top`` words by weight, ties A-Z; ``rank`` from 1."""
    w = Window.partitionBy("doc").orderBy(F.desc("weight"), F.asc("word"))
    top_rows = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return top_rows.select(F.col("doc").alias(doc_col), F.col("word").alias("keyword"), "weight", "rank")


def tfidf_keywords(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", top: int = KEYWORDS_TOP) -> DataFrame:
    """K-1: per document the ``top`` words by ``tf/len * ln(N/df)``.

    The term-count table feeds three consumers (document frequency, corpus
    size, the join), so it is written once as a Parquet table below the shared
    checkpoint folder (a job runs when this is called) instead of tokenising
    every text three times.
    """
    terms = materialize(term_counts(docs, doc_col, text_col), "term-counts")
    return top_keywords(weigh(terms, document_frequencies(terms)), doc_col, top)


def keywords_as_list(keywords: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Ranked rows -> ``array<struct<keyword, weight>>`` per document (at most ``top`` rows each)."""
    g = keywords.groupBy(doc_col).agg(F.array_sort(F.collect_list(F.struct("rank", "keyword", "weight"))).alias("_s"))
    return g.select(doc_col, F.transform("_s", lambda s: F.struct(s["keyword"].alias("keyword"), s["weight"].alias("weight"))).alias("keywords"))


def keyword_vocabulary(keywords: DataFrame, size: int = KEYWORD_VOCAB_SIZE) -> DataFrame:
    """A-6 / L-6 / K-3: the ``size`` most frequent keywords (occurrences, Q-9), ties A-Z; ``idx`` from 0."""
    counts = keywords.groupBy("keyword").agg(F.count(F.lit(1)).alias("count"))
    top = counts.orderBy(F.desc("count"), F.asc("keyword")).limit(size)
    w = Window.orderBy(F.desc("count"), F.asc("keyword"))  # over at most `size` rows
    return top.withColumn("idx", (F.row_number().over(w) - 1).cast("int"))


def restrict_to_vocabulary(keywords: DataFrame, vocab: DataFrame, doc_col: str = "doc_id", size: int = KEYWORD_VOCAB_SIZE) -> DataFrame:
    """A-7 / K-3: per document its keywords that are in the vocabulary (vocabulary order); documents left with none are dropped."""
    v = bounded_broadcast(vocab.select("keyword", "idx"), size)
    j = keywords.select(doc_col, "keyword").join(v, "keyword", "inner")
    g = j.groupBy(doc_col).agg(F.array_sort(F.collect_set(F.struct("idx", "keyword"))).alias("_s"))
    return g.select(doc_col, F.transform("_s", lambda s: s["keyword"]).alias("labels"))


def append_missing_keywords(existing: DataFrame, docs: DataFrame, stored: DataFrame, doc_col: str = "doc_id", text_col: str = "text", top: int = KEYWORDS_TOP,
                            origin_col: str | None = None) -> DataFrame:
    """U-6: documents without keywords get K-1 keywords; the rest stay.

    ``stored`` holds the document frequencies of the documents that have
    keywords.  The new documents are added to it and weighed against the whole
    corpus, so an appended document's keywords are those of a full recompute
    and do not depend on the batch.  With ``origin_col`` the rows are tagged
    ``existing`` / ``new``.
    """
    fresh_docs = docs.join(existing.select(doc_col).distinct(), doc_col, "left_anti")
    terms = materialize(term_counts(fresh_docs, doc_col, text_col), "term-counts-new")
    fresh = top_keywords(weigh(terms, add_frequencies(stored, document_frequencies(terms))), doc_col, top)
    if origin_col:
        existing = existing.withColumn(origin_col, F.lit("existing"))
        fresh = fresh.withColumn(origin_col, F.lit("new"))
    return existing.unionByName(fresh)
