"""K-1 phrase candidates: frequent phrases of one to four words with the nested-count correction (C-value).

A phrase is a run of up to four consecutive words of a text, all of three
letters or more; punctuation, digits and shorter words end a run.  A phrase
that mostly occurs inside longer ones is a part, not a term: its count is
reduced by the mean count of the longer candidates around it
(C-value; Frantzi, Ananiadou and Mima, 2000; ``log2(words + 1)``, so that
single words take part):

    C(a) = log2(|a| + 1) * (f(a) - mean of f(b) over the candidates b that contain a)

A document's phrases are ranked by ``tf / len * ln(N / df) * C / f``: TF-IDF
scaled by the share of the phrase's count that is its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import KEYWORDS_TOP
from ..session import join_hot_keys, materialize, split_repeats, spread
from .text import clean_text

MAX_WORDS = 4
LEAST_LETTERS = 3
LEAST_COUNT = 5
BITS = 26  # bits of a bitmap's addresses
STRETCH = 1 << 20  # words counted at a time


def words_in_order(c) -> Column:
    """Words of the lower-cased, cleaned text in order; whatever is neither letter nor space stands between them as ``.``."""
    return F.split(F.regexp_replace(F.lower(clean_text(c)), r"[^\p{L} ]+", " . "), " +")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def pair_hash(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of words that begin at ``at``."""
    return _mix(_mix(key[at]) + key[at + 1])


def bitmap(hashes: DataFrame) -> np.ndarray:
    """2^BITS flags as bytes of 8, set where a hash (long column ``h``) falls; the driver gets at most 2^(BITS - 6) words."""
    address = hashes.select(F.shiftrightunsigned("h", 64 - BITS).alias("a"))
    got = address.groupBy(F.shiftrightunsigned("a", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(a & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (BITS - 6), dtype=np.int64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out.view(np.uint8)


def _has(flags: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(64 - BITS)).astype(np.int64)
    return (flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _stretches(batches, hashes: str):
    """Record batches cut to some ``STRETCH`` words: (the rows, each word's hash as unsigned, each word's row)."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column(hashes)), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STRETCH, "right")))
            part = b.slice(lo, hi - lo)
            column = part.column(hashes)
            row = np.repeat(np.arange(hi - lo), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
            yield part, column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), row
            lo = hi


def _joined(key: np.ndarray, row: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each word may be part of a candidate, whether it and the next one may)."""
    good = (key != 0) & _has(words, key)
    return good, good[:-1] & good[1:] & (row[:-1] == row[1:])


def _count_pairs(words: np.ndarray):
    """Partition function: (hash, occurrences) of the pairs of frequent words of every stretch."""

    def run(batches):
        for _, key, row in _stretches(batches, "h"):
            h, n = np.unique(pair_hash(key, np.flatnonzero(_joined(key, row, words)[1])), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return run


def _count_phrases(words: np.ndarray, pairs: np.ndarray, max_words: int):
    """Partition function: (doc, phrase, words, tf, doc_len) of the phrases all of whose words and pairs are frequent.

    Words are compared as numbers of the stretch's own dictionary, phrases as numbers of (first words, last word).
    """

    def run(batches):
        for part, key, row in _stretches(batches, "h"):
            coded = part.column("w").flatten().dictionary_encode()
            word, number = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            good, runs = _joined(key, row, words)
            at = np.flatnonzero(runs)
            runs[at] = _has(pairs, pair_hash(key, at))
            at, known = np.flatnonzero(good), number[good]
            for size in range(1, max_words + 1):
                if size > 1:
                    more = at + size - 2 < len(runs)
                    more[more] = runs[at[more] + size - 2]
                    at = at[more]
                    known = np.unique(known[more] * len(word) + number[at + size - 1], return_inverse=True)[1]
                if not len(at):
                    break
                _, first, times = np.unique(row[at] * (known.max() + 1) + known, return_index=True, return_counts=True)
                begin = at[first]
                phrase = pc.binary_join_element_wise(*[word.take(pa.array(number[begin + k])) for k in range(size)], " ")
                rows = part.select(["doc", "doc_len"]).take(pa.array(row[begin]))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc"), phrase, pa.array(np.full(len(begin), size, dtype=np.int32)), pa.array(times.astype(np.int64)), rows.column("doc_len")],
                    names=["doc", "phrase", "words", "tf", "doc_len"],
                )

    return run


def listed_words(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, w, h, doc_len)``: a row's words in order and their hashes (0: no part of a phrase); ``doc_len`` counts the words of three letters or more."""
    listed = spread(docs.select(doc_col, text_col)).select(F.col(doc_col).alias("doc"), words_in_order(text_col).alias("w"))
    hashed = listed.select("doc", "w", F.transform("w", lambda x: F.when(F.length(x) >= LEAST_LETTERS, F.xxhash64(x).bitwiseOR(F.lit(1))).otherwise(F.lit(0))).alias("h"))
    return hashed.select("doc", "w", "h", F.size(F.filter("h", lambda h: h != 0)).alias("doc_len"))


def phrase_counts(docs: DataFrame, least: int = LEAST_COUNT, doc_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """``(doc, phrase, words, tf, doc_len)`` over whole texts, of every phrase that can occur ``least`` times or more in the corpus.

    No phrase is more frequent than its parts: a first scan counts the words, a second the pairs of
    frequent words (by hashes), and this one counts, inside each row, the phrases all of
    whose words and pairs are frequent.  The tasks are told which by bitmaps of a fixed size, which only
    let too much pass.  Rows of one document are put together by a shuffle of those rows alone.
    """
    listed = listed_words(docs, doc_col, text_col)
    words = listed.select(F.explode_outer("w").alias("word")).where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = bitmap(words.where(F.col("n") >= least).select(F.xxhash64("word").bitwiseOR(F.lit(1)).alias("h")))
    pairs = listed.select("h").mapInArrow(_count_pairs(words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    pairs = bitmap(pairs.where(F.col("n") >= least).select("h"))
    schema = T.StructType([
        T.StructField("doc", docs.schema[doc_col].dataType), T.StructField("phrase", T.StringType()), T.StructField("words", T.IntegerType()),
        T.StructField("tf", T.LongType()), T.StructField("doc_len", T.IntegerType()),
    ])
    count = lambda d: listed_words(d, doc_col, text_col).mapInArrow(_count_phrases(words, pairs, max_words), schema)
    once, again = split_repeats(docs.select(doc_col, text_col), doc_col, "repeated-ids")
    if again is None:
        return count(once)
    return count(once).unionByName(count(again).groupBy("doc", "phrase", "words").agg(F.sum("tf").alias("tf"), F.first("doc_len").alias("doc_len")))


def candidates(counts: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """``(phrase, words, f, df)`` of the phrases that occur ``least`` times or more in the corpus."""
    total = counts.groupBy("phrase", "words").agg(F.sum("tf").alias("f"), F.count(F.lit(1)).alias("df"))
    return total.where(F.col("f") >= least)


def with_cvalue(found: DataFrame) -> DataFrame:
    """Add ``n_around`` (longer candidates that contain the phrase) and ``cvalue``.

    Every candidate lists its parts (at most nine), which are added up by part:
    one shuffle of the candidates, no pairing of phrases.
    """
    w = F.split("phrase", " ")
    none = F.array().cast("array<string>")
    parts_of = lambda n: F.when(F.col("words") > n, F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda at: F.array_join(F.slice(w, at, n), " "))).otherwise(none)
    parts = F.concat(*[parts_of(n) for n in range(1, MAX_WORDS)])
    inside = found.where("words > 1").select("f", F.explode(F.array_distinct(parts)).alias("phrase"))
    around = inside.groupBy("phrase").agg(F.count(F.lit(1)).alias("n_around"), F.sum("f").alias("f_around"))
    joined = found.join(around, "phrase", "left")
    n = F.coalesce("n_around", F.lit(0))
    own = F.col("f") - F.when(n > 0, F.col("f_around") / n).otherwise(F.lit(0.0))
    return joined.select("phrase", "words", "f", "df", n.alias("n_around"), (F.log2(F.col("words") + 1) * own).alias("cvalue"))


def documents_with_words(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> int:
    """How many documents have a word of three letters or more."""
    return docs.where(F.lower(clean_text(text_col)).rlike(r"\p{L}{%d}" % LEAST_LETTERS)).select(F.countDistinct(doc_col)).first()[0]


def keyphrases(counts: DataFrame, ranked: DataFrame, n_docs: int, doc_col: str = "doc_id", top: int = KEYWORDS_TOP) -> DataFrame:
    """K-1 over phrases: per document its ``top`` candidates by weight, ties A-Z; ``rank`` from 1.

    ``counts`` and ``ranked`` are read twice: pass written tables.
    """
    j = join_hot_keys(counts.drop("words"), ranked.select("phrase", "f", "df", "cvalue"), "phrase", "df")
    weight = (F.col("tf") / F.col("doc_len")) * F.log(F.lit(n_docs) / F.col("df")) * (F.col("cvalue") / F.col("f"))
    # rounded before ranking: equal weights stay equal whatever the order of the factors
    scored = j.select("doc", "phrase", F.round(weight, 9).alias("weight"))
    w = Window.partitionBy("doc").orderBy(F.desc("weight"), F.asc("phrase"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(F.col("doc").alias(doc_col), "phrase", "weight", "rank")


def corpus_keyphrases(docs: DataFrame, least: int = LEAST_COUNT, doc_col: str = "doc_id", text_col: str = "text", top: int = KEYWORDS_TOP) -> tuple[DataFrame, DataFrame]:
    """(candidates with C-values, the documents' phrases); both tables that feed several readers are written once."""
    counts = materialize(phrase_counts(docs, least, doc_col, text_col), "phrase-counts")
    ranked = materialize(with_cvalue(candidates(counts, least)), "phrase-candidates")
    return ranked, keyphrases(counts, ranked, documents_with_words(docs, doc_col, text_col), doc_col, top)
