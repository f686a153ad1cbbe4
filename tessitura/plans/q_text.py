"""Text queries over ``documents`` (lyrics role): cleanup, TF-IDF keywords, vocabulary, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import phrases, text
from ..session import materialize
from ..sources.tables import read_table, vocabulary_line
from .registry import register

CLEAN_SQL = "trim(translate(text, chr(10) || chr(160), '  '))"


def docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def _kw_sql(where: str = "") -> str:
    return f"""
SELECT doc_id, w AS keyword, weight, rank FROM (
  WITH d AS (SELECT doc_id, regexp_extract_all(lower({CLEAN_SQL}), '\\p{{L}}{{3,}}') AS toks FROM documents {where}),
       t AS (SELECT doc_id, unnest(toks) AS w, len(toks) AS n FROM d),
       tf AS (SELECT doc_id, w, count(*) AS tf, any_value(n) AS n FROM t GROUP BY doc_id, w),
       df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
       nd AS (SELECT count(DISTINCT doc_id) AS nd FROM tf),
       s AS (SELECT tf.doc_id, tf.w, (tf.tf / tf.n) * ln((SELECT nd FROM nd) / df.df) AS weight FROM tf JOIN df USING (w))
  SELECT doc_id, w, weight, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, w) AS rank FROM s
) WHERE rank <= 10
"""


KW_SQL = _kw_sql()


@register(
    "text_clean_lyrics",
    ("F-8", "S-15", "S-4"),
    f"""
SELECT doc_id AS track_id, CAST(length({CLEAN_SQL}) AS INTEGER) AS n_chars_clean,
       CASE WHEN length({CLEAN_SQL}) > 0 THEN 'lyrics/' || CAST(doc_id AS VARCHAR) || '.txt' END AS lyrics_path
FROM documents
""",
)
def q_clean(spark, sf_dir):
    d = docs(spark, sf_dir).withColumnRenamed("doc_id", "track_id")
    tracks = d.select("track_id")
    out = text.attach_lyrics(tracks, d.select("track_id", "text"))
    lengths = d.select("track_id", F.length(text.clean_text("text")).alias("n_chars_clean"))
    return out.join(lengths, "track_id").select("track_id", "n_chars_clean", "lyrics_path")


@register("text_keywords", ("K-1",), f"SELECT doc_id, keyword, round(weight, 6) AS weight, CAST(rank AS INTEGER) AS rank FROM ({KW_SQL})")
def q_keywords(spark, sf_dir):
    kw = text.tfidf_keywords(docs(spark, sf_dir))
    return kw.select("doc_id", "keyword", F.round("weight", 6).alias("weight"), F.col("rank").cast("int").alias("rank"))


VOCAB_SQL = f"""
SELECT keyword, count(*) AS count FROM ({KW_SQL}) GROUP BY keyword ORDER BY count DESC, keyword LIMIT 50
"""


@register(
    "text_keyword_vocabulary",
    ("A-6", "L-6"),
    f"SELECT keyword, count, CAST(row_number() OVER (ORDER BY count DESC, keyword) - 1 AS INTEGER) AS idx FROM ({VOCAB_SQL})",
)
def q_vocab(spark, sf_dir):
    return text.keyword_vocabulary(text.tfidf_keywords(docs(spark, sf_dir)))


@register(
    "text_vocabulary_line",
    ("S-11", "S-10"),
    f"""
SELECT string_agg(keyword, ';' ORDER BY idx) AS line FROM (
  SELECT keyword, row_number() OVER (ORDER BY count DESC, keyword) - 1 AS idx FROM ({VOCAB_SQL}))
""",
)
def q_vocab_line(spark, sf_dir):
    return vocabulary_line(text.keyword_vocabulary(text.tfidf_keywords(docs(spark, sf_dir))))


@register(
    "text_keyword_labels",
    ("A-7", "K-3"),
    f"""
WITH kw AS ({KW_SQL}),
     v AS (SELECT keyword, row_number() OVER (ORDER BY count DESC, keyword) - 1 AS idx FROM ({VOCAB_SQL}))
SELECT doc_id, string_agg(keyword, '|' ORDER BY idx) AS labels, count(*) AS n_labels
FROM (SELECT DISTINCT kw.doc_id, kw.keyword, v.idx FROM kw JOIN v USING (keyword)) GROUP BY doc_id
""",
)
def q_kw_labels(spark, sf_dir):
    # the keyword table (10 rows per document) feeds both the vocabulary and the restriction
    kw = materialize(text.tfidf_keywords(docs(spark, sf_dir)), "keywords")
    vocab = text.keyword_vocabulary(kw)
    lab = text.restrict_to_vocabulary(kw, vocab)
    return lab.select("doc_id", F.array_join("labels", "|").alias("labels"), F.size("labels").cast("long").alias("n_labels"))


@register(
    "text_keywords_append",
    ("U-6",),
    f"""
SELECT doc_id, keyword, round(weight, 6) AS weight, CAST(rank AS INTEGER) AS rank, 'existing' AS origin FROM ({_kw_sql("WHERE lang = 'en'")})
UNION ALL
SELECT doc_id, keyword, round(weight, 6), CAST(rank AS INTEGER), 'new' FROM ({KW_SQL}) JOIN documents USING (doc_id) WHERE lang <> 'en' OR lang IS NULL
""",
)
def q_append(spark, sf_dir):
    d = docs(spark, sf_dir)
    # what is stored for the documents that already have keywords: the keywords and the document frequencies
    terms = materialize(text.term_counts(d.where(F.col("lang") == "en")), "term-counts-stored")
    stored = materialize(text.document_frequencies(terms), "frequencies-stored")
    existing = materialize(text.top_keywords(text.weigh(terms, stored)), "keywords-existing")
    out = text.append_missing_keywords(existing, d, stored, origin_col="origin")
    return out.select("doc_id", "keyword", F.round("weight", 6).alias("weight"), F.col("rank").cast("int").alias("rank"), "origin")


@register(
    "text_keyword_weights",
    ("F-3", "F-1", "S-10"),
    f"""
SELECT doc_id, keyword, round(weight, 6) AS weight FROM ({KW_SQL})
""",
)
def q_weights(spark, sf_dir):
    """Keywords stored the CSV way (``;``-joined words and weights) and parsed back."""
    from ..functions.lists import keyword_structs

    kw = text.tfidf_keywords(docs(spark, sf_dir)).withColumn("weight", F.round("weight", 6))
    lists = text.keywords_as_list(kw)
    stored = lists.select(
        "doc_id",
        F.array_join(F.transform("keywords", lambda s: s["keyword"]), ";").alias("keywords"),
        F.array_join(F.transform("keywords", lambda s: s["weight"].cast("string")), ";").alias("weights"),
    )
    parsed = stored.select("doc_id", F.explode(keyword_structs("keywords", "weights")).alias("k"))
    return parsed.select("doc_id", F.col("k.keyword").alias("keyword"), F.col("k.weight").alias("weight"))


PHRASES_SQL = f"""
WITH d AS (SELECT doc_id, string_split_regex(regexp_replace(lower({CLEAN_SQL}), '[^\\p{{L}} ]+', ' . ', 'g'), ' +') AS w FROM documents),
     l AS (SELECT doc_id, w, len(list_filter(w, lambda x: length(x) >= 3)) AS n FROM d),
     g AS (SELECT doc_id, n, k, list_slice(w, i, i + k - 1) AS p FROM (SELECT doc_id, w, n, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM l, range(1, 5) ks(k) WHERE len(w) >= k)),
     c AS (SELECT doc_id AS doc, array_to_string(p, ' ') AS phrase, k AS words, count(*) AS tf, any_value(n) AS doc_len FROM g WHERE len(list_filter(p, lambda x: length(x) < 3)) = 0 GROUP BY ALL),
     f AS (SELECT phrase, words, sum(tf)::BIGINT AS f, count(*) AS df FROM c GROUP BY ALL HAVING sum(tf) >= 5),
     s AS (SELECT DISTINCT f, phrase AS b, array_to_string(list_slice(string_split(phrase, ' '), i, i + m - 1), ' ') AS phrase
           FROM (SELECT f, phrase, words, m, unnest(generate_series(1, words - m + 1)) AS i FROM f, range(1, 4) ms(m) WHERE m < words)),
     a AS (SELECT phrase, count(*) AS n_around, sum(f) AS f_around FROM s GROUP BY phrase),
     v AS (SELECT f.phrase, f.words, f.f, f.df, coalesce(n_around, 0) AS n_around, log2(f.words + 1) * (f.f - CASE WHEN n_around > 0 THEN f_around / n_around ELSE 0 END) AS cvalue
           FROM f LEFT JOIN a USING (phrase))
"""


@register("text_phrase_candidates", ("K-1",), f"{PHRASES_SQL} SELECT phrase, CAST(words AS INTEGER) AS words, f, df, n_around, round(cvalue, 6) AS cvalue FROM v")
def q_phrases(spark, sf_dir):
    """Frequent phrases of up to four words with their C-values."""
    ranked, _ = phrases.corpus_keyphrases(docs(spark, sf_dir))
    return ranked.select("phrase", "words", "f", "df", "n_around", F.round("cvalue", 6).alias("cvalue"))


@register(
    "text_phrase_keywords",
    ("K-1",),
    f"""
{PHRASES_SQL}
SELECT doc AS doc_id, phrase, weight, CAST(row_number() OVER (PARTITION BY doc ORDER BY weight DESC, phrase) AS INTEGER) AS rank
FROM (SELECT doc, phrase, round((tf / doc_len) * ln((SELECT count(DISTINCT doc) FROM c) / df) * (cvalue / f), 9) AS weight FROM c JOIN v USING (phrase))
QUALIFY rank <= 10
""",
)
def q_phrase_keywords(spark, sf_dir):
    _, ranked = phrases.corpus_keyphrases(docs(spark, sf_dir))
    return ranked.select("doc_id", "phrase", "weight", F.col("rank").cast("int").alias("rank"))
