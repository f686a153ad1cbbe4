"""Score/metric queries: the 64 embedding values folded into 10 class scores (value j counts for class j mod 10), ``label`` is the truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.scores import (
    argmax,
    bce_with_logits,
    binary_accuracy,
    categorical_crossentropy,
    crossentropy_index,
    multi_hot_from_indices,
    multi_hot_inverse,
    names_of,
    one_hot,
    sigmoid_all,
    softmax,
    topk_indices,
    weighted_binary_crossentropy,
)
from ..operators import metrics
from ..schemas import EMOTIONS
from ..sources.tables import read_table
from .bindings import sql_list
from .q_features import EMB_SQL, embedding_rows
from .registry import register

FOLD_SQL = "list_transform(range(10), lambda c: round(list_sum(list_transform(list_filter(range(len(v)), lambda j: j % 10 = c), lambda j: v[j + 1])), 9))"
SCORES_SQL = f"SELECT track_id, {FOLD_SQL} AS s, label FROM ({EMB_SQL})"
NAMES10 = EMOTIONS[:10]


def score_rows(spark, sf_dir):
    mine = lambda c: F.filter("v", lambda x, j: j % 10 == c)
    folded = F.array(*[F.round(F.aggregate(mine(c), F.lit(0.0), lambda a, x: a + x), 9) for c in range(10)])
    return embedding_rows(spark, sf_dir).select("track_id", folded.alias("s"), "label")


TOPK_SQL = f"""
WITH s AS ({SCORES_SQL}),
     x AS (SELECT track_id, unnest(s) AS x, unnest(range(len(s))) AS i FROM s),
     r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY x DESC, i) AS rk FROM x)
"""


@register(
    "scores_topk_multi_hot",
    ("M-2", "M-5"),
    f"""
{TOPK_SQL}
SELECT track_id, string_agg(CASE WHEN rk <= 3 THEN '1' ELSE '0' END, '' ORDER BY i) AS bits,
       string_agg(CASE WHEN rk <= 3 THEN {sql_list(NAMES10)}[i + 1] END, '|' ORDER BY i) AS names
FROM r GROUP BY track_id
""",
)
def q_topk_multi_hot(spark, sf_dir):
    """The three best classes as a 0/1 vector, and the names that the vector stands for."""
    s = score_rows(spark, sf_dir).withColumn("hot", multi_hot_from_indices(topk_indices("s", 3), 10))
    return s.select("track_id", F.array_join("hot", "").alias("bits"), F.array_join(multi_hot_inverse("hot", NAMES10), "|").alias("names"))


@register(
    "scores_top1",
    ("M-1",),
    f"""
WITH s AS ({SCORES_SQL})
SELECT track_id, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS pred,
       repeat('0', list_position(s, list_max(s)) - 1) || '1' || repeat('0', 10 - list_position(s, list_max(s))) AS one_hot
FROM s
""",
)
def q_top1(spark, sf_dir):
    s = score_rows(spark, sf_dir).withColumn("pred", argmax("s"))
    return s.select("track_id", "pred", F.array_join(one_hot("pred", 10), "").alias("one_hot"))


@register(
    "scores_topk",
    ("M-2", "M-3", "F-13"),
    f"""
{TOPK_SQL}
SELECT track_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY rk) AS top3,
       string_agg({sql_list(NAMES10)}[i + 1], ',' ORDER BY rk) AS top3_names
FROM r WHERE rk <= 3 GROUP BY track_id
""",
)
def q_topk(spark, sf_dir):
    s = score_rows(spark, sf_dir).withColumn("t", topk_indices("s", 3))
    return s.select(
        "track_id",
        F.array_join(F.transform("t", lambda i: i.cast("string")), ",").alias("top3"),
        F.array_join(names_of("t", NAMES10), ",").alias("top3_names"),
    )


@register(
    "scores_accuracy",
    ("M-6", "M-7"),
    f"""
{TOPK_SQL},
     t AS (SELECT track_id, bool_or(i = (SELECT label FROM s WHERE s.track_id = r.track_id) AND rk <= 1) AS h1,
                  bool_or(i = (SELECT label FROM s WHERE s.track_id = r.track_id) AND rk <= 3) AS h3 FROM r GROUP BY track_id)
SELECT round(avg(CAST(h1 AS DOUBLE)), 6) AS top1_accuracy, round(avg(CAST(h3 AS DOUBLE)), 6) AS top3_accuracy,
       round(avg(CAST(h3 AS DOUBLE)), 6) AS cover_accuracy
FROM t
""",
)
def q_accuracy(spark, sf_dir):
    s = score_rows(spark, sf_dir)
    return s.agg(
        F.round(metrics.topk_accuracy_expr("s", "label", 1), 6).alias("top1_accuracy"),
        F.round(metrics.topk_accuracy_expr("s", "label", 3), 6).alias("top3_accuracy"),
        F.round(metrics.cover_accuracy_expr(F.array("label"), topk_indices("s", 3)), 6).alias("cover_accuracy"),
    )


@register(
    "scores_confusion",
    ("M-8",),
    f"""
WITH s AS ({SCORES_SQL}), p AS (SELECT label, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS pred FROM s),
     l AS (SELECT CAST(unnest(range(10)) AS INTEGER) AS label)
SELECT l.label, {", ".join(f"count(p.pred) FILTER (WHERE p.pred = {i}) AS pred_{i}" for i in range(10))}
FROM l LEFT JOIN p USING (label) GROUP BY l.label
""",
)
def q_confusion(spark, sf_dir):
    s = score_rows(spark, sf_dir).withColumn("pred", argmax("s"))
    return metrics.confusion_matrix(s, "label", "pred", list(range(10)))


LAB_SQL = f"""
SELECT l.doc_id AS track_id, [l.quality, l.toxic] AS y, [e.v[1] * 10, e.v[2] * 10] AS logit
FROM labels l JOIN ({EMB_SQL}) e ON l.doc_id = e.track_id
"""


def label_rows(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels")
    e = embedding_rows(spark, sf_dir)
    j = lab.join(e, lab.doc_id == e.track_id)
    return j.select(
        F.col("doc_id").alias("track_id"),
        F.array("quality", "toxic").alias("y"),
        F.array(F.element_at("v", 1) * 10, F.element_at("v", 2) * 10).alias("logit"),
    )


@register(
    "scores_binary_accuracy",
    ("M-9", "M-11", "M-5"),
    f"""
WITH l AS ({LAB_SQL}),
     p AS (SELECT track_id, y, list_transform(logit, lambda x: 1.0 / (1.0 + exp(-x))) AS p FROM l)
SELECT round(avg(((CAST(p[1] > 0.5 AS INTEGER) = y[1])::INTEGER + (CAST(p[2] > 0.5 AS INTEGER) = y[2])::INTEGER) / 2.0), 6) AS binary_accuracy,
       count(*) AS n_rows
FROM p
""",
)
def q_binary_accuracy(spark, sf_dir):
    l = label_rows(spark, sf_dir).withColumn("p", sigmoid_all("logit"))
    return l.agg(F.round(F.avg(binary_accuracy("y", "p")), 6).alias("binary_accuracy"), F.count(F.lit(1)).alias("n_rows"))


@register(
    "scores_losses",
    ("M-10", "M-11"),
    f"""
WITH s AS (SELECT track_id, list_transform(s, lambda x: x * 10) AS z, label FROM ({SCORES_SQL})),
     m AS (SELECT *, list_max(z) AS mx FROM s),
     sm AS (SELECT *, list_transform(z, lambda x: exp(x - mx)) AS ex FROM m),
     p AS (SELECT *, list_transform(ex, lambda x: x / list_sum(ex)) AS prob FROM sm),
     ce AS (SELECT -ln(least(greatest(prob[label + 1], 1e-7), 1 - 1e-7)) AS ce,
                   mx + ln(list_sum(ex)) - z[label + 1] AS ce_idx FROM p),
     l AS ({LAB_SQL}),
     b AS (SELECT (greatest(logit[1], 0.0) - logit[1] * y[1] + ln(1 + exp(-abs(logit[1])))
                 + greatest(logit[2], 0.0) - logit[2] * y[2] + ln(1 + exp(-abs(logit[2])))) / 2.0 AS bce,
                  list_transform(logit, lambda x: least(greatest(1.0 / (1.0 + exp(-x)), 1e-7), 1 - 1e-7)) AS pc, y FROM l),
     w AS (SELECT bce, -(4.0 * y[1] * ln(pc[1]) + (1 - y[1]) * ln(1 - pc[1])) - (4.0 * y[2] * ln(pc[2]) + (1 - y[2]) * ln(1 - pc[2])) AS wbce FROM b)
SELECT (SELECT round(avg(ce), 6) FROM ce) AS categorical_ce, (SELECT round(avg(ce_idx), 6) FROM ce) AS index_ce,
       (SELECT round(avg(bce), 6) FROM w) AS bce_logits, (SELECT round(sum(wbce), 4) FROM w) AS weighted_bce_sum
""",
)
def q_losses(spark, sf_dir):
    s = score_rows(spark, sf_dir).withColumn("z", F.transform("s", lambda x: x * 10))
    s = s.withColumn("prob", softmax("z")).withColumn("y1", one_hot("label", 10))
    ce = s.agg(
        F.round(F.avg(categorical_crossentropy("y1", "prob")), 6).alias("categorical_ce"),
        F.round(F.avg(crossentropy_index("label", "z")), 6).alias("index_ce"),
    )
    l = label_rows(spark, sf_dir).withColumn("p", sigmoid_all("logit"))
    # the label-table losses are one-row aggregates: scalar subqueries, not a join
    bce = l.select(F.round(F.avg(bce_with_logits("y", "logit")), 6)).scalar()
    wbce = l.select(F.round(F.sum(weighted_binary_crossentropy("y", "p")), 4)).scalar()
    return ce.select("*", bce.alias("bce_logits"), wbce.alias("weighted_bce_sum"))


@register(
    "scores_encode_label",
    ("M-4",),
    f"""
WITH s AS ({SCORES_SQL})
SELECT track_id, {sql_list(EMOTIONS)}[label + 1] AS name,
       CAST(list_position({sql_list(sorted(EMOTIONS))}, {sql_list(EMOTIONS)}[label + 1]) - 1 AS INTEGER) AS label_idx
FROM s
""",
)
def q_encode(spark, sf_dir):
    s = score_rows(spark, sf_dir).withColumn("name", F.element_at(F.array(*[F.lit(e) for e in EMOTIONS]), F.col("label") + 1))
    return metrics.encode_labels(s, "name", EMOTIONS).select("track_id", "name", "label_idx")


def chunk_rows(spark, sf_dir):
    e = embedding_rows(spark, sf_dir)
    return e.select("track_id", F.posexplode(arrays.equal_chunks("v", 10)).alias("chunk", "s"))


VOTE_SQL = f"""
WITH e AS ({EMB_SQL}),
     c AS (SELECT track_id, v, unnest(range(0, len(v) // 10)) AS chunk FROM e),
     x AS (SELECT track_id, chunk, unnest(list_slice(v, chunk * 10 + 1, chunk * 10 + 10)) AS x,
                  unnest(range(10)) AS i FROM c),
     r AS (SELECT *, row_number() OVER (PARTITION BY track_id, chunk ORDER BY x DESC, i) - 1 AS rk FROM x),
     t AS (SELECT track_id, i AS label, count(*) AS votes, min(chunk * 100 + rk) AS first FROM r WHERE rk < 3 GROUP BY ALL),
     v AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY votes DESC, first, label) - 1 AS pos FROM t)
"""


def _emoji_case(col: str) -> str:
    from ..schemas import EMOJI

    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EMOJI.items())
    return f"coalesce(CASE {col} {whens} END, '')"


def _words_case(col: str) -> str:
    from ..schemas import EMOTION_WORDS

    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EMOTION_WORDS.items())
    return f"coalesce(CASE {col} {whens} END, {col})"


@register(
    "scores_chunk_vote",
    ("A-9", "W-3", "F-12", "F-16"),
    f"""
{VOTE_SQL},
     n AS (SELECT track_id, pos, {sql_list(EMOTIONS)}[label + 1] AS emotion FROM v WHERE pos < 3)
SELECT track_id, string_agg(emotion, ',' ORDER BY pos) AS emotions,
       max(CASE WHEN pos = 0 THEN emotion END) AS emotion_1, max(CASE WHEN pos = 1 THEN emotion END) AS emotion_2,
       max(CASE WHEN pos = 2 THEN emotion END) AS emotion_3,
       max(CASE WHEN pos = 0 THEN {_emoji_case('emotion')} END) AS emoji_1,
       max(CASE WHEN pos = 0 THEN {_words_case('emotion')} END) AS words_1
FROM n GROUP BY track_id
""",
)
def q_chunk_vote(spark, sf_dir):
    votes = metrics.chunk_vote(chunk_rows(spark, sf_dir), "track_id", "chunk", "s", 3, 3)
    names = votes.withColumn("emotion", F.element_at(F.array(*[F.lit(e) for e in EMOTIONS]), F.col("label") + 1))
    lists = metrics.collect_ranked(names, "track_id", "emotion", "pos", "labels")
    return lists.select(
        "track_id",
        F.array_join("labels", ",").alias("emotions"),
        *metrics.ranked_fields("labels", 3, "emotion"),
        metrics.emoji_of(F.try_element_at("labels", F.lit(1))).alias("emoji_1"),
        metrics.emotion_words_of(F.try_element_at("labels", F.lit(1))).alias("words_1"),
    )


def fonts_table(spark, sf_dir):
    """Emotion -> fonts from ``part``: the distinct brands of parts whose id picks that emotion.

    Pre-aggregated to distinct (emotion, brand) before the collect, so each list
    is bounded by the number of brands.
    """
    p = read_table(spark, sf_dir, "part")
    pairs = p.select(
        F.element_at(F.array(*[F.lit(e) for e in EMOTIONS]), (F.pmod("p_partkey", F.lit(len(EMOTIONS))) + 1).cast("int")).alias("emotion"),
        F.col("p_brand").alias("font"),
    ).distinct()
    return pairs.groupBy("emotion").agg(F.array_sort(F.collect_list("font")).alias("fonts"))


FONTS_SQL = f"""
SELECT emotion, list_sort(list(font)) AS fonts FROM (
  SELECT DISTINCT {sql_list(EMOTIONS)}[CAST(p_partkey % {len(EMOTIONS)} AS INTEGER) + 1] AS emotion, p_brand AS font FROM part)
GROUP BY emotion
"""


@register(
    "scores_fonts",
    ("J-11", "R-4", "S-10", "F-14"),
    f"""
WITH s AS ({SCORES_SQL}),
     p AS (SELECT track_id, CASE WHEN track_id % 13 = 0 THEN 'unknown' ELSE {sql_list(EMOTIONS)}[list_position(s, list_max(s))] END AS emotion FROM s),
     f AS ({FONTS_SQL}),
     j AS (SELECT p.track_id, p.emotion, coalesce(f.fonts, []::VARCHAR[]) AS fonts FROM p LEFT JOIN f USING (emotion)),
     k AS (SELECT track_id, emotion, fonts, unnest(range(5)) AS i FROM j WHERE len(fonts) > 0),
     picks AS (SELECT track_id, string_agg(fonts[CAST(('0x' || substr(md5(CAST(track_id AS VARCHAR) || ':' || CAST(i AS VARCHAR) || ':7'), 1, 8))::UBIGINT % len(fonts) AS BIGINT) + 1], '|' ORDER BY i) AS picks
               FROM k GROUP BY track_id)
SELECT j.track_id, j.emotion, CAST(len(j.fonts) AS INTEGER) AS n_fonts, coalesce(picks.picks, '') AS picks
FROM j LEFT JOIN picks USING (track_id)
""",
)
def q_fonts(spark, sf_dir):
    s = score_rows(spark, sf_dir)
    pred = F.element_at(F.array(*[F.lit(e) for e in EMOTIONS]), argmax("s") + 1)
    s = s.select("track_id", F.when(F.pmod("track_id", F.lit(13)) == 0, F.lit("unknown")).otherwise(pred).alias("emotion"))
    j = metrics.fonts_lookup(s, fonts_table(spark, sf_dir))
    picks = metrics.seeded_picks("fonts", "track_id", 5, seed=7)
    return j.select("track_id", "emotion", F.size("fonts").alias("n_fonts"), F.array_join(picks, "|").alias("picks"))


@register(
    "scores_result_json",
    ("F-14", "M-14"),
    f"""
{VOTE_SQL},
     n AS (SELECT track_id, pos, {sql_list(EMOTIONS)}[label + 1] AS emotion FROM v WHERE pos < 3),
     g AS (SELECT track_id, list(emotion ORDER BY pos) AS emotions FROM n GROUP BY track_id)
SELECT track_id, 'emotions' AS kind, CAST(to_json({{'result': {{'emotions': emotions}}}}) AS VARCHAR) AS body FROM g
UNION ALL SELECT track_id, 'keywords', CAST(to_json({{'result': {{'keywords': list_reverse(emotions)}}}}) AS VARCHAR) FROM g
UNION ALL SELECT track_id, 'error', CAST(to_json({{'result': {{'error': 'no "' || emotions[1] || '"'}}}}) AS VARCHAR) FROM g
UNION ALL SELECT track_id, 'fonts', CAST(to_json({{'result': list_transform(emotions, lambda e: {{'emotion': e, 'fonts': [e || 'A', e || 'B']}})}}) AS VARCHAR) FROM g
""",
)
def q_result_json(spark, sf_dir):
    votes = metrics.chunk_vote(chunk_rows(spark, sf_dir), "track_id", "chunk", "s", 3, 3)
    names = votes.withColumn("emotion", F.element_at(F.array(*[F.lit(e) for e in EMOTIONS]), F.col("label") + 1))
    lists = metrics.collect_ranked(names, "track_id", "emotion", "pos", "emotions")
    fonts = F.transform("emotions", lambda e: F.struct(e.alias("emotion"), F.array(F.concat(e, F.lit("A")), F.concat(e, F.lit("B"))).alias("fonts")))
    payloads = {
        "emotions": F.col("emotions"),
        "keywords": F.reverse("emotions"),
        "error": F.concat(F.lit('no "'), F.try_element_at("emotions", F.lit(1)), F.lit('"')),
        "fonts": fonts,
    }
    bodies = F.array(*[F.struct(F.lit(k).alias("kind"), metrics.result_json(k, p).alias("body")) for k, p in payloads.items()])
    return lists.select("track_id", F.explode(bodies).alias("b")).select("track_id", "b.kind", "b.body")


@register(
    "scores_mislabels",
    ("J-12", "U-5"),
    f"""
WITH s AS ({SCORES_SQL})
SELECT DISTINCT {sql_list(NAMES10)}[list_position(s, list_max(s))] AS pred, 'audio/' || CAST(track_id AS VARCHAR) || '.mp3' AS audio_path
FROM s WHERE list_position(s, list_max(s)) - 1 <> label
""",
)
def q_mislabels(spark, sf_dir):
    s = score_rows(spark, sf_dir)
    names = F.array(*[F.lit(e) for e in NAMES10])
    preds = s.select("track_id", F.element_at(names, argmax("s") + 1).alias("pred"))
    labels = s.select("track_id", F.array(F.element_at(names, F.col("label") + 1)).alias("labels"))
    tracks = s.select("track_id", F.concat(F.lit("audio/"), F.col("track_id").cast("string"), F.lit(".mp3")).alias("audio_path"))
    return metrics.mislabels(preds, labels, tracks)


@register(
    "scores_request_errors",
    ("P-20",),
    f"""
WITH s AS ({SCORES_SQL})
SELECT track_id, CASE WHEN track_id % 11 = 0 THEN 'Audio features are empty'
                      WHEN track_id % 7 = 0 THEN 'Unknown emotion' END AS error
FROM s
""",
)
def q_errors(spark, sf_dir):
    s = score_rows(spark, sf_dir)
    s = s.withColumn("chunks", F.when(F.pmod("track_id", F.lit(11)) == 0, F.array().cast("array<array<double>>")).otherwise(arrays.equal_chunks("s", 5)))
    s = s.withColumn("emotion", F.when(F.pmod("track_id", F.lit(7)) == 0, F.lit("bored")).otherwise(F.lit("happy")))
    return metrics.request_errors(s, chunks_col="chunks", emotion_col="emotion").select("track_id", "error")
