"""K-2: diversity re-rank of keyword candidates (greedy maximal marginal relevance).

Candidates are all words of a document, ranked by TF-IDF (K-1 weights).  Word
vectors are trained on the corpus (:mod:`.vectors`); words too rare for a vector are like
no other word.  Of the ``HOT_WORDS`` most frequent words a candidate carries a number only, and every
worker has their vectors; the others carry their vector.  The document vector
is the TF-IDF-weighted mean of its candidates' unit vectors.  The greedy selection runs per document
(in Arrow batches of documents), as described for EmbedRank (Bennani-Smires et
al., 2018): score = ``beta * sim(word, doc) - (1 - beta) * max sim(word,
chosen)``; candidates whose similarity to a chosen word reaches
``alias_threshold`` become its aliases and leave the pool.  Similarities and scores are
rounded to 9 digits, so ties are ties on any machine: the better TF-IDF rank wins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast, materialize
from .text import document_frequencies, term_counts, weigh
from .vectors import HOT_WORDS, train_vectors

MMR_SCHEMA = "doc_id long, rank int, keyword string, score double, aliases string"
MMR_ARROW = pa.schema([("doc_id", pa.int64()), ("rank", pa.int32()), ("keyword", pa.string()), ("score", pa.float64()), ("aliases", pa.string())])
DIGITS = 9
DOCS = 200  # documents whose candidates' vectors a worker holds at a time


def mmr_select(words, weights, vectors, n: int, beta: float, alias_threshold: float):
    """Greedy MMR over all of one document's words (given best TF-IDF first) and their vectors.

    Similarities to the chosen words are kept as a running maximum, so each
    step is one matrix-vector product: O(words x dims) memory and time per
    step, never words x words.
    """
    weights, vecs = np.asarray(weights, dtype=np.float64), np.asarray(vectors, dtype=np.float64)
    vn = vecs / np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-12)
    dvec = (np.maximum(weights, 0.0)[:, None] * vn).sum(axis=0)
    dn = dvec / max(np.linalg.norm(dvec), 1e-12)
    sim_doc = np.round(vn @ dn, DIGITS)
    active = np.ones(len(words), dtype=bool)
    max_sim = np.full(len(words), -np.inf)
    out = []
    while active.any() and len(out) < n:
        scores = sim_doc if not out else np.round(beta * sim_doc - (1 - beta) * max_sim, DIGITS)
        masked = np.where(active, scores, -np.inf)
        best = int(np.argmax(masked))  # first maximum: the better TF-IDF rank wins ties
        active[best] = False
        sim_best = np.round(vn @ vn[best], DIGITS)
        aliases = np.flatnonzero(active & (sim_best >= alias_threshold))
        active[aliases] = False
        max_sim = np.maximum(max_sim, sim_best)
        out.append((len(out) + 1, words[best], float(masked[best]), "|".join(sorted(words[a] for a in aliases))))
    return out


class Candidates:
    """One document's candidates: words, weights (best first) and vectors as arrays; item by item they are dicts as in the table."""

    def __init__(self, words, neg_weight: np.ndarray, at: np.ndarray, v, vectors: np.ndarray):
        self.words, self.neg_weight, self.at, self.v, self.vectors = words, neg_weight, at, v, vectors

    def __len__(self) -> int:
        return len(self.at)

    def __iter__(self):
        for weight, word, at, v in zip(self.neg_weight.tolist(), self.words.to_pylist(), self.at.tolist(), self.v.to_pylist()):
            yield {"neg_weight": weight, "keyword": word, "at": at, "v": v}


def _documents(batches, hot: np.ndarray):
    """Frames ``doc_id``, ``cands`` (:class:`Candidates`) of at most ``DOCS`` documents at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, DOCS):
            part = b.slice(lo, DOCS)
            listed = part.column(1)
            word, neg_weight, at, v = (listed.flatten().field(k) for k in ("keyword", "neg_weight", "at", "v"))
            at = at.to_numpy(zero_copy_only=False)
            own = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
            given = v.drop_null().flatten().to_numpy(zero_copy_only=False)
            vectors = np.zeros((len(at), len(given) // len(own) if len(own) else hot.shape[1]))
            vectors[at >= 0] = hot[at[at >= 0]] if len(hot) else 0
            if len(own):
                vectors[own] = given.reshape(len(own), -1)
            ends = np.append(0, np.cumsum(listed.value_lengths().to_numpy(zero_copy_only=False)))
            neg_weight = neg_weight.to_numpy(zero_copy_only=False)
            cands = [Candidates(word.slice(x, y - x), neg_weight[x:y], at[x:y], v.slice(x, y - x), vectors[x:y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pd.DataFrame({"doc_id": part.column(0).to_pandas(), "cands": pd.Series(cands, dtype=object)})


def _mmr_batches(n: int, beta: float, alias_threshold: float, hot: np.ndarray):
    def run(batches):
        for pdf in batches:
            rows = []
            for doc, c in zip(pdf["doc_id"], pdf["cands"]):
                for rank, word, score, aliases in mmr_select(c.words.to_pylist(), -c.neg_weight, c.vectors, n, beta, alias_threshold):
                    rows.append((int(doc), rank, word, score, aliases))
            yield pd.DataFrame(rows, columns=["doc_id", "rank", "keyword", "score", "aliases"])

    return run


def keyphrases(docs: DataFrame, n: int = 10, beta: float = 0.55, alias_threshold: float = 0.7, vectors: DataFrame | None = None) -> DataFrame:
    """K-2 over whole documents: ``(doc_id, rank, keyword, score, aliases)``.

    Every distinct word of a document is a candidate (no cut); a document's
    candidates are collected into one row (bounded by its own vocabulary) and
    re-ranked in Arrow batches of many documents.  ``vectors``: ``(word, v)``
    from an earlier training; trained on ``docs`` when not given.
    """
    vectors = train_vectors(docs) if vectors is None else vectors
    terms = materialize(term_counts(docs), "term-counts")
    frequencies = materialize(document_frequencies(terms), "frequencies")
    # rounded, so that equal weights stay equal and rank A-Z
    scored = weigh(terms, frequencies).select("doc", "word", F.round("weight", DIGITS).alias("weight"))
    top = vectors.where(F.col("v").isNotNull()).join(frequencies.select("word", "df"), "word").orderBy(F.desc("df"), F.asc("word")).limit(HOT_WORDS)
    w = Window.orderBy(F.desc("df"), F.asc("word"))  # over at most HOT_WORDS rows
    hot = materialize(top.select("word", "v", (F.row_number().over(w) - 1).cast("int").alias("at")), "hot-vectors")
    listed = hot.orderBy("at").select("v").toArrow().column("v").combine_chunks()
    matrix = listed.flatten().to_numpy().reshape(len(listed), -1) if len(listed) else np.zeros((0, 1))
    near = scored.join(bounded_broadcast(hot.select("word", "at"), HOT_WORDS), "word").withColumn("v", F.lit(None).cast("array<double>"))
    words = bounded_broadcast(hot.select("word"), HOT_WORDS)
    far = scored.join(words, "word", "left_anti").join(vectors.join(words, "word", "left_anti"), "word", "left").withColumn("at", F.lit(-1))
    per_doc = near.unionByName(far).groupBy(F.col("doc").alias("doc_id")).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("neg_weight"), F.col("word").alias("keyword"), "at", "v"))).alias("cands")
    )
    select = _mmr_batches(n, beta, alias_threshold, matrix)

    def run(batches):
        for pdf in select(_documents(batches, matrix)):
            yield pa.RecordBatch.from_pandas(pdf, MMR_ARROW, preserve_index=False)

    return per_doc.mapInArrow(run, MMR_SCHEMA)
