"""Toxicity by multiple-instance learning: a document is a bag of sentences.

Only documents carry labels.  Every sentence gets a probability from the words
it holds, the document's score is the noisy-or of its sentences (with a leak for
documents in which no sentence says anything), and the likelihood of the
document labels is climbed through that noisy-or, so the blame settles on the
sentences that explain the label.  Those with a high probability are located.

The model is fitted on a bounded sample of labelled rows (``max_train_docs``,
taken in the order of a hash of the id, texts up to ``max_train_chars``
characters); every document is scored over its whole text.

Defined results: null and empty texts hold no sentence and score the leak;
documents without a label are scored like all others; a repeated doc_id is
scored row by row; without labelled rows of both classes all documents get the
share of toxic labels (0 without labels).
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_remainder, read, register

MAX_TRAIN_DOCS = 5000
MAX_TRAIN_CHARS = 200_000
MIN_TOXIC_DOCS = 4
PREFIXES = (5, 6, 7)
_CACHE_WORDS = 400_000
_TOKEN = re.compile(r"\w+|[.!?\n]+")
_BREAK = frozenset(".!?\n")


def features(word: str) -> list[str]:
    """The lower-case word and its beginnings of 5 to 7 letters: inflected forms share their stem."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


@dataclass
class NoisyOrModel:
    """Feature weights of the sentence model; ``bias`` and ``leak`` as in the module text."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    leak: float = 0.0
    cache: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def word_weight(self, word: str) -> float:
        w = self.cache.get(word)
        if w is None:
            if len(self.cache) >= _CACHE_WORDS:
                self.cache.clear()
            w = self.cache[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return w

    def sentence_probs(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of each sentence that holds a weighted word."""
        found: list[tuple[int, int, float]] = []
        z, seen, start, end = 0.0, set(), -1, 0
        for m in _TOKEN.finditer(text):
            tok = m.group()
            if tok[0] in _BREAK:
                if seen:
                    found.append((start, m.end(), _sigmoid(self.bias + z)))
                z, seen, start = 0.0, set(), -1
                continue
            if start < 0:
                start = m.start()
            end = m.end()
            low = tok.lower()
            if low not in seen and (w := self.word_weight(low)):
                seen.add(low)
                z += w
        if seen:
            found.append((start, end, _sigmoid(self.bias + z)))
        return found

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or of the leak and the sentences; and the sentences themselves."""
        text = text or ""
        # texts without any weighted word need no sentence split
        if not any(map(self.word_weight, set(re.findall(r"\w+", text.lower())))):
            return self.leak, []
        found = self.sentence_probs(text)
        miss = 1.0 - self.leak
        for _, _, p in found:
            miss *= 1.0 - p
        return min(max(1.0 - miss, 0.0), 1.0), found


def _sigmoid(z: float) -> float:
    return 1.0 / (1.0 + math.exp(-min(max(z, -40.0), 40.0)))


def sentences(text: str) -> list[list[str]]:
    """Distinct lower-case words of each sentence."""
    out: list[list[str]] = []
    words: dict[str, None] = {}
    for tok in _TOKEN.findall(text):
        if tok[0] in _BREAK:
            if words:
                out.append(list(words))
            words = {}
        else:
            words[tok.lower()] = None
    if words:
        out.append(list(words))
    return out


def fit_noisy_or(texts: list[str | None], labels: list[int], rounds: int = 200, rate: float = 0.3, l1: float = 1e-4, bias: float = -6.0) -> NoisyOrModel:
    """Maximise the noisy-or likelihood of document labels over feature weights (full gradient, L1 by soft threshold).

    Candidate features are those found in at least four toxic documents and clearly more often there than elsewhere,
    so a small sample gives a cautious model rather than one that takes chance for evidence.
    """
    y = np.asarray(labels, dtype=np.float64)
    n, n_pos = len(y), int(sum(labels))
    if n == 0 or n_pos in (0, n):
        return NoisyOrModel(bias=bias, leak=float(y.mean()) if n else 0.0)
    in_docs, in_toxic = Counter(), Counter()
    for t, v in zip(texts, labels):
        seen = {f for w in set(re.findall(r"\w+", (t or "").lower())) for f in features(w)}
        if v:
            in_toxic.update(seen)
        in_docs.update(seen)
    odds, vocab = {}, []
    for f, c in in_toxic.items():
        other = in_docs[f] - c
        odds[f] = math.log((c + 0.5) / (n_pos + 1)) - math.log((other + 0.5) / (n - n_pos + 1))
        sure = odds[f] / math.sqrt(1 / (c + 0.5) + 1 / (other + 0.5))
        # much more often and not by chance, or somewhat more often and surely so
        if c >= MIN_TOXIC_DOCS and (odds[f] > 3.0 and sure > 2.3 or odds[f] > 1.5 and sure > 4.0):
            vocab.append(f)
    vocab = {f: i for i, f in enumerate(sorted(vocab))}
    word, sent, doc_of = array("l"), array("l"), array("l")
    for d, t in enumerate(texts):
        for s in sentences(t or ""):
            known = {vocab[f] for w in s for f in features(w) if f in vocab}
            if known:
                word.extend(sorted(known))
                sent.extend([len(doc_of)] * len(known))
                doc_of.append(d)
    word, sent, doc_of = (np.array(x, dtype=np.int64) for x in (word, sent, doc_of))
    w = np.array([odds[f] for f in vocab])
    grads = np.full(len(vocab), 1e-4)
    base_leak = 1e-3
    for _ in range(rounds if len(word) else 0):
        z = bias + np.bincount(sent, weights=w[word], minlength=len(doc_of))
        p = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-12, 1 - 1e-9)
        log_miss = np.bincount(doc_of, weights=np.log1p(-p), minlength=n) + np.log1p(-base_leak)
        hit = np.clip(-np.expm1(log_miss), 1e-9, 1)
        pull = np.where(y[doc_of] > 0, (1 - hit[doc_of]) / hit[doc_of], -1.0) * p
        g = np.bincount(word, weights=pull[sent], minlength=len(vocab)) / n
        grads += g * g
        step = rate / np.sqrt(grads)
        w = w + step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0.0)
    keep = {v: round(float(w[i]), 6) for v, i in vocab.items() if abs(w[i]) > 0.3}
    if not any(x > 0 for x in keep.values()):
        return NoisyOrModel(bias=bias, leak=float(y.mean()))
    bare = NoisyOrModel(keep, bias, 0.0)
    silent = [int(v) for t, v in zip(texts, y) if bare.score(t)[0] < 0.5]
    return NoisyOrModel(keep, bias, min(0.45, (sum(silent) + 0.1) / (len(silent) + 1)))


def training_sample(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_chars: int = MAX_TRAIN_CHARS) -> DataFrame:
    """At most ``max_docs`` labelled rows outside the held-out fold: doc_id, text, toxic."""
    lab = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (id_remainder() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)  # at most max_docs rows: safe to broadcast
    return docs.select("doc_id", "text").where(F.length("text") <= max_chars).join(F.broadcast(picked), "doc_id")


def fit_on(docs: DataFrame, labels: DataFrame, **bounds) -> NoisyOrModel:
    rows = sorted(training_sample(docs, labels, **bounds).collect(), key=lambda r: (r["doc_id"], r["text"]))
    return fit_noisy_or([r["text"] for r in rows], [r["toxic"] for r in rows])


def drop_toxic(docs: DataFrame, model: NoisyOrModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns unchanged."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return score_documents(whole, model, threshold).where(F.col("predicted") == 0).select("row.*")


def score_documents(docs: DataFrame, model: NoisyOrModel, threshold: float = 0.5) -> DataFrame:
    """``docs`` without its text, plus score, predicted and ``spans``: start, end (code points) and probability of the offending sentences."""
    others = [f for f in docs.schema.fields if f.name not in ("text", "score", "predicted", "spans")]
    src = docs.select(*[f.name for f in others], "text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["score double", "predicted int", "spans array<struct<start:int,end:int,prob:double>>"])
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("prob", pa.float64())]))

    def run(batches):
        for b in batches:
            scored = [model.score(t.as_py()) for t in b.column(b.num_columns - 1)]
            score = pa.array([s for s, _ in scored], type=pa.float64())
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(b.num_columns - 1)]
                + [score, pa.array([int(s >= threshold) for s, _ in scored], type=pa.int32()), pa.array([[{"start": x, "end": y, "prob": p} for x, y, p in f if p >= 0.5] for _, f in scored], type=span_type)],
                names=[f.name for f in others] + ["score", "predicted", "spans"],
            )

    return src.mapInArrow(run, schema)


@register("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; the model sees only labels whose id falls outside fold 0."""
    docs = read(spark, sf_dir, "documents")
    model = fit_on(docs, read(spark, sf_dir, "labels"))
    held = docs.select("doc_id", "text", F.coalesce(id_remainder() == 0, F.lit(False)).alias("held_out"))
    return score_documents(held, model).select("doc_id", "held_out", "score", "predicted", "spans")
