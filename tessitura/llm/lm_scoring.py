"""Language-model scoring with a distributed Elias-Fano n-gram trie.

The model is an interpolated bigram model over all words of the training texts;
every word is a context and a successor of its own:

    p(w | v) = b(v) * (c(v, w) / mu + p(w)),   b(v) = mu / (c(v) + mu)
    p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))

so it sums to one over the seen words and the unseen.  b(v) is a factor of its
own, so a document's score is a sum over its bigrams of the bracket and a sum
over its words of b.  Bigrams are dealt out by their second word: a shard has all
bigrams of its words, so c(w) is their sum, and the document's sums for w (base
score, known words, w as a context) are made there too.  It builds the trie of
its bigrams (word, then the word before; c / mu is stored as a quantised log).

Pass 1 counts all words.  Pass 2 sends every distinct bigram of each document
to its shard.  The driver gets three totals and the listed words (below).

Skew: words that make up more than one bucket's share of all text are listed (by
that share there are fewer of them than buckets); their counts go to all tasks
and their bigrams are dealt out by both words.  The list decides where a bigram
is counted, not whether.  Words are pre-aggregated per block, bigrams per document.

Defined results: null and empty texts consist of the end token; repeated
documents are scored (and, in training folds, counted) row by row; a null doc_id
is in no held-out fold; without training text every count is 0.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import lower_words, mix, text_chunks
from .common import materialize, read, register, shuffle_width, small_batches
from .jaccard_join import _from_six, _six_bytes
from .ngram_trie import NGramTrie

SHORTLIST = 65_000  # listed words have 16-bit numbers
RARE, BEGIN = 65_534, 65_535
FIRST, END = 0, 1  # 48-bit ids of what stands before the first word and of the end token; hashed words have ids above 255
MU = 400.0
FLUSH_TOKENS = 1_000_000
FLUSH_DOCS = 60_000
BUCKETS_PER_TASK = 8
_MOST = 32_767
_U = np.uint64


def _tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48-bit word ids of a stretch of documents, each closed by the end token, and their document numbers."""
    h, doc = lower_words(buf, off)
    n_docs = len(off) - 1
    upto = np.searchsorted(doc, np.arange(1, n_docs + 1))
    ends = upto + np.arange(n_docs)
    w = np.full(len(h) + n_docs, END, dtype=_U)
    inside = np.ones(len(w), dtype=bool)
    inside[ends] = False
    w[inside] = np.maximum(h >> _U(16), _U(256))
    docs = np.empty(len(w), dtype=np.int64)
    docs[inside], docs[ends] = doc, np.arange(n_docs)
    return w, docs


def _pack_words(words: np.ndarray, times: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """(bucket, 48-bit id, 15-bit count and training flag each in 8 bytes); ``words`` are 2 * id + flag."""
    times = times.astype(np.int64)
    while (times > _MOST).any():
        big = times > _MOST
        words, times = np.concatenate([words, words[big]]), np.concatenate([np.where(big, _MOST, times), times[big] - _MOST])
    bucket = (mix(words >> _U(1)) % _U(buckets)).astype(np.int64)
    o = np.argsort(bucket, kind="stable")
    packed = ((words >> _U(1)) << _U(16)) | (times.astype(_U) << _U(1)) | (words & _U(1))
    packed, cut = packed[o], np.searchsorted(bucket[o], np.arange(buckets + 1))
    return [(b, packed[cut[b] : cut[b + 1]].tobytes()) for b in range(buckets) if cut[b + 1] > cut[b]]


def _count_words(buckets: int):
    """Partition function over (train, text)."""

    def batch(held):
        words, times = np.unique(np.concatenate(held), return_counts=True)
        rows = _pack_words(words, times, buckets)
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "x"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            train = b.column(0).to_numpy(zero_copy_only=False).astype(_U)
            for lo, _, buf, off in text_chunks(b.column(1)):
                w, doc = _tokens(buf, off)
                held.append((w << _U(1)) | train[lo + doc])
                n += len(w)
                if n >= FLUSH_TOKENS:
                    yield batch(held)
                    held, n = [], 0
        if held:
            yield batch(held)

    return run


def _sum_words(listed: int):
    """Partition function: the end token, the words with more than 1 / ``listed`` of the partition's tokens, and one row (-1) with its totals.

    ``times`` are counted in training texts, ``every`` in all texts.
    """

    def run(batches):
        parts = [np.frombuffer(x, _U) for b in batches for x in b.column(1).to_pylist()]
        if not parts:
            return
        all_ = np.concatenate(parts)
        words, at = np.unique(all_ >> _U(16), return_inverse=True)
        n = ((all_ & _U(65_535)) >> _U(1)).astype(np.float64)
        every = np.bincount(at, weights=n).astype(np.int64)
        times = np.bincount(at, weights=np.where(all_ & _U(1), n, 0)).astype(np.int64)
        o = np.flatnonzero((every * listed > every.sum()) | (words == END))
        kinds = np.append(np.zeros(len(o), dtype=np.int64), np.count_nonzero(times))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(words[o].astype(np.int64), -1)), pa.array(np.append(times[o], times.sum())), pa.array(np.append(every[o], every.sum())), pa.array(kinds)], names=["word", "times", "every", "kinds"]
        )

    return run


class Shortlist:
    """The listed words, their counts, and the totals of the training text; all other words are RARE here and counted by their shards."""

    def __init__(self, words: np.ndarray, times: np.ndarray, n: int, v: int, n_docs: int):
        o = np.argsort(words)
        self.words, self.times = words[o].astype(_U), times[o].astype(np.int64)
        self.n, self.v, self.n_docs = n, v, n_docs
        self.rare_n, self.rare_v = n - int(self.times.sum()), v - int(np.count_nonzero(self.times))
        self.total = n + 0.5 * (v + 1)
        self.rare_total = self.rare_n + 0.5 * (self.rare_v + 1)
        # p(w) and c(v) by 16-bit number
        self.lower = np.zeros(65_536)
        self.lower[: len(words)] = (self.times + 0.5) / self.total
        self.lower[RARE] = self.rare_total / self.total
        self.context = np.zeros(65_536)
        self.context[: len(words)] = self.times
        self.context[RARE], self.context[BEGIN] = self.rare_n, n_docs

    def number(self, words: np.ndarray) -> np.ndarray:
        """16-bit number of each word; RARE outside the list."""
        if not len(self.words):
            return np.full(len(words), RARE, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, RARE)


_SENT = "kind int, bucket int, flush long, x binary, y binary, z binary"
_SENT_NAMES = ["kind", "bucket", "flush", "x", "y", "z"]
_SENT_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
DOCS, PAIRS, SUMS = 0, 1, 2
# DOCS: x ids, y tokens and known words, z base score and sum of log b, both of listed words.  PAIRS: x words with their number of
# pairs, y words before them with their number of entries, z documents and 2 * count + training flag of the entries.
# SUMS: x documents, y score and base score, z known words.


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_SENT_TYPES)], names=_SENT_NAMES)


def _entries(w: np.ndarray, v: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (w, v, document) in this order, and how often each occurs; more than ``_MOST`` in several entries."""
    if max(w.max(), v.max()) < 1 << 24:
        key = np.sort((w.astype(_U) << _U(40)) | (v.astype(_U) << _U(16)) | doc.astype(_U))
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        k = key[at]
        w, v, d = ((k >> _U(40)).astype(np.int64), ((k >> _U(16)) & _U((1 << 24) - 1)).astype(np.int64), (k & _U(65_535)).astype(np.int64))
    else:
        key = o = np.lexsort((doc, v, w))
        w, v, d = w[o], v[o], doc[o]
        at = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (v[1:] != v[:-1]) | (d[1:] != d[:-1])))
        w, v, d = w[at], v[at], d[at]
    times = np.diff(np.append(at, len(key)))
    if (times > _MOST).any():
        pieces = -(-times // _MOST)
        i = np.repeat(np.arange(len(times)), pieces)
        last = np.append(i[1:] != i[:-1], True)
        w, v, d, times = w[i], v[i], d[i], np.where(last, times[i] - _MOST * (pieces[i] - 1), _MOST)
    return w, v, d, times


def _send(short: Shortlist, buckets: int, mu: float):
    """Partition function over (id, train, text): document rows, and bigrams per bucket."""

    def pack(flush, parts):
        ids, train, w, doc = (np.concatenate(x) for x in zip(*parts))
        n_docs = len(ids)
        words, at = np.unique(np.append(_U(FIRST), w), return_inverse=True)
        w = at[1:]
        v = np.zeros(len(w), dtype=np.int64)
        v[1:] = np.where(doc[1:] != doc[:-1], 0, w[:-1])
        f = short.number(words)
        listed, c = f != RARE, short.context[f]
        base = np.bincount(doc, weights=np.where(listed, np.log10(c + 0.5), 0.0)[w], minlength=n_docs)
        known = np.bincount(doc, weights=(listed & (c > 0)).astype(np.float64)[w], minlength=n_docs)
        back = np.bincount(doc, weights=np.where(listed & (words != END), np.log10(mu / (c + mu)), 0.0)[w], minlength=n_docs)
        n_tokens = np.bincount(doc, minlength=n_docs)
        yield _rows([(DOCS, int(flush % buckets), flush, ids.tobytes(), np.stack([n_tokens, known.astype(np.int64)]).astype(np.int64).tobytes(), np.stack([base, back]).tobytes())])
        w, v, d, times = _entries(w, v, doc)
        t = (2 * times + train[d]).astype(np.uint16)
        pair = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (v[1:] != v[:-1])))
        n = np.diff(np.append(pair, len(w)))
        w, v = w[pair], v[pair]
        with np.errstate(over="ignore"):
            spread = mix(words[w])
            spread = np.where(listed[w], mix(spread + words[v]), spread)
        bucket = (spread % _U(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
        o = np.argsort(bucket, kind="stable")
        bucket, w, v, pair, n = bucket[o], w[o], v[o], pair[o], n[o]
        ends = np.cumsum(n)
        entry = np.arange(ends[-1]) + np.repeat(pair - (ends - n), n)
        d, t = d[entry].astype(np.uint16), t[entry]
        head = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (bucket[1:] != bucket[:-1])))
        n_pairs = np.diff(np.append(head, len(w))).astype(np.uint32)
        first, before, n, ends = words[w[head]], words[v], n.astype(np.uint32), np.append(0, ends)
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        word_cut = np.searchsorted(head, cut)
        rows = []
        for b in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            i, j, k = slice(word_cut[b], word_cut[b + 1]), slice(cut[b], cut[b + 1]), slice(ends[cut[b]], ends[cut[b + 1]])
            rows.append((PAIRS, b, flush, _six_bytes(first[i]) + n_pairs[i].tobytes(), _six_bytes(before[j]) + n[j].tobytes(), d[k].tobytes() + t[k].tobytes()))
        yield _rows(rows)

    def run(batches):
        part = TaskContext.get().partitionId()
        parts, n, n_docs, no = [], 0, 0, 0
        for b in batches:
            ids, train = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, buf, off in text_chunks(b.column(2)):
                for a in range(lo, hi, FLUSH_DOCS):
                    z = min(a + FLUSH_DOCS, hi)
                    if n_docs + z - a > FLUSH_DOCS:
                        yield from pack(part << 24 | no, parts)
                        parts, n, n_docs, no = [], 0, 0, no + 1
                    piece = off[a - lo : z - lo + 1]
                    w, doc = _tokens(buf[piece[0] : piece[-1]], piece - piece[0])
                    parts.append((ids[a:z], train[a:z], w, doc + n_docs))
                    n, n_docs = n + len(w), n_docs + z - a
                    if n >= FLUSH_TOKENS:
                        yield from pack(part << 24 | no, parts)
                        parts, n, n_docs, no = [], 0, 0, no + 1
        if parts:
            yield from pack(part << 24 | no, parts)

    return run


def bigram_trie(pairs: np.ndarray, times: np.ndarray, context: np.ndarray, mu: float, universe: int | None = None) -> NGramTrie:
    """Trie of the distinct ``pairs`` (one word's number in the upper half of the bits, the other's in the lower; sorted) with log10 times / (context + mu) as quantised values."""
    half = pairs.dtype.type(pairs.dtype.itemsize * 4)
    upper = (pairs >> half).astype(np.int64)
    grams = np.stack([upper, (pairs & pairs.dtype.type((1 << int(half)) - 1)).astype(np.int64)], 1)
    return NGramTrie(grams, [None, np.log10(times / (context[upper] + mu))], universe or 1 << int(half))


def _with_counts(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """48-bit ids and the 32-bit count of each."""
    ids = [_from_six(x[: len(x) // 10 * 6]) for x in blobs]
    return np.concatenate(ids), np.concatenate([np.frombuffer(x[len(x) // 10 * 6 :], np.uint32) for x in blobs])


def _score_shards(short: Shortlist, mu: float):
    """Partition function: sums per document of the bigrams that this shard holds."""

    def run(batches):
        rows = []
        for b in batches:
            passed = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                (passed if row[0] == DOCS else rows).append(row)
            if passed:
                yield _rows(passed)
        if not rows:
            return
        spread = TaskContext.get().partitionId()
        rows.sort(key=lambda r: r[2])
        flush, sizes = [r[2] for r in rows], [len(r[5]) // 4 for r in rows]
        w, n_pairs = _with_counts([r[3] for r in rows])
        v, n = _with_counts([r[4] for r in rows])
        d = np.concatenate([np.frombuffer(r[5][: len(r[5]) // 2], np.uint16) for r in rows])
        t = np.concatenate([np.frombuffer(r[5][len(r[5]) // 2 :], np.uint16) for r in rows])
        del rows
        words, w = np.unique(w, return_inverse=True)
        before, v = np.unique(v, return_inverse=True)
        key, number = np.unique((np.repeat(w, n_pairs).astype(_U) << _U(32)) | v.astype(_U), return_inverse=True)
        number = np.repeat(number, n)
        times = np.bincount(number, weights=np.where(t & 1, t >> 1, 0), minlength=len(key))
        w, v = (key >> _U(32)).astype(np.int64), (key & _U((1 << 32) - 1)).astype(np.int64)
        f = short.number(words)
        listed = f != RARE
        c = np.bincount(w, weights=times, minlength=len(words))  # of words that are not listed all bigrams are here
        p = np.where(listed, short.lower[f], (c + 0.5) / short.total)
        back = np.where(listed | (words == END), 0.0, np.log10(mu / (c + mu)))
        base, known = np.where(listed, 0.0, np.log10(c + 0.5)), np.where(listed, 0, c > 0)
        seen = times > 0
        direct = np.zeros(len(key))
        if seen.any():
            trie = bigram_trie(key[seen], times[seen], np.zeros(len(words)), mu, len(before))
            direct = 10.0 ** trie.value(np.stack([w, v], 1), -np.inf)
        score = np.log10(direct + p[w]) + back[w]
        base, known = base[w], known[w]
        cut = np.append(0, np.cumsum(sizes))
        heads = [i for i in range(len(flush)) if not i or flush[i] != flush[i - 1]]
        out = []
        for i, j in zip(heads, [*heads[1:], len(flush)]):
            e = slice(cut[i], cut[j])
            k, doc, m = number[e], d[e], (t[e] >> 1).astype(np.float64)
            docs = np.flatnonzero(np.bincount(doc))
            sums = [np.bincount(doc, weights=x[k] * m)[docs] for x in (score, base, known)]
            out.append((SUMS, spread, flush[i], docs.astype(np.uint16).tobytes(), np.stack(sums[:2]).tobytes(), sums[2].astype(np.uint32).tobytes()))
            if len(out) == 200:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    return run


_SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _collect_scores(short: Shortlist, mu: float):
    """Partition function over rows sorted by flush: one row per document."""

    def finish(doc_row, sums):
        ids = np.frombuffer(doc_row[3], np.int64)
        n_tokens, known = np.frombuffer(doc_row[4], np.int64).reshape(2, -1)
        base, score = np.frombuffer(doc_row[5], np.float64).reshape(2, -1)
        known, base, score = known.copy(), base - n_tokens * np.log10(short.total), score + np.log10(mu / (short.context[BEGIN] + mu))
        for row in sums:
            docs, both = np.frombuffer(row[3], np.uint16), np.frombuffer(row[4], np.float64).reshape(2, -1)
            score[docs] += both[0]
            base[docs] += both[1]
            known[docs] += np.frombuffer(row[5], np.uint32)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n_tokens), pa.array(known), pa.array(base), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    def run(batches):
        flush, doc_row, sums = None, None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[2] != flush:
                    if doc_row is not None:
                        yield finish(doc_row, sums)
                    flush, doc_row, sums = row[2], None, []
                if row[0] == DOCS:
                    doc_row = row
                else:
                    sums.append(row)
        if doc_row is not None:
            yield finish(doc_row, sums)

    return run


def score_texts(docs: DataFrame, training, mu: float = MU, shortlist: int = SHORTLIST) -> DataFrame:
    """_row, n_tokens, n_known, base_score, score, train_tokens for ``docs`` (_row: long, text); learns from rows where ``training`` holds."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    width = shuffle_width(spark)
    buckets = width * BUCKETS_PER_TASK
    listed = max(min(buckets, shortlist), 1)
    train = F.coalesce(training, F.lit(False)).alias("train")
    counted = docs.select(train, "text").mapInArrow(_count_words(buckets), "bucket int, x binary").repartition(width, "bucket").mapInArrow(_sum_words(listed), "word long, times long, every long, kinds long")
    counted = materialize(counted, "lm-words")
    n, v, every = counted.where(F.col("word") == -1).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("times", "kinds", "every")]).first()
    top = counted.where((F.col("word") >= 0) & (F.col("every") * listed > every)).select("word", "times").collect()  # fewer than ``listed`` rows
    n_docs = counted.where(F.col("word") == END).agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    short = Shortlist(np.array([r["word"] for r in top], dtype=np.int64), np.array([r["times"] for r in top], dtype=np.int64), int(n), int(v), int(n_docs))
    sent = docs.select("_row", train, "text").mapInArrow(_send(short, buckets, mu), _SENT)
    summed = sent.repartition(width, "bucket").mapInArrow(_score_shards(short, mu), _SENT)
    scored = summed.repartition(width, "flush").sortWithinPartitions("flush").mapInArrow(_collect_scores(short, mu), _SCORED)
    return scored.withColumnRenamed("doc_id", "_row").withColumn("train_tokens", F.lit(int(n)).cast("long"))


@register("op4_lm_scoring")
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; folds other than 1 are the training text."""
    docs = read(spark, sf_dir, "documents")
    # a null id travels as the smallest long
    no_id = F.lit(-(1 << 63))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), no_id).alias("_row"), "text")
    doc_id = F.when(F.col("_row") != no_id, F.col("_row"))
    held = F.coalesce((F.crc32(doc_id.cast("string")) % 5) == 1, F.lit(False))
    return score_texts(rows, ~held).select(doc_id.alias("doc_id"), held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
