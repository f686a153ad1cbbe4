"""Phrase collocations counted with broadcast double-array tries.

Words stand for themselves as 64-bit hashes of (language, word) while phrases are
counted.  Four scans of the texts:

1. words: counts per language (exact, by the words themselves); those below the
   least count drop out, so no phrase that holds one can be frequent.
2. pairs of frequent words, and 3. triples and fours all of whose pairs are
   frequent, are sieved by their hashes: a scan sends its distinct phrases with their counts to
   buckets, and those whose sum stays below the least count drop out.  Which words and
   pairs are frequent is told to the tasks by bitmaps of a fixed size, which only
   let too much pass.  What is left is the candidates.
4. the candidates are cut into slices of at most ``SLICE`` phrases by their first words.  For
   each slice a double-array trie over word numbers (two digits a word) is built and
   broadcast; the states of all text positions advance together, level by level;
   accepting states are bin-counted, and the tasks' arrays are summed by ranges.

Scores need only the counts: every cut joins its two parts' counts.  All
integers that may pass 64 bits are decimals of 38 digits.

Bounds: a bitmap is 4 MB; a slice's trie some 30 MB; both are all that the
driver ever holds.  A longer candidate list means more slices, each one more scan.

Skew: phrases are pre-aggregated per stretch of text, so a frequent phrase is one
record of each; buckets are by phrase.  The ranking takes the first per (language, part) before the first per language.

Defined results: null text is empty, null lang is ``und``; repeated rows count as often as they occur;
an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytescan import LOWER, LOWER_VALUE, mix, span_hashes, text_chunks, word_spans
from .common import materialize, read, register, shuffle_width
from .piece_bpe import ragged

CHUNK_BYTES = 1 << 22
BITS = 25  # bits of a bitmap's addresses
SLICE = 500_000  # candidates of one trie
BUCKET_PHRASES = 500_000  # words of text per sieve bucket
FOLD_PHRASES = 1 << 20
RANGE = 1 << 15  # candidates summed by one task
DIGIT = 9  # bits of a word number that one transition reads
_U = np.uint64

IS_WORD = np.ones(256, dtype=bool)
# Bytes that separate words, and bytes that end a piece.
IS_WORD[[0x20, 0x09]] = False
IS_BREAK = np.zeros(256, dtype=bool)
IS_BREAK[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = True
IS_WORD &= ~IS_BREAK


class Stretch:
    """Words of a stretch of texts: hashes, whether a word goes on from the one before it, and where it stands."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, salt: np.ndarray):
        self.buf = buf
        self.starts, self.ends, self.doc = word_spans(buf, off, IS_WORD)
        breaks = np.cumsum(IS_BREAK[buf])[self.starts] if len(self.starts) else self.starts
        self.joined = np.zeros(len(self.starts), dtype=bool)
        self.joined[1:] = (self.doc[1:] == self.doc[:-1]) & (breaks[1:] == breaks[:-1])
        self.key = np.maximum(mix(span_hashes(buf, self.starts, self.ends, LOWER_VALUE) ^ salt[self.doc]), _U(1))


_salts: dict[str, int] = {}


def _salt(lang: str) -> int:
    if lang not in _salts:
        _salts[lang] = int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "big")
    return _salts[lang]


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Stretch, np.ndarray, list[str]]]:
    """Stretches of (lang, text) batches, with each document's number in the list of the batch's languages."""
    for b in batches:
        coded = b.column(0).dictionary_encode()
        langs = coded.dictionary.to_pylist()
        number = coded.indices.to_numpy(zero_copy_only=False)
        salt = np.array([_salt(x) for x in langs], dtype=_U)
        for lo, hi, buf, off in text_chunks(b.column(1), CHUNK_BYTES):
            yield Stretch(buf, off, salt[number[lo:hi]]), number[lo:hi], langs


def _count_words(batches):
    """(lang, word, key, n) of the distinct words of every stretch, and per language the number of words (key 0)."""
    for s, number, langs in stretches(batches):
        key, first, n = np.unique(s.key, return_index=True, return_counts=True)
        size = s.ends[first] - s.starts[first]
        raw = LOWER[s.buf[ragged(s.starts[first], size)]]
        words = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(raw)])
        totals = np.bincount(number[s.doc], minlength=len(langs))
        lang = pa.array(langs, pa.string()).take(pa.array(np.concatenate([number[s.doc[first]], np.arange(len(langs))])))
        yield pa.RecordBatch.from_arrays(
            [lang, pa.concat_arrays([words, pa.nulls(len(langs), pa.string())]), pa.array(np.concatenate([key, np.zeros(len(langs), dtype=_U)]).view(np.int64)), pa.array(np.concatenate([n, totals]))],
            names=["lang", "word", "key", "n"],
        )


def phrase_hash(keys: np.ndarray) -> np.ndarray:
    """Hash of every row of word keys."""
    h = np.full(len(keys), keys.shape[1], dtype=_U)
    with np.errstate(over="ignore"):
        for c in range(keys.shape[1]):
            h = mix(h * _U(0x9E3779B97F4A7C15) + keys[:, c])
    return h


def _bit_address(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - BITS)).astype(np.int64)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """2^BITS flags as bytes of 8, set where a hash (long column ``h``) falls; the driver gets at most 2^(BITS - 6) words."""
    address = hashes.select(F.shiftrightunsigned("h", 64 - BITS).alias("a"))
    words = address.select(F.shiftrightunsigned("a", 6).alias("w"), F.expr("shiftleft(1L, cast(a & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    got = words.toArrow()
    out = np.zeros(1 << (BITS - 6), dtype=np.int64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out.view(np.uint8)


def _has(flags: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _bit_address(h)
    return (flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _sieve(orders: tuple[int, ...], words, pairs, buckets: int):
    """Partition function: records of the distinct phrases of ``orders`` words, packed by bucket."""

    def records(s: Stretch):
        runs = s.joined[1:] & (_has(words.value, s.key)[:-1] & _has(words.value, s.key)[1:] if pairs is None else True)
        if pairs is not None:
            at = np.flatnonzero(runs)
            runs = runs.copy()
            runs[at] = _has(pairs.value, phrase_hash(np.stack([s.key[at], s.key[at + 1]], axis=1)))
        for order in orders:
            n = len(s.key) - order + 1
            if n <= 0:
                continue
            good = runs[:n].copy()
            for k in range(1, order - 1):
                good &= runs[k : k + n]
            at = np.flatnonzero(good)
            keys = np.stack([s.key[at + k] for k in range(order)], axis=1)
            h, first, times = np.unique(phrase_hash(keys), return_index=True, return_counts=True)
            bucket = (h % _U(buckets)).astype(np.int64)
            o = np.argsort(bucket, kind="stable")
            keys, times, bucket = keys[first[o]], times[o].astype(np.int32), bucket[o]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, dtype=np.int64)
            for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)]):
                yield int(bucket[x]), order, keys[x:y].tobytes(), times[x:y].tobytes()

    def run(batches):
        for s, _, _ in stretches(batches):
            rows = list(records(s))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "words", "keys", "times"])

    return run


def _fold(order: int, keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_ = np.concatenate(keys)
    _, first, at = np.unique(phrase_hash(all_), return_index=True, return_inverse=True)
    return all_[first], np.bincount(at, weights=np.concatenate(times), minlength=len(first)).astype(np.int64)


def _keep_frequent(least: int):
    """Partition function over records sorted by (bucket, words): the phrases whose sum reaches ``least``."""

    def finish(order, keys, times):
        keys, times = _fold(order, keys, times)
        keys = keys[times >= least]
        columns = [pa.array(keys[:, k].view(np.int64) if k < order else np.zeros(len(keys), dtype=np.int64)) for k in range(4)]
        h = phrase_hash(keys).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), order, dtype=np.int32)), *columns, pa.array(h)], names=["words", "k1", "k2", "k3", "k4", "h"])

    def run(batches):
        now, keys, times, n = None, [], [], 0
        for b in batches:
            for bucket, order, key, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                if (bucket, order) != now:
                    if now is not None:
                        yield finish(now[1], keys, times)
                    now, keys, times, n = (bucket, order), [], [], 0
                keys.append(np.frombuffer(key.as_py(), dtype=_U).reshape(-1, order))
                times.append(np.frombuffer(count.as_py(), dtype=np.int32))
                n += len(keys[-1])
                if n > FOLD_PHRASES:
                    key, count = _fold(order, keys, times)
                    keys, times, n = [key], [count], len(key) // 2
        if now is not None:
            yield finish(now[1], keys, times)

    return run


def _number(batches):
    """Candidates sorted by slice get their numbers within it."""
    now, n = None, 0
    for b in batches:
        piece = b.column(0).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])) if len(piece) else []
        out = np.empty(len(piece), dtype=np.int32)
        for x, y in zip(at, [*at[1:], len(piece)]):
            if piece[x] != now:
                now, n = piece[x], 0
            out[x:y] = n + np.arange(y - x)
            n += y - x
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "number"])


class DoubleArrayTrie:
    """Phrases over word numbers; a transition reads the two digits of a number.

    The state of a first word is its number.  ``base[s] + digit`` is the next
    state if ``check`` there is ``s``.  ``accept[s]`` is the phrase's number or -1.
    """

    def __init__(self, keys: np.ndarray, words: np.ndarray, number: np.ndarray):
        """``keys``: (phrases, 4) word keys of which the first ``words`` count."""
        inside = np.arange(4) < words[:, None]
        self.vocabulary, at = np.unique(keys[inside], return_inverse=True)
        ids = np.zeros(keys.shape, dtype=np.int64)
        ids[inside] = at
        self.phrases = int(number.max()) + 1 if len(number) else 0
        v = len(self.vocabulary)
        self.width = (max(v, 1) - 1 >> DIGIT) + 1
        self.span = max(self.width, 1 << DIGIT)
        size = v + 3 * len(keys) + self.span
        self.base, self.check = np.full(size, -1, dtype=np.int32), np.full(size, -1, dtype=np.int32)
        self.check[:v] = -2  # taken, and nobody's children
        self._claim, self._rng = np.zeros(size, dtype=np.int32), np.random.default_rng(1)
        state = ids[:, 0].copy()
        rows = np.arange(len(keys))
        where = {}
        for depth in range(1, 4):
            rows = rows[words[rows] > depth]
            for digit in (ids[rows, depth] >> DIGIT, ids[rows, depth] & ((1 << DIGIT) - 1)):
                edge, at = np.unique(state[rows] * (self.span + 1) + digit, return_inverse=True)
                state[rows] = self._place(edge // (self.span + 1), edge % (self.span + 1))[at]
            done = rows[words[rows] == depth + 1]
            where[depth] = (state[done], number[done])
        self.accept = np.full(len(self.check), -1, dtype=np.int32)
        for s, n in where.values():
            self.accept[s] = n
        del self._claim, self._rng

    def _grow(self, more: int) -> None:
        for name in ("base", "check"):
            setattr(self, name, np.concatenate([getattr(self, name), np.full(more, -1, dtype=np.int32)]))
        self._claim = np.concatenate([self._claim, np.zeros(more, dtype=np.int32)])

    def _place(self, parent: np.ndarray, digit: np.ndarray) -> np.ndarray:
        """Find room for the children of all parents (edges sorted by parent); returns the children's states."""
        if len(parent) == 0:
            return parent
        heads = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        kids = np.diff(heads, append=len(parent))
        base = np.full(len(heads), -1, dtype=np.int64)
        least = 1 << int(kids.max()).bit_length() - 1
        while least:
            for tried in range(17):
                todo = np.flatnonzero((base < 0) & (kids >= least))
                if len(todo) == 0:
                    break
                if tried == 16:  # no luck: windows of their own, whose holes smaller families will fill
                    tries = len(self.check) + np.arange(len(todo)) * self.span
                    self._grow((len(todo) + 1) * self.span)
                else:
                    tries = self._rng.integers(0, len(self.check) - self.span, len(todo))
                edge = ragged(heads[todo], kids[todo])
                owner = np.repeat(np.arange(len(todo)), kids[todo])
                slot = tries[owner] + digit[edge]
                self._claim[slot] = owner
                fits = (self.check[slot] == -1) & (self._claim[slot] == owner)
                good = np.logical_and.reduceat(fits, np.cumsum(kids[todo]) - kids[todo])
                base[todo[good]] = tries[good]
                self.check[slot[good[owner]]] = parent[edge[good[owner]]]
            least >>= 1
        self.base[parent[heads]] = base
        return np.repeat(base, kids) + digit

    def step(self, state: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Next states, -1 where there is none."""
        for digit in (number >> DIGIT, number & ((1 << DIGIT) - 1)):
            base = np.where(state >= 0, self.base[state], -1)
            to = base + digit
            to[base < 0] = 0
            state = np.where((base >= 0) & (self.check[to] == state), to, -1)
        return state

    def count(self, key: np.ndarray, joined: np.ndarray, counts: np.ndarray) -> None:
        """Add the occurrences of all phrases in one stretch to ``counts``."""
        kinds, at = np.unique(key, return_inverse=True)
        place = np.minimum(np.searchsorted(self.vocabulary, kinds), len(self.vocabulary) - 1)
        number = np.where(self.vocabulary[place] == kinds, place, -1)[at]
        position = np.flatnonzero(number >= 0)
        position = position[self.base[number[position]] >= 0]
        state = number[position]
        for depth in range(1, 4):
            after = position + depth
            go = after < len(key)
            go[go] = joined[after[go]] & (number[after[go]] >= 0)
            position, state = position[go], state[go]
            state = self.step(state, number[position + depth])
            position, state = position[state >= 0], state[state >= 0]
            hit = self.accept[state]
            counts += np.bincount(hit[hit >= 0], minlength=len(counts))


def _count_slice(trie):
    """Partition function: the occurrences of the slice's phrases, by ranges of their numbers."""

    def run(batches):
        t = trie.value
        counts = np.zeros(t.phrases, dtype=np.int64)
        for s, _, _ in stretches(batches):
            t.count(s.key, s.joined, counts)
        lows = [x for x in range(0, len(counts), RANGE) if counts[x : x + RANGE].any()]
        if lows:
            yield pa.RecordBatch.from_arrays([pa.array(lows, pa.int32()), pa.array([counts[x : x + RANGE].tobytes() for x in lows], pa.binary())], names=["low", "counts"])

    return run


def _sum_ranges(batches):
    """(low, counts) sorted by low: the sums, one row per phrase."""

    def finish(low, total):
        hit = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array((low + hit).astype(np.int32)), pa.array(total[hit])], names=["number", "f"])

    now = total = None
    for b in batches:
        for low, raw in zip(b.column(0).to_pylist(), b.column(1)):
            x = np.frombuffer(raw.as_py(), dtype=np.int64)
            if low == now:
                total = total + x
            else:
                if now is not None:
                    yield finish(now, total)
                now, total = low, x
    if now is not None:
        yield finish(now, total)


def phrase_counts(docs: DataFrame, least: int, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(words, phrases): words with lang, word, key, f (key 0: all words of lang); phrases of 2 to 4 words with keys (array of long) and f."""
    spark = docs.sparkSession
    sc, width = spark.sparkContext, shuffle_width(spark)
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    counted = texts.mapInArrow(_count_words, "lang string, word string, key long, n long").groupBy("lang", "word", "key").agg(F.sum("n").alias("f"))
    words = materialize(counted.where((F.col("f") >= least) | F.col("word").isNull()), "collocation-words")
    frequent = words.where("key != 0")
    total = words.where("key = 0").agg(F.sum("f")).first()[0]
    buckets = max(1, (total or 0) // BUCKET_PHRASES)
    known = sc.broadcast(bitmap(frequent.select(F.col("key").alias("h"))))

    def sieve(orders, pairs):
        rows = texts.mapInArrow(_sieve(orders, known, pairs, buckets), "bucket int, words int, keys binary, times binary")
        kept = rows.repartition(width, "bucket").sortWithinPartitions("bucket", "words")
        return materialize(kept.mapInArrow(_keep_frequent(least), "words int, k1 long, k2 long, k3 long, k4 long, h long"), "collocation-sieve")

    pairs = sieve((2,), None)
    longer = sieve((3, 4), sc.broadcast(bitmap(pairs.select("h"))))
    candidates = pairs.unionByName(longer).drop("h")
    n = candidates.count()
    slices = -(-n // SLICE)
    sliced = candidates.select(F.pmod(F.xxhash64("k1"), F.lit(max(slices, 1))).cast("int").alias("slice"), "*")
    spread = sliced.repartition(max(slices, 1), "slice").sortWithinPartitions("slice", "k1", "k2", "k3", "k4")
    numbered = materialize(spread.mapInArrow(_number, "slice int, words int, k1 long, k2 long, k3 long, k4 long, number int"), "collocation-candidates")
    found = None
    for piece in range(slices):
        part = numbered.where(F.col("slice") == piece).toArrow()
        keys = np.stack([part.column(c).to_numpy() for c in ("k1", "k2", "k3", "k4")], axis=1).view(_U)
        trie = sc.broadcast(DoubleArrayTrie(keys, part.column("words").to_numpy(), part.column("number").to_numpy()))
        shards = texts.mapInArrow(_count_slice(trie), "low int, counts binary")
        sums = shards.repartition(width, "low").sortWithinPartitions("low").mapInArrow(_sum_ranges, "number int, f long")
        rows = materialize(sums.select(F.lit(piece).alias("slice"), "number", "f"), "collocation-counts")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = spark.createDataFrame([], "slice int, number int, f long")
    all_keys = F.array("k1", "k2", "k3", "k4")
    phrases = numbered.join(found, ["slice", "number"]).where(F.col("f") >= least)
    return words, phrases.select(F.slice(all_keys, F.lit(1), F.col("words")).alias("keys"), "f")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, cover: tuple[int, int] = (80, 100), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of every language: lang, rank, phrase, a, l, r, n, score.

    ``cover``: a phrase goes if a longer candidate around it has at least this share of its count.
    """
    words, phrases = phrase_counts(docs, least, lang_col, text_col)
    phrases = materialize(phrases, "collocation-phrases")
    singles = words.where("key != 0").select(F.array("key").alias("keys"), "f")
    parts = phrases.unionByName(singles)
    size = F.size("keys")

    longer = phrases.where(size > 2).select("f", F.explode(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.slice("keys", at, n)))).alias("same"))
    around = longer.select("f", F.explode("same").alias("keys")).groupBy("keys").agg(F.max("f").alias("around"))
    whole = F.col("f").cast("decimal(20,0)")
    kept = phrases.join(around, "keys", "left").where(F.col("around").isNull() | (F.col("around").cast("decimal(20,0)") * cover[1] < whole * cover[0]))

    cuts = kept.select("keys", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.withColumn("first", F.slice("keys", F.lit(1), F.col("cut"))).withColumn("rest", F.slice("keys", F.col("cut") + 1, size - F.col("cut")))
    cuts = cuts.join(parts.select(F.col("keys").alias("first"), F.col("f").alias("l")), "first").join(parts.select(F.col("keys").alias("rest"), F.col("f").alias("r")), "rest")
    score = F.expr("cast((cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    scored = cuts.withColumn("score", score).groupBy("keys", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s")).select("keys", "a", "s.score", "s.l", "s.r")

    names = words.where("key != 0").select("lang", "word", "key")
    scored = scored.withColumn("key", F.element_at("keys", 1)).join(names.select("lang", "key"), "key").drop("key")
    best = [F.col("score").desc(), F.col("a").desc()]
    scored = scored.withColumn("_part", F.pmod(F.xxhash64("keys"), F.lit(64)))
    for by in (["lang", "_part"], ["lang"]):
        # rank keeps all ties; the texts decide among them below
        scored = scored.withColumn("_at", F.rank().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("_at") <= top)
    spelled = scored.select("keys", F.posexplode("keys").alias("at", "key")).join(names.select("key", "word"), "key")
    spelled = spelled.groupBy("keys").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    totals = words.where("key = 0").select("lang", F.col("f").alias("n"))
    ranked = scored.join(spelled, "keys").join(totals, "lang")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best, F.col("phrase"))).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT d, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS ks(k) WHERE len(w) >= k)
  GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k >= 2 AND f >= 30
), inside AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS around
  FROM (SELECT lang, a, ws, m, unnest(generate_series(1, k - m + 1)) AS i FROM c, (VALUES (2), (3)) AS ms(m) WHERE m < k)
  GROUP BY ALL
), kept AS (
  SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE around IS NULL OR 100 * around::HUGEINT < 80 * a::HUGEINT
), cut AS (
  SELECT lang, k, phrase, a, ws, unnest(generate_series(1, k - 1)) AS cut FROM kept
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f::HUGEINT))::BIGINT AS score
  FROM cut c
  JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.cut], ' ')
  JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.cut + 1:], ' ')
), least AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM least JOIN n USING (lang) QUALIFY rank <= 2000
"""


@register("op13_collocations", _SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language over all documents."""
    return collocations(read(spark, sf_dir, "documents"))
