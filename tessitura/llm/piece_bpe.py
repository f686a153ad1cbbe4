"""SentencePiece (BPE with byte fallback) encoding and decoding by vectorised merge rounds.

Texts of a batch lie in one byte buffer.  It is cut into words where no piece of
the vocabulary can reach across (before a space that follows no space); equal
words are encoded once.  The symbols of all new words lie in one flat array: every round takes
each word's least pair rank with a segmented minimum, merges its occurrences from
the left in all words at once, compacts the arrays and ranks only the pairs that
changed, until no word has a pair left.  Where a merged piece could make a pair of a rank no worse
than its own, only the leftmost occurrence is merged in that round, so the order of
merges is the library's.  Characters without a piece become byte pieces.

The vocabulary is read once on the driver and broadcast: its size is that of the
model file (32,000 pieces here), whatever the texts.

Defined results: null and empty texts have no ids and decode to the empty text;
ids out of the vocabulary, null ids and control ids decode to nothing; all other columns stay
(a column that already has the name of the new one is replaced).
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import BYTE_VALUE, span_hashes, text_chunks
from .common import read, register

MARK = "▁"
CHUNK_BYTES = 1 << 20  # bytes encoded at once
CACHE_WORDS = 1 << 19  # a worker forgets its words beyond this many
BATCH_ROWS = 1000  # rows sent back at once
LONG_SYMBOLS = 1 << 12  # words with more symbols are merged with a heap, in the same order
OTHER = 1 << 16  # symbol of a character without a piece: OTHER + code point
NONE = np.int32(2**31 - 1)
_U = np.uint64


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PairTable:
    """Open-addressing hash table from symbol pairs to numbers, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        self.bits = max(10, int(2.5 * len(left)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int32)
        key = left.astype(np.int64) << 21 | right.astype(np.int64)
        key, at = np.unique(key, return_index=True)
        value, slot = value[at], self._slot(key)
        while len(key):
            slot, first = slot % len(self.keys), None
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[free[first]]
            self.keys[slot[first]], self.values[slot[first]] = key[first], value[first]
            rest = np.ones(len(key), dtype=bool)
            rest[first] = False
            key, value, slot = key[rest], value[rest], slot[rest] + 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 21 | right
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.values[slot], np.int32(-1))
        todo = np.flatnonzero((there != key) & (there >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[todo]]
            hit = there == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... for every (start, count), one after the other."""
    total = int(counts.sum())
    base = starts - (np.cumsum(counts) - counts)
    return np.repeat(base, counts) + np.arange(total)


class Vocabulary:
    """Arrays of a SentencePiece BPE model; made from the model file alone."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size, self.key = n, uuid.uuid4().hex
        names = [sp.id_to_piece(i) for i in range(n)]
        is_byte = np.array([sp.is_byte(i) for i in range(n)])
        plain = np.array([not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) for i in range(n)])
        probe = " Ａ  b "
        if is_byte.sum() != 256 or sp.decode(sp.encode(probe)) != probe or not sp.encode("b", out_type=str)[0].startswith(MARK) or any(sp.is_unused(i) for i in range(n)):
            raise ValueError("a BPE model with byte fallback, a space put before texts and unchanged characters is needed")
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for i in np.flatnonzero(is_byte):
            self.byte_ids[int(names[i][3:5], 16)] = i
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank_of = {s: k for k, s in enumerate(sorted(set(scores[plain]), reverse=True))}
        self.rank = np.array([rank_of[s] if p else NONE for s, p in zip(scores, plain)], dtype=np.int32)
        ids = {names[i]: i for i in np.flatnonzero(plain)}
        self.char = np.arange(OTHER, OTHER + 0x110000, dtype=np.int32)
        for t, i in ids.items():
            if len(t) == 1:
                self.char[ord(t)] = i
        self.char[0x20] = self.char[ord(MARK)]

        def symbol(t: str) -> int | None:
            return int(self.char[ord(t)]) if len(t) == 1 else ids.get(t)

        pairs, touching = [], set()
        for t, i in ids.items():
            if MARK in t.lstrip(MARK):
                raise ValueError(f"piece {i} has a space after other characters")
            touching.update(zip(t, t[1:]))
            for cut in range(1, len(t)):
                a, b = symbol(t[:cut]), symbol(t[cut:])
                if a is not None and b is not None:
                    pairs.append((a, b, i))
        left, right, made = (np.array(x, dtype=np.int64) for x in zip(*pairs))
        self.pairs = PairTable(left, right, made)
        near = np.array([(self.char[ord(a)], self.char[ord(b)]) for a, b in touching], dtype=np.int64)
        self.touching = PairTable(near[:, 0], near[:, 1], np.zeros(len(near), dtype=np.int32))
        # a piece is safe if every pair that it can form ranks behind it
        best = np.full(n, NONE, dtype=np.int32)
        for side in (left, right):
            known = side < n
            np.minimum.at(best, side[known], self.rank[made[known]])
        self.safe = best > self.rank
        as_bytes = [bytes([int(t[3:5], 16)]) if b else t.replace(MARK, " ").encode() if p else b"" for t, b, p in zip(names, is_byte, plain)]
        self.piece_len = np.array(list(map(len, as_bytes)), dtype=np.int64)
        self.piece_off = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(as_bytes), dtype=np.uint8)
        self.leading_space = np.array([p and t.startswith(MARK) for t, p in zip(names, plain)])

    def _code_points(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points of UTF-8 bytes and where each starts."""
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        code = raw[at].astype(np.int32)
        wide = np.flatnonzero(code >= 0x80)
        if len(wide):
            padded = np.concatenate([raw, np.zeros(3, dtype=np.uint8)])
            b0 = code[wide]
            b1, b2, b3 = ((padded[at[wide] + k] & 0x3F).astype(np.int32) for k in (1, 2, 3))
            two, three, four = (b0 & 0x1F) << 6 | b1, (b0 & 0x0F) << 12 | b1 << 6 | b2, (b0 & 0x07) << 18 | b1 << 12 | b2 << 6 | b3
            code[wide] = np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, four))
        return code, at

    def encode_spans(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every span of ``buf`` as a text of its own (no space put before it), and how many each has."""
        sizes = ends - starts
        if sizes.sum() == 0:
            return np.zeros(0, dtype=np.int32), np.zeros(len(starts), dtype=np.int64)
        code, at = self._code_points(buf[ragged(starts, sizes)])
        sym = self.char[code]
        word = np.searchsorted(np.cumsum(sizes), at, side="right")
        last = np.empty(len(sym), dtype=bool)
        last[-1] = True
        last[:-1] = (word[1:] != word[:-1]) | (self.touching.find(sym[:-1], sym[1:]) < 0)
        heads = np.flatnonzero(np.concatenate([[True], last[:-1]]))
        counts = self._merge(sym, last, heads)
        sym = sym[ragged(heads, counts)]
        word = np.repeat(word[heads], counts)
        other = sym >= OTHER
        if other.any():
            code = np.where(other, sym - OTHER, 0)
            width = np.where(other, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
            k = ragged(np.zeros(len(sym), dtype=np.int64), width)
            code, wide, other, word = (np.repeat(x, width) for x in (code, width, other, word))
            byte = code >> (6 * (wide - 1 - k)) & 0x3F | 0x80
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[wide] | code >> (6 * (wide - 1))
            sym = np.where(other, self.byte_ids[np.where(k == 0, lead, byte) & 0xFF], np.repeat(sym, width))
        return sym.astype(np.int32), np.bincount(word, minlength=len(starts))

    def _merge(self, out: np.ndarray, last: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Merge the words that start at ``heads`` until no pair is left; a word's symbols end up at its head.  Returns their counts."""
        counts = np.diff(heads, append=len(out))
        short = counts <= LONG_SYMBOLS
        for w in np.flatnonzero(~short):
            got = self._merge_heap(out[heads[w] : heads[w] + counts[w]].tolist())
            out[heads[w] : heads[w] + len(got)] = got
            counts[w] = len(got)
        word = np.flatnonzero((counts > 1) & short)
        take = ragged(heads[word], counts[word])
        sym, last = out[take], last[take]
        at = np.cumsum(counts[word]) - counts[word]
        made, rank = np.full(len(sym), -1, dtype=np.int32), np.full(len(sym), NONE, dtype=np.int32)
        open_ = np.flatnonzero(~last)
        while True:
            # pairs that changed (at first all)
            found = self.pairs.find(sym[open_], sym[open_ + 1])
            made[open_], rank[open_] = found, np.where(found >= 0, self.rank[found], NONE)
            if len(at) == 0:
                break
            least = np.minimum.reduceat(rank, at)
            size = np.diff(at, append=len(sym))
            done = least == NONE
            if done.any():
                out[ragged(heads[word[done]], size[done])] = sym[ragged(at[done], size[done])]
                counts[word[done]] = size[done]
                stay = np.repeat(~done, size)
                sym, last, made, rank = sym[stay], last[stay], made[stay], rank[stay]
                word, least, size = word[~done], least[~done], size[~done]
                at = np.cumsum(size) - size
                if len(word) == 0:
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            owner = np.searchsorted(at, hit, side="right")
            first = np.empty(len(hit), dtype=bool)
            first[0], first[1:] = True, owner[1:] != owner[:-1]
            run = first.copy()
            run[1:] |= hit[1:] != hit[:-1] + 1
            number = np.arange(len(hit))
            even = (number - np.maximum.accumulate(np.where(run, number, 0))) % 2 == 0
            hit = hit[first | (even & self.safe[made[hit]])]
            sym[hit], last[hit] = made[hit], last[hit + 1]
            stay = np.ones(len(sym), dtype=bool)
            stay[hit + 1] = False
            sym, last, made, rank = sym[stay], last[stay], made[stay], rank[stay]
            at = at - np.searchsorted(hit, at)
            hit = hit - np.arange(len(hit))
            made[hit], rank[hit] = -1, NONE
            before = hit[hit > 0] - 1
            open_ = np.concatenate([hit[~last[hit]], before[~last[before]]])
        return counts

    def _merge_heap(self, sym: list[int]) -> list[int]:
        """The same merges for one very long word, least rank and then leftmost first, in n log n steps."""
        n = len(sym)
        after, before, now = list(range(1, n)) + [-1], list(range(-1, n - 1)), sym[:]
        value, rank = np.array(sym, dtype=np.int64), self.rank.tolist()
        made = self.pairs.find(value[:-1], value[1:]).tolist()
        heap = [(rank[m], i, i + 1, sym[i], sym[i + 1], m) for i, m in enumerate(made) if m >= 0]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int, j: int) -> None:
            pair = (now[i], now[j])
            if pair not in known:
                known[pair] = int(self.pairs.find(np.array(pair[:1]), np.array(pair[1:]))[0])
            m = known[pair]
            if m >= 0:
                heapq.heappush(heap, (rank[m], i, j, *pair, m))

        while heap:
            _, i, j, left, right, m = heapq.heappop(heap)
            if now[i] != left or now[j] != right or after[i] != j:
                continue
            now[i], now[j], after[i] = m, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                push(i, after[j])
            if before[i] >= 0:
                push(before[i], i)
        return [s for s in now if s >= 0]

    def decode_flat(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the decoded texts, one after the other, and each one's length."""
        ids = np.where((ids >= 0) & (ids < self.size), ids, 0)
        size = self.piece_len[ids]
        # of the first id that stands for something, one leading space goes
        doc = np.repeat(np.arange(len(counts)), counts)
        real = np.flatnonzero(size > 0)
        lead = real[np.concatenate([[True], doc[real][1:] != doc[real][:-1]])] if len(real) else real
        lead = lead[self.leading_space[ids[lead]]]
        start = self.piece_off[ids]
        start[lead] += 1
        size[lead] -= 1
        return self.piece_bytes[ragged(start, size)], np.bincount(doc, weights=size, minlength=len(counts)).astype(np.int64)


def word_signs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Length and first bytes of every word: told apart from its hash, whatever that is."""
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    sign = (ends - starts).astype(_U)
    for k in range(6):
        sign |= np.where(starts + k < ends, padded[starts + k], 0).astype(_U) << _U(56 - 8 * k)
    return sign


class WordTable:
    """Ids of the words met so far, found by the words' hashes; length and first bytes are compared as well."""

    def __init__(self, vocabulary: Vocabulary, most: int = CACHE_WORDS):
        self.vocabulary, self.most = vocabulary, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
        self.sign, self.start, self.count = np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def look_up(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Slot of every word; ``start``, ``count`` and ``flat`` give the ids of a slot."""
        if len(self.keys) > self.most:
            self.clear()
        h = span_hashes(buf, starts, ends, BYTE_VALUE)
        sign = word_signs(buf, starts, ends)
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        slots = np.empty(len(keys), dtype=np.int64)
        slots[known] = self.slot[place[known]]
        fresh = np.flatnonzero(~known)
        slots[fresh] = self._add(buf, starts[first[fresh]], ends[first[fresh]], sign[first[fresh]])
        self.keys, self.slot = np.insert(self.keys, place[fresh], keys[fresh]), np.insert(self.slot, place[fresh], slots[fresh])
        out = slots[inverse]
        wrong = np.flatnonzero(self.sign[out] != sign)
        if len(wrong):  # two words of one hash: these are encoded by themselves
            out[wrong] = self._add(buf, starts[wrong], ends[wrong], sign[wrong])
        return out

    def _add(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, sign: np.ndarray) -> np.ndarray:
        ids, counts = self.vocabulary.encode_spans(buf, starts, ends)
        at = len(self.start) + np.arange(len(starts))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
        self.count, self.sign = np.concatenate([self.count, counts]), np.concatenate([self.sign, sign])
        self.flat = np.concatenate([self.flat, ids])
        return at


_tables: dict[str, WordTable] = {}


def word_table(vocabulary: Vocabulary) -> WordTable:
    """The worker's table for this vocabulary; one at a time is kept."""
    if vocabulary.key not in _tables:
        _tables.clear()
        _tables[vocabulary.key] = WordTable(vocabulary)
    return _tables[vocabulary.key]


def spaced(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space before every text that is not empty."""
    full = off[1:] > off[:-1]
    return np.insert(buf, off[:-1][full], 0x20), off + np.concatenate([[0], np.cumsum(full)])


def encode_column(column: pa.Array, vocabulary: Vocabulary):
    """Yield (ids, count per row) for stretches of the rows of a text column, in order."""
    words = word_table(vocabulary)
    if pc.any(pc.match_substring(column, MARK)).as_py():
        column = pc.replace_substring(column, MARK, " ")
    for _, _, buf, off in text_chunks(column, CHUNK_BYTES):
        buf, off = spaced(buf, off)
        if len(buf) == 0:
            yield np.zeros(0, dtype=np.int32), np.zeros(len(off) - 1, dtype=np.int64)
            continue
        space = buf == 0x20
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[off[:-1][off[:-1] < off[1:]]] = True
        starts = np.flatnonzero(start)
        ids, counts = [], []
        # a long text is taken a part at a time
        for lo in range(0, len(starts), 1 << 19):
            part = starts[lo : lo + (1 << 19) + 1]
            ends = part[1:] if len(part) > 1 << 19 else np.append(part[1:], len(buf))
            part = part[: len(ends)]
            base, top = int(part[0]), int(ends[-1])
            slot = words.look_up(buf[base:top], part - base, ends - base)
            counts.append(words.count[slot])
            ids.append(words.flat[ragged(words.start[slot], counts[-1])])
        total = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        yield np.concatenate(ids), np.diff(total[np.searchsorted(starts, off)])


def _add_columns(df: DataFrame, source: str, added: dict[str, T.DataType], make) -> DataFrame:
    """``df`` with the columns that ``make`` (Arrow array to Arrow arrays) computes from ``source`` in the workers."""
    rest = [c for c in df.columns if c not in added]
    names, at = [*rest, *added], len(rest)
    schema = T.StructType([*(df.schema[c] for c in rest), *(T.StructField(c, t) for c, t in added.items())])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BATCH_ROWS):
                part = b.slice(lo, BATCH_ROWS)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(at)), *make(part.column(at))], names=names)

    return df.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{source}`").alias("_coded")).mapInArrow(run, schema)


def _ids_of(column: pa.Array, vocabulary: Vocabulary) -> pa.Array:
    got = list(encode_column(column, vocabulary))
    counts = np.concatenate([np.zeros(0, dtype=np.int64), *(c for _, c in got)])
    ids = np.concatenate([np.zeros(0, dtype=np.int32), *(i for i, _ in got)])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))


def _texts_of(column: pa.Array, vocabulary: Vocabulary) -> pa.Array:
    column = pc.fill_null(column, pa.scalar([], column.type)) if column.null_count else column
    ids = pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False)
    counts = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    raw, size = vocabulary.decode_flat(ids, counts)
    off = np.concatenate([[0], np.cumsum(size)])
    try:
        whole = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(raw)])
        whole.validate(full=True)
        return whole
    except pa.ArrowInvalid:
        data = raw.tobytes()
        return pa.array([_replaced(data[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.string())


def encode_texts(texts: DataFrame, path: str | None = None, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """Add ``ids_col`` (array of int): the text encoded as the library does, without begin and end ids.

    With ``decoded_col`` the ids are decoded again in the same worker.
    """
    held = texts.sparkSession.sparkContext.broadcast(Vocabulary(path or model_path()))
    added = {ids_col: T.ArrayType(T.IntegerType())} | ({decoded_col: T.StringType()} if decoded_col else {})

    def make(column: pa.Array) -> list[pa.Array]:
        ids = _ids_of(column, held.value)
        return [ids, _texts_of(ids, held.value)] if decoded_col else [ids]

    return _add_columns(texts, text_col, added, make)


def decode_ids(coded: DataFrame, path: str | None = None, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add ``text_col``: the text that the ids of ``ids_col`` stand for; bytes that are no UTF-8 become U+FFFD."""
    held = coded.sparkSession.sparkContext.broadcast(Vocabulary(path or model_path()))
    return _add_columns(coded, ids_col, {text_col: T.StringType()}, lambda column: [_texts_of(column, held.value)])


def _replaced(raw: bytes) -> str:
    """UTF-8 with one U+FFFD for every byte that belongs to no character."""
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode() + "�")
            raw = raw[e.start + 1 :]
    return "".join(out)


@register("op12_sentencepiece")
def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again with the 32k piece vocabulary."""
    coded = encode_texts(read(spark, sf_dir, "documents").select("doc_id", "text"), decoded_col="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
