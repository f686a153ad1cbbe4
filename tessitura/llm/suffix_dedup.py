"""Suffix-array dedup: cut every byte covered by a 50-byte string that also starts in a document with a smaller id.

Suffixes cannot all be sorted together at scale, nor can every 50-byte string be
shipped.  Each 50-byte window is assigned the leftmost of its 12-byte strings
with the smallest hash (its anchor), so equal windows have equal anchors:

1. one pass sends a 12-byte entry per anchor; an anchor that no other document
   has, with at least one side of its surroundings equal too, can be in no shared
   window and is dropped there;
2. the windows of each anchor that is left form a fragment of about 65 bytes.
   Fragments are routed by anchor, equal ones once per block, and every shard
   sorts its fragments' suffixes by induced sorting, computes the permuted common
   prefixes and reads off, for each window, the smallest document that has it;
3. documents look up their fragments and join the windows into removed runs.

Texts themselves are shuffled once, by document, and that exchange is used by
all joins.  Whole texts that repeat exactly are found by digest first, and only
the smallest document of each takes part.

Skew: an anchor, fragment or text that very many documents share is reduced to
one entry per block before each shuffle, and occurrences join the shards'
results in an ordinary join that can be split.

Defined results: null and empty texts have no bytes; texts under 50 bytes are
never cut; a null doc_id counts as larger than all others and rows with equal
doc_ids never cut each other; runs that touch are one span.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import _BASE, _INVERSE, BYTE_VALUE, mix, powers, text_chunks
from .common import checked_broadcast, materialize, read, register, shuffle_width, small_batches
from .suffix_array import common_prefixes, suffix_array

LENGTH = 50
GRAM = 12
BUCKETS_PER_TASK = 8
FLUSH_ENTRIES = 500_000
FLUSH_BYTES = 6 << 20
BATCH_BYTES = 1 << 20
GATHER_BYTES = 1 << 20
HOT_BATCHES = 4
_LAST = (1 << 63) - 1
_PIECE = 1 << 21
_U = np.uint64


def _anchors_of_piece(buf: np.ndarray, off: np.ndarray, length: int, gram: int, least_start: int = 0, end_start: int | None = None) -> tuple[np.ndarray, ...]:
    n, w, half = len(buf), length - gram + 1, (length - gram + 1) // 2
    empty = np.zeros(0, dtype=np.int64)
    nothing = empty, empty, empty.astype(_U), empty.astype(_U)
    if n < length:
        return nothing
    with np.errstate(over="ignore"):
        run = np.empty(n + 1, dtype=_U)
        run[0] = 0
        np.cumsum(BYTE_VALUE[buf] * powers(n, _BASE), dtype=_U, out=run[1:])
        inverse = powers(n + 1, _INVERSE)
        h = mix((run[gram:] - run[:-gram]) * inverse[: n - gram + 1])
        # 42 bits of hash, then the position: the leftmost smallest wins, in every document alike
        least = (h & _U((1 << 64) - (1 << 22))) | np.arange(len(h), dtype=_U)
        width = 1
        while width * 2 <= w:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < w:
            least = np.minimum(least[: len(least) - (w - width)], least[w - width :])
        at = (least & _U((1 << 22) - 1)).astype(np.int64)
        room = np.repeat(off[1:], np.diff(off))[: len(at)] - np.arange(len(at))
        starts = np.flatnonzero(room >= length)
        if end_start is not None:
            starts = starts[(starts >= least_start) & (starts < end_start)]
        if not len(starts):
            return nothing
        at = at[starts]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        i = np.flatnonzero(new)
        first, last, at = starts[i], starts[np.append(i[1:], len(at)) - 1], at[i]
        doc = np.searchsorted(off, first, side="right") - 1
        a, b = np.maximum(off[doc], at - half), np.minimum(off[doc + 1], at + gram + half)
        left = mix((run[at + gram] - run[a]) * inverse[a] + (at - a).astype(_U))
        right = mix((run[b] - run[at]) * inverse[at] + (b - at).astype(_U))
        # anchors are the smallest hashes of their windows: mixed once more they fill the range evenly, and so the buckets
        entry = (mix(h[at]) >> _U(16) << _U(16)) | (left >> _U(56) << _U(8)) | (right >> _U(56))
        content = mix((run[last + length] - run[first]) * inverse[first] + (last - first).astype(_U))
    return first, last, entry, content


def anchors(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document number, first window start, last window start, entry, hash of the fragment) of every anchor, in text order.

    An entry is 48 bits of the anchor's hash and 8 bits each of the hashes of the
    anchor with its left and with its right surroundings.  A long text is scanned
    in pieces.
    """
    if len(buf) <= _PIECE * 2 or len(off) > 2:
        first, last, entry, content = _anchors_of_piece(buf, off, length, gram)
    else:
        parts = []
        for a in range(0, len(buf), _PIECE):
            lo = max(0, a - 64 - length)
            sub = buf[lo : a + _PIECE + length - 1 + 64 + length]
            piece = buf[lo : a + _PIECE + length + 64]  # with the surroundings of its first and last anchor
            f, l, e, c = _anchors_of_piece(piece, np.array([0, len(piece)]), length, gram, a - lo, a + _PIECE - lo)
            parts.append((f + lo, l + lo, e, c))
        first, last, entry, content = (np.concatenate(x) for x in zip(*parts))
    return np.searchsorted(off, first, side="right") - 1, first, last, entry, content


def _narrow(ids: np.ndarray) -> bytes:
    small = len(ids) == 0 or -(1 << 31) <= ids.min() and ids.max() < 1 << 31
    return ids.astype(np.int32 if small else np.int64).tobytes()


def _wide(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, np.int32 if len(blob) == 4 * n else np.int64).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of sorted integers, first all lowest ones, .., last all highest ones: the last planes compress to next to nothing."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplaned(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(_U).reshape(-1)


# Packed rows.  kind 0: entries for a bucket of anchors (x planes of entries, y ids); kind 1: pairs of an id and an entry
# that another document has too (x entries, y ids); kind 2: like kind 0, entries that several documents of the block have.
_ENTRY = "kind int, bucket int, x binary, y binary"
_ENTRY_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("x", pa.binary()), ("y", pa.binary())])


def _entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ENTRY_ARROW)], schema=_ENTRY_ARROW)


def _group_flags(keys: np.ndarray, ids: np.ndarray, several: np.ndarray) -> np.ndarray:
    """True for the members of every key that occurs with two ids or more; a member marked ``several`` has them alone."""
    o = np.argsort(keys)
    k, d = keys[o], ids[o]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    shared = (np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)) | np.logical_or.reduceat(several[o], at)
    out = np.empty(len(keys), dtype=bool)
    out[o] = np.repeat(shared, np.diff(np.append(at, len(k))))
    return out


def _send_anchors(length: int, buckets: int):
    """Partition function over (id, text): entries per bucket, and the pairs whose anchor is already shared inside the block."""

    def pack(entries, ids):
        e, d = np.concatenate(entries), np.concatenate(ids)
        o = np.argsort(e)
        e, d = e[o], d[o]
        at = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
        least, most = np.minimum.reduceat(d, at), np.maximum.reduceat(d, at)
        several = least != most
        known = np.repeat(several, np.diff(np.append(at, len(e))))
        n, entry = int(known.sum()), e[at]
        step = 50_000
        rows = [(1, int((e[known][i] >> _U(16)) % _U(buckets)), e[known][i : i + step].tobytes(), _narrow(d[known][i : i + step])) for i in range(0, n, step)]
        # the smallest id speaks for the block; an entry of several ids says so, as one of the same anchor and side may have one of them only
        for kind, i in ((0, ~several), (2, several)):
            e, d = entry[i], least[i]
            # buckets are stretches of the hash range, so they lie in order already
            cut = np.searchsorted(((e >> _U(48)) * _U(buckets)) >> _U(16), np.arange(buckets + 1, dtype=_U))
            rows += [(kind, b, _planes(e[cut[b] : cut[b + 1]]), _narrow(d[cut[b] : cut[b + 1]])) for b in range(buckets) if cut[b + 1] > cut[b]]
        return _entry_batch(rows)

    def run(batches):
        entries, ids, held = [], [], 0
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for lo, _, buf, off in text_chunks(b.column(1)):
                doc, _, _, e, _ = anchors(buf, off, length)
                if len(e):
                    entries.append(e)
                    ids.append(keys[lo + doc])
                    held += len(e)
                if held >= FLUSH_ENTRIES:
                    yield pack(entries, ids)
                    entries, ids, held = [], [], 0
        if held:
            yield pack(entries, ids)

    return run


def _few_buckets(held: dict[int, list[tuple]], weight: Callable[[tuple], int], most: int) -> Iterator[list[tuple]]:
    """The packed rows of a task in stretches of whole buckets, each ended by the bucket that brings it to ``most``; given rows are let go.

    Equal anchors lie in one bucket, so a task unpacks, sorts and answers a few buckets at a time.
    """
    rows, n = [], 0
    for bucket in sorted(held):
        own = held.pop(bucket)
        rows += own
        n += sum(map(weight, own))
        if n >= most:
            yield rows
            rows, n = [], 0
    if rows:
        yield rows


def _answer_anchors(buckets: int):
    """Partition function over entries: the pairs that another document has too, packed per bucket of ids."""

    def shared_pairs(rows):
        e = np.concatenate([_unplaned(x) for _, x, _ in rows])
        d = np.concatenate([_wide(y, len(x) // 8) for _, x, y in rows])
        several = np.repeat([kind == 2 for kind, _, _ in rows], [len(x) // 8 for _, x, _ in rows])
        key = e >> _U(16)
        shared = _group_flags(e >> _U(8), d, several) | _group_flags((key << _U(8)) | (e & _U(255)), d, several)
        shared &= ~several  # the pairs of these are known
        return e[shared], d[shared]

    def run(batches):
        held, known, whose = {}, [], []
        for b in batches:
            for kind, bucket, x, y in zip(*(col.to_pylist() for col in b.columns)):
                if kind == 1:
                    known.append(np.frombuffer(x, _U))
                    whose.append(_wide(y, len(x) // 8))
                else:
                    held.setdefault(bucket, []).append((kind, x, y))
        for rows in _few_buckets(held, lambda r: len(r[1]) // 8, FLUSH_ENTRIES):
            e, d = shared_pairs(rows)
            known.append(e)
            whose.append(d)
        if known:
            e, d = np.concatenate(known), np.concatenate(whose)
            bucket = (mix(d.view(_U)) % _U(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
            o = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[o], np.arange(buckets + 1))
            rows = [(1, b, e[i].tobytes(), _narrow(d[i])) for b in range(buckets) if len(i := o[cut[b] : cut[b + 1]])]
            yield _entry_batch(rows)

    return run


def _answers_by_id(batches):
    """Partition function over packed pairs of whole id buckets: one row (id, its entries) per document."""
    entries, ids = [], []
    for b in batches:
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            entries.append(np.frombuffer(x, _U))
            ids.append(_wide(y, len(x) // 8))
    if not entries:
        return
    e, d = np.concatenate(entries), np.concatenate(ids)
    o = np.argsort(d)
    e, d = e[o], d[o]
    cut = np.flatnonzero(np.append(True, d[1:] != d[:-1])).tolist()
    for i in range(0, len(cut), 10_000):
        part = cut[i : i + 10_000] + cut[i + 10_000 : i + 10_001]
        ends = part[1:] + ([len(e)] if i + 10_000 >= len(cut) else [])
        yield pa.RecordBatch.from_arrays([pa.array(d[part[: len(ends)]]), pa.array([e[a:z].tobytes() for a, z in zip(part, ends)], pa.binary())], names=["id", "entries"])


def _shared_fragments(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(id, first, last, entry, content hash, bytes, offsets into bytes) of the shared fragments of a stretch of documents."""
    keys = batch.column(0).to_numpy(zero_copy_only=False)
    blobs = batch.column(2).to_pylist()
    for lo, hi, buf, off in text_chunks(batch.column(1)):
        told = [blobs[i] or b"" for i in range(lo, hi)]
        own = np.frombuffer(b"".join(told), _U)
        if not len(own):
            continue
        doc, first, last, e, content = anchors(buf, off, length)
        where = np.repeat(np.arange(hi - lo), [len(x) // 8 for x in told])
        with np.errstate(over="ignore"):
            wanted = np.sort(mix(own + mix(where.astype(_U))))
            asked = mix(e + mix(doc.astype(_U)))
        i = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, asked), len(wanted) - 1)] == asked)
        doc = doc[i]
        yield keys[lo + doc], first[i] - off[doc], last[i] - off[doc], e[i], content[i], buf, off[doc]


# Rows of one exchange.  kind 0: distinct fragments of a block for a shard (a planes of anchors, b smallest ids, c occurrences,
# d sizes, e bytes); kind 1: occurrences (a fragments' hashes, b ids, c starts, d tags), dealt out evenly.  A fragment is
# known by the 64-bit hash of its bytes and a tag, 16 bits of its anchor's hash.
_SENT = "kind int, bucket int, a binary, b binary, c binary, d binary, e binary"
_SENT_NAMES = [c.split()[0] for c in _SENT.split(", ")]
_SENT_TYPES = [pa.int32(), pa.int32()] + [pa.binary()] * 5
_TAG = _U(65_535)


def _gather(buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all (at, size) stretches, one after the other; the places, several bytes for each byte, are made for about ``GATHER_BYTES`` at a time."""
    ends = np.cumsum(size)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(n, len(buf)) < 1 << 31 else np.int64
    out, lo, done = np.empty(n, dtype=buf.dtype), 0, 0
    while done < n:
        hi = max(int(np.searchsorted(ends, done + GATHER_BYTES, side="right")), lo + 1)
        stop, part = int(ends[hi - 1]), slice(lo, hi)
        out[done:stop] = buf[np.arange(done, stop, dtype=kind) + np.repeat((at[part] - (ends[part] - size[part])).astype(kind), size[part])]
        lo, done = hi, stop
    return out


def _content_hashes(data: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Hash of each fragment's bytes, as :func:`anchors` computes it in the text."""
    ends = np.cumsum(size)
    with np.errstate(over="ignore"):
        n = len(data)
        run = np.zeros(n + 1, dtype=_U)
        np.cumsum(BYTE_VALUE[data] * powers(n, _BASE), dtype=_U, out=run[1:])
        return mix((run[ends] - run[ends - size]) * powers(n + 1, _INVERSE)[ends - size] + (size - length).astype(_U))


def _merge(anchor, content, least, times, size, data):
    """Equal fragments once: grouped by anchor, smallest id, summed occurrences.

    16 bits of the content hash order a group; if two contents share them their
    copies may stay apart, which costs a few bytes and changes nothing.
    """
    o = np.argsort((anchor << _U(16)) | (content >> _U(48)))
    a, c = anchor[o], content[o]
    head = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]))
    at = np.flatnonzero(head)
    pick = o[at]
    ends = np.cumsum(size)
    return a[at], c[at], np.minimum.reduceat(least[o], at), np.add.reduceat(times[o], at), size[pick], _gather(data, (ends - size)[pick], size[pick])


def _send_fragments(length: int, buckets: int):
    """Partition function over (id, text, entries): packed distinct fragments per bucket, and their occurrences."""

    def pack(parts):
        anchor, content, ids, size, data, at = (np.concatenate(x) for x in zip(*parts))
        a, c, least, times, size, data = _merge(anchor, content, ids, np.ones(len(ids), dtype=np.int64), size, data)
        # buckets are stretches of the anchors' hash range, so they lie in order already
        cut = np.searchsorted(((a >> _U(32)) * _U(buckets)) >> _U(16), np.arange(buckets + 1, dtype=_U))
        ends = np.append(0, np.cumsum(size))
        rows = []
        for b in range(buckets):
            i = slice(cut[b], cut[b + 1])
            if cut[b + 1] > cut[b]:
                rows.append((0, b, _planes(a[i]), _narrow(least[i]), times[i].tobytes(), size[i].astype(np.int32).tobytes(), data[ends[cut[b]] : ends[cut[b + 1]]].tobytes()))
        step = 20_000
        for i in range(0, len(ids), step):
            j = slice(i, i + step)
            rows.append((1, int(content[i] % _U(buckets)), content[j].tobytes(), _narrow(ids[j]), _narrow(at[j]), (anchor[j] & _TAG).astype(np.uint16).tobytes(), None))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_SENT_TYPES)], names=_SENT_NAMES)

    def run(batches):
        parts, held = [], 0
        for b in batches:
            for ids, first, last, e, content, buf, base in _shared_fragments(b, length):
                size = last - first + length
                parts.append((e >> _U(16), content, ids, size, _gather(buf, first + base, size), first))
                held += int(size.sum())
                if held >= FLUSH_BYTES:
                    yield pack(parts)
                    parts, held = [], 0
        if parts:
            yield pack(parts)

    return run


def _occurrences(batches):
    """Partition function over sent rows: one row (content, id, start and tag in one number) per occurrence."""
    for b in batches:
        for kind, _, c, ids, at, tag, _ in zip(*(col.to_pylist() for col in b.columns)):
            if kind == 1:
                n = len(c) // 8
                place = _wide(at, n) << 16 | np.frombuffer(tag, np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(c, np.int64)), pa.array(_wide(ids, n)), pa.array(place)], names=["content", "id", "place"])


def window_minima(size: np.ndarray, data: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """For every window of every fragment, in order: the smallest ``least`` of all fragments that hold the same window.

    One shard array: fragments are joined by separators, their suffixes sorted by
    induced sorting, and neighbours with a common prefix of ``length`` grouped.
    """
    m, ends = len(size), np.cumsum(size)
    t = np.ones(len(data) + m + 1, dtype=np.uint16)
    t[-1] = 0
    frag = np.repeat(np.arange(m, dtype=np.int32), size)
    place = np.arange(len(data), dtype=np.int32)
    t[place + frag] = data.astype(np.uint16) + 2
    sa = suffix_array(t)
    owner = np.full(len(t), -1, dtype=np.int32)
    window = np.repeat(ends, size) - place >= length  # windows start here
    owner[(place + frag)[window]] = frag[window]
    mine = owner[sa]
    full = mine >= 0
    pos, mine = sa[full], mine[full]
    # equal windows are neighbours among the suffixes that start with a whole window
    joined = common_prefixes(t, pos, length)[pos] >= length
    group = np.cumsum(~joined) - 1
    at = np.flatnonzero(~joined)
    best = np.minimum.reduceat(least[mine], at)[group] if len(at) else least[mine]
    by_pos = np.zeros(len(t), dtype=np.int64)
    by_pos[pos] = best
    return by_pos[owner >= 0]


def _shard_results(length: int):
    """Partition function over packed fragments: (content, run, least) for runs of windows of fragments that matter; run is first << 32 | last << 16 | tag."""

    def results(a, c, least, times, size, best):
        windows = size - length + 1
        frag = np.repeat(np.arange(len(size)), windows)
        start = np.arange(len(frag)) - np.repeat(np.cumsum(windows) - windows, windows)
        head = np.append(True, (frag[1:] != frag[:-1]) | (best[1:] != best[:-1]))
        at = np.flatnonzero(head)
        f, g = frag[at], best[at]
        lo, hi = start[at], start[np.append(at[1:], len(frag)) - 1]
        use = (times[f] > 1) | (g < least[f])
        f, g, lo, hi = f[use], g[use], lo[use], hi[use]
        return pa.RecordBatch.from_arrays([pa.array(c[f].view(np.int64)), pa.array((lo << 32 | hi << 16).astype(np.int64) | (a[f] & _TAG).view(np.int64)), pa.array(g)], names=["content", "run", "least"])

    def hot(size, data, least):
        """A group too large for one array: its windows are dealt out by hash and sorted part by part."""
        windows = size - length + 1
        frag = np.repeat(np.arange(len(size)), windows)
        start = np.arange(len(frag)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(np.cumsum(size) - size, windows)
        with np.errstate(over="ignore"):
            n = len(data)
            run = np.zeros(n + 1, dtype=_U)
            np.cumsum(BYTE_VALUE[data] * powers(n, _BASE), dtype=_U, out=run[1:])
            h = mix((run[start + length] - run[start]) * powers(n + 1, _INVERSE)[start])
        parts = len(frag) * length // BATCH_BYTES + 1
        best = np.empty(len(frag), dtype=np.int64)
        for p in range(parts):
            i = np.flatnonzero(h % _U(parts) == _U(p))
            if len(i):
                best[i] = window_minima(np.full(len(i), length), _gather(data, start[i], np.full(len(i), length)), least[frag[i]], length)
        return best

    def unpacked(rows):
        for a, l, t, s, d in rows:
            a, size, d = _unplaned(a), np.frombuffer(s, np.int32).astype(np.int64), np.frombuffer(d, np.uint8)
            yield a, _content_hashes(d, size, length), _wide(l, len(a)), np.frombuffer(t, np.int64), size, d

    def shard(rows):
        a, c, least, times, size, data = _merge(*(np.concatenate(x) for x in zip(*unpacked(rows))))
        ends = np.cumsum(size)
        groups = np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a))  # never cut inside an anchor
        i = 0
        while i < len(groups) - 1:
            base = ends[groups[i]] - size[groups[i]]
            j = int(np.searchsorted(ends[groups[1:] - 1], base + BATCH_BYTES, side="right"))
            j = max(j, i + 1)
            lo, hi = groups[i], groups[j]
            piece = data[base : ends[hi - 1]]
            large = len(piece) > HOT_BATCHES * BATCH_BYTES
            best = hot(size[lo:hi], piece, least[lo:hi]) if large else window_minima(size[lo:hi], piece, least[lo:hi], length)
            yield results(a[lo:hi], c[lo:hi], least[lo:hi], times[lo:hi], size[lo:hi], best)
            i = j

    def run(batches):
        held = {}
        for b in batches:
            for kind, bucket, *row in zip(*(col.to_pylist() for col in b.columns)):
                if kind == 0:
                    held.setdefault(bucket, []).append(row)
        for rows in _few_buckets(held, lambda r: len(r[4]), FLUSH_BYTES):
            yield from shard(rows)

    return run


def union_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of (start, end) intervals; touching ones are joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def cut_documents(docs: DataFrame, finish: Callable[[bytes, list[tuple[int, int]], int | None], tuple], schema: str, arrow: list[tuple[str, pa.DataType]], keep: list[str] | None = None, length: int = LENGTH) -> DataFrame:
    """Find the removed spans of every row of ``docs`` (doc_id, text, ..) and return what ``finish(bytes, spans, None)`` makes of them.

    Of an exact copy of an earlier text all bytes go: ``finish(b"", [], size)``.

    The result has the columns ``keep`` of ``docs`` (default: doc_id), then those of ``schema``.
    """
    keep = keep if keep is not None else ["doc_id"]
    spark = docs.sparkSession
    small_batches(spark)
    width = shuffle_width(spark)
    buckets = width * BUCKETS_PER_TASK
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    digests = docs.where(F.octet_length("text") >= length).select(key.alias("_key"), F.sha2("text", 256).alias("_sha"))
    firsts = digests.groupBy("_sha").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    copies = digests.join(firsts, "_sha").where(F.col("_key") > F.col("_first")).groupBy("_key").agg(F.collect_set("_sha").alias("_shas"))
    copies = materialize(copies, "dedup-copies")
    copies = checked_broadcast(copies, copies.count())  # few: their texts are not even shuffled
    base = docs.select(key.alias("_key"), F.struct(*[F.col(k) for k in keep]).alias("_keep"), F.octet_length("text").alias("_size"), "text").join(copies, "_key", "left")
    copy = F.coalesce(F.array_contains("_shas", F.sha2("text", 256)), F.lit(False))
    base = base.select("_key", "_keep", "_size", F.when(~copy, F.col("text")).alias("text"), copy.alias("_copy"))

    # every branch reads the same columns, so that Spark shuffles the texts once and uses that exchange again
    rest = ["_keep", "_size", "_copy"]
    # dealt out by number, every task gets as many buckets
    entries = base.select("_key", "text", *rest).mapInArrow(_send_anchors(length, buckets), _ENTRY)
    answers = entries.repartitionById(width, "bucket").mapInArrow(_answer_anchors(buckets), _ENTRY)
    shared = answers.repartitionById(width, "bucket").mapInArrow(_answers_by_id, "id long, entries binary").withColumnRenamed("id", "_key")
    told = base.join(shared.hint("shuffle_hash"), "_key").select("_key", "text", "entries", *rest)
    sent = told.mapInArrow(_send_fragments(length, buckets), _SENT).repartitionById(width, "bucket")  # read by both of the following
    found = sent.mapInArrow(_shard_results(length), "content long, run long, least long")
    places = sent.mapInArrow(_occurrences, "content long, id long, place long")
    tag = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFF))
    hits = places.join(found.withColumnRenamed("content", "_content"), (F.col("content") == F.col("_content")) & (tag("place") == tag("run"))).where(F.col("least") < F.col("id"))
    at, first, last = F.shiftright("place", 16), F.shiftright("run", 32), F.shiftright("run", 16).bitwiseAND(F.lit(0xFFFF))
    spans = hits.select(F.col("id").alias("_key"), F.shiftleft(at + first, 32).bitwiseOR(at + last + length).alias("_span"))  # start << 32 | end
    spans = spans.groupBy("_key").agg(F.collect_list("_span").alias("_spans"))

    def apply(batches):
        for b in batches:
            out = []
            texts, copied, sizes, spans_ = b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)
            for i in range(b.num_rows):
                raw = (texts[i].as_py() or "").encode()
                cut = [] if copied[i] else union_spans([(x >> 32, x & 0xFFFFFFFF) for x in spans_[i].as_py() or ()])
                out.append(finish(raw, cut, sizes[i] or 0 if copied[i] else None))
            kept = b.column(0)
            yield pa.RecordBatch.from_arrays(
                [kept.field(k) for k in range(len(keep))] + [pa.array([o[k] for o in out], t) for k, (_, t) in enumerate(arrow)], names=[*keep, *[n for n, _ in arrow]]
            )

    kinds = dict(docs.dtypes)
    full = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [schema])
    return base.join(spans.hint("shuffle_hash"), "_key", "left").select("_keep", "text", "_copy", "_size", "_spans").mapInArrow(apply, full)


def _digest(raw: bytes, cut: list[tuple[int, int]], copy_of: int | None) -> tuple:
    if copy_of is not None:
        return copy_of, copy_of, 1, hashlib.sha256().hexdigest()
    h, at = hashlib.sha256(), 0
    for a, b in cut:
        h.update(raw[at:a])
        at = b
    h.update(raw[at:])
    return len(raw), sum(b - a for a, b in cut), len(cut), h.hexdigest()


def whole_characters(raw: bytes, cut: list[tuple[int, int]]) -> str:
    """The text without the removed runs; a character goes only if all its bytes do."""
    out, at = [], 0
    for a, b in cut:
        while a < b and a < len(raw) and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append(raw[at:a])
            at = b
    out.append(raw[at:])
    return b"".join(out).decode()


def dedup_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with its repeated passages cut out of ``text``; other columns stay."""
    others = [c for c in docs.columns if c != "text"]
    out = cut_documents(docs, lambda raw, cut, copy_of: (whole_characters(raw, cut),), "text string", [("text", pa.string())], keep=others, length=length)
    return out.select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(generate_series(0, (length(h) // 2 - 50)::INT)) AS i FROM d WHERE length(h) >= 100)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, i FROM w JOIN m USING (s) WHERE doc_id > first),
r AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, -1) AS fresh FROM c),
g AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM s),
p AS (SELECT k.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS head, max(b) AS last FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN p USING (doc_id)
"""


@register("op2_suffix_dedup", ORACLE)
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 50-byte strings of every document."""
    fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    return cut_documents(read(spark, sf_dir, "documents"), _digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", fields)
