"""N-gram Jaccard join: size bands, part signatures, bitmap bounds, exact sorted-array intersection.

A document is the set of its word n-grams, kept as sorted 64-bit hashes.  Equal
sets are one node.  Two sets can only link if their sizes differ little, so
sizes are cut into bands and a set meets its own band and the next.  If sets a
and b link, they differ in at most ``a * (1 - t) / t`` n-grams; cut into more
parts than that by hash, one part must be equal.  Documents with an equal part
form a candidate cluster, inside which tiles of two size bands are compared:
hashed parity bitmaps bound every pair's overlap from above by their bit counts,
and the pairs that pass are intersected exactly.  No pair is lost: parts that are
empty are covered by spare parts, or by a common fallback key.

Skew: a part key that very many documents share is reduced to one entry per
block before the shuffle; a cluster too large for one task is cut into tiles by
band and hash, and each pair of tiles is a task of its own.  Only links that
join two components of a tile are emitted.

Defined results: null and empty texts have an empty set and link with nothing;
texts with fewer words than n are one n-gram; repeated rows have equal sets and
link; rows with a null doc_id link like others but never name a component.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import lower_words, mix, text_chunks
from .common import materialize, read, register, shuffle_width, small_batches
from .components import connected_components

TILE_SHINGLES = 4_000_000  # n-grams of a tile of sets: 32 MB of hashes
BITMAP_TILE = 8  # a bitmap takes a half byte per n-gram at most, so a tile of bitmaps holds so many times as many in half the bytes
MOST_BITS = 1 << 16
KEY_BITS = 23
FLUSH_KEYS = 500_000
BUCKETS_PER_TASK = 2
_U = np.uint64


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of every text of an Arrow column, in row order."""
    for lo, hi, buf, off in text_chunks(column):
        h, doc = lower_words(buf, off)
        first = np.searchsorted(doc, np.arange(hi - lo + 1))
        with np.errstate(over="ignore"):
            grams = h[: max(len(h) - n + 1, 0)].copy()
            for k in range(1, n):
                grams = mix(grams * _U(0x9FB21C651E98DF25)) + h[k : k + len(grams)]
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                with np.errstate(over="ignore"):
                    one = _U(b - a)
                    for x in h[a:b]:
                        one = mix(np.array([one * _U(0xD6E8FEB86659FD93) + x]))[0]
                yield np.array([one], dtype=_U)
            else:
                yield np.zeros(0, dtype=_U)


def node_of(u: np.ndarray) -> int:
    """64-bit identity of a set (signed)."""
    with np.errstate(over="ignore"):
        s = mix(np.array([np.sum(mix(u), dtype=_U) + _U(len(u)) * _U(0x9E3779B97F4A7C15)], dtype=_U))
    return int(s.view(np.int64)[0])


class Bands:
    """Size bands for a threshold num / den: the partners of a set lie in its own band or the next."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        # below this size two linked sets are equal
        self.least = next(a for a in range(1, 100_000) if self.differ(a) > 0)
        self.starts = [self.least]

    def differ(self, smaller: int) -> int:
        """Largest symmetric difference of two linked sets, the smaller of this size."""
        return smaller * (self.den - self.num) // self.num

    def largest_partner(self, smaller: int) -> int:
        return smaller * self.den // self.num

    def of(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(max(self.largest_partner(self.starts[-1]), self.starts[-1]) + 1)
        return bisect.bisect_right(self.starts, n) - 1

    def parts(self, band: int) -> int:
        """Parts of a band: one more than its sets may differ in, and a spare one for an empty part."""
        self.of(self.starts[band])
        return self.differ(self.starts[band + 1] - 1) + 2


def part_keys(u: np.ndarray, bands: Bands) -> np.ndarray:
    """Hash of every non-empty part, for the set's own band and the band below."""
    n = len(u)
    if n < bands.least:
        return np.zeros(0, dtype=_U)
    own = bands.of(n)
    keys = []
    with np.errstate(over="ignore"):
        run = np.zeros(n + 1, dtype=_U)
        np.cumsum(mix(u ^ _U(0xA5A5A5A5A5A5A5A5)), dtype=_U, out=run[1:])
        high = u >> _U(32)
        for band in (own, own - 1):
            if band < 0:
                continue
            p = bands.parts(band)
            cut = np.searchsorted((high * _U(p)) >> _U(32), np.arange(p + 1, dtype=_U))
            full = np.flatnonzero(cut[1:] > cut[:-1])
            salt = _U((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            keys.append(mix(run[cut[full + 1]] - run[cut[full]] + mix(full.astype(_U) + salt)))
            if len(full) < p - 1:  # too many empty parts for the counting argument
                keys.append(mix(np.array([salt ^ _U(0xE3779B97F4A7C15F)], dtype=_U)))
    return np.concatenate(keys)


def _star(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries (key, node) as: one (key, smallest node) per key, and links from it to the key's other nodes."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[fresh], nodes[fresh]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    low = nodes[first][np.cumsum(first) - 1] if len(keys) else nodes
    links = np.unique(np.stack([low[~first], nodes[~first]], 1), axis=0) if len(keys) else np.zeros((0, 2), dtype=np.int64)
    return keys[first], nodes[first], links[:, 0], links[:, 1]


# Packed rows.  kind 0: entries of a bucket, document by document (x: 48 bits of every key, y: the nodes, z: keys per
# node); kind 1: links found inside a block (x and y: their ends).
_BLOB = "bucket int, kind int, x binary, y binary, z binary"
_BLOB_NAMES = [c.split()[0] for c in _BLOB.split(", ")]
_BLOB_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _six_bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view(_U).reshape(-1)


def _key_blobs(n: int, num: int, den: int, buckets: int):
    """Partition function: texts to packed (key, node) entries per bucket, and links found inside a block."""

    def pack(keys, nodes):
        keys, nodes, a, b = _star(np.concatenate(keys) >> _U(16), np.concatenate(nodes))
        bucket = (keys % _U(buckets)).astype(np.int64)
        o = np.argsort(nodes)  # a node's keys of one bucket lie together and name it once
        o = o[np.argsort(bucket[o].astype(np.uint16) if buckets < 1 << 16 else bucket[o], kind="stable")]
        keys, nodes, bucket = keys[o], nodes[o], bucket[o]
        at = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = []
        for i in range(buckets):
            k, m = keys[at[i] : at[i + 1]], nodes[at[i] : at[i + 1]]
            if len(k):
                first = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
                rows.append((i, 0, _six_bytes(k), m[first].tobytes(), np.diff(np.append(first, len(m))).astype(np.uint32).tobytes()))
        step = 50_000
        rows += [(int(a[i] % buckets), 1, a[i : i + step].tobytes(), b[i : i + step].tobytes(), None) for i in range(0, len(a), step)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_BLOB_TYPES)], names=_BLOB_NAMES)

    def run(batches):
        bands, keys, nodes, held = Bands(num, den), [], [], 0
        for batch in batches:
            for u in shingle_sets(batch.column(0), n):
                k = part_keys(u, bands)
                if len(k):
                    keys.append(k)
                    nodes.append(np.full(len(k), node_of(u), dtype=np.int64))
                    held += len(k)
                    if held >= FLUSH_KEYS:
                        yield pack(keys, nodes)
                        keys, nodes, held = [], [], 0
        if held:
            yield pack(keys, nodes)

    return run


def _bucket_links(batches):
    """Partition function: packed entries to links between nodes that share a key."""
    keys, nodes, links = [], [], []
    for b in batches:
        for kind, x, y, z in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
            if kind:
                links.append(np.stack([np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)], 1))
            else:
                keys.append(_from_six(x))
                nodes.append(np.repeat(np.frombuffer(y, np.int64), np.frombuffer(z, np.uint32)))
    if keys:
        _, _, a, b = _star(np.concatenate(keys), np.concatenate(nodes))
        links.append(np.stack([a, b], 1))
    if links:
        all_links = np.unique(np.concatenate(links), axis=0)
        for i in range(0, len(all_links), 100_000):
            part = all_links[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["a", "b"])


def signature_bits(n: int) -> int:
    """Bits of the parity bitmap of a set of ``n``: a power of two, two bits per n-gram or more.

    With fewer, the bitmaps of unrelated sets come so close to the bound that many pairs pass by chance.
    """
    bits = 128
    while bits < min(2 * n, MOST_BITS):
        bits *= 2
    return bits


def parity_bitmap(u: np.ndarray, bits: int) -> np.ndarray:
    """Bit i tells whether an odd number of the set's hashes fall on i; sets that differ in d places differ in at most d bits."""
    parity = np.bincount((u >> _U(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(_U)


def fold(bitmap: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap the same set would have with fewer bits."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, bits // 64), axis=0)


def describe_sets(docs: DataFrame, n: int, carried: list[str]) -> DataFrame:
    """doc_id, the long columns ``carried``, n_shingles, node, bitmap: one narrow row per document."""
    ids = ["doc_id", *carried]

    def run(batches):
        for b in batches:
            sizes, nodes, maps = [], [], []
            for u in shingle_sets(b.column(len(ids)), n):
                sizes.append(len(u))
                nodes.append(node_of(u))
                maps.append(parity_bitmap(u, signature_bits(len(u))).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(ids)], pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(maps, pa.binary())], names=[*ids, "n_shingles", "node", "bitmap"])

    schema = ", ".join([f"{c} long" for c in ids] + ["n_shingles long, node long, bitmap binary"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carried, "text").mapInArrow(run, schema)


def tile_links(sets: list[np.ndarray] | None, nodes: list[int], upper: list[bool] | None, num: int, den: int, sizes: list[int], bitmaps: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning links of one tile; with ``upper`` only pairs of a lower and an upper member are compared.

    Without ``sets`` every pair that the bitmaps cannot rule out is a link.
    """
    sizes = np.array(sizes, dtype=np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    side = np.array(upper, dtype=bool)[order] if upper is not None else None
    bits = min(len(m) for m in bitmaps) * 64
    maps = np.stack([fold(bitmaps[i], bits) for i in order])
    parent = np.arange(len(nodes))  # always points to the component's label: merged labels are rewritten
    links = []
    for i in range(len(nodes) - 1):
        stop = np.searchsorted(sizes, sizes[i] * den // num, side="right")
        near = np.arange(i + 1, stop)
        near = near[parent[near] != parent[i]]
        if side is not None:
            near = near[side[near] != side[i]]
        if len(near) == 0:
            continue
        apart = np.bitwise_count(maps[near] ^ maps[i]).sum(axis=1, dtype=np.int64)
        bound = (sizes[near] + sizes[i] - apart) // 2
        near = near[den * bound >= num * (sizes[near] + sizes[i] - bound)]
        mine = sets[order[i]] if sets is not None else None
        for j in near.tolist():
            if parent[j] == parent[i]:
                continue
            if mine is not None:
                other = sets[order[j]]
                at = np.searchsorted(other, mine)
                at[at == len(other)] = 0
                inter = int(np.count_nonzero(other[at] == mine))
            if mine is None or den * inter >= num * (len(mine) + len(other) - inter):
                links.append((nodes[order[i]], nodes[order[j]]))
                parent[parent == parent[j]] = parent[i]
    return links


def _compare_tiles(num: int, den: int, exact: bool):
    """Partition function over rows (tile, node, upper, blob, n) sorted by tile: the links of each tile.

    ``exact``: the blob holds the n-gram hashes; else the bitmap of a set of ``n``.
    """

    def finish(blobs, nodes, upper, sizes, out):
        if len(nodes) < 2:
            return
        if exact:
            bits = signature_bits(max(sizes))
            out += tile_links(blobs, nodes, upper if any(upper) else None, num, den, sizes, [parity_bitmap(u, bits) for u in blobs])
        else:
            out += tile_links(None, nodes, upper if any(upper) else None, num, den, sizes, blobs)

    def run(batches):
        tile, blobs, nodes, upper, sizes, out = None, [], [], [], [], []
        for b in batches:
            for t, node, up, blob, n in zip(*(b.column(i).to_pylist() for i in range(5))):
                if t != tile:
                    finish(blobs, nodes, upper, sizes, out)
                    tile, blobs, nodes, upper, sizes = t, [], [], [], []
                if not nodes or nodes[-1] != node:
                    blobs.append(np.frombuffer(blob, _U))
                    nodes.append(node)
                    upper.append(up)
                    sizes.append(n)
            if len(out) > 100_000:
                yield _link_batch(out)
                out = []
        finish(blobs, nodes, upper, sizes, out)
        if out:
            yield _link_batch(out)

    return run


def _link_batch(out):
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])


def spread_tiles(members: DataFrame, num: int, den: int, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """tile, node, upper, _key, _more, n, bitmap: the members of every tile.  ``members``: root, node, n, _key, _more, bitmap (narrow rows).

    A cluster of up to ``tile_shingles`` n-grams is one tile.  A larger one is cut
    by size band and by hash; each pair of cuts of one band or of neighbouring
    bands is a tile (``upper`` marks its second cut).
    """
    log_ratio = float(np.log(den / num))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(log_ratio)).cast("long")
    rows = members.withColumn("band", band)
    large = rows.groupBy("root").agg(F.sum("n").alias("_all")).where(F.col("_all") > tile_shingles).select("root")
    small = rows.join(large, "root", "left_anti").select(F.col("root").cast("string").alias("tile"), "node", F.lit(False).alias("upper"), "_key", "_more", "n", "bitmap")
    cuts = rows.join(large, "root", "left_semi").groupBy("root", "band").agg(F.ceil(2 * F.sum("n") / F.lit(tile_shingles)).cast("int").alias("cuts"))
    above, below = cuts.select("root", (F.col("band") - 1).alias("band"), F.col("cuts").alias("cuts_up")), cuts.select("root", (F.col("band") + 1).alias("band"), F.col("cuts").alias("cuts_down"))
    plan = cuts.join(above, ["root", "band"], "left").join(below, ["root", "band"], "left")
    big = rows.join(plan, ["root", "band"]).withColumn("c", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))

    def name(lo_band, lo, hi_band, hi):
        return F.concat_ws(":", F.col("root").cast("string"), lo_band.cast("string"), lo.cast("string"), hi_band.cast("string"), hi.cast("string"))

    def upto(count):
        return F.when(F.coalesce(count, F.lit(0)) > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    same = F.transform(upto(F.col("cuts")), lambda j: F.struct(name(F.col("band"), F.least("c", j), F.col("band"), F.greatest("c", j)).alias("tile"), (F.col("c") > j).alias("upper")))
    up = F.transform(upto(F.col("cuts_up")), lambda j: F.struct(name(F.col("band"), F.col("c"), F.col("band") + 1, j).alias("tile"), F.lit(False).alias("upper")))
    down = F.transform(upto(F.col("cuts_down")), lambda j: F.struct(name(F.col("band") - 1, j, F.col("band"), F.col("c")).alias("tile"), F.lit(True).alias("upper")))
    tiled = big.select("node", "_key", "_more", "n", "bitmap", F.explode(F.concat(same, up, down)).alias("t")).select("t.tile", "node", "t.upper", "_key", "_more", "n", "bitmap")
    return small.unionByName(tiled)


def likely_rows(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``_key`` is not in ``wanted``: none that is in it is lost.

    The keys fall on 2^KEY_BITS flags, kept as 64-bit words: a table of at most
    2^(KEY_BITS - 6) rows whatever the data, so it is broadcast.
    """
    address = F.shiftrightunsigned("_key", 64 - KEY_BITS)
    word, flag = F.shiftrightunsigned(address, 6).alias("_word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_key, {64 - KEY_BITS}) & 63 as int))")
    flags = wanted.select(word, flag.alias("_flag")).groupBy("_word").agg(F.bit_or("_flag").alias("_flags"))
    return rows.select("*", word).join(F.broadcast(flags), "_word").where(F.col("_flags").bitwiseAND(flag) != 0).select(*rows.columns)


def jaccard_components(docs: DataFrame, n: int = 3, threshold: tuple[int, int] = (90, 100), tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id per row of ``docs`` (doc_id, text): links where den * overlap >= num * union.

    ``component_id`` is the smallest doc_id reachable by links, the row's own
    included.
    """
    placed, empty = place_rows(docs, n, threshold, tile_shingles)
    named = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    full = placed.join(named, "root").select("doc_id", "n_shingles", "component_id")
    return full.unionByName(empty.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_first_rows(docs: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """``docs`` with exactly one row of each component: of its smallest doc_id (null ids last), then of the smallest hash of the row.

    Rows with an empty set stay.
    """
    key = F.xxhash64(*[x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])
    placed, _ = place_rows(docs.withColumn("_row", key), n, threshold, carried=["_row"])
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    best = placed.groupBy("root").agg(F.min(rank).alias("_best"))
    judged = placed.groupBy("root", "doc_id", "_row").agg(F.count(F.lit(1)).alias("_n")).join(best, "root")
    # what happens to the rows of a hash: all go, or one of several equal ones stays; others are not listed
    marks = judged.groupBy("_row").agg(F.max(F.col("_best") == rank).alias("_stays"), F.sum("_n").alias("_n")).where(~F.col("_stays") | (F.col("_n") > 1)).select("_row", "_stays")
    marks = materialize(marks, "jac-marks")
    marked = docs.withColumn("_row", key).join(marks, "_row", "left")
    once = marked.where(F.col("_stays")).dropDuplicates(["_row"])
    return marked.where(F.col("_stays").isNull()).unionByName(once).select(*[F.col(f"`{c}`") for c in docs.columns])


def place_rows(docs: DataFrame, n: int, threshold: tuple[int, int], tile_shingles: int = TILE_SHINGLES, carried: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """doc_id, the long columns ``carried``, n_shingles and root (of the component) of every row, and those of rows with empty sets without a root."""
    num, den = threshold
    ids = ["doc_id", *(carried or [])]
    spark = docs.sparkSession
    small_batches(spark)
    width = shuffle_width(spark)
    # a row's text is found again by hashes of its id and text: rows without an id, or of one id, are no hot key
    flat = [F.col("doc_id").isNull(), "doc_id", "text"]
    keyed = docs.withColumns({"_key": F.xxhash64(*flat), "_more": F.hash("text", "doc_id").cast("long")})
    described = materialize(describe_sets(keyed, n, [*ids[1:], "_key", "_more"]), "jac-sets")
    blobs = docs.select("text").mapInArrow(_key_blobs(n, num, den, width * BUCKETS_PER_TASK), _BLOB)
    candidates = blobs.repartition(width, "bucket").mapInArrow(_bucket_links, "a long, b long")
    clusters = materialize(connected_components(candidates, "jac-cand"), "jac-clusters")

    first = F.min(F.struct("_key", "_more", F.col("n_shingles").alias("n"), "bitmap")).alias("f")
    reps = described.where(F.col("n_shingles") > 0).groupBy("node").agg(first).select("node", "f._key", "f._more", "f.n", "f.bitmap")
    columns = ["root", "node", "n", "_key", "_more", "bitmap"]
    members = materialize(reps.join(clusters, "node").select(*columns), "jac-members")
    # A passage that many documents hold can chain unrelated ones into one large cluster.  Large clusters are first cut down by
    # the bitmaps alone: what they cannot rule out makes the clusters whose sets are shipped.
    large = materialize(members.groupBy("root").agg(F.sum("n").alias("_all")).where(F.col("_all") > tile_shingles).select("root"), "jac-large")
    if not large.isEmpty():
        rough = spread_tiles(members.join(large, "root", "left_semi"), num, den, tile_shingles * BITMAP_TILE).select("tile", "node", "upper", "bitmap", "n")
        rough = rough.repartition(width, "tile").sortWithinPartitions("tile", "node").mapInArrow(_compare_tiles(num, den, False), "a long, b long")
        finer = materialize(connected_components(rough, "jac-fine"), "jac-finer")
        kept = members.join(large, "root", "left_anti").select(*columns)
        members = materialize(kept.unionByName(members.drop("root").join(finer, "node").select(*columns)), "jac-members-fine")
    placed = spread_tiles(members, num, den, tile_shingles).drop("bitmap")
    # one text per representative: equal rows collapse before they are shuffled, and most others are left out by a bitmap
    # (no semi join here: the optimizer would move it below the bitmap, and shuffle all texts)
    texts = likely_rows(keyed.select("_key", "_more", "text"), members.select("_key")).groupBy("_key", "_more").agg(F.first("text").alias("text"))

    def as_sets(batches):
        for b in batches:
            rows = [(t, k, up, u.tobytes(), len(u)) for t, k, up, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), shingle_sets(b.column(3), n)) if node_of(u) == k]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_()), pa.array([r[3] for r in rows], pa.binary()), pa.array([r[4] for r in rows], pa.int64())], names=["tile", "node", "upper", "shingles", "n"])

    sets = texts.join(placed, ["_key", "_more"]).select("tile", "node", "upper", "text").mapInArrow(as_sets, "tile string, node long, upper boolean, shingles binary, n long")
    tiles = sets.repartition(width, "tile").sortWithinPartitions("tile", "node")
    links = tiles.mapInArrow(_compare_tiles(num, den, True), "a long, b long")
    parts = materialize(connected_components(links, "jac-comp"), "jac-parts")

    placed = described.where(F.col("n_shingles") > 0).join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = materialize(placed.select(*ids, "n_shingles", "root"), "jac-placed")
    return placed, described.where(F.col("n_shingles") == 0).select(*ids, "n_shingles")


@register("op6_jaccard_join")
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets overlap by 90 % or more."""
    return jaccard_components(read(spark, sf_dir, "documents"))
