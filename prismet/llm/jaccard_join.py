"""Exact n-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection of sorted arrays.

A document's set holds the 64-bit hashes of its distinct word n-grams. Documents of equal sets form one vertex
(their smallest doc_id). In one global order of the hashes, two vertices that link share k of the first
n - ceil(t * n) + k of each set, for any k. The order puts frequent hashes last (they are counted over all rows;
the order changes the work, never the result), so a common passage forms few tiles.

1. Prefixes with k of about half their plain length: vertices with fewer shared hashes than any partner of their
   size band would need drop out; they cannot link. Prefix rows travel packed, a block a task and target, at about
   13 bytes a hash. Frequent hashes are shared by definition and are not sent.
2. A hash shared among the plain prefixes (k = 1) names a tile; only rows of a tile whose sizes lie in a band of
   ratio t meet. First round: every vertex goes to one tile, the first it shares, with its signature and sorted
   array. Inside, a pair is looked at only while its ends are in different components; bit counts of the
   signatures bound the overlap from above (a bit of x that y lacks is an element of x that y lacks), and pairs
   that pass are intersected exactly. A tile of many rows is dealt out by a salt; later rounds join what that parts.
3. A second round takes the tiles that still hold several components; tiles of one smallest vertex form a group, so
   a pair that shares many tiles is met once or a few times. Groups of up to PAIRED rows are looked at by signatures
   alone, and their open pairs are intersected after joining the arrays. Larger groups get the arrays and settle
   every open pair in place, so a group never sends out its pairs; groups above BLOCK rows are cut into blocks, and
   every two blocks meet in a task. Where the first round had to deal a group out, one vertex of each of its
   components is tried before.
4. Components come from contracting the link graph (never on the driver).

Copies thus cost one row, and a group of near copies about one intersection a member, while no link between
different components is left untested.

Defined results: null, empty or white-space texts have an empty set and link with nothing; a text of fewer than
n words is one n-gram; repeated rows get the same component; a null doc_id takes part (it never is a component's
id while another id is there); an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, byte_view, release, remove_folder, shared_folder, slices, stored, table

WORDS = 4
PERCENT = 85
TILE = 2048
TILE_SIZES = 4 << 20  # elements of the sets of a tile: 32 MB
BLOCK = 2048
PAIRED = 48  # rows of a group up to which its open pairs are sent out; larger groups are settled in place
HEAVY = 1 << 18
HEAVY_LEAST = 48
BROADCAST_ROWS = 1_000_000

_U = np.uint64
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_STEP = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _word_hashes(data: np.ndarray, starts: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Hashes of the words that begin at `starts`; bytes between words are spaces."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + block)))
        lo, hi = starts[a], starts[b] if b < len(starts) else len(data)
        part = data[lo:hi]
        first = starts[a:b] - lo
        lengths = np.diff(np.append(first, hi - lo))
        place = np.arange(hi - lo) - np.repeat(first, lengths)
        powers = np.cumprod(np.full(int(lengths.max()), _STEP | _U(1)), dtype=np.uint64)
        values = _BYTE[_LOWER[part]] * powers[place]
        values[_SPACE[part]] = 0
        out[a:b] = np.add.reduceat(values, first)
        a = b
    return mix(out)


def shingle_sets(column, words: int = WORDS) -> list[np.ndarray]:
    """The sorted array of distinct n-gram hashes of every text of an Arrow column."""
    data, offsets = byte_view(column)
    n = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * n
    inside = ~_SPACE[data]
    fresh = np.ones(len(data), bool)
    fresh[1:] = ~inside[:-1]
    fresh[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(inside & fresh)
    hashes = _word_hashes(data, starts)
    first = np.searchsorted(starts, offsets)  # per document its first word, and the end
    count = np.diff(first)
    grams = hashes
    with np.errstate(over="ignore"):
        if len(hashes) >= words:
            grams = hashes[: len(hashes) - words + 1]
            for k in range(1, words):
                grams = grams * _STEP + hashes[k : len(hashes) - words + 1 + k]
            grams = mix(grams)
        out = []
        for i in range(n):
            if count[i] >= words:
                own = np.sort(grams[first[i] : first[i] + count[i] - words + 1])
                fresh = np.ones(len(own), bool)
                np.not_equal(own[1:], own[:-1], out=fresh[1:])
                out.append(own[fresh])
            elif count[i]:
                own = _U(int(count[i]))
                for h in hashes[first[i] : first[i + 1]]:
                    own = own * _STEP + h
                out.append(mix(np.array([own])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def least_overlap(size: int, percent: int) -> int:
    """ceil(percent * size / 100): what a set of this size must share with any partner."""
    return (percent * size + 99) // 100


def plain_prefix(size: int, percent: int) -> int:
    """Length of the prefix in which two linked sets share one hash at least."""
    return size - least_overlap(size, percent) + 1


def wanted(size: int, percent: int) -> int:
    """k of a set: how many hashes the longer prefix is made to share."""
    return (plain_prefix(size, percent) + 1) // 2


def wanted_least(n: Column, percent: int) -> Column:
    """The least k among a set of n and its partners: that of the smallest partner (k grows with the size)."""
    least = F.floor((percent * n + 99) / 100)
    return F.floor((least - F.floor((percent * least + 99) / 100) + 2) / 2)


def linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


# --- signatures


def width_of(size: int) -> int:
    """64-bit words of the signature of a set: about two bits an element, in bands of four."""
    width = 4
    while 32 * width < size and width < 512:
        width *= 4
    return width


def signature(values: np.ndarray) -> np.ndarray:
    width = width_of(len(values))
    bit = values & _U(64 * width - 1)
    flags = np.zeros(64 * width, np.uint8)
    flags[bit.astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def folded(sig: np.ndarray, width: int) -> np.ndarray:
    """The signature at a smaller width: bits whose places agree there fall together."""
    return sig if len(sig) == width else np.bitwise_or.reduce(sig.reshape(-1, width), axis=0)


class Tile:
    """Rows of one tile in order of size: sizes, vertices and signatures in matrices by width."""

    def __init__(self, vertices, sizes, signatures) -> None:
        self.order = np.lexsort((vertices, sizes))
        self.v = np.asarray(vertices, np.int64)[self.order]
        self.n = np.asarray(sizes, np.int64)[self.order]
        sigs = [np.frombuffer(signatures[i], np.uint64) for i in self.order]
        widths = np.array([len(s) for s in sigs])
        self.parts = []  # width, first row, matrix; widths rise with the sizes
        for w in np.unique(widths):
            rows = np.flatnonzero(widths == w)
            self.parts.append((int(w), int(rows[0]), np.stack([sigs[r] for r in rows])))
        self.sigs = sigs

    def passing(self, i: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Earlier rows whose size fits row i and whose bound passes, and the bounds on the overlap."""
        low = int(np.searchsorted(self.n[:i], least_overlap(int(self.n[i]), percent)))
        rows, bounds = [], []
        for width, first, matrix in self.parts:
            a, b = max(low, first), min(i, first + len(matrix))
            if a >= b:
                continue
            own = folded(self.sigs[i], width)
            other = matrix[a - first : b - first]
            lacking = np.bitwise_count(own[None] & ~other).sum(axis=1, dtype=np.int64)
            missing = np.bitwise_count(other & ~own[None]).sum(axis=1, dtype=np.int64)
            bound = np.minimum(self.n[i] - lacking, self.n[a:b] - missing)
            ok = 100 * bound >= percent * (self.n[i] + self.n[a:b] - bound)
            rows.append(np.flatnonzero(ok) + a)
            bounds.append(bound[ok])
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(bounds)


def tile_links(vertices, sizes, signatures, arrays, percent: int = PERCENT, components=None, blocks=None, same: bool = True) -> list[tuple[int, int]]:
    """Links that join the tile's components, found with as few intersections as its components need.

    `components` says what is connected before; unless `same`, only rows of different blocks are compared."""
    tile = Tile(vertices, sizes, signatures)
    sets = [np.frombuffer(arrays[i], np.uint64) for i in tile.order]
    group = np.arange(len(sets)) if components is None else np.unique(np.asarray(components, np.int64)[tile.order], return_inverse=True)[1]
    block = None if same else np.asarray(blocks, np.int64)[tile.order]
    out = []
    for i in range(len(sets)):
        rows, bounds = tile.passing(i, percent)
        open_ = group[rows] != group[i]
        if block is not None:
            open_ &= block[rows] != block[i]
        rows = rows[open_][np.argsort(-bounds[open_], kind="stable")]
        while len(rows):
            j = int(rows[0])
            if tile.v[i] == tile.v[j] or linked(intersection(sets[i], sets[j]), len(sets[i]), len(sets[j]), percent):
                if tile.v[i] != tile.v[j]:
                    out.append((int(tile.v[j]), int(tile.v[i])))
                group[group == group[j]] = group[i]
            rows = rows[1:]
            rows = rows[group[rows] != group[i]]
    return out


def tile_pairs(vertices, sizes, signatures, components, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs (smaller vertex, larger) of different components whose bound passes."""
    tile = Tile(vertices, sizes, signatures)
    comp = np.asarray(components, np.int64)[tile.order]
    out = set()
    for i in range(len(comp)):
        rows, _ = tile.passing(i, percent)
        out.update(tuple(sorted((int(tile.v[i]), int(tile.v[j])))) for j in rows[comp[rows] != comp[i]])
    return list(out)


# --- streams of rows in key order


def grouped(batches, keys: list[str]):
    """Lists of the columns of every run of equal keys, from batches sorted by them."""
    held: dict[str, list] | None = None
    here = None
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        ids = list(zip(*(columns[k] for k in keys), strict=True))
        a = 0
        for b in range(1, len(ids) + 1):
            if b < len(ids) and ids[b] == ids[a]:
                continue
            if ids[a] != here:
                if held is not None:
                    yield held
                here, held = ids[a], {c: [] for c in columns}
            for c, values in columns.items():
                held[c] += values[a:b]
            a = b
    if held is not None:
        yield held


def _frequent(words: int, least: int = 4, chunk: int = 1 << 20):
    """Per task the hashes that several of its different sets hold; those that one chunk holds once are passed over."""
    schema = pa.schema([("hash", pa.int64()), ("n", pa.int64())])

    def task(batches):
        found, counts, seen, waiting, held = [], [], set(), [], 0

        def close():
            values = np.sort(np.concatenate(waiting))
            first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            n = np.diff(np.append(first, len(values)))
            found.append(values[first[n > 1]])
            counts.append(n[n > 1])

        for batch in slices(batches, size=2 << 20):
            for s in shingle_sets(batch.column("text"), words):
                name = (len(s), int(s[0]), int(s[-1]), int(np.bitwise_xor.reduce(s))) if len(s) else None
                if name and name not in seen:
                    if len(seen) < 200_000:
                        seen.add(name)
                    waiting.append(s)
                    held += len(s)
            if held > chunk:
                close()
                waiting, held = [], 0
        if waiting:
            close()
        if not found:
            return
        keys, at = np.unique(np.concatenate(found), return_inverse=True)
        n = np.bincount(at, np.concatenate(counts), len(keys)).astype(np.int64)
        keys, n = keys[n >= least], n[n >= least]
        for a in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 50_000].view(np.int64)), pa.array(n[a : a + 50_000])], schema=schema)

    return task


class Order:
    """The global order of hashes: rare ones by value, then the frequent ones from the least frequent on."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        at = np.argsort(hashes)
        self.hashes = hashes[at]
        self.place = np.empty(len(hashes), np.int64)
        self.place[np.lexsort((hashes[at], counts[at]))] = np.arange(len(hashes))

    def prefix(self, values: np.ndarray, length: int) -> tuple[np.ndarray, int]:
        """The first `length` of a sorted set in this order, and how many of them are rare."""
        if not len(self.hashes):
            return values[:length], min(length, len(values))
        rare, late, a, step = [], [], 0, length + 16
        while length > 0 and a < len(values):
            part = values[a : a + step]
            at = np.minimum(np.searchsorted(self.hashes, part), len(self.hashes) - 1)
            heavy = self.hashes[at] == part
            kept = part[~heavy][:length]
            rare.append(kept)
            late.append((part[heavy], self.place[at[heavy]]))
            length -= len(kept)
            a += step
            step *= 2
        out = np.concatenate(rare) if rare else values[:0]
        if length <= 0:
            return out, len(out)
        hashes, places = (np.concatenate(c) for c in zip(*late, strict=True))
        return np.concatenate([out, hashes[np.argsort(places)][:length]]), len(out)


def frequent_order(docs: DataFrame, words: int) -> Order:
    counted = docs.select("text").mapInArrow(_frequent(words), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY_LEAST)
    rows = counted.orderBy(F.desc("n"), "hash").limit(HEAVY).toArrow()
    return Order(rows.column("hash").to_numpy().view(np.uint64), rows.column("n").to_numpy())


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("rare", pa.binary()), ("plain", pa.int32()), ("heavy", pa.list_(pa.struct([("key", pa.int64()), ("plain", pa.int32())])))])
_SETS_DDL = "doc_id long, n long, s1 long, s2 long, rare binary, plain int, heavy array<struct<key:long,plain:int>>"


def set_name(values: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a whole set."""
    with np.errstate(over="ignore"):
        mixed = mix(values * _STEP + _U(len(values)))
        return int(np.add.reduce(mixed, dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(mixed + _STEP)).view(np.int64))


def _described(words: int, percent: int, order):
    """Per document the size of its set, two hashes of the whole set, and its prefix: rare keys as 6 bytes each (the
    first `plain` of them belong to the plain prefix), frequent keys one by one."""

    def task(batches):
        own = order.value
        for batch in slices(batches, size=2 << 20):
            rows = []
            for s in shingle_sets(batch.column("text"), words):
                n = len(s)
                if not n:
                    rows.append((0, 0, 0, b"", 0, []))
                    continue
                plain = plain_prefix(n, percent)
                prefix, rare = own.prefix(s, plain + wanted(n, percent) - 1)
                packed = prefix[:rare].view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
                rows.append((n, *set_name(s), packed, min(rare, plain), [{"key": int(h), "plain": int(rare + i < plain)} for i, h in enumerate(prefix[rare:].view(np.int64))]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(_SETS)[1:], strict=True))], schema=_SETS)

    return task


def _pack(parts: int, most: int = 4096):
    """Prefix rows as blocks: for each target a block holds its vertices once, and two bytes of place and six of key a row."""
    schema = pa.schema([("target", pa.int32()), ("block", pa.binary())])

    def task(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                packed = part.column("rare").to_pylist()
                v, n = part.column("v").to_numpy(), part.column("n").to_numpy()
                lengths = np.array([len(x) // 6 for x in packed])
                if not lengths.sum():
                    continue
                keys = np.zeros((int(lengths.sum()), 8), np.uint8)
                keys[:, :6] = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, 6)
                keys = keys.view(np.uint64).ravel()
                row = np.repeat(np.arange(len(v)), lengths)
                place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                mark = row.astype(np.uint16) | ((place < part.column("plain").to_numpy()[row]).astype(np.uint16) << np.uint16(15))
                target = (keys % _U(parts)).astype(np.int64)
                by = np.argsort(target, kind="stable")
                edges = np.searchsorted(target[by], np.arange(parts + 1))
                out = []
                for t in np.flatnonzero(np.diff(edges)):
                    rows = by[edges[t] : edges[t + 1]]
                    used, local = np.unique(row[rows], return_inverse=True)
                    body = [np.array([len(used), len(rows)], np.int32), v[used].astype(np.int64), n[used].astype(np.int64), local.astype(np.uint16) | (mark[rows] & np.uint16(1 << 15)), keys[rows].view(np.uint8).reshape(-1, 8)[:, :6]]
                    out.append((int(t), b"".join([x.tobytes() for x in body])))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], schema=schema)

    return task


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, v, n and plain of the rows of a block."""
    m, r = np.frombuffer(block, np.int32, 2)
    v, n = np.frombuffer(block, np.int64, m, 8), np.frombuffer(block, np.int64, m, 8 + 8 * m)
    mark = np.frombuffer(block, np.uint16, r, 8 + 16 * m)
    keys = np.zeros((r, 8), np.uint8)
    keys[:, :6] = np.frombuffer(block, np.uint8, 6 * r, 8 + 16 * m + 2 * r).reshape(-1, 6)
    at = mark & np.uint16((1 << 15) - 1)
    return keys.view(np.int64).ravel(), v[at], n[at], (mark >> np.uint16(15)).astype(np.int32)


def near_in_key(key: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Of rows sorted by (key, n), those with a neighbour of the same key within the size band."""
    near = (key[1:] == key[:-1]) & (100 * n[:-1] >= percent * n[1:])
    out = np.zeros(len(key), bool)
    out[1:] |= near
    out[:-1] |= near
    return out


_SHARED_DDL = "key long, v long, n long, plain int"


def _shared_task(percent: int):
    """A target's rows: those whose key another vertex of their size band has. Its size is set by the number of targets."""
    schema = pa.schema([("key", pa.int64()), ("v", pa.int64()), ("n", pa.int64()), ("plain", pa.int32())])

    def task(batches):
        blocks = [unpack(b) for batch in batches for b in batch.column("block").to_pylist()]
        if not blocks:
            return
        key, v, n, plain = (np.concatenate(c) for c in zip(*blocks, strict=True))
        del blocks
        order = np.argsort(key, kind="stable")
        repeated = key[order][1:] == key[order][:-1]  # most keys occur once: they go before the finer sort
        some = np.zeros(len(key), bool)
        some[1:] |= repeated
        some[:-1] |= repeated
        order = order[some]
        key, v, n, plain = key[order], v[order], n[order], plain[order]
        order = np.lexsort((v, n, key))
        key, v, n, plain = key[order], v[order], n[order], plain[order]
        ok = near_in_key(key, n, percent)
        for a in range(0, len(key), 100_000):
            part = ok[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000][part]) for x in (key, v, n, plain)], schema=schema)

    return task


def _arrays(words: int):
    schema = pa.schema([("v", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("arr", pa.binary())])

    def task(batches):
        for batch in slices(batches, size=2 << 20):
            sets = shingle_sets(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    return task


_EDGE_DDL = "a long, b long"
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edge_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_EDGES)


def _first_round(percent: int):
    def task(batches):
        for g in grouped(batches, ["key", "salt"]):
            if len(g["v"]) > 1:
                links = tile_links(g["v"], g["n"], g["sig"], g["arr"], percent)
                if links:
                    yield _edge_batch(links)

    return task


def _small_groups(percent: int):
    def task(batches):
        for g in grouped(batches, ["owner"]):
            pairs = tile_pairs(g["v"], g["n"], g["sig"], g["c"], percent)
            if pairs:
                yield _edge_batch(pairs)

    return task


def _large_groups(percent: int):
    def task(batches):
        for g in grouped(batches, ["owner", "lo", "hi"]):
            links = tile_links(g["v"], g["n"], g["sig"], g["arr"], percent, g["c"], g["block"], g["lo"][0] == g["hi"][0])
            if links:
                yield _edge_batch(links)

    return task


def _verify(percent: int):
    def task(batches):
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if linked(intersection(x, y), len(x), len(y), percent):
                    rows.append((a, b))
            if rows:
                yield _edge_batch(rows)

    return task


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(v, c) for every vertex of the edges, c the smallest vertex of its component: by contracting the graph.

    A turn writes two tables, where each vertex goes and the edges left; the turns are joined once at the end."""
    spark = edges.sparkSession
    rows = 2 * edges.count()  # no table here has more
    edges = stored(spark, edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), folder, f"{name}-edges", rows)
    hooks = []
    while edges.limit(1).count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to"))
        for _ in range(2):
            on = hook.select(F.col("a").alias("to"), F.col("to").alias("next"))
            hook = hook.join(on, "to", "left").select("a", F.coalesce("next", "to").alias("to"))
        hook = stored(spark, hook, folder, f"{name}-hook{len(hooks)}", rows)
        hooks.append(hook)
        left = edges.join(hook.withColumnRenamed("to", "x"), "a").join(hook.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        left = left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = stored(spark, left, folder, f"{name}-edges{len(hooks)}", rows)
    if not hooks:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("c"))
    labels = hooks[0].select(F.col("a").alias("v"), F.col("to").alias("c"))
    for hook in hooks[1:]:
        labels = labels.join(hook.withColumnRenamed("a", "c"), "c", "left").select("v", F.coalesce("to", "c").alias("c"))
    return stored(spark, labels, folder, f"{name}-labels", rows) if len(hooks) > 1 else labels


def joined_labels(labels: DataFrame, more: DataFrame, folder: str, name: str) -> DataFrame:
    """The labels after further edges: those are contracted between the components known so far."""
    to = lambda end: labels.select(F.col("v").alias(end), F.col("c").alias(f"c{end}"))
    between = more.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = components(between, folder, name)
    moved = labels.join(merged.select(F.col("v").alias("c"), F.col("c").alias("to")), "c", "left").select("v", F.coalesce("to", "c").alias("c"))
    return moved.union(merged.join(labels.select("v"), "v", "left_anti"))


def _parts(spark, rows: int, each: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    texts = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = spark.sparkContext.broadcast(frequent_order(texts, words))
    sets = stored(spark, texts.mapInArrow(_described(words, percent, order), _SETS_DDL), folder, "sets")
    # Vertices: the documents of one set. v is their smallest id; sets of null ids alone are named by their hash.
    named = stored(spark, sets.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).withColumn("v", F.coalesce("least", F.col("s1"))), folder, "vertices")
    mine = sets.where("n > 0").withColumn("v", F.coalesce("doc_id", "s1")).join(named.select("v", "s1", "s2"), ["v", "s1", "s2"])
    # Tiles.
    total = (sets.agg(F.sum(F.octet_length("rare"))).first()[0] or 0) // 6
    parts = _parts(spark, total, 1_000_000)
    packed = mine.select("v", "n", "rare", "plain").mapInArrow(_pack(parts), "target int, block binary").repartitionById(parts, F.col("target"))
    rare = packed.mapInArrow(_shared_task(percent), _SHARED_DDL).withColumn("late", F.lit(0))
    heavy = mine.select(F.explode("heavy").alias("h"), "v", "n").select("h.key", "v", "n", "h.plain", F.lit(1).alias("late"))
    found = stored(spark, rare.unionByName(heavy), folder, "shared")
    n_found = found.count()
    # The prefixes have served; documents keep the names of their sets.
    sets_kept = stored(spark, sets.select("doc_id", "n", "s1", "s2"), folder, "names")
    remove_folder(spark, f"{folder}/sets")
    release(spark)
    # Repeated rows of a document may count a key twice here, which keeps a vertex more and never one less.
    able = found.groupBy("v").agg(F.count("*").alias("keys"), F.max("n").alias("n")).where(F.col("keys") >= wanted_least(F.col("n"), percent)).select("v")
    shared = found.where("plain = 1").select("key", "v", "n", "late").join(able, "v", "left_semi")
    shared = stored(spark, shared, folder, "tiles", n_found)
    shared = shared.join(shared.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key"), "key", "left_semi")
    shared = stored(spark, shared, folder, "tiles-2", n_found)
    for old in ("shared", "tiles"):
        remove_folder(spark, f"{folder}/{old}")
    # Sets of the vertices that share a tile.
    met = stored(spark, shared.groupBy("v").agg(F.min_by("key", F.struct("late", "key")).alias("key"), F.max("n").alias("size")), folder, "met", n_found)
    n_met = met.count()
    rows = texts.withColumnRenamed("doc_id", "v").where("v is not null")
    chosen = met.select("v")
    arrays = rows.join(F.broadcast(chosen) if n_met <= BROADCAST_ROWS else chosen, "v").select("v", "text")
    nameless = named.where("least is null").select("v").join(chosen, "v")
    arrays = arrays.mapInArrow(_arrays(words), "v long, n long, sig binary, arr binary")
    if nameless.limit(1).count():
        again = sets_kept.where("doc_id is null").select("s1")
        void = texts.where("doc_id is null").mapInArrow(_nameless(words), "v long, n long, sig binary, arr binary").join(again.select(F.col("s1").alias("v")).distinct(), "v", "left_semi")
        arrays = arrays.unionByName(void)
    arrays = stored(spark, arrays, folder, "arrays")
    # First round.
    counts = met.groupBy("key").agg(F.count("*").alias("rows"), F.sum("size").alias("sizes")).where("rows > 1")
    shares = F.ceil(F.greatest(F.col("rows") / TILE, F.col("sizes") / TILE_SIZES))
    dealt = met.join(counts, "key").withColumn("salt", F.pmod(F.xxhash64("v"), shares).cast("int")).select("v", "key", "salt")
    first = arrays.join(dealt, "v").repartition(_parts(spark, n_met, 20_000), "key", "salt").sortWithinPartitions("key", "salt")
    edges = stored(spark, first.select("key", "salt", "v", "n", "sig", "arr").mapInArrow(_first_round(percent), _EDGE_DDL), folder, "edges-0")
    release(spark)
    labels = components(edges, folder, "round-0")
    # Later: the tiles of one smallest vertex form a group, so a pair that shares many tiles is tested once or a few times.
    owners = shared.groupBy("key").agg(F.min("v").alias("owner"))
    joint = stored(spark, shared.join(owners, "key").select("owner", "v", "n").distinct(), folder, "joint", n_found)
    largest = joint.groupBy("owner").agg(F.count("*").alias("rows")).agg(F.max("rows")).first()[0] or 0

    def unsettled(labels):
        """Rows (owner, v, n, c), with the rows and sizes of their group, of groups that hold several components."""
        where = joint.join(labels, "v", "left").withColumn("c", F.coalesce("c", "v"))
        several = where.groupBy("owner").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("rows"), F.sum("n").alias("sizes")).where("low < high").select("owner", "rows", "sizes")
        return where.join(several, "owner")

    def in_place(rows):
        """Links inside groups, by arrays, in blocks."""
        split = rows.withColumn("blocks", F.ceil(F.greatest(F.col("rows") / BLOCK, F.col("sizes") / TILE_SIZES)).cast("int")).withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("owner", "v", "c", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
        return split.join(arrays, "v").repartition(F.col("owner"), F.col("lo"), F.col("hi")).sortWithinPartitions("owner", "lo", "hi").mapInArrow(_large_groups(percent), _EDGE_DDL)

    if largest > TILE:  # what the first round dealt out: one vertex of each component of a group
        one = unsettled(labels).where(F.col("rows") > TILE).groupBy("owner", "c").agg(F.min_by("n", "v").alias("n"), F.min("v").alias("v"))
        one = one.join(one.groupBy("owner").agg(F.count("*").alias("rows"), F.sum("n").alias("sizes")), "owner")
        more = stored(spark, in_place(one), folder, "edges-1")
        if more.limit(1).count():
            labels = stored(spark, joined_labels(labels, more, folder, "round-1"), folder, "labels-1", 2 * n_met)
    rest = stored(spark, unsettled(labels), folder, "unsettled", n_found)
    signed = rest.where(F.col("rows") <= PAIRED).drop("n").join(arrays.select("v", "n", "sig"), "v").repartition(F.col("owner")).sortWithinPartitions("owner")
    pairs = stored(spark, signed.mapInArrow(_small_groups(percent), _EDGE_DDL).distinct(), folder, "pairs")
    both = pairs.join(arrays.select(F.col("v").alias("a"), F.col("arr").alias("x")), "a").join(arrays.select(F.col("v").alias("b"), F.col("arr").alias("y")), "b")
    more = both.select("a", "b", "x", "y").mapInArrow(_verify(percent), _EDGE_DDL).union(in_place(rest.where(F.col("rows") > PAIRED)))
    more = stored(spark, more, folder, "edges-2")
    if more.limit(1).count():
        labels = stored(spark, joined_labels(labels, more, folder, "round-2"), folder, "labels-2", 2 * n_met)
    for old in ("tiles-2", "joint", "unsettled", "arrays"):
        remove_folder(spark, f"{folder}/{old}")
    # Components by document: only sets with copies or links need a look-up.
    members = named.join(labels, "v", "left").withColumn("c", F.coalesce("c", "v"))
    least = members.join(labels.select("c").distinct(), "c", "left_semi").groupBy("c").agg(F.min("least").alias("component"))
    known = members.join(least, "c", "left").withColumn("component", F.coalesce("component", "least")).where("copies > 1 or not component <=> least")
    found = sets_kept.join(known.select("n", "s1", "s2", "component"), ["n", "s1", "s2"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _nameless(words: int):
    """Sets of rows without an id, under the name that their set's hash gives."""
    schema = pa.schema([("v", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("arr", pa.binary())])

    def task(batches):
        for batch in slices(batches, size=2 << 20):
            rows = []
            for s in shingle_sets(batch.column("text"), words):
                if len(s):
                    rows.append((set_name(s)[0], len(s), signature(s).tobytes(), s.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return task


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Of each component one row stays, that of the smallest id, with its own columns.

    Rows are told apart by id and text. Of the texts of a repeated id one keeps the id as its name; the others, and
    rows without an id, are named by a hash from 2**62 on, so they stay only where no row has a smaller name. Equal
    rows fold to one, save those without an id whose texts have no shingle."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    digest = F.xxhash64("text")
    texts = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(digest).alias("least"))
    repeated = stored(spark, texts.where("rows > 1").select(F.col("doc_id").alias("id"), "least"), folder, "repeated")
    n_repeated = repeated.count()
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(1)), 2) + F.lit(1 << 62)
    named = rows.join(F.broadcast(repeated) if n_repeated <= BROADCAST_ROWS else repeated, F.col("doc_id") == F.col("id"), "left")
    named = named.withColumn("name", F.when(F.col("doc_id").isNotNull() & (F.col("id").isNull() | (F.col("least") == digest)), F.col("doc_id")).otherwise(hashed))
    found = near_duplicates(named.select(F.col("name").alias("doc_id"), "text"), words, percent)
    found = stored(spark, found.where("n_shingles = 0 or not doc_id <=> component_id"), folder, "found")
    gone = found.where("not doc_id <=> component_id").select(F.col("doc_id").alias("gone")).distinct()
    left = named.join(gone, F.col("name") == F.col("gone"), "left_anti")
    if not n_repeated and not docs.where("doc_id is null").limit(1).count():
        return left.select("row.*")
    bare = found.where("n_shingles = 0").select(F.col("doc_id").alias("bare")).distinct()
    odd = left.where("doc_id is null or id is not null").join(bare, F.col("name") == F.col("bare"), "left")
    odd = odd.withColumn("copy", F.when(F.col("doc_id").isNull() & F.col("bare").isNotNull(), F.monotonically_increasing_id()).otherwise(-1))
    return left.where("doc_id is not null and id is null").select("row").union(odd.dropDuplicates(["name", "copy"]).select("row")).select("row.*")


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
