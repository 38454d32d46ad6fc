"""Sum-of-squares online packing of tokenised documents into windows of fixed capacity.

1. Every task tokenises its documents and writes pieces to the shared folder: a document longer than a window gives
   whole windows first, and its remainder. Beside its ids a piece has a number, its length and its checksum.
2. Numbers, lengths and checksums, without the ids, are dealt by a hash to tasks of about PIECES pieces each, and placed in
   the order of another hash, so that neither the order of the input nor its files decide what meets. A piece goes to the
   fill level that minimises the sum, over levels, of the squared count of partially filled windows. Moving a window from level
   h to h+s changes the sum by 2 * (N[h+s] - N[h]) + 2, so the best level is found in one pass over the level array N.
   At the end the windows still open are taken apart: their pieces, counted by length, fill windows exactly where a sum of
   lengths allows it, and only what is left then is cut; the last window is cut at powers of two, which need no padding.
3. The few pieces that were cut are joined to their ids for the checksums of their parts.

Window ids carry the task's number, and a task that is run again gives its rows anew as a whole. A task holds some dozen
bytes a piece.

Defined results: null text counts as empty and gives the one closing id; an empty table gives no rows; rows
that repeat a document are packed each for itself; a null doc_id is carried through. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORKER_CACHE, bounded, shared_folder, slices, stored, table, texts_of

CAPACITY = 2048
CLOSING_ID = 1
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Recent(dict):
    """A bounded cache of two generations: when the young one is full it becomes the old one, whose hits are kept."""

    def __init__(self, make, limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > 64:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """Ids of a text, word by word, as little-endian unsigned 32-bit bytes.

    White space always ends a token of this vocabulary, so a text's ids are those of its words. Words are kept
    in a bounded cache. Words of Latin-1 characters (which normalisation leaves alone) are lower-cased and cut
    here and only their pieces go to the model; all others, and those that may hold a control token, go through
    the whole tokenizer.
    """

    LIMIT = 300_000

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.bytes = byte_alphabet()
        self.words = Recent(self._word, self.LIMIT)

    def _word(self, word: str) -> bytes:
        """Words and the pieces that they are cut into share the cache."""
        if not word:
            return b""
        if word.isascii() or max(word) <= "\xff":
            low = word.lower()
            if low.isalpha():
                return self._piece(low) if low == word else self.words[low]
            if "<|" not in word:
                pieces = self.find(low)
                return self._piece(low) if pieces == [word] else b"".join([self.words[p] for p in pieces])
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.bytes)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process; its cache serves all tasks that run there."""
    kept = WORKER_CACHE.get("packing")
    if kept is None or kept[0] != path:
        kept = WORKER_CACHE["packing"] = (path, WordEncoder(path))
    return kept[1]


class Packer:
    """Windows of one task. A piece is (key, at, ..., size): `size` ids of the piece `key` from its id `at` on; rows are (key, at, size, window, offset)."""

    #: Lengths that an exact filling looks at for one window.
    LOOK = 96

    def __init__(self, capacity: int, first_id: int) -> None:
        self.capacity, self.next_id = capacity, first_id
        self.count = np.zeros(capacity + 1)
        self.count[0], self.count[capacity] = 0.5, -0.5  # a new window costs one less, a full one counts no more
        self.at: list[list[list]] = [[] for _ in range(capacity)]
        self.rows: list[tuple] = []
        self.shared = 0  # windows of several pieces that the placement filled

    def put(self, key: int, size: int) -> None:
        if size == self.capacity:
            self._emit([(key, 0, size)])
        elif size:
            self._place((key, 0, size), size)

    def _place(self, piece: tuple, size: int) -> None:
        count, top = self.count, self.capacity - size
        change = np.where(count[: top + 1] > 0, count[size:] - count[: top + 1], np.inf)
        level = top - int(change[::-1].argmin())
        if level:
            window = self.at[level].pop()
            count[level] -= 1
        else:
            window = []
        window.append(piece)
        if level + size == self.capacity:
            self.shared += 1
            self._emit(window)
        else:
            self.at[level + size].append(window)
            count[level + size] += 1

    def _emit(self, window: list[tuple]) -> None:
        offset = 0
        for piece in window:
            self.rows.append((piece[0], piece[1], piece[-1], self.next_id, offset))
            offset += piece[-1]
        self.next_id += 1

    def drain(self) -> None:
        """Close the open windows: exact sums of their pieces first, then whole windows by cutting, last a tail by powers of two."""
        pieces = [piece for level in self.at for window in level for piece in window]
        self.at = [[] for _ in range(self.capacity)]
        self.count[1 : self.capacity] = 0
        left = self._exact(pieces)
        window, room = [], self.capacity
        while left:
            key, at, size = left.pop()
            take = min(room, size)
            window.append((key, at, take))
            room -= take
            if take < size:
                left.append((key, at + take, size - take))
            if not room:
                self._emit(window)
                window, room = [], self.capacity
        if window:
            self._by_powers(window)

    def _exact(self, pieces: list[tuple]) -> list[tuple]:
        """Windows that whole pieces fill exactly, the largest piece first; returns the pieces that found no such window, the largest last."""
        by: list[list[tuple]] = [[] for _ in range(self.capacity)]
        for piece in pieces:
            by[piece[-1]].append(piece)
        count = np.array([len(x) for x in by])
        stuck = []
        largest = self.capacity - 1
        while largest:
            if not count[largest]:
                largest -= 1
                continue
            count[largest] -= 1
            chosen = self._subset(count, self.capacity - largest)
            if chosen is None:  # no other piece of this length finds a window either: all that could join it are still there
                stuck += by[largest]
                by[largest], count[largest] = [], 0
                continue
            self._emit([by[size].pop() for size in (largest, *chosen)])
            for size in chosen:
                count[size] -= 1
        return stuck[::-1]

    def _subset(self, count: np.ndarray, room: int) -> list[int] | None:
        """Lengths that add up to `room`, among at most LOOK of those that are there and fit, spread over them."""
        if not room:
            return []
        fit = np.flatnonzero(count[: room + 1])[::-1]
        items = []  # (length, how many of it), numbers doubling, so that any number up to the count is a sum
        for size in fit[:: max(1, -(-len(fit) // self.LOOK))].tolist():
            left, many = min(int(count[size]), room // size), 1
            while left:
                many = min(many, left)
                items.append((size, many))
                left -= many
                many *= 2
        reach, seen, full = 1, [], (1 << (room + 1)) - 1
        for size, many in items:
            seen.append(reach)
            reach |= (reach << (size * many)) & full
            if reach >> room & 1:
                break
        else:
            return None
        out = []
        for (size, many), before in zip(items[len(seen) - 1 :: -1], seen[::-1], strict=True):
            if not before >> room & 1:
                out += [size] * many
                room -= size * many
        return out

    def _by_powers(self, pieces: list[tuple]) -> None:
        rest = sum(p[-1] for p in pieces)
        pieces = pieces[::-1]
        while rest:
            room = 1 << (rest.bit_length() - 1)
            rest -= room
            window = []
            while room:
                key, at, size = pieces.pop()
                take = min(room, size)
                window.append((key, at, take))
                room -= take
                if take < size:
                    pieces.append((key, at + take, size - take))
            self._emit(window)


def cut_whole(doc_id, ids: bytes, capacity: int):
    """(doc_id, start, ids, doc_tokens): whole windows of a document, then its remainder."""
    total = len(ids) // 4
    for start in range(0, total, capacity):
        yield doc_id, start, ids[4 * start : 4 * (start + capacity)], total


_PIECES_DDL = "piece long, doc_id long, start long, doc_tokens long, length long, ids_crc32 long, width int, ids binary"
_PIECES = pa.schema([("piece", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("width", pa.int32()), ("ids", pa.binary())])
_PLACED_DDL = "piece long, at long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PLACED = pa.schema([(c.split(" ")[0], pa.int64()) for c in _PLACED_DDL.split(", ")])
RESULT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

#: Pieces that one task places, about; and cut pieces up to which their numbers are broadcast.
PIECES, BROADCAST_ROWS = 100_000, 1_000_000


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, closing_id: int = CLOSING_ID) -> DataFrame:
    """Tokenised documents in pieces of at most `capacity`; ids below 65,536 take two bytes each."""

    def task(batches):
        words = encoder(path or tokenizer_path())
        closing = np.array([closing_id], "<u4").tobytes()
        narrow = max(words.tokenizer.get_vocab_size(), closing_id + 1) <= 1 << 16
        piece = TaskContext.get().partitionId() << 33

        for batch in slices(batches, keep="packing"):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                rows += cut_whole(doc_id, words.encode(text) + closing, capacity)
            docs, starts, parts, totals = zip(*rows, strict=True)
            ids = np.frombuffer(b"".join(parts), "<u4")
            width = 2 if narrow else 4
            ends = np.cumsum([0, *map(len, parts)], dtype=np.int32) // (4 // width)
            column = pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.astype(f"<u{width}").tobytes())])
            numbers = pa.array(range(piece, piece + len(parts)), pa.int64())
            piece += len(parts)
            yield pa.RecordBatch.from_arrays([numbers, pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(totals, pa.int64()), pa.array([len(x) // 4 for x in parts], pa.int64()), pa.array(list(map(zlib.crc32, parts)), pa.int64()), pa.array([width] * len(parts), pa.int32()), column], schema=_PIECES)

    return bounded(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(task, _PIECES_DDL)


def place(light: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece or part of one, at its place; every partition of `light` (pieces without ids) is packed for itself.

    The checksum of a part is null."""

    def task(batches):
        packer = Packer(capacity, TaskContext.get().partitionId() << 33)
        held = pa.Table.from_batches(list(batches), schema=pa.schema([f for f in _PIECES if f.name in ("piece", "doc_id", "start", "doc_tokens", "length", "ids_crc32")]))
        sizes = held.column("length").to_numpy()
        for key, size in enumerate(sizes.tolist()):
            packer.put(key, size)
        packer.drain()
        for a in range(0, len(packer.rows), 50_000):
            key, at, size, window, offset = (np.array(c, np.int64) for c in zip(*packer.rows[a : a + 50_000], strict=True))
            own = held.take(pa.array(key)).combine_chunks().to_batches()[0]
            crc = pa.array(own.column("ids_crc32").to_numpy(), mask=size != sizes[key])
            yield pa.RecordBatch.from_arrays([own.column("piece"), pa.array(at), own.column("doc_id"), pa.array(own.column("start").to_numpy() + at), pa.array(size), crc, own.column("doc_tokens"), pa.array(window), pa.array(offset)], schema=_PLACED)

    return light.mapInArrow(task, _PLACED_DDL)


def _checked(batches):
    """Parts of pieces (rows of place() with width and ids) with their checksums."""
    for batch in slices(batches, column="ids", keep="packing"):
        crc = []
        for width, ids, at, length in zip(*(batch.column(c).to_pylist() for c in ("width", "ids", "at", "length")), strict=True):
            crc.append(zlib.crc32(np.frombuffer(ids, f"<u{width}")[at : at + length].astype("<u4").tobytes()))
        columns = {c: batch.column(c) for c in _PLACED.names} | {"ids_crc32": pa.array(crc, pa.int64())}
        yield pa.RecordBatch.from_arrays([columns[c] for c in _PLACED.names], schema=_PLACED)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, closing_id: int = CLOSING_ID, together: int = PIECES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `capacity` must be a power of two, so that a window of the size of its last part needs no padding."""
    if capacity < 2 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    spark = docs.sparkSession
    folder = shared_folder(spark)
    cut = stored(spark, pieces(docs, capacity, path, closing_id), folder, "pieces")
    light = cut.select("piece", "doc_id", "start", "doc_tokens", "length", "ids_crc32", F.xxhash64("piece").alias("turn"))
    dealt = light.repartition(max(1, -(-cut.count() // together)), "piece").sortWithinPartitions("turn").drop("turn")
    placed = stored(spark, place(dealt, capacity), folder, "placed")
    parts = placed.where("ids_crc32 is null")
    n_parts = parts.count()
    whole = placed.where("ids_crc32 is not null").select(*RESULT)
    if not n_parts:
        return whole
    ids = cut.select("piece", "width", "ids")
    joined = ids.join(F.broadcast(parts) if n_parts <= BROADCAST_ROWS else parts, "piece")
    return whole.unionByName(joined.mapInArrow(_checked, _PLACED_DDL).select(*RESULT))


def query(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
