"""Cross-tokenizer alignment: which tokens of one vocabulary stand for which of another.

1. mapInPandas encodes every text with both tokenizers and merges the cumulative byte ends of their tokens with two
   pointers, a batch of texts at once: places where both end cut the tokens into groups. All A-B pairs of a group are
   links. A text's links are folded to its distinct id pairs and how often it has each; they are written once, beside its
   counts and the digest of its groups.
2. groupBy counts, for every id pair, the texts that hold it linked (combined map-side, so a pair that every text holds
   costs one row a task), and the highest count of every A id.
3. Counts and maxima are joined back. The pairs with the highest counts, MOST_PAIRS at most, are broadcast, whatever their
   number in all; each of the others holds less than one of MOST_PAIRS parts of all rows, so they are joined by a shuffle
   without a hot key. Sums by text follow, combined map-side.

A worker holds a slice of texts (SLICE_BYTES, one text at least) with its tokens and links. Pairs of one group whose number
is large are formed from its distinct ids.

Defined results: texts that are null or empty, or that the vocabularies do not give back byte by byte, have no tokens: zeros
and an empty digest; strings of special tokens inside texts are plain text; rows that repeat a document are documents of
their own; a null doc_id is carried through; ties of the highest count are all best; an empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORKER_CACHE, bounded, shared_folder, stored, table

A_FILE, A_RANKS, B_FILE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Most id pairs that are broadcast with their counts: 2**19 rows of 17 bytes.
MOST_PAIRS = 1 << 19
SLICE_BYTES = 2 << 20
#: Links of one group up to which they are listed one by one.
LISTED = 1 << 8
B_BITS = 20  # an id pair is a << B_BITS | b
SPACE = "▁"

#: Characters whose classes no Unicode version changes; for them the rank form of vocabulary A gives the same ids, faster.
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable Latin-1 itself, the rest from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = sorted(set(range(256)) - set(own))
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_bytes(piece: str) -> bytes:
    if re.fullmatch("<0x[0-9A-Fa-f]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(SPACE, " ").encode()


class Vocabularies:
    """Both encoders, and per id its bytes."""

    def __init__(self, a_file: str, a_ranks: str | None, b_file: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.ranks = None
        if a_ranks:
            import public_tokenizers
            import tiktoken

            with open(a_ranks, "rb") as f:
                ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        chars = byte_characters()
        entries = self.a.get_vocab()
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(chars[c] for c in entry) if all(c in chars for c in entry) else entry.encode()
        self.b_bytes = [piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        if len(self.b_bytes) > 1 << B_BITS:
            raise ValueError(f"vocabulary B has more than {1 << B_BITS} pieces")
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        # An id as it is written inside its side of a group, and at the end of it.
        self.a_written, self.b_written = (np.array([[f"{i}{end}" for i in range(n)] for end in (",", last)], object) for n, last in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";")))

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both; none unless both give the bytes of the text, after a space, back."""
        if not text:
            return [], []
        spaced = " " + text
        a = self.ranks.encode_ordinary(spaced) if self.ranks and not _BEYOND_LATIN.search(text) else self.a.encode(spaced, add_special_tokens=False).ids
        b = self.b.encode(text)
        whole = spaced.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return [], []
        return a, b


def vocabularies(a_file: str, a_ranks: str | None, b_file: str) -> Vocabularies:
    """One pair a worker process."""
    key = (a_file, a_ranks, b_file)
    kept = WORKER_CACHE.get("alignment")
    if kept is None or kept[0] != key:
        WORKER_CACHE.clear()
        kept = WORKER_CACHE["alignment"] = (key, Vocabularies(*key))
    return kept[1]


def merged_ends(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of A and of B tokens up to each byte place where tokens of both end (the two pointers meet)."""
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    at = np.searchsorted(b_ends, a_ends)
    met = np.flatnonzero(b_ends[np.minimum(at, len(b_ends) - 1)] == a_ends)
    return met + 1, at[met] + 1


def links_of(a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, times) of all links; a pair may come several times."""
    a_from, b_from = np.append(0, a_cut[:-1]), np.append(0, b_cut[:-1])
    na, nb = a_cut - a_from, b_cut - b_from
    each = na * nb
    listed = each <= LISTED
    groups = np.flatnonzero(listed)
    group = np.repeat(groups, each[groups])
    within = np.arange(len(group)) - np.repeat(np.cumsum(each[groups]) - each[groups], each[groups])
    pair = a[a_from[group] + within // nb[group]] << B_BITS | b[b_from[group] + within % nb[group]]
    out = [(group, pair, np.ones(len(group), np.int64))]
    for g in np.flatnonzero(~listed):
        (x, i), (y, j) = (np.unique(v[f[g] : c[g]], return_counts=True) for v, f, c in ((a, a_from, a_cut), (b, b_from, b_cut)))
        out.append((np.full(len(x) * len(y), g), (x[:, None] << B_BITS | y[None]).ravel(), (i[:, None] * j[None]).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def written_groups(v: Vocabularies, a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> np.ndarray:
    """The tokens of both in the order in which they are written, each with what follows it: `a1,`, `a2|`, `b1;`, ..."""
    out = np.empty(len(a) + len(b), object)
    a_from, b_from = np.append(0, a_cut[:-1]), np.append(0, b_cut[:-1])
    for ids, cut, own_from, shift, table in ((a, a_cut, a_from, b_from, v.a_written), (b, b_cut, b_from, a_cut, v.b_written)):
        last = np.zeros(len(ids), np.int64)
        last[cut - 1] = 1
        out[np.arange(len(ids)) + np.repeat(shift, cut - own_from)] = table[last, ids]
    return out


_ALIGNED = "row long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def align_texts(texts: list[str], v: Vocabularies) -> pd.DataFrame:
    """Counts, digest and folded links of every text."""
    encoded = [v.encode(t) for t in texts]
    n = len(texts)
    n_a, n_b = (np.array([len(e[k]) for e in encoded], np.int64) for k in (0, 1))
    a, b = (np.fromiter(chain.from_iterable(e[k] for e in encoded), np.int64, m.sum()) for k, m in ((0, n_a), (1, n_b)))
    out = {"n_a": n_a, "n_b": n_b, "n_groups": np.zeros(n, np.int64), "n_links": np.zeros(n, np.int64), "groups_sha256": [""] * n}
    empty = np.zeros(0, np.int64)
    pairs, times = [empty] * n, [empty] * n
    if len(a):
        # Texts end at a place where both end, so their tokens can stand in one row.
        a_cut, b_cut = merged_ends(v.a_sizes[a], v.b_sizes[b])
        a_end, b_end = np.cumsum(n_a), np.cumsum(n_b)
        text_of = np.searchsorted(a_end, a_cut - 1, side="right")  # of each group
        edges = np.searchsorted(text_of, np.arange(n + 1))
        group, pair, number = links_of(a, b, a_cut, b_cut)
        order = np.lexsort((pair, text_of[group]))
        text, pair, number = text_of[group][order], pair[order], number[order]
        first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])))
        number, text, pair = np.add.reduceat(number, first), text[first], pair[first]
        out["n_groups"] = np.diff(edges)
        out["n_links"] = np.bincount(text, number, n).astype(np.int64)
        bounds = np.searchsorted(text, np.arange(n + 1))
        written = written_groups(v, a, b, a_cut, b_cut)
        for i in np.flatnonzero(n_a):
            hi = a_end[i] + b_end[i]
            groups = "".join(written[hi - n_a[i] - n_b[i] : hi].tolist())[:-1]
            out["groups_sha256"][i] = hashlib.sha256(groups.encode()).hexdigest()
            pairs[i], times[i] = pair[bounds[i] : bounds[i + 1]], number[bounds[i] : bounds[i + 1]]
    return pd.DataFrame(out | {"pairs": pairs, "times": times})


def align(docs: DataFrame, a_file: str | None = None, a_ranks: str | None = None, b_file: str | None = None) -> DataFrame:
    """Per document its counts, the digest of its groups and its distinct id pairs with their numbers of links.

    `a_ranks` names the rank form of the same vocabulary as `a_file`; without it, only `a_file` is used."""
    if a_file is None:
        a_file, a_ranks = vocabulary_path(A_FILE), vocabulary_path(A_RANKS)
    b_file = b_file or vocabulary_path(B_FILE)

    def task(frames):
        v = vocabularies(a_file, a_ranks, b_file)
        row = TaskContext.get().partitionId() << 33
        for frame in frames:
            texts = [t if isinstance(t, str) else "" for t in frame["text"]]
            ends = np.cumsum([len(t) for t in texts])
            start = 0
            while start < len(texts):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE_BYTES, side="right")))
                out = align_texts(texts[start:stop], v)
                out.insert(0, "doc_id", frame["doc_id"].iloc[start:stop].to_numpy())
                out.insert(0, "row", np.arange(row, row + stop - start))
                row += stop - start
                yield out
                start = stop

    # Ids travel as text: pandas would turn long ids beside nulls into floats.
    return bounded(docs).selectExpr("cast(cast(doc_id as long) as string) doc_id", "text").mapInPandas(task, _ALIGNED).withColumn("doc_id", F.col("doc_id").cast("long"))


def counted_pairs(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold the id pair linked, and whether no pair of its A id has more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = counts.withColumn("a", F.shiftright("pair", B_BITS))
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))
    return counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def least_broadcast(counts: DataFrame, most: int) -> int:
    """The least count from which on the pairs number `most` or fewer; counts are looked at by powers of two."""
    levels = counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count("*").alias("pairs")).orderBy(F.desc("level")).collect()
    least, held = 1 << 62, 0
    for r in levels:  # 64 at most
        held += r["pairs"]
        if held > most:
            break
        least = 1 << int(r["level"])
    return least


def with_counts(aligned: DataFrame, counts: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """(row, n_best, count_sum) by text: counts and maxima joined back to its links."""
    least = least_broadcast(counts, most)
    links = aligned.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    sums = lambda joined: joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    frequent = links.join(F.broadcast(counts.where(F.col("n") >= least)), "pair")
    if not counts.where(F.col("n") < least).limit(1).count():
        return sums(frequent)
    names = F.broadcast(counts.where(F.col("n") >= least).select("pair"))
    rest = links.join(names, "pair", "left_anti").join(counts.where(F.col("n") < least).hint("merge"), "pair")
    return sums(frequent.unionByName(rest))


def align_documents(docs: DataFrame, most: int = MOST_PAIRS, **files) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    aligned = stored(spark, align(docs, **files), folder, "aligned")
    counts = stored(spark, counted_pairs(aligned), folder, "counts")
    sums = with_counts(aligned, counts, most)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return aligned.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def query(spark, sf_dir):
    return align_documents(table(spark, sf_dir, "documents"))
