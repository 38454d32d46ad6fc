"""Cross-tokenizer alignment against a plain reading of its definition."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from prismet.llm import alignment as A

from .conftest import EDGE

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["a▁b", "<|endoftext|> and <s>", "  two  spaces\n\n\tand lines ", "ẞ Ω Ж 漢字かな 한국어 👩‍👩‍👧", "\x00\x01", "é" * 40, "aaaa" * 300, " " * 500 + "x", "don't they'LL 12345678", "﻿BOM", "<0x41>", "ﬁ ligature"]


def plain(rows):
    """One text, one token, one pair at a time."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    chars = A.byte_characters()
    done = []
    for doc, text in rows:
        text = text or ""
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ends = []
        whole = []
        for ids, of in ((x, lambda i: bytes(chars[c] for c in a.id_to_token(i))), (y, lambda i: A.piece_bytes(b.id_to_piece(i)))):
            at, own, joined = 0, [], b""
            for i in ids:
                at += len(of(i))
                joined += of(i)
                own.append(at)
            ends.append(own)
            whole.append(joined)
        if not text or whole[0] != (" " + text).encode() or whole[1] != whole[0]:
            done.append((doc, 0, 0, [], Counter()))
            continue
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append((x[i:p], y[j:q]))
            i, j = p, q
        links = Counter((s, t) for g, h in groups for s in g for t in h)
        done.append((doc, len(x), len(y), groups, links))
    counts = Counter(pair for *_, links in done for pair in links)
    highest = {}
    for (s, _), n in counts.items():
        highest[s] = max(n, highest.get(s, 0))
    out = []
    for doc, n_a, n_b, groups, links in done:
        digest = hashlib.sha256(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups).encode()).hexdigest() if groups else ""
        out.append((doc, n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if counts[p] == highest[p[0]]), sum(n * counts[p] for p, n in links.items()), digest))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def corpus():
    rng = random.Random(2)
    words = ["the", "straße", "tion", "über", "don't", "x1", "Élan", "zzzqqq", "naïve", ",", "...", "42", "日本"]
    rows = [(100 + i, "".join(rng.choice(words) + rng.choice([" ", " ", "", "  ", "\n"]) for _ in range(rng.randint(1, 60)))) for i in range(40)]
    return [(i, t[:4000] if t else t) for i, t in EDGE] + rows + [(200 + i, t) for i, t in enumerate(ODD)] + rows[:3]


@pytest.mark.parametrize("most", [A.MOST_PAIRS, 20, 0])
def test_against_the_definition(make, most):
    rows = corpus()
    assert found(A.align_documents(make(rows).repartition(3), most=most)) == plain(rows)


def test_large_groups_are_folded(make, monkeypatch):
    monkeypatch.setattr(A, "LISTED", 1)
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 5, 60), rng.integers(0, 5, 70)
    a_cut, b_cut = np.array([1, 40, 60]), np.array([1, 2, 70])
    got = Counter()
    for g, p, n in zip(*(x.tolist() for x in A.links_of(a, b, a_cut, b_cut)), strict=True):
        got[g, p] += n
    want = Counter()
    for g, (i, p, j, q) in enumerate([(0, 1, 0, 1), (1, 40, 1, 2), (40, 60, 2, 70)]):
        want.update((g, int(x) << A.B_BITS | int(y)) for x in a[i:p] for y in b[j:q])
    assert got == want


def test_the_rank_form_gives_the_same_ids():
    v = A.vocabularies(A.vocabulary_path(A.A_FILE), A.vocabulary_path(A.A_RANKS), A.vocabulary_path(A.B_FILE))
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x250)]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    assert all(v.ranks.encode_ordinary(t) == v.a.encode(t, add_special_tokens=False).ids for t in texts)
    for entry in v.ranks.token_byte_values():
        try:
            t = entry.decode()
        except UnicodeDecodeError:
            continue
        assert v.ranks.encode_ordinary(t) == v.a.encode(t, add_special_tokens=False).ids


def test_long_text_and_slices(make, monkeypatch):
    monkeypatch.setattr(A, "SLICE_BYTES", 50)
    rows = [(1, "word, " * 3000), (2, "word, x"), (None, "word"), (2**62 + 1, "word")]
    assert found(A.align_documents(make(rows))) == plain(rows)


def test_empty(make):
    assert found(A.align_documents(make([]))) == []
    assert found(A.align_documents(make([(1, None), (2, "")]))) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
