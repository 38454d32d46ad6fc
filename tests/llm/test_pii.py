import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prismet.llm import pii

from .conftest import EDGE


def base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(pii.digits_of(m[0])) <= 19 and pii.luhn(pii.digits_of(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(pii.digits_of(m[0])) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.+-1 5()9_4", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == base(text)


def test_gradients_by_differences():
    m = pii.Tagger(hidden=3)
    rng = np.random.default_rng(0)
    ids, tags = rng.integers(0, pii.VOCABULARY, (2, 5)), rng.integers(0, pii.TAGS, (2, 5))
    m.p = {k: v.astype(float) for k, v in m.p.items()}
    _, g = m.gradients(ids, tags)
    for k, v in m.p.items():
        at = (int(ids[0, 1]), 2) if k[0] == "x" else tuple(int(rng.integers(0, s)) for s in v.shape)
        v[at] += 1e-3
        up = m.gradients(ids, tags)[0]
        v[at] -= 2e-3
        down = m.gradients(ids, tags)[0]
        v[at] += 1e-3
        assert g[k][at] == pytest.approx((up - down) / 2e-3, abs=2e-4)


def test_decoding_by_brute_force():
    from itertools import product

    m = pii.Tagger(hidden=3, seed=4)
    m.p["trans"] = np.random.default_rng(2).normal(size=m.p["trans"].shape).astype(np.float32)
    ids = np.random.default_rng(3).integers(0, pii.VOCABULARY, (1, 3))
    e = m.emissions(ids)[:, 0]
    best = max(product(range(pii.TAGS), repeat=3), key=lambda y: sum(e[t, y[t]] for t in range(3)) + sum(m.p["trans"][a, b] for a, b in zip(y, y[1:], strict=False)))
    assert tuple(m.decode(ids)[0]) == best


def test_reconciling_takes_the_heaviest_disjoint_set():
    assert pii.reconcile([(0, 0, 5, 1.0), (4, 1, 9, 1.5), (4, 1, 9, 1.5), (9, 2, 12, 1.0)]) == [(4, 1, 9), (9, 2, 12)]
    assert pii.reconcile([(0, 0, 5, 2.0), (4, 1, 9, 3.0), (8, 0, 12, 2.0)]) == [(0, 0, 5), (8, 0, 12)]


def test_windows_cover_stretches():
    for n in (1, 63, 64, 65, 96, 200, 1000):
        w = pii.windows(10, 10 + n)
        assert w[0][0] == 10 and w[-1][1] == 10 + n and all(b[0] - a[0] <= pii.T // 2 for a, b in zip(w, w[1:], strict=False))


def test_tagger_learns_held_out_lines():
    model = pii.default_tagger()
    lines = pii.generated_lines(300, seed=99)
    hit = said = there = 0
    for (_, spans), got in zip(lines, pii.tagged_spans([t for t, _ in lines], model), strict=True):
        want = {(a, pii.KINDS.index(k), b) for a, b, k in spans}
        hit, said, there = hit + len(want & set(got)), said + len(got), there + len(want)
    assert hit / said > 0.9 and hit / there > 0.9


def test_rows(make):
    text = "mail a.b@mail1.example.com, 10.0.0.1 😀 4111 1111 1111 1111 or +1 (017) 555-7713 now"
    rows = {r["doc_id"]: r for r in pii.find(make([(50, text), *EDGE])).collect() if r["doc_id"]}
    r = rows[50]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert r["base_sha256"] == hashlib.sha256(pii.joined(base(text)).encode()).hexdigest()
    assert set(pii.joined(base(text)).split(",")) <= set(r["spans"].split(","))
    assert rows[1]["spans"] == ""
    assert pii.find(make([])).count() == 0


class Runs:
    """Tags runs by their characters alone, cut ones too."""

    def decode(self, ids):
        out = np.zeros(ids.shape, np.int8)
        for r, row in enumerate(ids):
            line = "".join("\0" if c == 0 else chr(c + 31) if c < 96 else "ü" for c in row)
            for m in re.finditer(r"[A-Z0-9](?:[A-Z0-9]| (?=[A-Z0-9\0]|$))*|[ü@]+(?:\.ü*)*", line):
                k = pii.KINDS.index("email" if "ü" in m[0] or "@" in m[0] else "id")
                out[r, m.start() : m.end()] = 2 + 2 * k
                out[r, m.start()] = 1 + 2 * k
        return out


@pytest.mark.parametrize("value", ["GB12" + " 3456" * n + tail for n in (5, 6, 7) for tail in ("", " 789")] + ["ü" * n + "@" + "ü" * n + ".ü" for n in (5, 20, 31, 40, 90, 700)])
def test_spans_of_any_length_are_found_at_every_place(value):
    kind = "email" if "@" in value else "id"
    for filler in ("x7.", "xyz."):
        for at in range(64):
            text = (filler * 99)[: 100 + at] + "; " + value + "; " + filler * 60
            want = (102 + at, pii.KINDS.index(kind), 102 + at + len(value))
            assert want in pii.added(text, pii.base_spans(text), pii.tagged_spans([text], Runs())[0])


def test_a_cut_value_is_read_again_in_few_rounds():
    rounds = []

    class Counting(Runs):
        def decode(self, ids):
            rounds.append(ids.size)
            return super().decode(ids)

    text = "ü" * 20_000 + "@" + "ü" * 20_000 + ".ü"
    assert pii.tagged_spans([text], Counting()) == [[(0, 0, len(text))]]
    assert len(rounds) < 15 and sum(rounds) < 12 * len(text)


def test_long_addresses_with_other_letters_are_found_whole():
    model = pii.default_tagger()
    for address in ("müllerlüdenscheidtgesellschaft.annemarie@büro.example", "jörgfriedrichwilhelmaugust.schmidtbauer@büro.example", "zoé.lefèvre@société.fr"):
        text = f"Please write to {address} before the end of the month."
        spans = pii.added(text, pii.base_spans(text), pii.tagged_spans([text], model)[0])
        assert [(text[a:b], pii.KINDS[k]) for a, k, b in spans] == [(address, "email")]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab@. 15ü\n-", max_size=200))
def test_stretches_hold_whole_marked_words(text):
    parts = pii.stretches(text)
    for m in re.finditer(r"\S+", text):
        if re.search("[0-9@]", m[0]):
            assert any(a <= max(0, m.start() - pii.CONTEXT) and min(len(text), m.end() + pii.CONTEXT) <= b for a, b in parts)
    assert all(b < c for (_, b), (c, _) in zip(parts, parts[1:], strict=False))


def test_account_numbers_are_whole_or_not_reported():
    french, german = "FR14 2004 1010 0505 0001 3M02 606", "DE89370400440532013000"
    for number in (french, german, "GB29 NWBK 6016 1331 9268 19"):
        text = f"to {number}, thanks"
        assert pii.account_end(text, 3) == 3 + len(number)
        wrong = text.replace("9", "8", 1) if "9" in number else text.replace("1", "2", 1)
        assert pii.account_end(wrong, 3) is None
    k = pii.KINDS.index("id")
    text = f"IBAN {french} ok"
    assert pii.added(text, [], [(5, k, 5 + len("FR14 2004 1010 0505 0001"))]) == [(5, k, 5 + len(french))]
    text = "IBAN FR15 2004 1010 0505 0001 3M02 606"
    assert pii.added(text, [], [(5, k, 5 + len("FR15 2004 1010 0505 0001"))]) == []


def test_a_fuller_address_stands_beside_the_base_one():
    text = "write to anna.öz@firma.de now"
    base = pii.base_spans(text)
    assert [text[a:b] for a, _, b in base] == ["z@firma.de"]
    a, b = text.index("anna"), text.index(" now")
    assert pii.added(text, base, [(a, 0, b)]) == [(a, 0, b)] and pii.added(text, base, [base[0]]) == [] and pii.added(text, base, [(a, 0, a + 7)]) == []
