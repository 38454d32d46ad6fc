import zlib

import numpy as np

from prismet.llm import language_id as L

from .conftest import EDGE

WORDS = {"en": "the and of with this there which from".split(), "de": "der und nicht über schön heit keit ung".split(), "fr": "le être où déjà eau çà les pour".split()}


def documents(n=240):
    rng = np.random.default_rng(1)
    out = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        out.append((i, " ".join(rng.choice(WORDS[lang], rng.integers(3, 40))), lang if i % 10 else None))
    return out


def test_held_out_accuracy_and_edges(make):
    rows = documents()
    docs = make(rows + [(1000 + i, t) for i, (_, t) in enumerate(EDGE)])
    model = L.train(docs)
    got = {r["doc_id"]: r for r in L.identify(docs, model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert np.mean([got[i]["lang_pred"] == list(WORDS)[i % 3] for i in held]) > 0.95
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == got[1002]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_kernel_by_brute_force():
    texts = ["Der Tag, der.", "the the day", "", "été 1", "x"]
    model = L.Model(["Der Tag der", "the day", "été là"], ["de", "en", "fr"], landmarks=3)

    def grams(t):
        t = "".join(c if c.isalpha() else " " for c in t.lower())
        t = "".join(c if c == " " or ord(c) in model.grams.known else "\1" for c in t)
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    marks = [grams(t) for t in ["Der Tag der", "the day", "été là"]]
    want = [[len(grams(t) & m) / np.sqrt(max(1, len(grams(t))) * len(m)) for m in marks] for t in texts]
    assert np.allclose(model.kernel(texts), want, atol=1e-5)


def test_nothing_to_learn_from(make):
    docs = make([(1, "abc", None), (2, "", None)])
    assert {r["lang_pred"] for r in L.identify(docs, L.train(docs)).collect()} == {"und"}
    assert L.identify(make([]), L.train(make([]))).count() == 0


def test_rare_scripts_and_letters_above_the_first_plane():
    rng = np.random.default_rng(3)
    alphabets = {"common": [chr(c) for c in [*range(0x61, 0x7B), *range(0x430, 0x450), *range(0x3B1, 0x3C1)]], "hy": [chr(0x561 + i) for i in range(20)], "ka": [chr(0x10D0 + i) for i in range(20)], "deseret": [chr(0x10428 + i) for i in range(20)], "osage": [chr(0x104D8 + i) for i in range(20)]}
    texts = [(g, " ".join("".join(rng.choice(letters, 4)) for _ in range(200 if g == "common" else 12))) for g, letters in alphabets.items() for _ in range(20)]
    model = L.Model([t for _, t in texts[::2]], [g for g, _ in texts[::2]])
    assert model.predict([t for _, t in texts[1::2]])[0] == [g for g, _ in texts[1::2]]


def test_no_language_is_left_out(make):
    docs = make([(i, f"text {i}", f"l{i % 230}") for i in range(2300)])
    assert {g for _, g in L.training_rows(docs)} == {f"l{i}" for i in range(230)}


def test_ties_and_repeated_rows(make):
    """Equal texts get equal results in each of their rows, labelled one way or the other."""
    rows = documents(120)
    docs = make(rows + rows[:4] + [(700 + i, rows[0][1], lang) for i, lang in enumerate(("en", "de", None))])
    got = L.identify(docs, L.train(docs)).collect()
    text = {i: t for i, t, _ in rows} | {700 + i: rows[0][1] for i in range(3)}
    by = {}
    for r in got:
        by.setdefault(text[r["doc_id"]], set()).add((r["lang_pred"], r["score"]))
    assert len(got) == 127 and all(len(v) == 1 for v in by.values())
