"""Personal data: four fixed patterns, and a character BiLSTM-CRF for forms that the patterns miss.

The patterns give the base spans. The tagger is a bidirectional LSTM over one-hot characters with a CRF on top,
written in numpy and trained from labelled spans (by default from generated lines whose spans are known by
construction; train() takes any labelled lines). Every kind that it knows must hold a digit or an @ (passes() says so),
so a value lies in the words that hold one or in digits a few characters apart. The tagger therefore reads every word
with a digit or an @ from end to end, with CONTEXT characters on both sides, in windows of T characters that overlap by
half; what it does not read cannot be part of a value that it may report. Each window is
decoded by Viterbi; a span that touches a window's edge inside the text is left to the neighbour, or else read again
in ever larger windows around it until it is whole, so spans may have any length; then the spans of all
windows of a document are reconciled at once: equal spans add up their weights and the set of disjoint spans of
the largest weight stays. An account number goes to the end that its check sum confirms, letters in it included. Spans that
fail the kind's check (digit counts, Luhn sum, parts up to 255), ids that letters or digits continue, and spans that overlap a
base span are dropped, but for those that hold base spans of their own kind whole.

Defined results: null text counts as empty (no spans, the digest of the empty string); positions are code points,
ends exclusive; texts are read whole; repeated rows give repeated results; an empty table gives no rows. The
model does not depend on the input. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, slices, table, texts_of

KINDS = ("email", "ip", "card", "phone", "id")
TAGS = 1 + 2 * len(KINDS)
T = 64
HIDDEN = 20
CONTEXT = 24

# The patterns of the base spans. A look-behind spares starts inside a run of digits, which fail like its first.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 * (d > "4")) for i, d in enumerate(digits[::-1])) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int, int]]:
    """The same matches as local part, @ and domain from left to right, found from the @ outwards."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the fixed patterns."""
    out = _emails(text)
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = digits_of(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


# --- labelled lines


def generated_lines(n: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Lines of invented words with labelled personal data and with look-alikes that are none."""
    rng = np.random.default_rng(seed)
    parts = "an en er in re on ti es st th nd le la de el os ue ie ch ge un be ur ma po si to ca vi lo".split()

    accents = "äöüßéèáíóñçøåœжцйλ你好한"

    def number(k: int, first: str = "0123456789") -> str:
        return "".join([first[rng.integers(len(first))], *(str(x) for x in rng.integers(0, 10, k - 1))]) if k else ""

    def word() -> str:
        w = "".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(1, 5)))
        return w.capitalize() if rng.random() < 0.2 else w

    def accented(w: str) -> str:
        return "".join(accents[rng.integers(len(accents))] if c in "aeiouncs" and rng.random() < 0.3 else c for c in w)

    def card() -> str:
        body = number(int(rng.integers(13, 19)), "3456")
        d = next(body + c for c in "0123456789" if luhn(body + c))
        sep = (" ", "-", "", "", ".")[rng.integers(5)]
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        forms = ("+# (###) ###-####", "(###) ###-####", "###-###-####", "+## ### ### ####", "+##-##-########", "0## #######", "0###/######", "+############", "###.###.####", "00## ## ########")
        return "".join(number(1) if c == "#" else c for c in forms[rng.integers(len(forms))])

    def email() -> str:
        w = word if rng.random() < 0.6 else lambda: accented(word() + (word() if rng.random() < 0.5 else ""))
        local = w().lower() + ("", "." + word().lower(), str(rng.integers(100)), "_" + word().lower(), "." + str(rng.integers(100)))[rng.integers(5)]
        return local + "@" + w().lower() + ("", str(rng.integers(10)))[rng.integers(2)] + (".example.com", ".org", ".net", ".example", ".co.uk", ".de", ".fr")[rng.integers(7)]

    def ident() -> str:
        return (f"{number(3)}-{number(2)}-{number(4)}", "".join(("DE", "FR", "ES", "GB")[rng.integers(4)] + number(2) + " " + " ".join(number(4) for _ in range(4)) + " " + number(2)))[rng.integers(2)]

    def other() -> str:
        forms = (f"{rng.integers(1900, 2030)}", f"{rng.integers(1, 999)}.{rng.integers(100):02d}", f"{rng.integers(24)}:{rng.integers(60):02d}", f"{rng.integers(1900, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", f"{rng.integers(1, 9)}.{rng.integers(9)}.{rng.integers(9)}", f"{rng.integers(1, 99)},{rng.integers(1000):03d}", f"#{rng.integers(99999)}", f"{rng.integers(100)}%", "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, 40)), number(int(rng.integers(1, 9))), f"@{word()}", f"{word()} @ {word()}", f"{rng.integers(1, 29)}.{rng.integers(1, 13)}.{rng.integers(1990, 2030)}", f"{word()}{rng.integers(10)}", f"{rng.integers(1, 99)}/{rng.integers(1, 99)}", f"{number(3)}-{number(3)}")
        return forms[rng.integers(len(forms))]

    makers = {"email": email, "ip": lambda: ".".join(str(x) for x in rng.integers(0, 256, 4)), "card": card, "phone": phone, "id": ident}
    out = []
    for _ in range(n):
        line, spans = "", []
        for _ in range(int(rng.integers(3, 9))):
            r = rng.random()
            if r < 0.28:
                kind = KINDS[rng.integers(len(KINDS))]
                value = makers[kind]()
                spans.append((len(line), len(line) + len(value), kind))
                line += value + (". ", ", ", "; ", " ", " ", " ", "\n", " | ")[rng.integers(8)]
            elif r < 0.5:
                line += other() + (" ", " ", ". ")[rng.integers(3)]
            else:
                line += word() + (" ", " ", ". ", ", ")[rng.integers(4)]
        out.append((line, spans))
    return out


# --- the tagger


def char_ids(text: str) -> np.ndarray:
    """1 to 95 printable ASCII, 96 other letters, 97 other characters; 0 is kept for filling."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((codes >= 32) & (codes < 127), codes - 31, np.where(codes >= 192, 96, 97)).astype(np.int64)


VOCABULARY = 98


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """BiLSTM-CRF over windows of T characters."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        h = hidden
        self.p = {}
        for d in ("f", "b"):
            self.p["x" + d] = (rng.normal(0, 0.3, (VOCABULARY, 4 * h))).astype(np.float32)
            self.p["x" + d][:, h : 2 * h] += 1  # forget gate open
            self.p["h" + d] = (rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))).astype(np.float32)
        self.p["out"] = (rng.normal(0, 0.2, (2 * h, TAGS))).astype(np.float32)
        self.p["bias"] = np.zeros(TAGS, np.float32)
        self.p["trans"] = np.zeros((TAGS, TAGS), np.float32)
        self.hidden = h

    def _run(self, ids: np.ndarray, d: str, keep: bool):
        """ids (T, B) in reading order; hidden states (T, B, h) and what the way back needs."""
        h = self.hidden
        x, w = self.p["x" + d], self.p["h" + d]
        state = np.zeros((ids.shape[1], h), np.float32)
        cell = np.zeros_like(state)
        out = np.empty((len(ids), ids.shape[1], h), np.float32)
        kept = []
        for t, row in enumerate(ids):
            z = x[row] + state @ w
            s = _sigmoid(z[:, : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            before = cell
            cell = s[:, h : 2 * h] * cell + s[:, :h] * g
            tc = np.tanh(cell)
            if keep:
                kept.append((s, g, before, tc, state))
            state = s[:, 2 * h :] * tc
            out[t] = state
        return out, kept

    def _back(self, ids, d, grad, kept):
        h = self.hidden
        w = self.p["h" + d]
        gw, whole = np.zeros_like(w), []
        dh = np.zeros_like(grad[0])
        dc = np.zeros_like(dh)
        for t in range(len(ids) - 1, -1, -1):
            s, g, before, tc, state = kept[t]
            dh = dh + grad[t]
            dc = dc + dh * s[:, 2 * h :] * (1 - tc * tc)
            i, f, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            whole.append(dz)
            gw += state.T @ dz
            dh = dz @ w.T
            dc = dc * f
        # Sums by character in one product with its one-hot rows.
        flat, dz = ids[::-1].reshape(-1), np.concatenate(whole)
        one = np.zeros((len(self.p["x" + d]), len(flat)), dz.dtype)
        one[flat, np.arange(len(flat))] = 1
        return one @ dz, gw

    def emissions(self, ids: np.ndarray, keep: bool = False):
        """ids (B, T) to scores (T, B, TAGS)."""
        forward = np.ascontiguousarray(ids.T)
        a, ka = self._run(forward, "f", keep)
        b, kb = self._run(forward[::-1], "b", keep)
        states = np.concatenate([a, b[::-1]], axis=2)
        scores = states @ self.p["out"] + self.p["bias"]
        return (scores, states, ka, kb) if keep else scores

    def gradients(self, ids: np.ndarray, tags: np.ndarray):
        """Mean negative log-likelihood of the tags (B, T), and its gradients."""
        scores, states, ka, kb = self.emissions(ids, keep=True)
        n, batch = len(scores), ids.shape[0]
        e = scores.astype(float)
        # Forward and backward sums as products, each step scaled to add up to 1.
        step, high = np.exp(self.p["trans"].astype(float)), e.max(axis=2, keepdims=True)
        local = np.exp(e - high)
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((n, batch, 1))
        for t in range(n):
            alpha[t] = local[t] * (alpha[t - 1] @ step if t else 1.0)
            scale[t] = alpha[t].sum(axis=1, keepdims=True)
            alpha[t] /= scale[t]
        for t in range(n - 2, -1, -1):
            beta[t] = ((local[t + 1] * beta[t + 1]) @ step.T) / scale[t + 1]
        gold = tags.T
        rows = np.arange(batch)
        trans = self.p["trans"].astype(float)
        loss = np.log(scale).sum() + high.sum() - e[np.arange(n)[:, None], rows[None], gold].sum() - trans[gold[:-1], gold[1:]].sum()
        demission = alpha * beta
        demission[np.arange(n)[:, None], rows[None], gold] -= 1
        dtrans = step * np.einsum("tbi,tbj->ij", alpha[:-1], local[1:] * beta[1:] / scale[1:], optimize=True)
        np.add.at(dtrans, (gold[:-1], gold[1:]), -1)
        de = (demission / batch).astype(np.float32)
        flat = states.reshape(-1, states.shape[2])
        grads = {"out": flat.T @ de.reshape(-1, TAGS), "bias": de.sum(axis=(0, 1)), "trans": (dtrans / batch).astype(np.float32)}
        dstates = de @ self.p["out"].T
        forward = np.ascontiguousarray(ids.T)
        grads["xf"], grads["hf"] = self._back(forward, "f", dstates[:, :, : self.hidden], ka)
        grads["xb"], grads["hb"] = self._back(forward[::-1], "b", dstates[::-1, :, self.hidden :], kb)
        return loss / batch, grads

    def decode(self, ids: np.ndarray, block: int = 512) -> np.ndarray:
        """Best tags (B, T) of windows (B, T)."""
        out = np.zeros(ids.shape, np.int8)
        trans = self.p["trans"]
        for a in range(0, len(ids), block):
            part = ids[a : a + block]
            e = self.emissions(part)
            score, back = e[0], np.empty((len(e), len(part), TAGS), np.int8)
            for t in range(1, len(e)):
                step = score[:, :, None] + trans[None]
                back[t] = step.argmax(axis=1)
                score = np.take_along_axis(step, back[t][:, None, :].astype(np.int64), axis=1)[:, 0] + e[t]
            tag = score.argmax(axis=1)
            rows = np.arange(len(part))
            for t in range(len(e) - 1, -1, -1):
                out[a : a + block, t] = tag
                if t:
                    tag = back[t][rows, tag]
        return out


def train(lines: list[tuple[str, list[tuple[int, int, str]]]], steps: int = 350, batch: int = 48, rate: float = 0.015, seed: int = 2) -> Tagger:
    """Fit a tagger to labelled lines (text, [(start, end, kind)]) by Adam on random windows."""
    rng = np.random.default_rng(seed)
    model = Tagger()
    encoded = []
    for text, spans in lines:
        tags = np.zeros(len(text), np.int64)
        for a, b, kind in spans:
            k = KINDS.index(kind)
            tags[a:b] = 2 + 2 * k
            tags[a] = 1 + 2 * k
        encoded.append((char_ids(text), tags))
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    for step in range(1, steps + 1):
        ids, tags = np.zeros((batch, T), np.int64), np.zeros((batch, T), np.int64)
        for r, i in enumerate(rng.integers(0, len(encoded), batch)):
            x, y = encoded[i]
            a = int(rng.integers(0, max(1, len(x) - T + 1)))
            b = min(len(x), a + T)
            ids[r, : b - a] = x[a:b]
            tags[r, : b - a] = y[a:b]
        _, grads = model.gradients(ids, tags)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g * min(1.0, 5 / max(norm, 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model.p[k] -= (lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


@functools.cache
def default_tagger() -> Tagger:
    """Trained once a process; it depends on the seeds alone."""
    return train(generated_lines(4000))


# --- windows and reconciling

TRIGGER = re.compile(r"[0-9@]")
MARKED = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text that can hold personal data: whole words with a digit or an @, and what lies around them."""
    out: list[list[int]] = []
    for m in MARKED.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def windows(a: int, b: int) -> list[tuple[int, int]]:
    """Windows of T characters over [a, b), each half a window after the one before; the last ends with the stretch."""
    if b - a <= T:
        return [(a, b)]
    starts = list(range(a, b - T, T // 2))
    return [(s, s + T) for s in starts] + [(b - T, b)]


def reconcile(candidates: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Disjoint (start, kind, end) of the largest total weight among (start, kind, end, weight)."""
    weights: dict[tuple[int, int, int], float] = {}
    for a, k, b, w in candidates:
        weights[(a, k, b)] = weights.get((a, k, b), 0.0) + w
    spans = sorted(weights, key=lambda s: (s[2], s[0], s[1]))
    ends = [s[2] for s in spans]
    best, take = [0.0], []
    for i, (a, _k, _b) in enumerate(spans):
        before = bisect_right(ends, a, 0, i)
        gain = best[before] + weights[spans[i]]
        take.append((gain > best[i], before))
        best.append(max(best[i], gain))
    out, i = [], len(spans)
    while i:
        if take[i - 1][0]:
            out.append(spans[i - 1])
            i = take[i - 1][1]
        else:
            i -= 1
    return out[::-1]


def passes(kind: str, value: str) -> bool:
    d = digits_of(value)
    if kind == "email":
        return re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", value) is not None
    if kind == "ip":
        parts = value.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and re.fullmatch(r"[0-9 .\-]+", value) is not None
    if kind == "phone":
        return 8 <= len(d) <= 15 and re.fullmatch(r"[+(]?[0-9][0-9 ()./\-]*[0-9]", value) is not None and not value.isdigit()
    return re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[0-9]{4}){3,7}(?: ?[0-9]{1,3})?", value) is not None


def may_pass(kind: str, part: str) -> bool:
    """Whether a value that holds this part can pass its check, however it goes on."""
    if kind == "email":
        return part.count("@") <= 1 and not re.search(r"\s", part)
    return len(digits_of(part)) <= {"ip": 12, "card": 19, "phone": 15, "id": 33}[kind]


def enlarged(cut: list[tuple[int, int]], length: int) -> list[tuple[int, int, tuple[int, int]]]:
    """Windows (start, end, core) around cut spans, the cores, with as much again on both sides and T at least."""
    merged: list[list[int]] = []
    for a, b in sorted(cut):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return [(max(0, a - max(T, b - a)), min(length, b + max(T, b - a)), (a, b)) for a, b in merged]


def _runs(texts: list[str], model: Tagger, where: list[tuple[int, int, int, tuple[int, int] | None]]):
    """Tagged runs (window, start, kind's place, end) of windows (text, start, end, core), decoded with others of about their length."""
    by_size: dict[int, list] = {}
    for w in where:
        by_size.setdefault(T << max(0, -(-(w[2] - w[1]) // T) - 1).bit_length(), []).append(w)
    for size, ws in by_size.items():
        many = max(1, 4096 * T // size)
        for at in range(0, len(ws), many):
            part = ws[at : at + many]
            ids = np.zeros((len(part), size), np.int64)
            for r, (i, s, e, _) in enumerate(part):
                ids[r, : e - s] = char_ids(texts[i][s:e])
            tags = model.decode(ids)
            for r in np.flatnonzero(tags.any(axis=1)):
                n, row, t = part[r][2] - part[r][1], tags[r], 0
                while t < n:
                    if row[t] % 2 == 1:
                        k, u = row[t] // 2, t + 1
                        while u < n and row[u] == row[t] + 1:
                            u += 1
                        yield part[r], t, int(k), u
                        t = u
                    else:
                        t += 1


def tagged_spans(texts: list[str], model: Tagger) -> list[list[tuple[int, int, int]]]:
    """Reconciled spans (start, kind's place, end) of each text."""
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    where = [(i, s, e, None) for i, text in enumerate(texts) for a, b in stretches(text) for s, e in windows(a, b)]
    while where:
        cut: dict[int, list[tuple[int, int]]] = {}
        for (i, s, e, core), t, k, u in _runs(texts, model, where):
            a, b = s + t, s + u
            if core is None or a < core[1] and b > core[0]:
                if (t or s == 0) and (u < e - s or e == len(texts[i])):
                    size = max(T, e - s)
                    found[i].append((a, k, b, (u - t) * (1 + min(t, size - u) / size)))
                elif may_pass(KINDS[k], texts[i][a:b]):
                    cut.setdefault(i, []).append((min(a, core[0]), max(b, core[1])) if core else (a, b))
        where = [(i, *w) for i, spans in cut.items() for w in enlarged(uncovered(spans, found[i]), len(texts[i]))]
    return [reconcile(f) if f else [] for f in found]


def uncovered(cut: list[tuple[int, int]], whole: list[tuple[int, int, int, float]]) -> list[tuple[int, int]]:
    """The cut spans that lie in no whole one."""
    spans = sorted((a, b) for a, _, b, _ in whole)
    starts = [a for a, _ in spans]
    furthest = list(itertools.accumulate((b for _, b in spans), max))
    return [(a, b) for a, b in cut if not (n := bisect_right(starts, a)) or furthest[n - 1] < b]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")


def account_end(text: str, start: int) -> int | None:
    """End of the longest account number (country, two check digits, letters and digits) from `start` whose check sum is right."""
    m = ACCOUNT.match(text, start)
    for end in range(m.end() if m else start, start + 14, -1):
        value = text[start:end].replace(" ", "")
        if text[end - 1] != " " and not text[end : end + 1].isalnum() and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1:
            return end
    return None


def completed(text: str, start: int, kind: str, end: int) -> int | None:
    """End of a tagged value, or None: an account number that checks goes to its own end; any other value must pass its check, and
    neither letters nor digits may go on behind an id, nor a group of them that has the form of the number's own."""
    if kind == "id":
        whole = account_end(text, start)
        if whole is not None:
            return whole
        if text[end : end + 1].isalnum() or (text[start].isalpha() and re.match(r" [A-Z0-9]{4}(?![A-Za-z0-9])", text[end : end + 6])):
            return None
    return end if passes(kind, text[start:end]) else None


def added(text: str, base: list[tuple[int, int, int]], tagged: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Tagged spans that pass their check and touch no base span, or hold base spans of their own kind whole."""
    out = []
    for a, k, b in tagged:
        b = completed(text, a, KINDS[k], b)
        if b is not None and not any(x < b and a < y and not (j == k and a <= x and y <= b and (a, b) != (x, y)) for x, j, y in base):
            out.append((a, k, b))
    return out


_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS[:4]], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def find(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """One row per document with its personal data."""
    shipped = docs.sparkSession.sparkContext.broadcast(model or default_tagger())

    def task(batches):
        own = shipped.value
        for batch in slices(batches):
            rows, texts = [], texts_of(batch)
            for text, tagged in zip(texts, tagged_spans(texts, own), strict=True):
                base = base_spans(text) if TRIGGER.search(text) else []
                more = added(text, base, tagged)
                rows.append((*[sum(k == i for _, k, _ in base) for i in range(4)], hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)), len(more)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(_SCHEMA)[1:], strict=True))], schema=_SCHEMA)

    return bounded(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(task, _DDL)


def query(spark, sf_dir):
    return find(table(spark, sf_dir, "documents"))
