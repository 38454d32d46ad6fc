import hashlib
import zlib

import numpy as np

from prismet.llm import media

from .conftest import EDGE


def test_round_trip(make):
    rows = media.read_back(media.store(make(EDGE))).collect()
    want = []
    for r in EDGE:
        b = (r[1] or "").encode()
        p = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
        want.append((r[0], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows), key=str) == sorted(want, key=str)
    by_text = {}
    for r in rows:
        by_text.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], tuple(r["fp_time"]), tuple(r["fp_code"])))
    assert all(len(v) == 1 for v in by_text.values())


def test_chunks_change_nothing(monkeypatch):
    x = np.random.default_rng(0).integers(0, 256, 192 * 50).astype(np.uint8)
    whole = media.fingerprint(x)
    monkeypatch.setattr(media, "CHUNK", 7)
    parts = media.fingerprint(x)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_pairs_by_brute_force():
    x = np.random.default_rng(1).integers(0, 256, 192 * 9).astype(np.uint8)
    peaks = media.spectral_peaks(x)
    want = []
    for t in range(len(peaks)):
        for b in range(media.BANDS):
            for d in (1, 2):
                if t + d < len(peaks) and peaks[t][b] >= 0 and peaks[t + d][b] >= 0:
                    want.append((t, ((b * 64 + peaks[t][b]) * 64 + peaks[t + d][b]) * 4 + d))
    times, codes = media.fingerprint(x)
    assert list(zip(times.tolist(), codes.tolist(), strict=True)) == want


def test_empty(make):
    assert media.read_back(media.store(make([]))).count() == 0
