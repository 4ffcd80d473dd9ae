"""Fill-in-middle against the plain construction, code point by code point."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from cases import SCHEMA, messy, nothing, rows  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from tailgauge.llm import fill_in_middle as fim


def plain_version(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted(x % (n + 1) for x in h[:2])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", a, b - a, sha(f"<S>{suf}<P>{pre}<M>{mid}"), sha(text))
    return (doc_id, n, "psm", a, b - a, sha(f"<P>{pre}<S>{suf}<M>{mid}"), sha(text))


@pytest.mark.parametrize("window", [1 << 20, 7])
def test_digests_equal_the_plain_version(spark, messy, rows, window, monkeypatch):
    monkeypatch.setattr(fim, "WINDOW", window)
    got = Counter(tuple(r) for r in fim.digests(messy).collect())
    assert got == Counter(plain_version(r[0], r[1]) for r in rows)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}


def test_marked_and_half_marked_texts(spark):
    texts = ["<P", ">", "x<S>y", "<P><M>", "<", "P>" * 9, "<<M", "ä<S", ">😀<P", "<M>"]
    docs = spark.createDataFrame([(i * 7, t) for i, t in enumerate(texts * 9)], "doc_id long, text string").coalesce(1)
    got = Counter(tuple(r) for r in fim.digests(docs).collect())
    assert got == Counter(plain_version(i * 7, t) for i, t in enumerate(texts * 9))


def test_outputs_are_texts_and_empty_table(spark, messy, nothing, rows):
    found = fim.restore(fim.transform(messy, seed=3, fim_percent=100)).collect()
    assert Counter(r.restored for r in found) == Counter(r[1] or "" for r in rows)
    assert all(r.form == "plain" or len(r.output) == r.n + 9 for r in found)
    assert fim.digests(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="a<é😀PSM>", max_size=12), st.integers(0, 99), st.integers(0, 99), st.booleans()), max_size=6),
       st.integers(1, 9))
def test_scatter_and_gather_are_inverse(cases, window):
    cases = [c for c in cases if not any(m in c[0] for m in ("<P>", "<S>", "<M>"))]
    before, fim.WINDOW = fim.WINDOW, window
    try:
        raw = [c[0].encode() for c in cases]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        cuts = [sorted((a % (len(t) + 1), b % (len(t) + 1))) for t, a, b, _ in cases]
        form = np.array([("plain" if not t else "spm" if s else "psm") for t, _, _, s in cases], object)
        pre = np.array([a for a, _ in cuts], np.int64)
        mid = np.array([b - a for a, b in cuts], np.int64)
        out, ends = fim.scatter(data, offsets, form, pre, mid)
        for i, (t, (a, b)) in enumerate(zip((c[0] for c in cases), cuts)):
            want = {"plain": t, "psm": f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "spm": f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"}[form[i]]
            assert out[ends[i] : ends[i + 1]].tobytes().decode() == want
        back, at = fim.gather(out, ends, form)
        assert back.tobytes() == data.tobytes() and (at == offsets).all()
    finally:
        fim.WINDOW = before
