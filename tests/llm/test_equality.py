"""Words that sums of powers modulo 2**64 cannot tell apart, and patterns on long inputs."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import jaccard, pieces, pii, ppm, sample, tiling
from tidemark.llm.common import SpanHash


def thue_morse(bits):
    """A word of 2**bits letters and its complement."""
    t = [bin(k).count("1") % 2 for k in range(1 << bits)]
    return "".join("ab"[x] for x in t), "".join("ba"[x] for x in t)


@pytest.mark.parametrize("bits", range(5, 15))
@pytest.mark.parametrize("salt", [0, 1])
def test_span_hash(bits, salt):
    data = np.frombuffer("".join(thue_morse(bits)).encode(), np.uint8)
    one, two = SpanHash(data, salt).of(np.array([0, 1 << bits]), np.array([1 << bits, 2 << bits]))
    assert one != two and (SpanHash(data[1 << bits :], salt).of(np.array([0]), np.array([1 << bits])) == two).all()


@pytest.mark.parametrize("bits", [10, 14])
def test_operators_tell_such_words_apart(spark, bits):
    one, two = thue_morse(bits)
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"{one} {two} {one}")], "doc_id long, text string")
    assert all(r.round_trip for r in pieces.encode(docs, verify=True).collect())
    scored = {r.doc_id: r for r in ppm.train_and_score(docs.filter("doc_id = 2"), docs.filter("doc_id = 1"), order=1).collect()}
    assert scored[2].n_known == 1 and scored[2].n_tokens == 2
    assert all(r.n_links == 0 for r in jaccard.near_classes(docs).collect())
    items = spark.createDataFrame([(1, f"p q r s {one}")], "item_id long, text string")
    near = spark.createDataFrame([(1, f"p q r s {two}"), (2, f"p q r s {one}")], "doc_id long, text string")
    assert [r.doc_id for r in tiling.leaks(near, items).collect()] == [2]


@pytest.mark.parametrize("text", ["x a@" + "b." * 100_000 + "com y", "1 " * 100_000, "4111 1111 1111 111" * 2000, "@" * 100_000, "a@" * 50_000, "1234567890" * 20_000, "+1 " * 50_000, "a.b." * 50_000 + "c@d.ef"])
def test_pii_on_long_inputs(spark, text):
    began = time.time()
    out = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(out) == 1 and abs(len(out[0].text) - len(text)) < 10 and time.time() - began < 120


def test_pii_beside_other_letters(spark):
    """An address goes on with letters of an alphabet with spaces, so it is another one; elsewhere it ends there."""
    texts = ["ÄB@c.de", "Ä.b@c.de", "яb@c.de", "邮箱ab@c.de", "x ab@c.de y", "née 1.2.3.4", "é1.2.3.4"]
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.text == t for r, t in zip(rows, texts, strict=True)] == [True, True, True, False, False, False, True]
    assert rows[3].text[2:] == rows[4].text[2:-2]


def test_samples_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", 7), (2, "b", 8)], "label long, text string, order long")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "label long, toxic int")
    got = sample.labelled_sample(docs, labels, "label", "toxic", 5)[0]
    assert sorted((r.text, r.label) for r in got.collect()) == [("a", 1), ("b", 0)]


def test_long_texts_are_encoded_in_parts(spark, monkeypatch):
    """Parts give the ids of the whole text, whatever stands at their ends."""
    texts = ["one two three  four " * 40, "a▁ b ▁ c" * 60, "x" * 500 + " y " + "z" * 500, "é ü▁ß  " * 70, " " * 300 + "end", "\n\t a b\n c" * 50, "▁ " * 200, "word"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: list(r.ids) for r in pieces.encode(docs).collect()}
    coder = pieces.Encoder(pieces.load())
    for size in (5, 16, 64):
        for i, t in enumerate(texts):
            raw = np.frombuffer(t.encode(), np.uint8)
            cuts = list(coder.parts(raw, size))
            assert cuts[0][0] == 0 and cuts[-1][1] == len(raw) and all(a[1] == b[0] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
            monkeypatch.setattr(pieces, "BLOCK_BYTES", size)
            ids, first, same = pieces._in_parts(coder, raw, True)
            assert ids.tolist() == want[i] and first.tolist() == [0, len(ids)] and same == [True]
    assert len(list(coder.parts(np.frombuffer(texts[0].encode(), np.uint8), 16))) > 20


@pytest.mark.parametrize("order", [0, 5])
def test_long_texts_are_scored_in_parts(spark, monkeypatch, order):
    texts = ["Some words and more words, " * 30, "x" * 300, "a b " * 100 + "y" * 90 + " \n" * 40, "", "é ü " * 40, " lead", "short text"]
    docs = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate(texts * 2)], "doc_id long, text string, learn boolean")
    scored = lambda: sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 7), round(r.score, 7)) for r in ppm.train_and_score(docs, docs.learn, order=order).collect())
    want = scored()
    data = pa.array(texts)
    monkeypatch.setattr(ppm, "_BLOCK", 16)
    parts = list(ppm._parts(data, order))
    assert len(parts) > 60 and sum(p[6] * (p[1] - p[0]) for p in parts) == len(texts) and sum(len(p[4]) for p in parts) == sum(len(t.encode()) + 1 for t in texts)
    monkeypatch.setattr(ppm, "_parts", _small(ppm._parts, 16))
    assert scored() == want


def _small(parts, size):
    """``parts`` with blocks of ``size`` bytes, also in other processes."""

    def run(arr, order):
        ppm._BLOCK = size
        try:
            yield from parts(arr, order)
        finally:
            ppm._BLOCK = 1 << 18

    return run
