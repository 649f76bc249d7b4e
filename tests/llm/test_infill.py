"""Fill-in-middle over seekable frames against plain string code."""

from __future__ import annotations

import hashlib
import re

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import infill

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def plain(i, text, seed=42):
    """(n, form, prefix_chars, middle_chars, output) of a text, from whole strings."""
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    one, two, three, four = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or three % 100 >= 50:
        return n, "plain", None, None, text
    lo, hi = sorted((one % (n + 1), two % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if four % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", " \t\n", "one", " one two\n", "a <P> b", "<S", "ends with <", "é ü ß € 😀 x y z w", "x" * 5000, "ä" * 3001 + " b", "a b " * 3000, "\n".join("line %d here" % k for k in range(500)), " " * 4000 + "end", "end" + "\r\n" * 4000, "tab\x0bx\x0cy\x1cz\x85w"]


@pytest.mark.parametrize("frame_bytes", [7, 64, 1 << 16])
def test_infill_is_the_plain_one(spark, frame_bytes):
    rows = [(k * len(TEXTS) + j, t) for k in range(6) for j, t in enumerate(TEXTS)] + [(None, "no id here at all"), (3, "one"), (3, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit(1).alias("n"), F.lit("q").alias("form"), F.lit(2).alias("frames"), F.lit(3).alias("k0"))
    stored = infill.store(docs, frame_bytes=frame_bytes)
    made = infill.infill(stored, frame_bytes=frame_bytes)
    kept = ("doc_id", "n", "form", "prefix_chars", "middle_chars")
    got = sorted(tuple(r) for r in infill.digests(made, kept).select(*[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in (*kept, "output_sha256", "restored_sha256")]).collect())
    made_of = lambda i, t, r: (i, *r[:4], sha(r[4]), sha(t or ""))
    want = sorted(tuple("-" if x is None else str(x) for x in made_of(i, t, plain(i, t))) for i, t in rows)
    assert got == want and len({r[2] for r in got}) == 3
    assert sorted((r.text, r.restored) for r in infill.texts(made, ("doc_id",)).collect()) == sorted((plain(i, t)[4], t or "") for i, t in rows)


@given(st.text(st.sampled_from(" \n\tab<PSMé€😀"), max_size=80), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_frames_give_the_text_and_its_counts(text, size):
    data = text.encode()
    frames = list(infill.cut_frames(data, size))
    assert b"".join(data[lo:hi] for lo, hi, _, _ in frames) == data
    words = [m.end() for m in re.finditer(rb"[^\x20\x09-\x0d]+", data)]
    for lo, hi, units, points in frames:
        assert units == sum(e <= lo for e in words) and points == len(data[:lo].decode()) and hi - lo <= size + 3
    if frames:
        pack = zstandard.ZstdCompressor()
        stored = infill.Frames(zstandard.ZstdDecompressor(), [pack.compress(data[a:b]) for a, b, _, _ in frames], [b - a for a, b, _, _ in frames], [f[2] for f in frames], [f[3] for f in frames])
        ends = [0, *words] + ([len(data)] if data[-1:].isspace() else [])
        for unit, end in enumerate(ends):
            assert stored.unit_end(unit, len(words)) == (end, len(data[:end].decode()))


def test_only_cut_frames_are_decompressed(spark):
    """Whole frames reach the output as they are stored."""
    text = "word and some more text " * 20_000
    docs = spark.createDataFrame([(i, text) for i in range(8)], "doc_id long, text string")
    stored = infill.store(docs, frame_bytes=1 << 12)
    bodies = {bytes(f.body) for r in stored.collect() for f in r.frames}
    for r in infill.infill(stored, frame_bytes=1 << 12).collect():
        new = [x for x in r.output if bytes(x) not in bodies]
        assert len(new) <= 7 if r.form != "plain" else not new


def test_marks_must_be_told_apart():
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "ba", "cc")):
        with pytest.raises(ValueError, match="marks"):
            infill.Marks(*bad)


def test_infill_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    made = infill.infill(infill.store(docs))
    assert infill.digests(made, ("doc_id",)).collect() == [] and infill.texts(made, ("doc_id",)).columns == ["doc_id", "text", "restored"]
