"""Fill-in-middle transformation over seekable compressed frames (operator 11).

A text is stored as independent zstandard frames of bounded size, each with the number of units and of code
points before it. A unit is a word with the white space in front of it, or the white space at a text's end. To
cut a text, the frames in which the cuts lie are found by these counts and decompressed; all others go into the
output as they are, still compressed. Digests are taken by decompressing frames one after the other. So a
document needs its own bytes and a few frames of memory, however long it is.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_type, batch, staged
from .exact_dedup import _ddl

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"  # what bytes.split() splits at
_INSIDE = bytes(range(0x80, 0xC0))  # bytes of a UTF-8 character behind its first
FRAME_BYTES = 1 << 16
_FRAME = pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("size", pa.int64()), ("body", pa.binary())])


@dataclass(frozen=True)
class Marks:
    """The strings before prefix, suffix and middle. Each begins with a character that stands nowhere else in
    them, so text beside a mark never makes another one."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        if len({*self}) < 3 or any(not m or any(m[0] in x[1:] for x in self) for m in self):
            raise ValueError("marks must differ and begin with a character found nowhere else in them")

    def __iter__(self) -> Iterator[str]:
        return iter((self.prefix, self.suffix, self.middle))


def chars(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(data.translate(None, _INSIDE))


def cut_frames(data: bytes, frame_bytes: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, words that end before or at the start, code points before it) of a text's frames, which end
    between characters."""
    lo = units = points = 0
    while lo < len(data):
        hi = min(lo + frame_bytes, len(data))
        for _ in range(3):
            hi += hi < len(data) and data[hi] & 0xC0 == 0x80
        yield lo, hi, units, points
        piece = data[lo:hi]
        goes_on = hi < len(data) and data[hi] not in _SPACES and piece[-1] not in _SPACES
        units += len(piece.split()) - goes_on
        points += chars(piece)
        lo = hi


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = (), marks: Marks | None = None, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """One row per row of ``docs``: the id, ``extra`` columns, ``n`` (units), ``n_words``, ``marked`` (the text holds a
    mark) and ``frames`` (units before, code points before, bytes, body). A null text counts as the empty one,
    which has no frames; repeated rows are stored again. Rows stay where they are read."""
    kept, names = [id_col, *extra], [m.encode() for m in marks or Marks()]
    schema = pa.schema([*[(f"k{i}", arrow_type(docs, c)) for i, c in enumerate(kept)], ("n", pa.int64()), ("n_words", pa.int64()), ("marked", pa.bool_()), ("frames", pa.list_(_FRAME))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            n, n_words, marked = [], [], []
            first, frames = [0], ([], [], [], [])
            for value in b.column(b.num_columns - 1):
                data = value.as_buffer().to_pybytes()
                words = 0
                for lo, hi, units, points in cut_frames(data, frame_bytes):
                    piece = data[lo:hi]
                    for column, x in zip(frames, (units, points, hi - lo, pack.compress(piece)), strict=True):
                        column.append(x)
                    words = units + len(piece.split()) if hi == len(data) else words
                first.append(len(frames[0]))
                n_words.append(words)
                n.append(words + (data[-1:] != b"" and data[-1] in _SPACES))
                marked.append(any(m in data for m in names))
            parts = pa.StructArray.from_arrays([pa.array(c, t.type) for c, t in zip(frames, _FRAME, strict=True)], fields=list(_FRAME))
            yield batch(schema, *[b.column(i) for i in range(len(kept))], n, n_words, marked, pa.ListArray.from_arrays(pa.array(first, pa.int32()), parts))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    out = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], text).mapInArrow(run, _ddl(schema))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], "n", "n_words", "marked", "frames")


class Frames:
    """A stored text: access by position; the frame decompressed last is held."""

    def __init__(self, unpack: zstandard.ZstdDecompressor, bodies: list[bytes], sizes: list[int], units: list[int] = (), points: list[int] = ()) -> None:
        self.unpack, self.bodies, self.sizes, self.units, self.points = unpack, bodies, sizes, units, points
        self.begins = [0, *np.cumsum(sizes, dtype=np.int64).tolist()]
        self._at, self._data = -1, b""

    def piece(self, k: int) -> bytes:
        if k != self._at:
            self._at, self._data = k, self.unpack.decompress(self.bodies[k])
        return self._data

    def unit_end(self, unit: int, n_words: int) -> tuple[int, int]:
        """(byte, code point) at which the unit of this number (from 1; 0: the beginning) ends."""
        if not unit or not self.bodies:
            return 0, 0
        if unit > n_words:  # the white space at the end
            last = len(self.bodies) - 1
            return self.begins[-1], self.points[last] + chars(self.piece(last))
        k = bisect_left(self.units, unit) - 1
        left = unit - self.units[k]
        end = next(m.end() for i, m in enumerate(_WORD.finditer(self.piece(k)), 1) if i == left)
        return self.begins[k] + end, self.points[k] + chars(self.piece(k)[:end])

    def span(self, lo: int, hi: int) -> Iterator[tuple[bytes | None, bytes]]:
        """(compressed frame, or None where it is cut; its bytes from lo to hi, or none where it is whole)."""
        k = bisect_right(self.begins, lo) - 1
        while lo < hi:
            end = min(hi, self.begins[k + 1])
            if lo == self.begins[k] and end == self.begins[k + 1]:
                yield self.bodies[k], b""
            else:
                yield None, self.piece(k)[lo - self.begins[k] : end - self.begins[k]]
            lo, k = end, k + 1

    def read(self, lo: int, hi: int) -> Iterator[bytes]:
        k = bisect_right(self.begins, lo) - 1
        while lo < hi:
            end = min(hi, self.begins[k + 1])
            yield self.piece(k)[lo - self.begins[k] : end - self.begins[k]]
            lo, k = end, k + 1


class Packer:
    """Puts pieces together into frames; whole compressed frames pass through."""

    def __init__(self, pack: zstandard.ZstdCompressor, frame_bytes: int) -> None:
        self.pack, self.limit = pack, frame_bytes
        self.bodies: list[bytes] = []
        self.sizes: list[int] = []
        self.held: list[bytes] = []
        self.size = 0

    def add(self, data: bytes) -> None:
        self.held.append(data)
        self.size += len(data)
        if self.size >= self.limit:
            self.flush()

    def copy(self, body: bytes, size: int) -> None:
        self.flush()
        self.bodies.append(body)
        self.sizes.append(size)

    def flush(self) -> None:
        if self.size:
            self.bodies.append(self.pack.compress(b"".join(self.held)))
            self.sizes.append(self.size)
        self.held, self.size = [], 0


def _stored(b: pa.RecordBatch, column: int) -> Iterator[tuple[list, ...]]:
    """The columns of each row's list of frames, as lists."""
    lists = b.column(column)
    first = lists.offsets.to_pylist()
    fields = lists.values.flatten() if pa.types.is_struct(lists.values.type) else [lists.values]
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        yield tuple(x.slice(lo, hi - lo).to_pylist() for x in fields)


def draws(id_col: str, seed: int) -> list[Column]:
    """The four numbers that decide on a document: the first 8-digit groups of the sha256 of seed and id, as
    unsigned integers; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def infill(stored: DataFrame, id_col: str = "doc_id", extra: tuple[str, ...] = (), seed: int = 42, rate: int = 50, spm: int = 80, marks: Marks | None = None, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """One row per row of ``store``'s table: the id, ``extra``, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and
    ``output``, the frames of the new text.

    Of 100 documents about ``rate`` are cut in three, of these ``spm`` in suffix-first form; the others, empty texts
    and those with a mark are ``plain``, their output is their text and both counts are null. What a
    document gets depends on its id and ``seed`` alone, so rows that repeat an id with one text get the same."""
    m = marks or Marks()
    one, two, three, four = draws(id_col, seed)
    form = F.when((F.col("n") == 0) | F.col("marked") | (three % 100 >= rate), "plain").when(four % 100 < spm, "spm").otherwise("psm")
    cuts = one % (F.col("n") + 1), two % (F.col("n") + 1)
    kept = [id_col, *extra]
    schema = pa.schema([*[(f"k{i}", arrow_type(stored, c)) for i, c in enumerate(kept)], ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.list_(pa.binary()))])
    p, s, t = (x.encode() for x in m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for b in batches:
            k = len(kept)
            plan = zip(*(b.column(k + i).to_pylist() for i in range(5)), _stored(b, k + 5), strict=True)
            counts, first, bodies = [], [0], []
            for _, n_words, kind, lo, hi, (units, points, sizes, own) in plan:
                if kind == "plain":
                    counts.append((None, None))
                    bodies += own
                else:
                    text = Frames(unpack, own, sizes, units, points)
                    (a, a_points), (z, z_points) = text.unit_end(lo, n_words), text.unit_end(hi, n_words)
                    counts.append((a_points, z_points - a_points))
                    prefix, middle, suffix = (0, a), (a, z), (z, text.begins[-1])
                    out = Packer(pack, frame_bytes)
                    for mark, span in ((p, prefix), (s, suffix), (t, middle)) if kind == "psm" else ((s, suffix), (p, prefix), (t, middle)):
                        out.add(mark)
                        at = span[0]
                        for body, piece in text.span(*span):
                            if body is None:
                                out.add(piece)
                            else:
                                out.copy(body, 0)
                            at += len(piece)
                    out.flush()
                    bodies += out.bodies
                first.append(len(bodies))
            parts = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(bodies, pa.binary()))
            yield batch(schema, *[b.column(i) for i in range(k)], b.column(k), b.column(k + 2), [c[0] for c in counts], [c[1] for c in counts], parts)

    wanted = stored.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], "n", "n_words", form.alias("form"), F.least(*cuts).alias("lo"), F.greatest(*cuts).alias("hi"), "frames")
    out = wanted.mapInArrow(run, _ddl(schema))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], "n", "form", "prefix_chars", "middle_chars", "output")


def parts_of(text: Frames, form: str, marks: list[bytes]) -> list[tuple[int, int]]:
    """Where prefix, middle and suffix lie in an output, found by its marks."""
    if form == "plain":
        return [(0, text.begins[-1])]
    at: dict[bytes, int] = {}
    carry, begin, longest = b"", 0, max(map(len, marks)) - 1
    for k in range(len(text.bodies)):
        window = carry + text.piece(k)
        for m in marks:
            if m not in at and (hit := window.find(m)) >= 0:
                at[m] = begin + hit
        carry = window[-longest:] if longest else b""
        begin += len(window) - len(carry)
    order = sorted(at, key=at.get)
    if len(order) < 3:
        raise ValueError("an output without its marks")
    ends = [at[m] for m in order[1:]] + [text.begins[-1]]
    where = {m: (at[m] + len(m), end) for m, end in zip(order, ends, strict=True)}
    p, s, t = marks
    return [where[p], where[t], where[s]]


def _outputs(made: DataFrame, kept: list[str], fields: list[tuple], of, marks: Marks) -> DataFrame:
    """``of(Frames, form, marks)`` gives the values of ``fields`` for each row of an output table."""
    schema = pa.schema([*[(f"k{i}", arrow_type(made, c)) for i, c in enumerate(kept)], *fields])
    names = [m.encode() for m in marks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for form, (bodies,) in zip(b.column(len(kept)).to_pylist(), _stored(b, len(kept) + 1), strict=True):
                sizes = [zstandard.frame_content_size(x) for x in bodies]
                rows.append(of(Frames(unpack, bodies, sizes), form, names))
            if rows:
                yield batch(schema, *[b.column(i) for i in range(len(kept))], *map(list, zip(*rows, strict=True)))

    out = made.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], "form", "output").mapInArrow(run, _ddl(schema))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *[f[0] for f in fields])


def _digests(text: Frames, form: str, marks: list[bytes]) -> tuple[str, str]:
    out, back = hashlib.sha256(), hashlib.sha256()
    for x in text.read(0, text.begins[-1]):
        out.update(x)
    for span in parts_of(text, form, marks):
        for x in text.read(*span):
            back.update(x)
    return out.hexdigest(), back.hexdigest()


def digests(made: DataFrame, kept: tuple[str, ...], marks: Marks | None = None) -> DataFrame:
    """``kept`` columns, ``output_sha256`` of each output and ``restored_sha256`` of the text that its form and marks
    give back. Nothing but ``form`` and ``output`` is looked at."""
    return _outputs(made, list(kept), [("output_sha256", pa.string()), ("restored_sha256", pa.string())], _digests, marks or Marks())


def texts(made: DataFrame, kept: tuple[str, ...], marks: Marks | None = None) -> DataFrame:
    """``kept`` columns, the output as ``text``, and ``restored``, the text that it gives back."""

    def both(text: Frames, form: str, names: list[bytes]) -> tuple[str, str]:
        back = b"".join(x for span in parts_of(text, form, names) for x in text.read(*span))
        return b"".join(text.read(0, text.begins[-1])).decode(errors="replace"), back.decode(errors="replace")

    return _outputs(made, list(kept), [("text", pa.string()), ("restored", pa.string())], both, marks or Marks())


def op11_infill_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``: doc_id, n, form, prefix_chars, middle_chars, output_sha256 and
    restored_sha256. The frames of all texts are written to the shared folder and read back."""
    stored = staged(store(spark.read.parquet(f"{sf_dir}/documents.parquet")), "frames")
    return digests(infill(stored), ("doc_id", "n", "form", "prefix_chars", "middle_chars"))


_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '{_UNIT}') AS u FROM documents),
k AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:z], '') AS mid, array_to_string(u[z + 1:n], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
