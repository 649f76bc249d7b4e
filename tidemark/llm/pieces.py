"""SentencePiece encoding and decoding by batched numpy Viterbi (operator 5).

A text is cut into units that no piece can cross (a run of spaces with the word behind it). Units of
equal length advance together: for each end position, the hashes of all substrings that end there are
probed in the sorted piece keys, and the maximum over the allowed ones stores a backpointer.

In a unigram model the maximum is over the sums of piece scores. In a BPE model, where scores are merge
priorities, a piece may follow another only if merging their text would leave exactly these two; the
segmentation whose neighbours all agree is the one that merging gives, and one backpointer per
position is allowed (see ``Vocabulary.agree``). So the same search gives the exact result for both.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, SpanHash, _power, arrow_type, batch, blocks, mix
from .exact_dedup import _ddl

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_M1 = np.uint64(0x9E3779B97F4A7C15)
SPACE_MARK = "▁"
_BIG = np.int64(1 << 40)


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            x = raw[at]
            at += 1
            value |= (x & 127) << shift
            if x < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, raw[at : (at := at + n)]
        else:
            n = 4 if key & 7 == 5 else 8
            yield key >> 3, raw[at : (at := at + n)]


@dataclass
class Vocabulary:
    """A SentencePiece model's pieces in byte form, with spaces for its space marks."""

    pieces: list[bytes]
    scores: np.ndarray
    kinds: np.ndarray  # 1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte
    bpe: bool
    dummy_prefix: bool
    byte_ids: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)
        self.byte_ids = np.full(256, int(np.flatnonzero(self.kinds == 2)[0]) if (self.kinds == 2).any() else 0, np.int32)
        normal = [i for i in range(len(self.pieces)) if self.kinds[i] in (1, 4)]
        for i in np.flatnonzero(self.kinds == 6):
            value = int(re.fullmatch(rb"<0x([0-9A-F]{2})>", self.pieces[i])[1], 16)
            self.byte_ids[value] = i
        by_bytes = {self.pieces[i]: i for i in reversed(normal)}
        chars = {p for p in by_bytes if len(p.decode()) == 1}
        # When each piece is made in merging (a character is there from the start), and of which two.
        self.made = np.full(len(self.pieces), -1, np.int64)
        self.left = np.full(len(self.pieces), -1, np.int64)
        self.right = np.full(len(self.pieces), -1, np.int64)
        usable = set(by_bytes.values())
        if self.bpe:
            many = sorted((i for p, i in by_bytes.items() if p not in chars), key=lambda i: (-self.scores[i], i))
            for when, i in enumerate(many):
                self.made[i] = when
            for i in many:
                last = self._last_merge(self.pieces[i], by_bytes)
                if last is None:
                    usable.discard(i)
                else:
                    self.left[i], self.right[i] = last
        ids = np.array(sorted(usable), np.int64)
        data = np.frombuffer(b"".join(self.pieces[i] for i in ids), np.uint8)
        ends = np.cumsum(self.sizes[ids])
        spans = SpanHash(data)
        self.raw = np.zeros(len(self.pieces), np.uint64)  # hash sums, which add up when pieces are joined
        self.raw[ids] = (spans.sums[ends] - spans.sums[ends - self.sizes[ids]]) * spans.back[ends - self.sizes[ids]]
        key = mix(self.raw[ids] + self.sizes[ids].astype(np.uint64))
        order = np.argsort(key)
        self.keys, self.key_ids = key[order], ids[order]
        self.longest = int(self.sizes[ids].max(initial=1))
        used = np.zeros(256, bool)
        for i in usable:
            if len(self.pieces[i]) > 1:
                used[list(self.pieces[i])] = True
        self.alone = ~used
        self.alone[0x80:] = False
        self.alone[0x20] = False
        #: No piece has a space behind another character, so units may be cut before a word's spaces.
        self.cuts = all(b" " not in self.pieces[i].lstrip(b" ") for i in usable)
        self._lead = self._probe = None
        self._pair_keys = self._pair_values = None
        table = [bytes([int(np.flatnonzero(self.byte_ids == i)[0])]) if self.kinds[i] == 6 else p if self.kinds[i] in (1, 4) else b"" for i, p in enumerate(self.pieces)]
        self.out_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.out_first = np.concatenate([[0], np.cumsum([len(x) for x in table])])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_lead": None, "_probe": None, "_pair_keys": None, "_pair_values": None}

    def _last_merge(self, piece: bytes, by_bytes: dict[bytes, int]) -> tuple[int, int] | None:
        parts = [c.encode() for c in piece.decode()]
        goal = by_bytes[piece]
        while len(parts) > 1:
            best = min(((self.made[i], k) for k in range(len(parts) - 1) if (i := by_bytes.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                return None
            k = best[1]
            if len(parts) == 2:
                if by_bytes.get(parts[0]) is None or by_bytes.get(parts[1]) is None or by_bytes[parts[0] + parts[1]] != goal:
                    return None
                return by_bytes[parts[0]], by_bytes[parts[1]]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return None

    def find(self, raw: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Ids of the substrings with these hash sums and lengths, or -1. The sorted piece keys are probed from
        the first key with the same leading 16 bits on; there is rarely more than one."""
        if self._lead is None:
            self._lead = np.searchsorted(self.keys, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)).astype(np.int32)
            self._probe = np.append(self.keys, np.uint64(0xFFFFFFFFFFFFFFFF))
        q = mix(raw + size.astype(np.uint64))
        at = self._lead[q >> np.uint64(48)]
        key = self._probe[at]
        left = np.flatnonzero(key < q)
        while len(left):
            at[left] += 1
            key[left] = self._probe[at[left]]
            left = left[key[left] < q[left]]
        out = np.full(len(q), -1, np.int64)
        hit = np.flatnonzero(key == q)
        hit = hit[at[hit] < len(self.keys)]
        out[hit] = self.key_ids[at[hit]]
        return out

    def agree(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """If merging the joined text of pieces ``one`` and ``two`` ends in just these two.

        Both are unmade step by step, the later-made one first. At each step the two pieces that touch
        at the seam existed together; they would have merged across it if the piece that they form
        comes before the left one's own next merge and not after the right one's (of equal merges the
        left one is done first)."""
        a, b = one.copy(), two.copy()
        next_a, next_b = np.full(len(a), _BIG), np.full(len(a), _BIG)
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            size = self.sizes[x] + self.sizes[y]
            joined = self.find(self.raw[x] + self.raw[y] * _power(int(self.sizes.max()) + 1, "p0", _M1)[self.sizes[x]], size)
            c = np.where(joined >= 0, self.made[joined], _BIG)
            bad = (c < next_a[live]) & (c <= next_b[live])
            good[live[bad]] = False
            left = self.made[x] > self.made[y]
            done = bad | ((self.made[x] < 0) & (self.made[y] < 0))
            go = live[left & ~done]
            next_a[go] = self.made[a[go]]
            a[go] = self.right[a[go]]
            go = live[~left & ~done]
            next_b[go] = self.made[b[go]]
            b[go] = self.left[b[go]]
            live = live[~done]
        return good

    def _allowed(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """``agree`` with a table of 2**18 remembered pairs, in which later pairs displace earlier ones."""
        if self._pair_keys is None:
            self._pair_keys, self._pair_values = np.full(1 << 18, -1, np.int64), np.zeros(1 << 18, bool)
        key = one * len(self.pieces) + two
        slot = (mix(key.view(np.uint64)) & np.uint64((1 << 18) - 1)).astype(np.int64)
        out = self._pair_values[slot]
        new = np.flatnonzero(self._pair_keys[slot] != key)
        if len(new):
            uniq, at, back = np.unique(key[new], return_index=True, return_inverse=True)
            found = self.agree(uniq // len(self.pieces), uniq % len(self.pieces))
            out[new] = found[back]
            where = slot[new][at]
            self._pair_keys[where], self._pair_values[where] = uniq, found
            # of several new pairs in one slot the last key stands there; so must its value
            same = self._pair_keys[where] == uniq
            self._pair_values[where[same]] = found[same]
        return out

    def viterbi(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the rows of a matrix of bytes, joined, and the number of each row's: all rows are
        units of this one length."""
        n, size = units.shape
        power, inverse = _power(size + 1, "p0", _M1), SpanHash(np.zeros(size, np.uint8)).back
        sums = np.zeros((n, size + 1), np.uint64)
        np.cumsum((units.astype(np.uint64) + np.uint64(1)) * power[:size], axis=1, out=sums[:, 1:])
        begins = np.ones((n, size + 1), bool)  # a character may begin here
        begins[:, :size] = (units & 0xC0) != 0x80
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        token, back = np.full((n, size + 1), -1, np.int64), np.zeros((n, size + 1), np.int64)
        starts_in = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(begins[:, :size], axis=1)], axis=1)
        worst = float(self.scores.min(initial=0)) - 10.0
        for e in range(1, size + 1):
            low = max(0, e - max(self.longest, 4))
            rows, s = np.nonzero((begins[:, low:e] & (best[:, low:e] > -np.inf)) & begins[:, e : e + 1])
            s += low
            width = e - s
            ids = self.find((sums[rows, e] - sums[rows, s]) * inverse[s], width)
            value = best[rows, s] + (0.0 if self.bpe else self.scores[ids])
            lone = np.flatnonzero((ids < 0) & (width <= 4))  # a character without a piece stands for its bytes
            lone = lone[starts_in[rows[lone], e] - starts_in[rows[lone], s[lone]] == 1]
            value[lone] = best[rows[lone], s[lone]] + worst
            ok = ids >= 0
            if self.bpe:
                before = token[rows, s]
                ask = np.flatnonzero(ok & (before >= 0))
                ok[ask] = self._allowed(before[ask], ids[ask])
            ok[lone] = True
            pick = np.flatnonzero(ok)
            pick = pick[np.lexsort((value[pick], rows[pick]))]
            pick = pick[np.append(np.diff(rows[pick]) != 0, True)] if len(pick) else pick
            best[rows[pick], e], token[rows[pick], e], back[rows[pick], e] = value[pick], ids[pick], width[pick]
        rows, e = np.arange(n), np.full(n, size)
        found: list[tuple[np.ndarray, ...]] = []
        while len(rows):  # all rows go back one piece at a time
            w, t = back[rows, e], token[rows, e]
            lone = t < 0
            found.append((rows[~lone], e[~lone] - w[~lone], t[~lone]))
            for k in range(int(w[lone].max(initial=0))):
                one = lone & (w > k)
                found.append((rows[one], e[one] - w[one] + k, self.byte_ids[units[rows[one], e[one] - w[one] + k]].astype(np.int64)))
            e = e - w
            rows, e = rows[e > 0], e[e > 0]
        row, at, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(row * (size + 1) + at)
        return ids[order].astype(np.int32), np.bincount(row, minlength=n)

    def units(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the units of a block of marked texts, and each text's first unit (n + 1 values)."""
        cut = np.zeros(len(data) + 1, bool)
        if self.cuts and len(data):
            space = data == 0x20
            cut[1:-1] = space[1:] & ~space[:-1]
            lone = self.alone[data]
            cut[:-1] |= lone
            cut[1:] |= lone
        cut[off] = True
        cut[0] = False
        ends = np.flatnonzero(cut)
        return ends, np.searchsorted(ends, off, "right")


def load(path: str = MODEL) -> Vocabulary:
    """Read a model file. Only models that leave text as it is (no character map, white space kept) are
    read; others would need their normaliser first."""
    pieces, scores, kinds, trainer, norm = [], [], [], {}, {}
    for number, value in _fields(Path(path).read_bytes()):
        if number == 1:
            p = dict(_fields(value))
            kinds.append(p.get(3, 1))
            text = p.get(1, b"")
            pieces.append(text.replace(SPACE_MARK.encode(), b" ") if kinds[-1] in (1, 4) else text)
            scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            norm = dict(_fields(value))
    if norm.get(2) or norm.get(4, 1):
        raise ValueError("this model normalises its text; only identity models are read")
    return Vocabulary(pieces, np.array(scores), np.array(kinds), trainer.get(3, 1) == 2, bool(norm.get(3, 1)))


class Encoder:
    """Encodes blocks; remembers units, up to ``limit``, under their 64-bit hash."""

    def __init__(self, vocab: Vocabulary, limit: int = 400_000) -> None:
        self.v, self.limit = vocab, limit
        self._forget()

    def _forget(self) -> None:
        self.keys, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _learn(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> None:
        order = np.argsort(sizes, kind="stable")
        flats, counts = [], []
        for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            size = int(sizes[group[0]])
            step = max(1, (1 << 17) // size)
            for part in (group[i : i + step] for i in range(0, len(group), step)):
                ids, n = self.v.viterbi(data[starts[part][:, None] + np.arange(size)])
                flats.append(ids)
                counts.append(n)
        n = np.concatenate(counts)
        first = len(self.flat) + np.cumsum(n) - n
        self.flat = np.concatenate([self.flat, *flats])
        all_keys = np.concatenate([self.keys, keys[order]])
        place = np.argsort(all_keys)
        self.keys = all_keys[place]
        self.starts = np.concatenate([self.starts, first])[place]
        self.sizes = np.concatenate([self.sizes, n])[place]

    def encode(self, raw: np.ndarray, off: np.ndarray, front: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts of a block, and each text's first (n + 1 values); ``front``: texts begin here."""
        data, off = self._marked(raw, off, front)
        ends, first = self.v.units(data, off)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        h = SpanHash(data).of(starts, ends)
        uniq, at, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(uniq) > self.limit:
            self._forget()
        pos = np.searchsorted(self.keys, uniq)
        new = np.flatnonzero(self.keys[np.minimum(pos, len(self.keys) - 1)] != uniq) if len(self.keys) else np.arange(len(uniq))
        if len(new):
            self._learn(data, starts[at[new]], ends[at[new]] - starts[at[new]], uniq[new])
        which = np.searchsorted(self.keys, uniq)[back]
        n = self.sizes[which]
        out_first = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.arange(out_first[-1]) - np.repeat(out_first[:-1], n) + np.repeat(self.starts[which], n)]
        return ids, out_first[first]

    def parts(self, raw: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
        """A long text in parts of about ``limit`` bytes that begin where units do, at a space behind another character
        (also no space mark); the tokens of the parts are those of the text. Longer units stay whole."""
        lo = at = 0
        while self.v.cuts and len(raw) - lo > limit:
            at = max(at, lo + limit)
            window = raw[at - 3 : at + limit]  # each byte with the three before it
            mark = (window[:-3] == 0xE2) & (window[1:-2] == 0x96) & (window[2:-1] == 0x81)
            hit = np.flatnonzero((window[3:] == 0x20) & (window[2:-1] != 0x20) & ~mark)
            if len(hit):
                yield lo, at + int(hit[0])
                lo = at + int(hit[0])
            elif at + limit >= len(raw):
                break
            else:
                at += limit
        yield lo, len(raw)

    def _marked(self, raw: np.ndarray, off: np.ndarray, front: bool) -> tuple[np.ndarray, np.ndarray]:
        """Space marks in the texts become spaces, and each text that isn't empty gets one in front."""
        mark = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)) if len(raw) > 2 else []
        if len(mark):
            keep = np.ones(len(raw), bool)
            keep[mark + 1] = keep[mark + 2] = False
            raw = raw.copy()
            raw[mark] = 0x20
            off = np.concatenate([[0], np.cumsum(keep)])[off]
            raw = raw[keep]
        added = (np.diff(off) > 0) & (self.v.dummy_prefix and front)
        moved = off + np.concatenate([[0], np.cumsum(added)])
        data = np.full(moved[-1], 0x20, np.uint8)
        data[np.arange(len(raw)) + np.repeat((moved - off)[:-1] + added, np.diff(off))] = raw
        return data, moved


def decode_block(v: Vocabulary, ids: np.ndarray, first: np.ndarray, front: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts of a block of token ids, and their offsets. Control and unknown ids give none. ``front``: texts
    begin here."""
    n = v.out_first[ids + 1] - v.out_first[ids]
    at = np.concatenate([[0], np.cumsum(n)])
    data = v.out_bytes[np.arange(at[-1]) - np.repeat(at[:-1], n) + np.repeat(v.out_first[ids], n)]
    off = at[first]
    if v.dummy_prefix and front and len(data):
        drop = off[:-1][(np.diff(off) > 0)]
        drop = drop[data[drop] == 0x20]
        keep = np.ones(len(data), bool)
        keep[drop] = False
        off = np.concatenate([[0], np.cumsum(keep)])[off]
        data = data[keep]
    return data, off


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL, extra: tuple[str, ...] = (), verify: bool = False) -> DataFrame:
    """id, ``extra`` columns and ``ids`` (array of int) for each row, whole texts; no shuffle. A null or
    empty text has no ids; repeated rows are encoded again. A text of more than BLOCK_BYTES is encoded in parts that end between
    units. Characters without a piece become their bytes' pieces. ``verify`` adds
    ``round_trip``: if the ids, decoded again, give the text (space marks counting as spaces)."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model_path))  # a vocabulary, a few MB
    kept = [id_col, *extra]
    schema = pa.schema([*[(c, arrow_type(docs, c)) for c in kept], ("ids", pa.list_(pa.int32())), *([("round_trip", pa.bool_())] if verify else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value)
        for x in batches:
            for lo, hi, raw, off in blocks(x.column(x.num_columns - 1)):
                if hi - lo == 1 and len(raw) > BLOCK_BYTES:
                    ids, first, same = _in_parts(coder, raw, verify)
                else:
                    ids, first = coder.encode(raw, off)
                    same = same_texts(coder.v, ids, first, raw, off) if verify else None
                more = [same] if verify else []
                yield batch(schema, *[x.column(i).slice(lo, hi - lo) for i in range(len(kept))], pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids)), *more)

    return docs.select(*kept, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")).mapInArrow(run, _ddl(schema))


def _in_parts(coder: Encoder, raw: np.ndarray, verify: bool) -> tuple[np.ndarray, np.ndarray, list[bool]]:
    """The ids of one long text, its two firsts, and if decoding gives it, part by part: only the ids are held."""
    found, same = [], True
    for lo, hi in coder.parts(raw, BLOCK_BYTES):
        off = np.array([0, hi - lo])
        ids, first = coder.encode(raw[lo:hi], off, not lo)
        found.append(ids)
        same = same and (not verify or same_texts(coder.v, ids, first, raw[lo:hi], off, not lo)[0])
    ids = np.concatenate(found)
    return ids, np.array([0, len(ids)]), [same]


def same_texts(v: Vocabulary, ids: np.ndarray, first: np.ndarray, raw: np.ndarray, off: np.ndarray, front: bool = True) -> list[bool]:
    """For each text of a block, if decoding its ids gives it."""
    data, back = decode_block(v, ids.astype(np.int64), first, front)
    if np.array_equal(back, off) and np.array_equal(data, raw):
        return [True] * (len(off) - 1)
    mark = SPACE_MARK.encode()
    return [data[a:b].tobytes() == raw[c:d].tobytes().replace(mark, b" ") for a, b, c, d in zip(back[:-1], back[1:], off[:-1], off[1:], strict=True)]


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str = MODEL, extra: tuple[str, ...] = ()) -> DataFrame:
    """id, ``extra`` columns and ``text`` for each row; null ids give the empty text. Bytes that are no
    UTF-8 come out as replacement characters."""
    shared = tokens.sparkSession.sparkContext.broadcast(load(model_path))
    kept = [id_col, *extra]
    schema = pa.schema([*[(c, arrow_type(tokens, c)) for c in kept], ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for x in batches:
            for lo in range(0, x.num_rows, 1000):
                part = x.slice(lo, 1000)
                lists = part.column(part.num_columns - 1)
                first = lists.offsets.to_numpy().astype(np.int64)
                data, off = decode_block(v, lists.values.to_numpy(zero_copy_only=False)[first[0] : first[-1]].astype(np.int64), first - first[0])
                body = data.tobytes()
                yield batch(schema, *[part.column(i) for i in range(len(kept))], [body[a:b].decode(errors="replace") for a, b in zip(off[:-1], off[1:], strict=True)])

    return tokens.select(*kept, F.coalesce(ids_col, F.expr("cast(array() as array<int>)")).alias("__ids")).mapInArrow(run, _ddl(schema))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids again and compare."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, verify=True).withColumn("n_tokens", F.size("ids").cast("long"))
