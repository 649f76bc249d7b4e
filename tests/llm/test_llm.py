"""Each operator against a plain version of it, and its defined results for odd input."""

from __future__ import annotations

import calendar
import collections
import hashlib
import itertools
import json
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

import corpus_pipeline
from tidemark.llm import chat, common, components as components_module, exact_dedup, jaccard, nbsvm, patricia, pieces, pii, ppm, registry, sample, textcnn, tiling, warc
from tidemark.llm.common import staged
from tidemark.llm.components import components

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "Same Text here now please stop"), (5, "same text HERE now please stop"), (5, "same text HERE now please stop"), (None, "same text here now please stop"), (7, "é ü ß " * 5000), (8, "x")]


def odd(spark):
    """Nulls, empty and long texts, repeats, and further columns with clashing names."""
    return spark.createDataFrame(ODD, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit(1).alias("id"), F.lit("q").alias("rows"), F.lit(2).alias("score"), F.lit(3).alias("set"), F.lit(None).cast("string").alias("source"))


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# ------------------------------------------------------------------------------ 7 exact duplicates
@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 50)), max_size=60), st.sampled_from([4, 10_000]))
@settings(max_examples=60, deadline=None)
def test_trie(rows, budget):
    trie, want = patricia.OwnerTrie(lambda a, b: a > b, budget), {}
    for k, i in rows:
        trie.insert(k, i)
        o = want.get(k)
        want[k] = (max(i, o[0]) if o else i, (o[1] if o else 0) + 1)
    got = list(trie.items())
    assert {k: (o, n) for k, o, n in got} == want and len(got) == len(want)


def test_trie_spills():
    trie = patricia.OwnerTrie(lambda a, b: a > b, 2000)
    keys = [hashlib.sha256(bytes([i % 100])).digest() * 3 for i in range(300)]
    for i, k in enumerate(keys):
        trie.insert(k, i)
    assert {(k, o, n) for k, o, n in trie.items()} == {(keys[i], i + 200, 3) for i in range(100)} and trie.spills > 0


def test_exact_owners_odd(spark):
    rows = exact_dedup.exact_owners(odd(spark)).collect()
    assert len(rows) == len(ODD)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.keep_id, r.group_size, r.kept))
    assert by[1] == [(2, 2, False)] and by[2] == [(2, 2, True)] and by[4] == [(5, 4, False)] and by[5] == [(5, 4, True)] * 2 and by[None] == [(5, 4, False)]
    kept = exact_dedup.deduplicate(odd(spark))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 7, 8] and kept.columns == odd(spark).columns
    assert exact_dedup.exact_owners(odd(spark).filter("false")).count() == 0


def test_trie_budget_counts_nodes():
    """Many short strings: the memory held stays near the budget, also where edges are a few bytes."""
    budget = 4 << 20
    trie = patricia.OwnerTrie(lambda a, b: a > b, budget)
    tracemalloc.start()
    for i in range(60_000):
        trie.insert(hashlib.sha256(str(i).encode()).digest()[:10], i)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert trie.spills > 0 and peak < 2.5 * budget and sum(1 for _ in trie.items()) == 60_000


def test_deduplicate_ties_and_names(spark):
    """The row that stays does not depend on the order of rows; columns may have any name."""
    rows = [(1, "Text", 0, "a"), (1, "text", 4, "b"), (1, "TEXT", 2, "c"), (2, "other", 1, "d"), (2, "more", 1, "e"), (None, "n", 5, "f"), (None, "n", 6, "g"), (0, "more", 9, "h"), (7, None, 0, "i"), (6, "", 0, "j")]
    names = "doc_id long, text string, __id int, __sha string"
    got = {tuple(sorted(map(tuple, exact_dedup.deduplicate(spark.createDataFrame(random.Random(k).sample(rows, len(rows)), names).repartition(1 + k)).collect()), key=repr)) for k in range(3)}
    assert len(got) == 1
    kept = next(iter(got))
    assert len(kept) == 5 and {(r[0], (r[1] or "").lower()) for r in kept} == {(1, "text"), (2, "other"), (2, "more"), (None, "n"), (7, "")}
    df = spark.createDataFrame(rows, names)
    for c in ("c1", "raw", "marked", "bits", "row", "o_id", "sha"):
        assert exact_dedup.deduplicate(df.withColumnRenamed("__id", c)).columns == ["doc_id", "text", c, "__sha"]
    assert exact_dedup.deduplicate(df.filter("false")).count() == 0


# ------------------------------------------------------------------------------------- 10 chat
@given(st.lists(st.sampled_from([*chat.Template().controls, "\\", "<", "[", "s>", "a", "</", "<<SYS", "|"]), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_escape(text):
    t = chat.Template()
    e = t.escape(text)
    assert t.unescape(e) == text and not any(c in e for c in t.controls)


def test_fold_and_render(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "He"), (1, 1, 2, "delta", None, "llo</s>"), (1, 0, 3, "edit", None, "hi there"),
        (1, 1, 4, "regenerate", None, None), (1, 1, 5, "delta", None, "Bye"), (1, 2, 6, "message", "user", "x"), (1, 2, 7, "delete", None, None), (None, 0, 0, "message", None, None),
    ]
    e = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string").repartition(3)
    parts = {r.conv: r for r in chat.render_log(e).collect()}
    assert parts[1].formatted == "<s>[ROLE]user[/ROLE]hi there</s><s>[ROLE]assistant[/ROLE]Bye</s>" and parts[1].n_turns == 2
    assert [parts[1].formatted[s.start : s.stop] for s in parts[1].loss] == ["Bye"] and parts[None].formatted == "<s>[ROLE][/ROLE]</s>"
    small = chat.read_back(chat.render_log(e, part_chars=5)).collect()
    assert sorted(map(tuple, small), key=repr) == sorted(map(tuple, chat.read_back(chat.render_log(e)).collect()), key=repr)


def test_streamed_log_folds_to_the_turns(spark):
    """Repeated turns, null roles and texts, and a conversation of one empty answer."""
    rows = [(1, 0, "user", "Hi ü"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (1, 1, "assistant", "abc 日本"), (2, 0, None, None), (2, 1, "assistant", None), (None, 5, "user", "q"), (3, 0, "assistant", "")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit(1)).withColumn("seq", F.lit("clash"))
    log = chat.streamed_log(c)
    assert {r.kind for r in log.collect()} == {"message", "regenerate", "delta", "edit"}
    plain = chat.render_log(chat.events_of(c))
    assert sorted(map(tuple, chat.render_log(log).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert chat.read_back(chat.render_log(chat.streamed_log(c.filter("false")))).count() == 0


# ------------------------------------------------------------------------------------- 4 WARC
def captures(spark, rows, path, **more):
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("marked", F.lit(1))
    warc.write_archives(p.repartition(3), f"file://{path}", captures_per_file=2, **more)
    recs = warc.read_records(spark, f"file://{path}")
    return recs, [(json.loads(r.metadata.payload.decode()[9:]), r.response) for r in warc.assemble(recs).collect()]


def test_warc(spark, tmp_path):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(3, "http://x/a b", tricky), (1, None, tricky), (2, "u", None), (4, "u\r\nWARC-Type: no", ""), (None, "n", "lone"), (5, "é", "ü" * 50_000), (None, "n", tricky)]
    recs, whole = captures(spark, rows, tmp_path / "w")
    assert {r.kind: r["count"] for r in recs.groupBy("kind").count().collect()} == {"request": 7, "metadata": 7, "response": 4, "revisit": 3}
    assert len(whole) == 7 and all(r.request and r.metadata and r.response for r in warc.assemble(recs).collect())
    assert sorted((r.payload.decode() for _, r in whole if r.payload is not None), key=len) == ["", "lone", tricky, "ü" * 50_000]
    assert {m.get("id"): m.get("refers_to") for m, r in whole if r.kind == "revisit"} == {"3": "1", None: "1", "4": "2"}
    ids = {r.record_id for _, r in whole if r.kind == "response"}
    assert all(r.refers_to in ids for _, r in whole if r.kind == "revisit")


@pytest.mark.parametrize("bits", [common.MOST_BITS, 1 << 5])
def test_warc_repeated_rows(spark, tmp_path, bits, monkeypatch):
    """Each row is a capture of its own; a crowded bitmap changes nothing."""
    monkeypatch.setattr(common, "MOST_BITS", bits)
    rng = random.Random(8)
    rows = [(rng.randint(0, 6), rng.choice(["u", "v"]), rng.choice(["p", "q", "", None, "hot"])) for _ in range(60)] + [(100 + i, "h", "hot") for i in range(400)] + [(1000 + i, "s", f"single {i}") for i in range(100)]
    recs, whole = captures(spark, rows, tmp_path / "w")
    low = {}
    for i, _, t in rows:
        low[t or ""] = min(i, low.get(t or "", i))
    want = collections.Counter((str(i), u, "response" if i == low[t or ""] else "revisit", None if i == low[t or ""] else str(low[t or ""]), (t or "") if i == low[t or ""] else None) for i, u, t in rows)
    assert collections.Counter((m["id"], m["url"], r.kind, m.get("refers_to"), r.payload.decode() if r.kind == "response" else None) for m, r in whole) == want
    assert recs.select("record_id").distinct().count() == 3 * len(rows)
    _, small = captures(spark, rows, tmp_path / "x", min_bytes=2)
    assert sum(r.kind == "response" for _, r in small) == sum(t != "hot" or i == low["hot"] for i, _, t in rows)
    assert captures(spark, rows[:1], tmp_path / "y")[1][0][1].kind == "response"


@given(st.lists(st.text(st.sampled_from("\r\nWa"), max_size=12), max_size=6))
@settings(max_examples=200, deadline=None)
def test_warc_pieces(bodies):
    """Records whose payloads hold blank lines in any number, cut at blank lines."""
    raw = "".join(f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: {i}\r\nContent-Length: {len(b)}\r\n\r\n{b}\r\n\r\n" for i, b in enumerate(bodies)).encode()
    cut = lambda x: (y := x.split(b"\r\n\r\n"))[: len(y) - (not y[-1])]
    assert [r[-1].decode() for r in warc.parse_records(iter(cut(raw)))] == bodies
    if bodies:
        with pytest.raises(ValueError):
            list(warc.parse_records(iter(cut(raw[:-5]))))


def test_warc_empty(spark, tmp_path):
    assert captures(spark, [], tmp_path / "w")[1] == []


# --------------------------------------------------------------------------------- 2 PPM scores
def plain_ppm(train, texts, order):
    """PPM with escape method C and exclusion, over dictionaries."""
    counts = collections.defaultdict(collections.Counter)
    sym = lambda t: bytes(order) + lower(t).encode() + b"\xff"
    for t in train:
        s = sym(t)
        for i in range(order, len(s)):
            for j in range(order + 1):
                counts[s[i - j : i]][s[i]] += 1
    out = []
    for t in texts:
        s, bits = sym(t), 0.0
        for i in range(order, len(s)):
            gone: set = set()
            for j in range(order, -1, -1):
                c = {k: n for k, n in counts.get(s[i - j : i], {}).items() if k not in gone}
                if not c:
                    gone |= set(counts.get(s[i - j : i], {}))
                    continue
                total = sum(c.values()) + len(c)
                if s[i] in c:
                    bits -= math.log2(c[s[i]] / total)
                    break
                bits -= math.log2(len(c) / total)
                gone |= set(c)
            else:
                bits += math.log2(256 - len(gone))
        out.append(-bits * math.log10(2))
    return out


@pytest.mark.parametrize("order", [0, 2, 5])
def test_ppm(spark, order):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "of", "Thé", "anders", "x1"]) for _ in range(rng.randint(0, 30))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in ppm.train_and_score(docs, docs.filter("doc_id < 20"), order=order).collect()}
    tok = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), "\0"]
    c = collections.Counter(w for t in texts[:20] for w in tok(t))
    n, v = sum(c.values()), len(c)
    for i, (t, want) in enumerate(zip(texts, plain_ppm(texts[:20], texts, order), strict=True)):
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tok(t)), sum(c[w] > 0 for w in tok(t)), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t))) and r.score == pytest.approx(want)


def test_ppm_odd(spark):
    rows = ppm.train_and_score(odd(spark), odd(spark)).collect()
    assert len(rows) == len(ODD) and all(r.score <= 0 and r.n_known == r.n_tokens for r in rows)
    none = ppm.train_and_score(odd(spark), odd(spark).filter("false")).filter("doc_id = 8").first()
    assert none.score == pytest.approx(-16 * math.log10(2)) and none.n_known == 0


def test_ppm_word_frequent_only_where_not_learned(spark, monkeypatch):
    """A word that no training text has is looked up in the tasks where it is frequent, and never counts as known."""
    monkeypatch.setattr(ppm, "SHARE_BITS", 3)
    docs = spark.createDataFrame([(0, "a b"), (1, "new new new new new a"), (2, "new b rare")], "doc_id long, text string")
    r = {x.doc_id: x for x in ppm.train_and_score(docs, F.col("doc_id") == 0).collect()}
    assert [(r[i].n_tokens, r[i].n_known, r[i].train_tokens) for i in range(3)] == [(3, 3, 3), (7, 2, 3), (4, 2, 3)]
    assert r[1].base_score == pytest.approx(2 * math.log10(2) - 7 * math.log10(3 + 3 + 1))
    assert ppm.train_and_score(docs.filter("false"), F.lit(True)).count() == 0


def test_context_probabilities_sum_to_one(spark):
    rng = random.Random(1)
    learned = ["".join(rng.choice("abcd ef") for _ in range(400)) for _ in range(3)]
    contexts = (0, 0x6162, 0x2020, 0x7A7A, 0x617A)
    g = np.concatenate([ppm.symbols(np.frombuffer(t.encode(), np.uint8), np.array([0, 400]), 2)[0] for t in learned]).tolist()
    rows = [(ppm.GRAM, k, 0, n, n) for k, n in collections.Counter(g).items()]
    rows += [(ppm.GRAM, c << 8 | s, 0, 1, 0) for c in contexts for s in range(256) if c << 8 | s not in set(g)]
    codes = ppm.code_lengths(spark.createDataFrame(rows, "kind int, k1 long, k2 long, n long, learned long"), 2).collect()
    for context in contexts:
        p = [2 ** -r.bits for r in codes if r.gram >> 8 == context]
        assert len(p) == 256 and sum(p) == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("order", [1, 5])
def test_ppm_joined_tail(spark, order, monkeypatch):
    """With almost nothing broadcast the joins give the same scores, also for a column that marks the training rows."""
    rng = random.Random(4)
    texts = ["", *(" ".join(rng.choice(["alpha", "beta", "Gamma", "été"]) for _ in range(rng.randint(1, 20))) for _ in range(20))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(ppm, "SHARE_BITS", 1)
    monkeypatch.setattr(ppm, "GRAM_BITS", 3)
    rows = {r.doc_id: r for r in ppm.train_and_score(docs, F.col("doc_id") < 9, order=order).collect()}
    assert [rows[i].score for i in range(21)] == pytest.approx(plain_ppm(texts[:9], texts, order))
    known = {w for t in texts[:9] for w in lower(t).split()}
    assert [rows[i].n_known for i in range(21)] == [1 + sum(w in known for w in lower(t).split()) for t in texts]


# ------------------------------------------------------------------------------ 3, 6 classifiers
def auc(y, s):
    o = np.argsort(np.argsort(s)) + 1
    return (o[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / y.sum() / (len(y) - y.sum())


def labelled(spark, bad):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows = []
    for i in range(600):
        w = [word() for _ in range(rng.randint(5, 60))]
        y = i % 3 == 0
        w = bad(w, rng) if y else w
        rows.append((i, " ".join(w), "en" if i % 2 else None, int(y)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, y int")


def test_textcnn(spark):
    df = labelled(spark, lambda w, rng: [*w[:3], rng.choice(["nasty!", "VILE"]), *w[3:]])
    model = textcnn.fit_toxicity(df.filter("doc_id < 400"), df.filter("doc_id < 400").select("doc_id", F.col("y").alias("toxic")))
    r = textcnn.score_toxicity(df, model).join(df.select("doc_id", "y"), "doc_id").filter("doc_id >= 400").toPandas()
    assert auc(r.y.to_numpy(), r.score.to_numpy()) > 0.95
    rows = textcnn.score_toxicity(odd(spark), model).collect()
    assert len(rows) == len(ODD) and all(0 <= x.score <= 1 for x in rows)
    empty = textcnn.fit_toxicity(df, df.filter("false").select("doc_id", F.col("y").alias("toxic")))
    assert textcnn.score_toxicity(df, empty).filter("score <> 0.5 or rejected").count() == 0


def test_nbsvm(spark):
    df = labelled(spark, lambda w, rng: [x + rng.choice(["%%%", "###"]) for x in w])
    model = nbsvm.fit_quality(df.filter("doc_id < 400"), df.filter("doc_id < 400").select("doc_id", (1 - F.col("y")).alias("quality")))
    r = nbsvm.score_quality(df, model).join(df.select("doc_id", "y"), "doc_id").filter("doc_id >= 400").toPandas()
    assert auc(1 - r.y.to_numpy(), r.score.to_numpy()) > 0.99
    assert nbsvm.score_quality(odd(spark), model).count() == len(ODD)


WORDS = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_logit(model, text):
    """The network word by word and window by window, in double precision."""
    rows = [textcnn.word_ids(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), model.bits) for w in WORDS.findall(lower(text))]
    x = [model.tables[0][a[0]].astype(float) + model.tables[1][b[0]] for a, b, _ in rows]
    zero, out = np.zeros(model.dim), float(model.bias)
    for i, (w, kernel) in enumerate(zip(model.widths, model.conv)):
        for f in range(model.filters):
            z = [sum((x[p + k] if p + k < len(x) else zero) @ kernel[k, :, f] for k in range(w)) for p in range(max(len(x), 1))]
            out += max(max(z) + model.conv_bias[i * model.filters + f], 0) * model.out[i * model.filters + f]
    return out


def test_textcnn_is_the_plain_convolution():
    model = textcnn.TextCNN(bits=8, dim=5, filters=4)
    model.conv_bias += 0.1
    texts = ["", "  ..", "one", "One two", "a b c d e f g a b", "été, über-all 12x", "z " * 50]
    data, off = common.utf8(pa.array(texts))
    assert model.logits(*textcnn.word_ids(data, off, 8)) == pytest.approx([plain_logit(model, t) for t in texts], abs=1e-4)


def test_textcnn_gradients_are_the_numeric_ones():
    model = textcnn.TextCNN(bits=6, dim=4, filters=3, seed=3)
    model.conv_bias += 0.2  # an empty text's maxima are 0, where the rectifier has no gradient
    for name, v in model._params().items():
        setattr(model, name, v.astype(np.float64)) if name in ("conv_bias", "out") else None
    model.conv, model.tables = [c.astype(np.float64) for c in model.conv], [10 * t.astype(np.float64) for t in model.tables]
    data, off = common.utf8(pa.array(["some words here", "", "other words and more of them", "x"]))
    a, b, first = textcnn.word_ids(data, off, 6)
    y, weight = np.array([1.0, 0, 0, 1]), np.array([1.0, 0.5, 2, 1])

    def loss():
        z = model.logits(a, b, first)
        return float(np.mean(weight * (np.log1p(np.exp(z)) - y * z)))

    grads, dx = model.gradients(a, b, first, y, weight)
    eps, off_by = 2e-3, []
    for name, value in model._params().items():
        for at in np.ndindex(value.shape):
            keep = value[at]
            value[at] = keep + eps
            up = loss()
            value[at] = keep - eps
            off_by.append(abs(grads[name][at] - (up - loss()) / 2 / eps))
            value[at] = keep
    for row in set(a.tolist()):
        for column in range(4):
            keep = model.tables[0][row, column]
            model.tables[0][row, column] = keep + eps
            up = loss()
            model.tables[0][row, column] = keep - eps
            off_by.append(abs(dx[a == row][:, column].sum() - (up - loss()) / 2 / eps))
            model.tables[0][row, column] = keep
    # a maximum may change hands within a step, where there is no gradient
    assert np.mean(np.array(off_by) < 2e-3) > 0.95 and max(abs(g).max() for g in grads.values()) > 0.05


def test_textcnn_thresholds_by_language():
    model = textcnn.TextCNN()
    s, y = np.array([0.9, 0.8, 0.7, 0.6, 0.5, 0.4]), np.array([1, 1, 1, 0, 1, 0.0])
    model.calibrate(s, y, np.ones(6), ["en"] * 6, 1.0, least=2)
    assert model.threshold == pytest.approx(0.65) and model.thresholds == {"en": pytest.approx(0.65)}
    model.calibrate(s, y, np.ones(6), ["en", "en", "de", "de", "de", None], 0.75, least=2)
    assert model.threshold == pytest.approx(0.45) and set(model.thresholds) == {"en", "de"} and model.thresholds["en"] == 0.4


def test_nbsvm_features_ratios_and_margin():
    def plain(text):
        t = lower(text).encode()
        w = re.findall(rb"[^\x20\x09-\x0D]+", t)
        return {*w, *zip(w, w[1:]), *((b"tri", t[i : i + 3]) for i in range(len(t) - 2))}

    texts = ["", "a", "The the cat", "Ünd so\tweiter und SO", "x y z x y z"]
    data, off = common.utf8(pa.array(texts))
    keys, first = nbsvm.features(data, off, 30)
    own = [keys[p:q] for p, q in zip(first[:-1], first[1:])]
    sets = [plain(t) for t in texts]
    assert [len(k) for k in own] == [len(x) for x in sets]
    assert all(len(np.intersect1d(own[i], own[j])) == len(sets[i] & sets[j]) for i in range(5) for j in range(5))
    small = [np.array([0, 2]), np.array([2]), np.array([1, 2])]
    got = nbsvm.log_count_ratios(small, np.array([1, 0, 1]), 4)
    pos, neg = np.array([2, 2, 3, 1]) / 8, np.array([1, 1, 2, 1]) / 5
    assert got == pytest.approx(np.log(pos / neg))
    model = nbsvm.NBSVM(2, np.array([1, -2, 0.5, 0], np.float32), 0.25, 2.0, -1.0)
    assert model.score(np.array([0, 2, 1]), np.array([0, 2, 2, 3])) == pytest.approx([1 / (1 + math.exp(-(2 * m - 1))) for m in (1.5 / math.sqrt(2) + 0.25, 0.25, -1.75)])


def test_dual_descent_reaches_the_optimum():
    """Against plain gradient descent on the primal problem."""
    rng = np.random.default_rng(2)
    n, d = 60, 8
    x = rng.normal(size=(n, d)) * (rng.random((n, d)) < 0.6)
    y, cost = np.where(x @ rng.normal(size=d) + 0.5 * rng.normal(size=n) > 0, 1.0, -1.0), rng.uniform(0.5, 2, n)
    w, bias = nbsvm.dual_coordinate_descent([np.flatnonzero(r) for r in x], [r[r != 0] for r in x], y, cost, d, epochs=2000)
    x1 = np.hstack([x, np.ones((n, 1))])
    loss = lambda v: 0.5 * v @ v + (cost * np.maximum(1 - y * (x1 @ v), 0) ** 2).sum()
    v = np.zeros(d + 1)
    for _ in range(20_000):
        v -= 0.002 * (v - 2 * x1.T @ (cost * y * np.maximum(1 - y * (x1 @ v), 0)))
    assert loss(np.append(w, bias)) == pytest.approx(loss(v), rel=1e-3)


def test_samples_are_bounded(spark):
    """Repeated ids and labels count once, and the sizes taken together stay within their bound; one class alone is learned as its share."""
    docs = spark.createDataFrame([(i % 40, f"text {i % 40} of {'words ' * (i % 7)}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 40, int(i % 40 < 20)) for i in range(120)], "doc_id long, y int")
    got, share = sample.labelled_sample(docs, labels, "doc_id", "y", 15)
    assert sorted(r["count"] for r in got.groupBy("label").count().collect()) == [15, 15] and got.select("doc_id").distinct().count() == 30 and share == 0.5
    sized = got.select("order", "label", F.split("text", " ").alias("w"))
    sizes = [n for _, _, n in sorted(map(tuple, sized.select("order", "label", F.size("w")).collect()))]
    left = sample.within(sized, "w", 60).collect()
    assert len(left) == sum(np.cumsum(sizes) <= 60) and sample.within(sized, "w", 0).count() == 0
    ones = labels.filter("y = 1")
    assert textcnn.score_toxicity(docs.withColumn("lang", F.lit("en")), textcnn.fit_toxicity(docs.withColumn("lang", F.lit("en")), ones, label_col="y")).filter("rejected").count() == 0
    assert nbsvm.score_quality(docs, nbsvm.fit_quality(docs, ones, label_col="y")).agg(F.min("score")).first()[0] > 0.99


def test_classifiers_on_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert textcnn.score_toxicity(df, textcnn.fit_toxicity(df, none)).count() == 0 and nbsvm.score_quality(df, nbsvm.fit_quality(df, none)).count() == 0


def test_held_out_folds(spark):
    for name, folds, one in (("op3_toxicity_cnn", 4, 2), ("op6_quality_nbsvm", 5, 0), ("op2_ppm_score", 7, 2)):
        for r in registry.QUERIES[name](spark, SF).select("doc_id", "held_out").collect():
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == one)


# ------------------------------------------------------------------------------ 5 SentencePiece
TEXTS = ["", " ", "  a  b", "\n\n", "Hello wörld 12.5e-7", "日本語 🎉é", "▁▁a▁b", "a" * 300, "def f(x):\n    return x+1", "ＡＢＣ \x00\x7f", "Released under the MIT License.\nOrined eringo"]


def test_encoding_is_the_library_s():
    sentencepiece = pytest.importorskip("sentencepiece")
    v = pieces.load()
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("abcdeth ino\n.,é") for _ in range(rng.randint(1, 200))) for _ in range(200)]
    coder = pieces.Encoder(v, limit=500)
    for _, _, raw, off in pieces.blocks(pa.array(texts), 2000):
        ids, first = coder.encode(raw, off)
        for k in range(len(off) - 1):
            text = raw[off[k] : off[k + 1]].tobytes().decode()
            assert ids[first[k] : first[k + 1]].tolist() == sp.encode(text)


def test_decoding(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None)]
    e = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), verify=True)
    assert e.filter("not round_trip").count() == 0
    got = {r.doc_id: r.text for r in pieces.decode(e).collect()}
    assert got == {i: (t or "").replace("▁", " ") for i, t in rows}
    assert pieces.encode(odd(spark), verify=True).filter("round_trip").count() == len(ODD)


def test_unigram_viterbi_is_best():
    names = [b"<unk>", *[bytes([c]) for c in b"abc "], b"ab", b"bc", b"abc", b"ca", b" a"]
    scores = np.array([0, -3, -3, -3, -2, -2.5, -4, -5.5, -2.2, -4.9])
    v = pieces.Vocabulary(names, scores, np.array([2] + [1] * 9), False, False)
    value = {p: s for p, s in zip(names[1:], scores[1:], strict=True)}

    def best(t):
        b = [0.0] + [-1e9] * len(t)
        for e in range(1, len(t) + 1):
            b[e] = max(b[s] + value[t[s:e]] for s in range(e) if t[s:e] in value)
        return b[-1]

    rng = random.Random(1)
    for size in (1, 5, 12):
        grid = np.array([[rng.choice(list(b"abc ")) for _ in range(size)] for _ in range(30)], np.uint8)
        ids, n = v.viterbi(grid)
        at = np.concatenate([[0], np.cumsum(n)])
        for k, row in enumerate(grid):
            own = ids[at[k] : at[k + 1]]
            assert b"".join(names[i] for i in own) == row.tobytes() and scores[own].sum() == pytest.approx(best(row.tobytes()))


# ------------------------------------------------------------------------------------ 8 Jaccard
def shingle_set(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("block", [2000, 7])
def test_jaccard(spark, block):
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(90)] for _ in range(4)]
    texts = []
    for b in base:
        for _ in range(25):
            w = list(b)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "new"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)) + [(500, None), (501, ""), (502, texts[0])], "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard.near_classes(docs, block=block).collect()}
    sets = {i: shingle_set(t) for i, t in [*enumerate(texts), (500, None), (501, ""), (502, texts[0])]}
    links = {i: {j for j, q in sets.items() if j != i and s and q and len(s & q) / len(s | q) >= 0.8} for i, s in sets.items()}
    root = {}
    for i in sorted(sets):
        if i not in root:
            stack, seen = [i], {i}
            while stack:
                for j in links[stack.pop()] - seen:
                    seen.add(j)
                    stack.append(j)
            root |= dict.fromkeys(seen, i)
    for i in sets:
        assert (got[i].class_id, got[i].n_links, got[i].n_text_links) == (root[i], len(links[i]), len({sets[j] for j in links[i]} - {sets[i]}))
    assert got[500].n_links == got[501].n_links == 0


def test_jaccard_odd(spark):
    assert jaccard.near_classes(odd(spark)).count() == len(ODD) and jaccard.near_classes(odd(spark).filter("false")).count() == 0
    clash = odd(spark).select("doc_id", "text", *[F.lit(1).alias(c) for c in ("__drop", "drop", "c0", "marked", "bits")])
    assert jaccard.keep_one(clash).columns == clash.columns and sorted(r.doc_id or 0 for r in jaccard.keep_one(clash).collect()) == [1, 2, 3, 4, 7, 8]


def test_jaccard_recall_on_documents(spark):
    """Every link of the supplied documents, found by comparing all pairs that share a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingle_set(r.text) for r in docs.select("doc_id", "text").collect()}
    by = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    common_ = collections.Counter(p for ids in by.values() for p in itertools.combinations(sorted(ids), 2))
    links = collections.Counter(x for (a, b), n in common_.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) for x in (a, b))
    got = {r.doc_id: r.n_links for r in jaccard.near_classes(docs).collect()}
    assert sum(links.values()) > 100 and {i: n for i, n in got.items() if n} == dict(links)


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components_module, "LEAST", 3)
    monkeypatch.setattr(components_module, "HOT", 8)
    monkeypatch.setattr(components_module, "FOREST", 5)  # so that much is left to the rounds
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    rng = random.Random(9)
    e = [(0, i) for i in range(1, 200)] + [(500, i) for i in range(300, 500)] + [(rng.randint(600, 700), rng.randint(600, 700)) for _ in range(60)] + [(199, 300)]
    root = {x: x for p in e for x in p}
    for _ in range(300):
        for a, b in e:
            root[a] = root[b] = min(root[a], root[b])
    lone = {a for a, b in e if a == b} - {x for a, b in e if a != b for x in (a, b)}
    assert {r.node: r.root for r in components(spark.createDataFrame(e, "a long, b long")).collect()} == {k: v for k, v in root.items() if k not in lone}
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame(e, "a long, b long"), rounds=1)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 90), (95, 90), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(e).collect()}
    assert got == dict.fromkeys(range(31), 0) | {100: 90, 95: 90, 90: 90}


# -------------------------------------------------------------------------------------- 9 tiling
def plain_tiles(doc, item, size):
    """Greedy string tiling by trying all pairs of positions."""
    a, b, out = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not a[d + n] and not b[i + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        if best[0] < size:
            return out
        n, i, d = best
        a[d : d + n] = [True] * n
        b[i : i + n] = [True] * n
        out += n


def test_tiling(spark):
    rng = random.Random(6)
    item = [f"t{i}" for i in range(30)]
    docs, items = [], [(1, " ".join(item)), (2, "one two"), (3, ""), (4, None), (5, "Z " * 12)]
    for i in range(40):
        cut = rng.sample(range(0, 30, 6), rng.randint(0, 5))
        w = [x for c in cut for x in [*item[c : c + 6], "gap"]] + [rng.choice("pqz") for _ in range(rng.randint(0, 20))]
        docs.append((i, " ".join(w)))
    docs += [(100, "say ONE, two!"), (101, None), (102, "")]
    got = {(r.doc_id, r.item_id): r.tiled_words for r in tiling.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in docs[:40]:
        n = plain_tiles(t.split(), item, 5)
        assert got.get((i, 1)) == (n if n >= 15 else None)
    assert got[(100, 2)] == 2 and not any(k[1] in (3, 4) for k in got)
    many = tiling.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=10)
    assert {(r.doc_id, r.item_id): r.tiled_words for r in many.collect()} == got


def hashed(*texts):
    return tiling.tokens(*tiling.utf8(pa.array([" ".join(t) for t in texts])))


@given(st.data())
@settings(max_examples=150, deadline=None)
def test_tiling_repetitive(data):
    """Texts over one to three words, where almost all windows are equal."""
    word = st.sampled_from("abc"[: data.draw(st.integers(1, 3))])
    items = data.draw(st.lists(st.lists(word, min_size=1, max_size=14), min_size=1, max_size=4))
    docs = data.draw(st.lists(st.lists(word, max_size=40), min_size=1, max_size=4))
    h, first = hashed(*items)
    seeds = tiling.Seeds([h[a:b] for a, b in zip(first[:-1], first[1:])], 3)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(tiling, "SLICE", data.draw(st.sampled_from([1, 10, 1 << 20])))
        got = {(r, k): t for r, k, t in seeds.leaks(*hashed(*docs), 0.5)}
    for r, doc in enumerate(docs):
        for k, item in enumerate(items):
            n = plain_tiles(doc, item, min(3, len(item)))
            tiles = got.get((r, k), [])
            assert sum(t[0] for t in tiles) == (n if n >= 0.5 * len(item) else 0)
            assert all(item[i : i + n] == doc[d : d + n] for n, i, d in tiles)


def test_tiling_of_equal_words_in_bounded_memory():
    """500,000 equal words against 500 of them: 10^8 pairs of equal windows, none of which are listed."""
    h, first = hashed(["z"] * 500, ["z"] * 40 + ["y"] * 20)
    seeds = tiling.Seeds([h[a:b] for a, b in zip(first[:-1], first[1:])], 5)
    docs = hashed(["z"] * 500_000, ["x"] * 10)
    tracemalloc.start()
    got = list(seeds.leaks(*docs, 0.5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(0, 0, [(500, 0, 0)]), (0, 1, [(40, 0, 0)])] and peak < 400 << 20


def test_clean_keeps_columns(spark):
    item = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(1, item), (None, "x " + item.upper()), (3, None), (3, "other words"), (4, "")], "doc_id long, text string")
    docs = docs.select("doc_id", "text", F.lit(1).alias("__bad"), F.lit("a").alias("t"), F.array(F.struct(F.lit(1.5).alias("c0"))).alias("c0"), F.current_timestamp().alias("item"))
    items = spark.createDataFrame([(1, item), (2, None), (3, item), (4, " ".join(["q"] * 20))], "item_id long, text string")
    for words in (500_000, 25):
        left = tiling.clean(docs, items, block_words=words)
        assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 3, 4] and left.first()["c0"][0]["c0"] == 1.5
    assert tiling.leaks(docs, items.filter("false")).count() == 0 and tiling.clean(docs, items.filter("false")).count() == 5 and tiling.clean(docs.filter("false"), items).count() == 0


# ----------------------------------------------------------------------------------------- 1 PII
def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10


def feistel(text, kind, key="tidemark"):
    """The string network, with hashlib."""
    def move(x, seed):
        out = ""
        for i, c in enumerate(x):
            k = int(hashlib.sha256(f"{seed}|{i // 16}".encode()).hexdigest()[(i % 16) * 4 : (i % 16) * 4 + 4], 16)
            for a, n in (("0", 10), ("a", 26), ("A", 26)):
                if ord(a) <= ord(c) < ord(a) + n:
                    c = chr(ord(a) + (ord(c) - ord(a) + k) % n)
                    break
            out += c
        return out

    a, b = text[: len(text) // 2], text[len(text) // 2 :]
    for r in range(1, 9):
        if r % 2:
            a = move(a, f"{key}|{kind}|{r}|{b}")
        else:
            b = move(b, f"{key}|{kind}|{r}|{a}")
    return a + b


def test_pii(spark):
    t = "a.b41@m.example.com 4946394592613935 4946-3945-9261-3935 bad 4946394592613936 +1 (255) 555-8013 (255) 555-8013 70.135.141.49 300.1.1.1 2024-02-29 2023-02-30 123-45-6789 666-45-6789 DE89370400440532013000 DE88370400440532013000"
    docs = spark.createDataFrame([(1, t), (2, "see 4946394592613935 " * 2), (3, None), (4, ""), (5, "plain 12 words @ 3.5")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pseudonymise(docs).collect()}
    w = rows[1].text.split()
    assert len(w) == len(t.split())
    card = "4" + feistel("94639459261393", "card")
    assert w[1][:-1] == card and luhn(w[1]) == 0 and w[2].replace("-", "") == w[1] and w[4] == "4946394592613936" and w[0] == feistel("a.b41", "email") + "@m.example.com"
    phone = feistel("2555558013", "phone")
    assert "".join(re.findall(r"\d", "".join(w[5:8]))) == "1" + phone and "".join(re.findall(r"\d", "".join(w[8:10]))) == phone
    assert all(int(x) < 256 for x in w[10].split(".")) and w[10] != "70.135.141.49" and w[11] == "300.1.1.1" and re.fullmatch(r"\d{4}-\d\d-\d\d", w[12]) and w[12] != "2024-02-29" and w[13] == "2023-02-30"
    assert re.fullmatch(r"\d{3}-\d\d-\d{4}", w[14]) and w[14] != "123-45-6789" and w[15] == "666-45-6789" and w[17] == "DE88370400440532013000"
    iban = w[16][4:] + w[16][:4]
    assert int("".join(str(int(c, 36)) for c in iban)) % 97 == 1 and w[16] != "DE89370400440532013000"
    assert rows[2].text == f"see {w[1]} " * 2 and rows[3].text == rows[4].text == "" and rows[5].text == "plain 12 words @ 3.5"
    assert (rows[1].n_email, rows[1].n_card, rows[1].n_phone, rows[1].n_ip, rows[1].n_date, rows[1].n_ssn, rows[1].n_iban) == (1, 2, 2, 1, 1, 1, 1)


def replaced(spark, texts):
    """For each text the kinds replaced, and the text with # for every replaced character."""
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert all(len(r.text) == len(t) or r.n_ip for r, t in zip(rows, texts))
    return [(r.text, {k: r[f"n_{k}"] for k in pii.KINDS if r[f"n_{k}"]}) for r in rows]


def test_pii_values_beside_signs(spark):
    cases = {
        "1.2.3.4:8080": {"ip": 1}, "1.2.3.4,5.6.7.8": {"ip": 2}, "10.1.2.3/24": {"ip": 1}, "10.0.0.1-10.0.0.9": {"ip": 2},
        "4111111111111111,5500000000000004": {"card": 2}, "4111111111111111:123": {"card": 1}, "4111111111111111/12/25": {"card": 1},
        "123-45-6789,787-65-4321": {"ssn": 2}, "2024-01-02T10:00:00Z": {"date": 1}, "2024-01-02/2024-02-03": {"date": 2}, "01/02/2024:10:00:00": {"date": 1},
        "12:00:00,2024-01-02": {"date": 1}, "DE89370400440532013000,DE89370400440532013000": {"iban": 2}, "(255) 555-8013,(255) 555-8013": {"phone": 2},
        "5,ann@x.org": {"email": 1}, "4111 1111 1111 1111 01/02/2024": {"card": 1, "date": 1},
        "1.2.3.4.5": {}, "0.4111111111111111": {}, "1-2024-01-02": {}, "2024-01-02-5": {}, "2024-01-02Tail": {}, "4111111111111111T10": {},
    }
    got = replaced(spark, list(cases))
    assert {t: n for t, (_, n) in zip(cases, got)} == cases
    assert all((new == t) == (not n) for t, (new, n) in zip(cases, got))
    assert got[0][0].endswith(":8080") and got[8][0].endswith("T10:00:00Z") and got[2][0].endswith("/24")


def test_pii_values_beside_other_numbers(spark):
    card, phone, iban = "4111 1111 1111 1111", "+1 (743) 555-3824", "BE68 5390 0754 7034"
    new_card, new_phone, new_iban = (x for x, _ in replaced(spark, [card, phone, iban]))
    assert card != new_card and phone != new_phone and iban != new_iban
    C, P, I = {"card": 1}, {"phone": 1}, {"iban": 1}  # noqa: E741
    cases = {
        "{c} 123": C, "7 {c}": C, "7 8 {c} 12 9": C, "1234567 8901234 {c}": C, "12:30 {c} 12:30": C, "{c} 12/25": C, "{c} 1x": C, "{c} {c}": {"card": 2}, "12 " * 9000 + "{c}" + " 12" * 9000: C,
        "{i} EUR": I, "{i} 123 4": I, "{i} {c}": {"iban": 1, "card": 1}, "{p} 12": P, "{p} {c}": {"phone": 1, "card": 1}, "{c} {p}": {"phone": 1, "card": 1},
    }
    got = replaced(spark, [t.format(c=card, p=phone, i=iban) for t in cases])
    assert got == [(t.format(c=new_card, p=new_phone, i=new_iban), n) for t, n in cases.items()]
    mixed = {"+49 30 123456 4111 1111 1111 1111": {"phone": 1, "card": 1}, "2024 123-45-6789": {"ssn": 1}, "4111-1111-1111-1111-123": C, "3782 822463 10005 1234": C, "+44 20 7946 0958 12": P, "4111 1111 1111 1112 123": {}}
    got = replaced(spark, list(mixed))
    assert [n for _, n in got] == list(mixed.values()) and got[4][0].endswith(" 12") and got[3][0].endswith(" 1234")


def halves(n):
    low = max(k for k in range(1, int(n**0.5) + 1) if n % k == 0)
    return low, n // low


def feistel_number(x, left, right, kind, key="tidemark"):
    """The number network, with hashlib."""
    a, b = divmod(x, right)
    for r in range(1, 9):
        h = int(hashlib.sha256(f"{key}|{kind}|{r}|{b if r % 2 else a}".encode()).hexdigest()[:14], 16)
        a, b = ((a + h) % left, b) if r % 2 else (a, (b + h) % right)
    return a * right + b


def plain_date(text):
    """The pseudonym of a date by listing all dates of its class."""
    sep = re.search("[-/.]", text)[0]
    x = text.split(sep)
    order = "ymd" if len(x[0]) == 4 else "dmy" if int(x[0]) > 12 else "mdy"
    v = dict(zip(order, map(int, x), strict=True))
    long_ = all(len(p) > 1 for p in x)
    if long_:
        fits = lambda m, d: (d > 12) == (v["d"] > 12)
    elif order == "dmy":
        fits = lambda m, d: m < 10 and d > 12
    else:
        fits = lambda m, d: (m < 10) == (v["m"] < 10) and (d < 10) == (v["d"] < 10)
    days = [(m, d) for m in range(1, 13) for d in range(1, 32) if d <= calendar.monthrange(2001, m)[1] and fits(m, d)]
    all_ = [(y, m, d) for m, d in days for y in range(1800, 2200)] + [(y, 2, 29) for y in range(1800, 2200) if calendar.isleap(y) and fits(2, 29)]
    y, m, d = all_[feistel_number(all_.index((v["y"], v["m"], v["d"])), *halves(len(all_)), "date")]
    new = {"y": str(y), "m": str(m), "d": str(d)}
    return sep.join(new[o].zfill(len(p)) for o, p in zip(order, x, strict=True))


def test_pii_each_kind_by_brute_force(spark):
    ip = lambda t: ".".join(str(n >> s & 255) for n in [feistel_number(sum(int(o) << s for o, s in zip(t.split("."), (24, 16, 8, 0))), 65536, 65536, "ip")] for s in (24, 16, 8, 0))

    def ssn(t):
        a, g, n = map(int, t.split("-"))
        x = feistel_number(((a - (2 if a > 666 else 1)) * 99 + g - 1) * 9999 + n - 1, 898 * 99, 9999, "ssn")
        a = x // 989901
        return f"{a + (2 if a + 1 >= 666 else 1):03}-{x // 9999 % 99 + 1:02}-{x % 9999 + 1:04}"

    def email(t):
        local, domain = t.split("@")
        return "".join(n.upper() if o.isupper() else n for n, o in zip(feistel(local.lower(), "email"), local)) + "@" + domain

    def card(t):
        body = t[0] + feistel(t[1:-1], "card")
        return body + next(c for c in "0123456789" if luhn(body + c) == 0)

    def iban(t):
        body = feistel(t[4:], "iban")
        return t[:2] + f"{98 - int(''.join(str(int(c, 36)) for c in body + t[:2] + '00')) % 97:02}" + body

    def phone(t):
        code, rest = t.split(" ", 1)
        new = iter(feistel(re.sub(r"\D", "", rest), "phone"))
        return code + " " + "".join(next(new) if c.isdigit() else c for c in rest)

    cases = {
        ip: ["0.0.0.0", "255.255.255.255", "192.168.1.77"], ssn: ["001-01-0001", "899-99-9999", "665-12-3456", "667-12-3456"],
        email: ["ann.Lee+x@Ex.org", "A1@b.co", "z@q.de"], card: ["4111111111111111", "378282246310005"], iban: ["DE89370400440532013000", "NO9386011117947"],
        phone: ["+49 30 1234567", "+352 621 12345", "+7 912 345-67-89"],
        plain_date: ["2024-02-29", "1800-01-01", "2199-12-31", "31/12/2024", "12/31/2024", "03.04.1999", "3/4/2024", "11/4/2024", "3/14/2024", "30/1/2024", "2/29/2024", "29.2.2000", "03/4/2024", "3/04/2024"],
    }
    flat = [(f, t) for f, ts in cases.items() for t in ts]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(flat)], "doc_id long, text string")
    new = pii.pseudonymise(docs)
    got = [r.text for r in new.orderBy("doc_id").collect()]
    assert got == [f(t) for f, t in flat] and all(a != b and len(a) == len(b) for a, b, (f, _) in zip(got, (t for _, t in flat), flat, strict=True) if f is not ip)
    assert [r.text for r in pii.pseudonymise(new, undo=True).orderBy("doc_id").collect()] == [t for _, t in flat]
    again = [r.text for r in pii.pseudonymise(docs, key="other").orderBy("doc_id").collect()]
    assert sum(a == b for a, b in zip(again, got)) == 0


def test_pii_spellings_are_linked(spark):
    same = [
        ["+49 30 1234567", "+49301234567", "+49-30-123-4567", "+49 (0)30 1234567"], ["+1 (255) 555-8013", "+12555558013", "255-555-8013", "(255) 555-8013"], ["+352 621 12345", "+35262112345"],
        ["Ann.Lee@x.org", "ann.lee@x.org", "ANN.LEE@X.org"], ["4111 1111 1111 1111", "4111111111111111"], ["2024-01-31", "31/01/2024", "01/31/2024", "31.01.2024"],
    ]
    got = replaced(spark, [t for g in same for t in g])
    assert all(sum(n.values()) == 1 for _, n in got)
    value = lambda t: "-".join(sorted(re.findall(r"\d+", t))) if re.fullmatch(r"[\d./]+|\d{4}-.*", t) and len(t) == 10 else re.sub(r"\(0\)|[^a-z0-9@]", "", t.lower())
    at = 0
    for g in same:
        new = [value(t) for t, _ in got[at : at + len(g)]]
        at += len(g)
        assert len({x[-9:] for x in new}) == 1 and len({x[-10:] for x in new}) == 1 if g[0].startswith("+1") else len(set(new)) == 1


@pytest.mark.parametrize(("layout", "days"), [("yyyy-MM-dd", 10_000), ("dd/MM/yyyy", 60_000), ("MM/dd/yyyy", 10_000), ("d.M.yyyy", 20_000)])
def test_pii_dates_are_permuted(spark, layout, days):
    d = spark.range(0, days).select(F.col("id").alias("doc_id"), F.date_format(F.date_add(F.lit("1850-01-01").cast("date"), F.col("id").cast("int")), layout).alias("text"))
    d = d.dropDuplicates(["text"]).cache()
    new = pii.pseudonymise(d)
    n, kinds, lengths = new.join(d.withColumnRenamed("text", "old"), "doc_id").agg(F.countDistinct("text"), F.sum("n_date"), F.sum(F.abs(F.length("text") - F.length("old")))).first()
    assert (n, kinds, lengths) == (days, days, 0)
    assert pii.pseudonymise(new, undo=True).join(d, ["doc_id", "text"]).count() == days


def test_pii_odd(spark):
    assert pii.pseudonymise(odd(spark)).count() == len(ODD) and pii.pseudonymise(odd(spark).filter("false")).count() == 0


# ------------------------------------------------------------------------------------- pipeline
def test_pipeline(spark):
    """Every stage against a plain version over what its predecessor kept."""
    sentencepiece = pytest.importorskip("sentencepiece")
    first = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in first.collect()}
    docs, kept = first, []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), name)
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert docs.count() == len(kept[-1])
        if name != "tokenize":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(rows[r.doc_id] == r for r in docs.collect())
    model = textcnn.fit_toxicity(first, spark.read.parquet(f"{SF}/labels.parquet"))
    score = {i: 1 / (1 + math.exp(-plain_logit(model, r.text or ""))) for i, r in rows.items()}
    limit = {i: model.thresholds.get(r.lang, model.threshold) for i, r in rows.items()}
    close = {i for i in rows if abs(score[i] - limit[i]) < 1e-4}
    assert kept[0] - close == {i for i in rows if score[i] < limit[i]} - close
    owner = {}
    for i in kept[0]:
        t = lower(rows[i].text)
        owner[t] = max(i, owner.get(t, i))
    assert kept[1] == set(owner.values())
    sets = {i: shingle_set(rows[i].text) for i in sorted(kept[1])}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert kept[2] == {i for i, r in root.items() if i == r}
    items = [WORDS.findall((r.text or "").lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaked(words):
        for item in items:
            size = min(5, len(item))
            grams = {tuple(item[k : k + size]) for k in range(len(item) - size + 1)}
            if item and any(tuple(words[k : k + size]) in grams for k in range(len(words) - size + 1)) and plain_tiles(words, item, size) >= 0.5 * len(item):
                return True
        return False

    assert kept[3] == {i for i in kept[2] if not leaked(WORDS.findall((rows[i].text or "").lower()))}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = {r.doc_id: (list(r.ids), r.n_tokens) for r in docs.collect()}
    assert got == {i: (sp.encode(rows[i].text or ""), len(sp.encode(rows[i].text or ""))) for i in kept[3]}


def test_stages_odd(spark):
    o = odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        if name == "toxicity":
            assert stage(spark, o.filter("false"), SF).count() == 0
        else:
            assert stage(spark, o, SF).count() <= len(ODD) and stage(spark, o.filter("false"), SF).count() == 0
    assert corpus_pipeline.toxicity(spark, o, SF).columns == o.columns


def test_toxicity_is_learned_from_all_labelled_rows(spark, monkeypatch):
    """More than 3,000 rows of a class, of which only the last by the hash order say what a word means; long texts count, too."""
    toxic, n = F.col("doc_id") % 2 == 0, F.row_number().over(Window.partitionBy(F.col("doc_id") % 2).orderBy(F.xxhash64(F.col("doc_id").cast("string"))))
    late = F.concat(F.lit("late words here"), F.when(F.col("doc_id") % 400 == 0, F.repeat(F.lit(" here"), 21_000)).otherwise(""))
    text = F.when(~toxic, "plain words here").when(F.col("n") > 3000, late).otherwise("early words here")
    df = spark.range(8000).withColumnRenamed("id", "doc_id").withColumn("n", n).select("doc_id", F.lit("en").alias("lang"), text.alias("text"), toxic.cast("int").alias("toxic"))
    monkeypatch.setattr(textcnn, "SHARD_ROWS", 2000)
    docs = df.repartition(3).cache()
    models = [textcnn.fit_toxicity(d, docs.select("doc_id", "toxic")) for d in (docs, docs.repartition(5, "text"))]
    asked = spark.createDataFrame([(0, "late", "en"), (1, "early", "en"), (2, "plain", "en")], "doc_id long, text string, lang string")
    late, early, other = [r.score for r in textcnn.score_toxicity(asked, models[0]).orderBy("doc_id").collect()]
    assert late > 0.5 and early > 0.5 and other < 0.5
    sums = textcnn.Sums(models[0])
    assert np.array_equal(*[m.state(sums) for m in models]) and models[0].thresholds == models[1].thresholds
