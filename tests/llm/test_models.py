"""Classifiers, rules and the language model."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import lm_scoring, quality_cnn, quality_rules, queries, toxicity
from gridloom.llm.labelled import training_rows

from . import brute

SF = "/root/testdata/sf0.01"
ODD = [(900001, None), (900002, ""), (900003, "\n \t"), (900004, "x" * 300_000), (900005, "a b " * 60_000), (None, "no id")]


def _tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame(ODD, "doc_id long, text string")).withColumn("score", F.lit("clash")).withColumn("held_out", F.lit(1)).withColumn("t_", F.lit(2))
    return docs, spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize(("run", "label", "least"), [(toxicity.score_toxicity, "toxic", 0.95), (quality_cnn.score_quality, "quality", 0.93)])
def test_held_out_accuracy(spark, run, label, least):
    docs, labels = _tables(spark)
    got = run(docs, labels).toPandas()
    assert len(got) == docs.count()
    assert got["score"].between(0, 1).all()
    truth = labels.toPandas().merge(got[got["held_out"]], on="doc_id")
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in truth["doc_id"])
    assert (truth["predicted"] == truth[label]).mean() >= least


def test_models_without_labels(spark):
    docs, labels = _tables(spark)
    some, none = docs.limit(5), labels.limit(0)
    assert {r.predicted for r in toxicity.score_toxicity(some, none).collect()} == {0}
    assert {r.predicted for r in quality_cnn.score_quality(some, none).collect()} == {1}
    assert toxicity.score_toxicity(docs.limit(0), none).collect() == []
    assert toxicity.drop_toxic(some, none).count() == 5
    assert quality_cnn.keep_quality(some, none).columns == docs.columns


def test_the_network_learns_what_no_table_of_words_can_tell():
    """A text is toxic where "grum" comes without "not" right before it; both words are in texts of either kind."""
    r = np.random.default_rng(5)

    def text(toxic: bool) -> str:
        words = [f"w{i}" for i in r.integers(0, 60, 20)]
        k = int(r.integers(2, 18))
        words[k - 1 : k + 1] = ["grum", "not"] if toxic else ["not", "grum"]
        return " ".join(words)

    labels = np.arange(600) % 2
    texts = [text(bool(y)) for y in labels]
    model = toxicity.learn(list(zip(texts[:500], labels[:500].tolist(), strict=True)))
    right = ((toxicity.score_texts(model, pa.array(texts[500:])) >= 0.5) == labels[500:]).mean()
    words = [set(t.split()) for t in texts]
    seen = {w: [sum(w in x for x, y in zip(words[:500], labels[:500], strict=True) if y == k) + 0.5 for k in (0, 1)] for w in set().union(*words)}
    odds = np.array([max(math.log(seen[w][1] / seen[w][0]) for w in x) for x in words])
    best = max(((odds[500:] >= t) == labels[500:]).mean() for t in np.unique(odds))
    assert right >= 0.95 > best + 0.2
    # The vectors of words and characters are what it reads: without them it does no better.
    blank = toxicity.Network()
    blank.p = dict(model[0].p) | {k: 0 * model[0].p[k] for k in "ec"}
    assert ((toxicity.score_texts((blank, model[1]), pa.array(texts[500:])) >= 0.5) == labels[500:]).mean() < right - 0.2


def test_gradients_of_the_vectors():
    r = np.random.default_rng(3)
    net = toxicity.Network(2)
    bucket = np.array([0, 9 << toxicity.SHIFT, 5 << toxicity.SHIFT])
    letters = (np.array([1, 2, 3, 1, 7]) << toxicity.SHIFT, np.array([0, 2, 2, 5]))
    word = np.array([2, 0, 2, 1])
    d = r.normal(size=(4, 2 * toxicity.WIDE)).astype(np.float32)
    grads = net.vector_gradients(d, word, bucket, letters)

    def told() -> float:
        x = net.inputs(np.zeros((3, toxicity.ODDS), np.float32), bucket, letters)[word][:, toxicity.ODDS :]
        return float((x * d).sum())

    for name, at in (("e", (5, 1)), ("e", (0, 0)), ("c", (1, 2)), ("c", (7, 0)), ("c", (3, 3)), ("e", (44, 0))):
        before = told()
        net.p[name][at] += 0.5
        assert grads[name][at] == pytest.approx((told() - before) / 0.5, rel=1e-3, abs=1e-4)
        net.p[name][at] -= 0.5


def test_training_rows_are_bounded_and_not_held_out(spark):
    docs, labels = _tables(spark)
    rows = training_rows(docs, labels.unionByName(labels), "quality", most_per_class=20)
    assert collections.Counter(y for _, y in rows) == {0: 20, 1: 20}
    few = training_rows(docs, labels, "quality", most_bytes=20_000)
    assert len(few) > 2 and all(sum(len(t.encode()) for t, own in few if own == y) <= 20_000 for y in (0, 1))


def test_gradients_of_the_recurrent_network():
    r = np.random.default_rng(0)
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = r.normal(size=(3, toxicity.WINDOW, toxicity.INPUTS))
    inside = np.arange(toxicity.WINDOW)[None, :] < np.array([[32], [5], [1]])
    x[~inside] = 0
    y = np.array([1.0, 0.0, 1.0])

    def loss() -> float:
        flat = np.concatenate([x.reshape(-1, toxicity.INPUTS), np.zeros((1, toxicity.INPUTS))])
        token = np.arange(3 * toxicity.WINDOW).reshape(3, -1)
        logit = net._pool(net._read(flat @ net.p["w"], token, inside, None), inside)[0]
        return float(np.mean(np.log1p(np.exp(logit)) - y * logit))

    grads, dx = net.gradients(x.astype(np.float32), inside, y.astype(np.float32))
    for name in "wuvo":
        at = tuple(r.integers(0, n) for n in net.p[name].shape)
        step = 1e-3
        net.p[name][at] += step
        up = loss()
        net.p[name][at] -= 2 * step
        down = loss()
        net.p[name][at] += step
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=1e-3)


def test_windows_cover_all_tokens_and_overlap():
    offsets = np.array([0, 0, 1, 32, 33, 100, 1000])
    first, size, text = toxicity.windows(offsets)
    for d in range(6):
        seen = {t for a, n, k in zip(first, size, text, strict=True) if k == d for t in range(a, a + n)}
        assert seen == set(range(offsets[d], offsets[d + 1]))
    assert (size <= toxicity.WINDOW).all()
    assert (np.diff(first)[np.diff(text) == 0] == toxicity.HOP).all()


def plain_toxicity(model, text: str) -> float:
    """Word by word and window by window, in plain loops."""
    net, tables = model
    words = re.findall(rb"[0-9a-z\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()))
    read = []
    for w in words:
        one = toxicity.Words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))
        read.append(net.inputs(one.odds(tables), one.bucket, one.letters())[0].astype(float))
    h, best = toxicity.HIDDEN, -math.inf
    sig = lambda x: 1 / (1 + np.exp(-x))
    start = 0
    while True:
        window = read[start : start + toxicity.WINDOW]
        states = []
        for d, order in ((0, window), (1, window[::-1])):
            now, own = np.zeros(h), []
            for x in order:
                a, u = x @ net.p["w"][d], now @ net.p["u"][d]
                z, r = sig(a[:h] + u[:h]), sig(a[h : 2 * h] + u[h : 2 * h])
                now = z * now + (1 - z) * np.tanh(a[2 * h :] + r * u[2 * h :])
                own.append(now)
            states.append(own if d == 0 else own[::-1])
        both = [np.concatenate(x) for x in zip(*states, strict=True)]
        weight = np.exp([x @ net.p["v"] for x in both])
        pooled = sum((w * x for w, x in zip(weight / weight.sum(), both, strict=True)), np.zeros(2 * h)) if both else np.zeros(2 * h)
        best = max(best, pooled @ net.p["o"][:-1] + net.p["o"][-1])
        start += toxicity.HOP
        if start + toxicity.WINDOW - toxicity.HOP >= len(read):
            return sig(best)


def plain_quality(net, text: str) -> float:
    raw = text.encode()
    wide, stride, half = quality_cnn.WIDTH, quality_cnn.STRIDE, quality_cnn.HALF
    held = raw + b"\0" * (wide + half)
    halves = []
    for h in range(max(1, -(-len(raw) // half))):
        places = [p for p in range(h * half, (h + 1) * half, stride) if p < len(raw)] or [h * half]
        halves.append(np.max([sum(net.p["t"][j, held[p + j]].astype(float) for j in range(wide)) for p in places], 0))
    chunks = np.array([np.maximum(a, b) for a, b in zip(halves, halves[1:], strict=False)] or halves)
    x = np.concatenate([chunks.mean(0), chunks.max(0), chunks.min(0), [np.log2(1 + min(len(raw), 2 * half))]])
    h = np.tanh(((x - net.mean) / net.scale) @ net.p["a"] + net.p["b"])
    return 1 / (1 + np.exp(-(h @ net.p["o"][:-1] + net.p["o"][-1])))


def test_queries_equal_plain_versions(spark):
    """op1 and op5 over a whole table, against their models evaluated in plain loops on a spread of its rows."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    some = sorted((i for i in texts if len(texts[i]) < 6000), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:25]
    for query, learn, label, plain, least in ((queries.op1_toxicity, toxicity.learn, "toxic", plain_toxicity, 0.5), (queries.op5_quality_cnn, quality_cnn.learn, "quality", plain_quality, 0.3)):
        got = {r.doc_id: r for r in query(spark, sf).collect()}
        assert set(got) == set(texts)
        model = learn(training_rows(docs, labels, label))
        for i in some:
            want = plain(model, texts[i]) if model is not None else got[i].score
            assert got[i].score == pytest.approx(want, rel=1e-3, abs=1e-5)
            assert got[i].predicted == (got[i].score >= least)
            assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_the_chat_query_adds_its_conversation(spark):
    got = {r.conv_id: r for r in queries.op9_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    said = "\\### Assistant: </turn> ok"
    assert got[-7].n_turns == 2
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[-7].loss_chars == len(said)


def test_filters_see_the_end_of_a_text():
    net = quality_cnn.Filters()
    net.p["o"][:] = 1
    plain = np.frombuffer(b"abcdefgh " * 300, np.uint8)
    odd = plain.copy()
    odd[-9:-1] = 255
    net.p["t"][:, 255] = 5
    a = net.score(plain, np.array([0, len(plain)]))
    b = net.score(odd, np.array([0, len(odd)]))
    assert a != b


def test_filters_look_at_every_byte():
    net = quality_cnn.Filters()
    net.p["t"][:] = 0
    net.p["t"][range(8), list(b"MARKED!?"), :] = 1
    for at in range(0, 260):
        text = b"." * at + b"MARKED!?" + b"." * 40
        laid, filled, first = quality_cnn._laid(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert net.halves(laid, filled)[0].max() == 8, at


def test_training_takes_the_same_steps_whatever_the_sample(monkeypatch):
    taken = []
    plain = quality_cnn.Filters.gradients
    monkeypatch.setattr(quality_cnn.Filters, "gradients", lambda self, *a: (taken.append(len(a[-1])), plain(self, *a))[1])
    for n in (2, 7, 700):
        taken.clear()
        quality_cnn.learn([("word " * (1 + i % 3) + ("good" if i % 2 else "bad"), i % 2) for i in range(n)], steps=5)
        assert taken == [quality_cnn.BATCH] * 5


def test_rules_statistics_and_learning(spark):
    docs, labels = _tables(spark)
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    for r in docs.select("doc_id", "text").collect():
        g, want = got[r.doc_id], brute.statistics(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (g.base_failed and g.kept)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    right = [g.kept == bool(truth[i]) for i, g in got.items() if i in truth and not g.base_failed]
    assert sum(right) / len(right) > 0.95
    assert quality_rules.quality_rules(docs.limit(0), labels).collect() == []


def test_rules_are_thresholds_in_order():
    rows = [({k: 0.0 for k in quality_rules.RATIOS} | {"upper_share": u, "n_words": n}, int(u > 0.5 and n > 10)) for u in (0.1, 0.4, 0.6, 0.9) for n in (5.0, 9.0, 20.0, 30.0) for _ in range(6)]
    rules = quality_rules.learn_list(rows)
    assert all(any(quality_rules._covers(r, x) for r in rules) == bool(y) for x, y in rows)


@pytest.mark.parametrize("size", [1, 249, 251, 255, 256, 257, 511, 512, 768])
def test_quality_of_a_text_does_not_depend_on_the_next(size):
    net = quality_cnn.Filters()
    text = ("a quick brown fox " * 60)[:size]
    alone = quality_cnn.score_texts(net, pa.array([text]))[0]
    for other in ("zzzzzzzz" * 40, "\x7f" * 300, "QW"):
        assert quality_cnn.score_texts(net, pa.array([text, other, text]))[[0, 2]].tolist() == pytest.approx([alone, alone], rel=1e-6)


def test_language_model(spark):
    docs, _ = _tables(spark)
    got = lm_scoring.score_documents(docs).collect()
    texts = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in docs.select("doc_id", "text").collect()}
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, ws in texts.items() if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(texts)
    for r in got:
        ws = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_scoring.score_documents(docs.limit(0)).collect() == []


def test_language_model_keeps_rare_words_as_history(spark):
    r = np.random.default_rng(8)
    common = [f"w{i}" for i in (r.zipf(1.3, 6000) % 900)]
    rows = [(i, " ".join(common[i * 20 : i * 20 + int(r.integers(0, 20))])) for i in range(300)]
    # Words and an n-gram far below 1/1,000 of the tokens, in training texts of several blocks.
    rows = [(i, f"{text} zyx wvu tsr" if i in (1, 130, 290) else text) for i, text in rows] + [(None, ""), (400, None), (1000, "zyx wvu tsr zyx wvu")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {g.doc_id: g for g in lm_scoring.score_documents(docs).collect()}
    texts = {i: (text or "").lower().split() + [None] for i, text in rows}
    want = brute.backoff_scores([ws for i, ws in texts.items() if not got[i].held_out], list(texts.values()))
    for i, score in zip(texts, want, strict=True):
        assert got[i].score == pytest.approx(score)
    again = {g.doc_id: g.score for g in lm_scoring.score_documents(docs.coalesce(1)).collect()}
    assert again == pytest.approx({i: g.score for i, g in got.items()})


def test_automaton_walk_and_sums():
    r = np.random.default_rng(5)
    k = 9
    seqs = [[*r.choice([0, 3, 4, 5, 6, 7, 8], size=int(n), p=[0.3, 0.3, 0.15, 0.1, 0.05, 0.05, 0.05]).tolist(), lm_scoring.END] for n in r.integers(0, 30, 60)]
    count = collections.Counter()
    single = np.zeros(k, np.int64)
    for s in seqs:
        padded = [lm_scoring.BEGIN, lm_scoring.BEGIN, *s]
        for i, x in enumerate(s):
            single[x] += 1
            count[2, padded[i + 1] * k + x] += 1
            count[3, (padded[i] * k + padded[i + 1]) * k + x] += 1
    m = lm_scoring.build([(o, key, n) for (o, key), n in count.items() if n >= 2], k, single)
    real = [s for s in range(k) if s != lm_scoring.BEGIN]
    for a in range(k):
        for b in range(k):
            p = 10 ** m.walk(np.full(len(real), a), np.full(len(real), b), np.array(real))
            assert p.sum() == pytest.approx(1.0)
    # One token after the other, carrying the state.
    arcs = dict(zip(m.arcs.tolist(), m.weights.tolist(), strict=True))
    for s in seqs[:20]:
        total, a, b = 0.0, lm_scoring.BEGIN, lm_scoring.BEGIN
        for x in s:
            state = int(m.states(np.array([a]), np.array([b]))[0])
            while state * k + x not in arcs:
                total += m.backoff[state]
                state = int(m.failure[state])
            total += arcs[state * k + x]
            a, b = b, x
        p = lm_scoring._padded(np.array(s[:-1], np.int64), np.array([len(s) - 1]))
        assert m.walk(*p).sum() == pytest.approx(total)
