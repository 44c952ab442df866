"""Mixing, packing, chat formatting and HTML extraction."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import chat, html_mincut, mixing, packing

VOCABULARY = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


# ---------------------------------------------------------------- mixing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.floats(0.01, 50), min_size=1))
def test_every_prefix_is_within_a_block(weights):
    own = mixing.whole_weights(weights, 500)
    slots, total, done = mixing.period(own), sum(own.values()), collections.Counter()
    assert len(slots) == total
    for t, k in enumerate(slots, 1):
        done[k] += 1
        assert all(abs(done[x] * total - own[x] * t) < total for x in own)
    assert done == own


def test_phases_place_every_block_once():
    weights = {"a": 7, "b": 2, "c": 1}
    blocks = {"a": 30, "b": 40, "c": 3}
    taken = []
    for source, lo, hi, start, total, places in mixing.phases(blocks, weights):
        for i, _ in enumerate(range(lo, hi)):
            taken.append((start + i // len(places) * total + places[i % len(places)], source, lo + i))
    assert sorted((s, k) for _, s, k in taken) == sorted((s, k) for s, n in blocks.items() for k in range(n))
    assert [t for t, _, _ in sorted(taken)] == list(range(73))
    # Blocks of a source keep their order; while all last, shares hold.
    done = collections.Counter()
    for t, (_, s, k) in enumerate(sorted(taken), 1):
        assert k == done[s]
        done[s] += 1
        if t <= 30:
            assert all(abs(done[x] - w / 10 * t) < 1 for x, w in weights.items())


def test_mix_keeps_rows_with_nulls_and_clashes(spark):
    rows = [(i, None if i % 11 == 0 else f"s{i % 3}", "x", 5, "y", i) for i in range(300)] + [(None, "s0", "n", 5, "y", 1), (7, "s1", "again", 5, "y", 1), (7, "s1", "again", 5, "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, rank_ string, slot_ int, source_ string, row_ long")
    got = mixing.mix(docs, {"s0": 5, "s1": 1}, block_rows=4)
    assert got.columns == ["doc_id", "source", "rank_", "source_", "row_", "block_", "slot_", "place_"]
    got = got.collect()
    assert len(got) == 303 and sum(r.rank_ == "again" for r in got) == 2
    by_slot = collections.defaultdict(list)
    for r in got:
        by_slot[r.slot_].append(r)
    assert sorted(by_slot) == list(range(len(by_slot)))
    for rs in by_slot.values():
        assert len({(r.source, r.block_) for r in rs}) == 1
        assert sorted(r.place_ for r in rs) == list(range(len(rs)))
    ordered = mixing.mixed_order(docs, block_rows=4)
    assert ordered.columns == docs.columns
    assert sorted(map(str, ordered.collect())) == sorted(map(str, docs.collect()))
    assert mixing.mix(docs.limit(0)).collect() == []
    assert mixing.mixed_order(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s0": 0.0})


def slot_by_slot(blocks):
    """The source of every slot: earliest deadline first among the released blocks, equal weights, one slot after the other; when
    a source is used up the others begin anew."""
    left, out = dict(blocks), []
    while left:
        done, t, n = dict.fromkeys(left, 0), 0, len(left)
        while all(left.values()):
            ready = [(n * (done[k] + 1), k is not None, k or "", k) for k in left if n * done[k] <= t]
            k = min(ready)[3]
            out.append(k)
            done[k] += 1
            left[k] -= 1
            t += 1
        left = {k: x for k, x in left.items() if x}
    return out


def test_the_query_equals_a_schedule_made_slot_by_slot(spark):
    from gridloom.llm import queries

    got = queries.op2_mixing(spark, "/root/testdata/sf0.001").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source").toPandas()
    own = {}
    for i, s in zip(docs["doc_id"], docs["source"], strict=True):
        own.setdefault(s, []).append((hashlib.md5(str(i).encode()).hexdigest(), i))
    slots = slot_by_slot({s: -(-len(x) // 64) for s, x in own.items()})
    want, used = {}, collections.Counter()
    for slot, s in enumerate(slots):
        for place, (_, i) in enumerate(sorted(own[s])[64 * used[s] : 64 * used[s] + 64]):
            want[i] = (used[s], slot, place)
        used[s] += 1
    assert {r.doc_id: (r.block_, r.slot_, r.place_) for r in got.itertuples()} == want


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.sampled_from("abcdé")), st.integers(1, 9), min_size=1))
def test_the_sql_equals_a_schedule_made_slot_by_slot(blocks):
    """Sources that are used up in any order, each with a last block of one row."""
    duckdb = pytest.importorskip("duckdb")
    from gridloom.llm.oracles import OP2_SQL

    names = [s for s, n in blocks.items() for _ in range(64 * (n - 1) + 1)]
    documents = pa.table({"doc_id": pa.array(range(len(names)), pa.int64()), "source": pa.array(names, pa.string())})
    link = duckdb.connect()
    link.register("documents", documents)
    got = link.execute(f"SELECT slot_, source, min(block_), max(block_) FROM ({OP2_SQL}) GROUP BY ALL ORDER BY slot_").fetchall()
    used, want = collections.Counter(), []
    for slot, s in enumerate(slot_by_slot(blocks)):
        want.append((slot, s, used[s], used[s]))
        used[s] += 1
    assert got == want


@pytest.mark.parametrize("weights", [dict.fromkeys([f"s{i}" for i in range(21)], 1.0), {"a": 0.1, "b": 0.2, "c": 0.7}, {"a": 1.0, "b": 1 / 3}, {"a": 3.0, "b": 1e-3 * 7}])
def test_rational_weights_are_exact(weights):
    own = mixing.whole_weights(weights)
    total = sum(weights.values())
    for k, w in weights.items():
        assert own[k] / sum(own.values()) == pytest.approx(w / total, rel=1e-12)
    # The schedule stays within a block of the target however long it is.
    slots = 10_000_000
    parts = mixing.phases(dict.fromkeys(weights, slots), own)
    for source, lo, hi, start, period, places in parts:
        if start == 0:
            run = slots // period * len(places) + sum(p < slots % period for p in places)
            assert abs(run - slots * weights[source] / total) < 1


# ---------------------------------------------------------------- packing


def test_short_pieces_enter_the_program(monkeypatch):
    seen, solve = [], packing.solve_configurations
    monkeypatch.setattr(packing, "solve_configurations", lambda sizes, counts, capacity, rounds: seen.append((counts.sum(), len(sizes) / rounds)) or solve(sizes, counts, capacity, rounds))
    histogram = {length: 5 for length in range(3, 120, 2)}
    plan = packing.plan_packing(histogram, 512)
    assert sum(n * k for contents, times in plan for _, n in contents for k in [times]) == sum(histogram.values())
    assert seen[0][0] == sum(histogram.values()) and seen[0][1] < 0.5


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), min_size=1, max_size=30))
def test_plans_hold_all_pieces(histogram):
    plan = packing.plan_packing(histogram, 64, most_classes=8, rounds=10)
    got = collections.Counter()
    for contents, n in plan:
        assert n > 0
        assert sum(length * k for length, k in contents) <= 64
        for length, k in contents:
            got[length] += k * n
    assert got == histogram
    # No two sequences are half empty: either of them would have held the other's pieces.
    fill = [sum(length * k for length, k in contents) for contents, n in plan for _ in range(n)]
    assert sum(2 * x <= 64 for x in fill) <= 1


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 64), st.integers(1, 300))
def test_one_length_packs_tight(length, n):
    plan = packing.plan_packing({length: n}, 64)
    assert sum(k for _, k in plan) == -(-n // (64 // length))


def fewest(pieces, capacity):
    """By trying every place of every piece."""
    best = len(pieces)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= pieces[i]:
                j = rooms.index(room)
                put(i + 1, [*rooms[:j], room - pieces[i], *rooms[j + 1 :]])
        put(i + 1, [*rooms, capacity - pieces[i]])

    put(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=8))
def test_few_pieces_against_the_optimum(pieces):
    got = sum(n for _, n in packing.plan_packing(collections.Counter(pieces), 64))
    assert got <= fewest(sorted(pieces, reverse=True), 64) + 1


@pytest.mark.parametrize(("low", "high"), [(1100, 2000), (600, 1700), (1, 1500)])
def test_the_program_packs_better_than_best_fit(low, high):
    histogram = collections.Counter(np.random.default_rng(1).integers(low, high, 6000).tolist())
    by_program = sum(n for _, n in packing.plan_packing(histogram, 4096))
    by_best_fit = sum(n for _, n in packing.plan_packing(histogram, 4096, rounds=0))
    assert by_program <= by_best_fit - (50 if low > 1000 else 0)


def test_the_program_places_the_pieces_of_documents(spark, monkeypatch):
    """On the documents' own lengths, many of which one or two pieces have, the sequences are the program's, and are as few as can be."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "text AS text_")
    histogram = {r[0]: r[1] for r in docs.mapInArrow(packing._pieces(VOCABULARY, 4096, 1), packing.PIECES).groupBy("length").count().collect()}
    by_best_fit, place = [], packing.Rooms.place
    monkeypatch.setattr(packing.Rooms, "place", lambda self, length, n: by_best_fit.append(n) or place(self, length, n))
    plan = packing.plan_packing(histogram, 4096)
    assert sum(by_best_fit) <= 0.1 * (sum(histogram.values()) - histogram.get(4096, 0))
    assert sum(n for _, n in plan) == -(-sum(k * n for k, n in histogram.items()) // 4096) == 221


def test_no_class_is_covered_beyond_its_demand():
    r = np.random.default_rng(3)
    for _ in range(20):
        sizes = np.unique(r.integers(3, 300, 12))
        counts = r.integers(1, 40, len(sizes)).astype(float)
        got = sum(amount * n for n, amount in packing.solve_configurations(sizes, counts, 512))
        assert (got <= counts + 1e-6).all() and (got > counts - 1).all()


def test_knapsack_finds_the_best():
    r = np.random.default_rng(2)
    for case in range(30):
        sizes = np.unique(r.integers(3, 20, 5))
        prices = r.random(len(sizes))
        most = None if case < 10 else r.integers(0, 4, len(sizes))
        got = packing.best_configuration(prices, sizes, 30, most)
        bounds = [30 // s if most is None else min(30 // s, int(most[k])) for k, s in enumerate(sizes.tolist())]
        assert (got <= bounds).all()
        best = max(sum(p * k for p, k in zip(prices, n, strict=True)) for n in itertools.product(*[range(b + 1) for b in bounds]) if sum(s * k for s, k in zip(sizes, n, strict=True)) <= 30)
        assert (got * sizes).sum() <= 30
        assert (got * prices).sum() == pytest.approx(best)


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer

    odd = [None, "", " \n", "It's DON'T we'll 123 a1b2 ÉCOLE ×3 é÷ <|endoftext|>x <|y|> #@!", "日本語 ΑΣΣ İ ſ é ẞ nb sp　x", "a" * 500 + "!" * 90, "word " * 9000, "same", "same"]
    rows = [*enumerate(odd), (None, "null id")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, piece int, length int")
    got = packing.pack(docs, VOCABULARY, capacity=64).collect()
    tok = Tokenizer.from_file(VOCABULARY)
    want = collections.Counter()
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((i, k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64])) for k, s in enumerate(range(0, len(ids), 64)))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(docs.limit(0), VOCABULARY).collect() == []


# ---------------------------------------------------------------- chat


def test_branches_are_ranked_and_read_back(spark):
    text = ["plain", "###", "\\###", "\\\\</turn>", "a\n</turn>\nb", "####\\", None, "### user\nx", "\\"]
    rows = [(1, 1, None, "system", text[0], 0.0), (1, 2, 1, "user", text[1], 1.0), (1, 3, 2, "assistant", text[2], 5.0), (1, 4, 2, "assistant", text[3], 9.0), (1, 5, 4, "us%0Aer\n", text[4], None), (1, 6, 5, "assistant", text[5], 0.0)]
    rows += [(2, 1, 99, "user", text[6], 0.0), (2, 2, 1, "assistant", text[7], 0.0), (2, 3, 1, None, text[8], 0.0), (None, 1, None, "user", "t", 0.0), (3, 1, 2, "user", "round", 0.0), (3, 2, 1, "user", "round", 0.0)]
    m = spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, role string, text string, score double").withColumn("height", F.lit(1))
    got = chat.format_branches(m, best=None).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    by = {(r.tree_id, r.leaf_id): r for r in got}
    assert set(by) == {(1, 3), (1, 6), (2, 2), (2, 3), (None, 1)}
    assert (by[1, 6].branch_rank, by[1, 3].branch_rank) == (1, 2)
    said = {k: [(t.role, t.text) for t in r.turns] for k, r in by.items()}
    assert said[1, 6] == [("system", text[0]), ("user", text[1]), ("assistant", text[3]), ("us%0Aer\n", text[4]), ("assistant", text[5])]
    assert said[2, 3] == [("user", ""), ("", text[8])]
    assert by[1, 6].loss == text[3] + text[5]
    assert by[2, 2].loss == text[7]
    assert chat.format_branches(m.limit(0)).collect() == []


def test_wide_trees_against_all_branches(spark):
    r = random.Random(3)
    parent, rows = {}, []
    for tree in (1, 2, 3):
        for i in range(1, 121):
            up = None if i == 1 else 1 if tree == 1 else r.randrange(1, i)  # tree 1: a star of 119 leaves
            parent[tree, i] = up
            rows.append((tree, i, up, r.choice(["user", "assistant"]), f"t{i} " * (200 if i == 1 else 1), r.choice([None, 0.0, 1.0, 2.0, -1.0])))
    score = {(t, i): s or 0.0 for t, i, _, _, _, s in rows}
    want = {}
    for tree in (1, 2, 3):
        inner = {u for (t, _), u in parent.items() if t == tree}
        for leaf in (i for i in range(1, 121) if i not in inner):
            path, at = [], leaf
            while at is not None:
                path.append(at)
                at = parent[tree, at]
            want[tree, leaf] = (sum(score[tree, i] for i in path), path[::-1])
    m = spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, role string, text string, score double")
    for best in (1, 3, None):
        got = chat.format_branches(m, best=best).withColumn("said", F.transform(chat.parse(F.col("formatted")), lambda t: t["text"])).collect()
        ranked = {t: sorted((-s, leaf) for (u, leaf), (s, _) in want.items() if u == t) for t in (1, 2, 3)}
        assert {(x.tree_id, x.branch_rank): (-x.branch_score, x.leaf_id) for x in got} == {(t, k): v for t in ranked for k, v in enumerate(ranked[t][:best], 1)}
        text = {(t, i): x for t, i, _, _, x, _ in rows}
        assert all(x.said == [text[x.tree_id, i] for i in want[x.tree_id, x.leaf_id][1]] for x in got)


def test_long_threads_and_repeats(spark):
    turns = [(4, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(70)] + [(5, 0, "user", "x"), (5, 0, "user", "x"), (5, 0, "assistant", "y"), (6, None, None, None)]
    got = {r.conv_id: r for r in chat.digest(chat.format_branches(chat.threads(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))).collect()}
    assert got[4].n_turns == 70
    assert got[4].turns_sha256 == hashlib.sha256("".join(f"{'user' if t % 2 == 0 else 'assistant'}\nt{t}\n" for t in range(70)).encode()).hexdigest()
    assert got[5].turns_sha256 == hashlib.sha256(b"assistant\ny\nuser\nx\nuser\nx\n").hexdigest()
    assert (got[6].n_turns, got[6].loss_chars) == (1, 0)


# ---------------------------------------------------------------- html

PAGE = """<!DOCTYPE html><html><body class="has-sidebar"><header class="site-header"><h1>Site</h1><p>A line under the name of the site that is long enough to look like text.</p></header>
<div class="cookie-notice">We use cookies on this site, please accept all of them now.</div><nav><a href="/">Home</a> <a href="/b">B</a></nav>
<article class="post"><header><h1>The&nbsp;title</h1></header><p>First &amp; <b>more</b>
 text.<p>Second<br>part <a href=x title="a>b">link</a>.<div class="ad-slot">Buy this wonderful thing now, it is cheap and good and much else.</div><p>Short.</p>
<form><label>Mail</label><input></form><ul><li>one<li>two</ul><aside>Related things to read</aside><!-- <p>hidden</p> -->
<script>if (a<b) "</p>"</script><style>p{}</style><div id="comments"><p>Great post, I liked reading this very much indeed!</p></div></article>
<div class="sidebar"><p>Words at the side</p></div><footer>&copy; foot</footer></body></html>"""


def test_page_parts():
    want = "The title\nFirst & more text.\nSecond part link.\nShort.\none\ntwo"
    assert html_mincut.main_text(PAGE) == want
    # Without an article every header is the page's own.
    assert html_mincut.main_text(PAGE.replace("article", "div")) == want.removeprefix("The title\n")
    assert html_mincut.main_text(PAGE[: PAGE.index("<footer")]) == want  # never closed
    for empty in (None, "", "<", "<<>>", "<!--", "<script>", "<p></p>", "<div><nav>x</nav></div>"):
        assert html_mincut.main_text(empty) in ("", "<", "<<>>")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-6, 6), min_size=1, max_size=8), st.data())
def test_cut_is_least(odds, data):
    n = len(odds)
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.integers(0, 4)).filter(lambda e: e[0] != e[1]), max_size=12))

    def cost(label) -> float:
        return sum(-o if (o < 0) and x else o if (o > 0) and not x else 0 for o, x in zip(odds, label, strict=True)) + sum(w for a, b, w in edges if label[a] != label[b])

    got = html_mincut.minimum_cut([float(o) for o in odds], [(a, b, float(w)) for a, b, w in edges])
    assert cost(got) == pytest.approx(min(cost(x) for x in itertools.product((False, True), repeat=n)))


def test_pages(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "<p>" + "word " * 50_000 + "</p>")]
    got = html_mincut.extract_main_text(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert sorted(r.n_chars for r in got)[0] == 0
    assert all(r.n_chars == len(r.text) for r in got)
    assert next(r for r in got if r.page_id is None).n_chars == 5 * 50_000 - 1


# ---------------------------------------------------------------- what the cut decides

PLAIN = """<html><head><title>t</title></head><body><div><a href=1>Home</a> <a href=2>News</a></div>
<div><h1>A short title</h1><p>%s</p><p>No.</p><p>%s</p><p>He left.</p><p>%s</p></div>
<div>&copy; 2024 Somebody</div></body></html>""" % tuple("the long words of a paragraph that says something in full sentences " * k for k in (6, 4, 5))


def test_short_paragraphs_are_kept_by_their_neighbours():
    told = html_mincut.labelled(PLAIN)
    kept = [t for t, use, _ in told if use]
    assert [t[:8] for t in kept] == ["A short ", "the long", "No.", "the long", "He left.", "the long"]
    by_themselves = [t for t, _, odds in told if odds > 0]
    assert "No." not in by_themselves and "He left." not in by_themselves


def test_the_cut_is_of_least_cost():
    r = np.random.default_rng(7)
    for _ in range(60):
        n = int(r.integers(1, 9))
        odds = (r.normal(0, 2, n)).tolist()
        edges = [(int(a), int(b), float(r.random() * 2)) for a, b in r.integers(0, n, (12, 2)) if a != b]

        def cost(label, odds=odds, edges=edges):
            return sum(abs(x) for x, use in zip(odds, label, strict=True) if (x > 0) != use) + sum(w for a, b, w in edges if label[a] != label[b])

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert cost(html_mincut.minimum_cut(odds, edges)) == pytest.approx(best, abs=1e-9)


def test_the_cut_changes_labels_for_the_better(spark):
    """Pages whose articles have lost their element: the text is as before with the cut, and seldom without."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    with_cut = without = changed = 0
    for page in pages:
        want = html_mincut.main_text(page)
        told = html_mincut.labelled(page.replace("<article", "<div").replace("</article", "</div"))
        with_cut += "\n".join(t for t, use, _ in told if use) == want
        without += "\n".join(t for t, _, odds in told if odds > 0) == want
        changed += sum((odds > 0) != use for _, use, odds in told)
    assert with_cut >= 0.95 * len(pages) > 2 * without
    assert changed > len(pages)


def plain_cut(odds, edges):
    """The source side of a minimum cut by one path after the other over a matrix of capacities."""
    n = len(odds)
    room = np.zeros((n + 2, n + 2))
    for i, x in enumerate(odds):
        room[(n, i) if x > 0 else (i, n + 1)] = abs(x)
    for a, b, w in edges:
        room[a, b] += w
        room[b, a] += w
    while True:
        before, queue = {n: None}, [n]
        for i in queue:
            for j in np.flatnonzero(room[i] > 1e-9).tolist():
                if j not in before:
                    before[j] = i
                    queue.append(j)
        if n + 1 not in before:
            return [i in before for i in range(n)]
        steps, j = [], n + 1
        while before[j] is not None:
            steps.append((before[j], j))
            j = before[j]
        flow = min(room[s] for s in steps)
        for a, b in steps:
            room[a, b] -= flow
            room[b, a] += flow


def test_the_query_equals_a_plain_cut(spark):
    from gridloom.llm import queries

    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()
    costs = html_mincut.learned_costs(p.html for p in sorted(pages, key=lambda p: hashlib.md5(str(p.page_id).encode()).hexdigest())[: html_mincut.SAMPLE_PAGES])
    want = []
    for p in pages:
        texts, odds, edges = html_mincut.graph(p.html or "", costs)
        text = "\n".join(t for t, use in zip(texts, plain_cut(odds, edges)) if use)
        want.append((p.page_id, p.url, text, len(text)))
    assert sorted(want) == sorted(tuple(r) for r in queries.op10_html_extraction(spark, sf).select("page_id", "url", "text", "n_chars").collect())


@pytest.mark.parametrize("blanked", [False, True])
def test_pairwise_edges_decide(spark, blanked):
    """Costs learned from other pages; then all edges go, and nothing else. Blanked: without article elements, classes, ids and roles."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").select("html").collect()]
    costs = html_mincut.learned_costs(pages[:100])
    right = alone = changed = 0
    for page in pages[100:]:
        want = re.search("<article[^>]*>(.*?)</article>", page, re.S)[1]
        want = [t for b, t in html_mincut.blocks(f"<article>{want}</article>")[0] if not b.zone[1]]
        if blanked:
            page = re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page.replace("<article", "<div").replace("</article", "</div"))
        texts, odds, edges = html_mincut.graph(page, costs)
        told = html_mincut.minimum_cut(odds, edges)[: len(texts)]
        bare = html_mincut.minimum_cut(odds, [])[: len(texts)]
        right += [t for t, use in zip(texts, told) if use] == want
        alone += [t for t, use in zip(texts, bare) if use] == want
        changed += sum(a != b for a, b in zip(told, bare))
    assert right >= (0.9 if blanked else 1.0) * len(pages[100:])
    assert alone < 0.1 * len(pages[100:]) and changed >= 0.9 * len(pages[100:])


def test_costs_settle_where_classes_are_apart():
    """The gradient of the penalised loss is nought at the weights, for any sample."""
    for n in (3, 50, 5000):
        x = np.random.default_rng(n).normal(0, 3, (n, 3))
        rows = [(1.0, *r) for r in x.tolist()]
        y = [r[1] > 0.5 for r in rows]
        start = np.array((-0.3, 0.3, 0.6, -4.0))
        w = np.array(html_mincut._logistic(rows, y, tuple(start)))
        p = 1 / (1 + np.exp(-np.array(rows) @ w))
        assert np.abs(np.array(rows).T @ (np.array(y) - p) - html_mincut.RIDGE * (w - start)).max() < 1e-3


def test_costs_without_marked_pages():
    assert html_mincut.learned_costs([]) == html_mincut.DEFAULT_COSTS
    assert html_mincut.learned_costs(["", "<p>x</p>", "<article>only</article>"]) == html_mincut.DEFAULT_COSTS


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>Real text here.</p><button>x<p>More article text, a whole sentence.</article>", "Real text here.\nMore article text, a whole sentence."),
        ("<title>abc<body><article><p>Real text here.</p></article>", "Real text here."),
        ("<article><p>One two three.</p><script>var x = '<p>no</p>'", "One two three."),
        ("<article><p>One two three.</p><script>var x = 1\n<p>Four five six.</p></article>", "One two three.\nFour five six."),
        ("<article><p>One two three.</p><noscript>Enable it</noscript><p>Four five six.</p></article>", "One two three.\nFour five six."),
        ("<article><p>a &lt; b &amp; c <b>bold</b>\n text</p></article>", "a < b & c bold text"),
        ("", ""),
        (None, ""),
    ],
)
def test_broken_pages(page, want):
    assert html_mincut.main_text(page) == want


@pytest.mark.parametrize("piece", ["<a ", "<a <b ", "<div>", "<p>x", "</b>", "<!-- ", "<! ", "<a '", "&amp", "<b><p>"])
def test_long_broken_pages_take_linear_time(piece):
    import time

    times = []
    for k in (20_000, 80_000):
        began = time.perf_counter()
        html_mincut.main_text(piece * k)
        times.append(time.perf_counter() - began)
    assert times[1] < 12 * times[0] + 0.5


def test_runs_of_backslashes(spark):
    texts = ["\\" * 40_000 + "x", "\\" * 40_000 + "###", "\\###", "\\\\###\\</turn>\\", "######</turn></turn>", "\\ ### \\\\</turn>"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape_text(F.col("t")).alias("e"), chat.unescape_text(chat.escape_text(F.col("t"))).alias("u")).collect()
    for r in got:
        assert r.u == r.t
        assert "\n</turn>" not in "\n" + r.e and not r.e.startswith("###")
