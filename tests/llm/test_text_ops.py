"""Fill-in-the-middle, URL filters and the source audit, against plain versions and on odd input."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gridloom.llm import fill_middle, source_audit, url_filters
from gridloom.llm.queries import URL_RULES

DOCS = "doc_id long, text string, lang string, source string"
ODD = ["", None, " ", "\n\t ", "a", " a ", "a  b\tc\n", "é\u00a0ü 漢字 😀 x", "<P> in it", "x <M", "<S", "a<S b", "word " * 30_000, "x" * 300_000, " " * 5_000]


# ---------------------------------------------------------------- fill-in-the-middle


def plain_fim(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(fill_middle.UNITS, text)
    assert "".join(units) == text
    n = len(units)
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate,spm", [(50, 80), (100, 50), (100, 0), (0, 80)])
def test_fill_in_middle_is_the_plain_one(spark, rate, spm):
    rng = random.Random(rate)
    texts = ODD + ["".join(rng.choice("ab <>PSM\n") for _ in range(rng.randint(0, 40))) for _ in range(150)]
    data = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "other text of an id"), (6, "a  b\tc\n"), (6, "a  b\tc\n")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("k1_", F.lit(0)).withColumn("form", F.lit("x"))
    made = fill_middle.fill_in_middle(docs, rate=rate, spm_rate=spm)
    got = sorted((tuple(r) for r in made.collect()), key=str)
    assert got == sorted(((i, *plain_fim(i, t, rate=rate, spm=spm)) for i, t in data), key=str)
    back = made.select("doc_id", "output", fill_middle.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((i, t or "") for i, t in data), key=str)


def test_no_documents_give_no_outputs(spark):
    assert fill_middle.digest(fill_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_units_are_dealt_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(fill_middle, "UNITS_A_TASK", 50)
    data = [(i, "w " * i) for i in range(60)]
    got = fill_middle.fill_in_middle(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted((i, *plain_fim(i, t)) for i, t in data)


# ---------------------------------------------------------------- URL filters


def plain_verdict(url, rules, default="allow"):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if None not in (h, p, v) and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, default)))


URLS = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "https://EXAMPLE.org/es/x", "https://a.b.example.ORG/en/12?q=/es/#f", "http://xorg/a", "http://x.org?/a", "http://example.org#x",
    "http://example.com/fr/1", "ftp://example.com/de/", "http://example.com/DE/", "http://é.com/fr/ü", "http://a.com://b.org/", "x://" + "a." * 3_000 + "org/" + "y" * 50_000, "http://.org/", "http://org./", "http://com/fr",
]


def test_filters_are_the_plain_ones(spark):
    rng = random.Random(5)
    parts = ["org", "com", "example.org", "a.example.org", "b.com"]
    rules = URL_RULES + [(rng.choice(parts), "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 3))), rng.choice(["allow", "block"])) for _ in range(60)]
    rules += [("org", "", "block"), ("org", "x", "block"), ("a/b", "/", "block"), (None, "/", "block"), ("org", None, "block"), ("com", "/q?x", "block")]
    urls = URLS + [f"http://{rng.choice(['', 'x.'])}{rng.choice(parts)}/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 5))) for _ in range(300)]
    pages = spark.createDataFrame([(i % 200, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("short", F.lit(2)).withColumn("best", F.lit(2))
    table = spark.createDataFrame(rules, "host string, path string, verdict string").withColumn("digest", F.lit("x"))
    for default in ("allow", "block"):
        for limit in ("10485760", "-1"):  # broadcast, and by shuffle
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            try:
                got = url_filters.judge(pages, table, default).collect()
            finally:
                spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            assert sorted(map(tuple, got), key=str) == sorted(((i % 200, *plain_verdict(u, rules, default)) for i, u in enumerate(urls)), key=str)


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in url_filters.judge(spark.createDataFrame([(1, "http://a/b")], "page_id long, url string"), none).collect()] == [(1, "a", "/b", None, "allow")]
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(URL_RULES, none.schema)).collect() == []


def test_short_prefixes_that_collide_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "SHORT", 1)
    rules = [(f"h{i}.org", "/", "block") for i in range(0, 40, 2)]
    pages = spark.createDataFrame([(i, f"http://h{i}.org/x") for i in range(40)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filters.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: "allow" if i % 2 else "block" for i in range(40)}


# ---------------------------------------------------------------- source audit


def plain_audit(rows, least=3, top=200):
    docs = [("" if t is None else t, lang or "", source or "") for t, lang, source in rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    per, held = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in docs:
        ts = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(low))
        per[lang, source].update(ts)
        held[lang].update(set(ts))
    out = []
    for lang in {x for x, _ in per}:
        kept = [t for t, n in held[lang].items() if n >= least]
        own = {s: per[x, s] for x, s in per if x == lang}
        v = len(kept)

        def p(c, v=v, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept}

        ps, q = {s: p(c) for s, c in own.items()}, p(sum(own.values(), collections.Counter()))
        for s in own:
            pair = sorted(((-sum((ps[s][t] - ps[o][t]) ** 2 // ps[o][t] for t in kept), o.encode(), o) for o in own if o != s))
            term = sorted((-((ps[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if own[s][t] and ps[s][t] > q[t])[:top]
            out += [(lang, s, part, item, -value, k) for part, found in (("pair", pair), ("term", term)) for k, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def audited(spark, rows, **kw):
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit(1)).withColumn("n", F.lit("clash")).withColumn("docs", F.lit(0.5))
    return sorted(tuple(r) for r in source_audit.audit(df, **kw).collect())


@pytest.mark.parametrize("cells", [1 << 20, 7, 1])
def test_audit_is_the_plain_one(spark, monkeypatch, cells):
    monkeypatch.setattr(source_audit, "CELLS", cells)
    rng = random.Random(cells)
    words = ["alpha", "Beta", "BETA", "é", "Éa", "漢", "😀", "z", "aa", "a1b", "x" * 400]
    rows = [(rng.choice([" ", "-", "7"]).join(rng.choices(words, [9, 5, 3, 2, 2, 2, 1, 1, 1, 1, 1], k=rng.randint(0, 12))), rng.choice(["en", "de", None]), rng.choice(["web", "web", "web", "news", None, "ü"])) for _ in range(150)]
    rows += [(None, "en", "silent"), ("", "none", "one"), ("1 2", "none", "two"), ("rare", "solo", "s"), ("e f", "few", "x"), ("e f", "few", "y")] + [("same same", "en", "web")] * 20
    assert audited(spark, rows) == plain_audit(rows)
    assert audited(spark, rows, least=1, top=2) == plain_audit(rows, 1, 2)


def test_audit_of_no_and_of_long_texts(spark):
    assert audited(spark, []) == []
    rows = [("tok " * 100_000 + str(i), "en", s) for i, s in enumerate("ab")] + [("tok b" + chr(97 + i), "en", "a") for i in range(3)]
    assert audited(spark, rows) == plain_audit(rows)


def test_shares_are_exact():
    import numpy as np

    c, n = np.array([0, 5, 10**15 - 1, 10**15]), 10**15
    assert source_audit.shares(c, np.array([n]), 7).tolist() == [1 + 10**9 * (int(x) + 1) // (n + 7) for x in c]
    with pytest.raises(OverflowError):
        source_audit.shares(c, np.array([10**16]), 7)
