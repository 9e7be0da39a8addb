"""Quality model, fill-in-the-middle and source audit against brute-force versions and held-out accuracy."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbisloom.llm import divergence, quality_gam
from orbisloom.llm.fim import fill_in_middle, restored

SF = "/root/testdata/sf0.01"


def test_features_count_whole_texts():
    names = quality_gam.FEATURES
    got = dict(zip(names, quality_gam.features_of(b"One two two.\nOne two two.\nTHREE | 4!")))
    assert got["log_words"] == pytest.approx(np.log1p(9))
    assert got["distinct_words"] == pytest.approx(6 / 9) and got["top_word"] == pytest.approx(2 / 9)
    assert got["repeated_next"] == 0 and got["bars"] == pytest.approx(1 / 9) and got["shouts"] == pytest.approx(1 / 9)
    assert got["duplicate_lines"] == pytest.approx(1 / 3) and got["ended_lines"] == 1.0
    assert quality_gam.features_of(b"") == quality_gam.features_of(b" \n\t ") == (0.0,) * len(names)
    far = b"word " * 200_000 + b"end"
    assert dict(zip(names, quality_gam.features_of(far)))["repeated_next"] == pytest.approx(199_999 / 200_001)


def _gain(groups):
    return sum(g * g / (h + quality_gam.RIDGE) for g, h in groups)


def test_trees_take_the_best_cuts():
    r = np.random.default_rng(5)
    for _ in range(20):
        g, h = r.normal(size=(5, 4)), r.uniform(3, 9, size=(5, 4))
        best = 0.0
        for a, b in ((g, h), (g.T, h.T)):
            for cut in range(1, len(a)):
                for x, y in product(range(1, a.shape[1] + 1), repeat=2):
                    cells = [(s, c) for s, k in ((slice(0, cut), x), (slice(cut, None), y)) for c in (slice(0, k), slice(k, None))]
                    best = max(best, _gain([(a[s, c].sum(), b[s, c].sum()) for s, c in cells]) - _gain([(a.sum(), b.sum())]))
        gain, value = quality_gam.pair_tree(g, h)
        assert gain == pytest.approx(best) and value.shape == g.shape and len(np.unique(value)) <= 4
        line, weight = g.ravel(), h.ravel()
        two = max(_gain([(line[:k].sum(), weight[:k].sum()), (line[k:].sum(), weight[k:].sum())]) for k in range(1, len(line)))
        tree = quality_gam.step_tree(line, weight, leaves=2)
        parts = [tree == v for v in np.unique(tree)]
        assert _gain([(line[p].sum(), weight[p].sum()) for p in parts]) == pytest.approx(two)


def test_pairs_learn_what_single_tables_cant():
    r = np.random.default_rng(2)
    x = r.uniform(-1, 1, size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality_gam.fit_gam(x[:3000], y[:3000], names=3)
    assert (0, 1) in model.pairs
    assert ((model.scores(x[3000:]) > 0.5) == (y[3000:] > 0)).mean() > 0.95
    one = x[3001:3002]  # a score is the intercept and one entry of each table
    at, low = model.binned(one, model.edges), model.binned(one, model.coarse)
    by_hand = model.intercept + sum(t[k[0]] for t, k in zip(model.tables, at)) + sum(g[low[i][0], low[j][0]] for (i, j), g in zip(model.pairs, model.grids))
    assert model.margins(one)[0] == pytest.approx(by_hand)


def test_quality_is_right_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_gam.score(docs, labels).join(labels, "doc_id").filter(quality_gam.held_out("doc_id")).select("quality", "quality_score").collect()
    good, bad = [r.quality_score for r in rows if r.quality == 1], [r.quality_score for r in rows if r.quality == 0]
    assert len(good) > 40 and len(bad) > 5
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.97
    assert sum(g >= quality_gam.THRESHOLD for g in good) == len(good)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, "Fine words. In lines.", "a", 0.5), (2, None, None, None), (2, "", "b", 1.0), (None, "no id", "c", 2.0), (4, "x" * 300_000, "d", 3.0), (1, "Fine words. In lines.", "a", 0.5)],
        "doc_id long, text string, id string, y double",
    )
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (4, None), (None, 1)], "doc_id long, quality int")
    got = quality_gam.score(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.quality_score <= 1 for r in got)
    scores = {(r.doc_id, r.text): r.quality_score for r in got}
    assert scores[2, None] == scores[2, ""]
    assert quality_gam.score(docs.limit(0), labels).count() == 0
    none = quality_gam.score(docs, labels.limit(0)).select("quality_score").distinct().collect()
    assert [r[0] for r in none] == [0.5]
    with pytest.raises(ValueError, match="prefix"):
        quality_gam.score(docs.withColumn("quality_score", F.lit(1)), labels)


UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
TEXTS = [
    "", None, "one", "Hello, world! It's 12.", "\x01\x02 \x0212\x01\x021", "\x02" * 9, "a\x01", "é ü 漢字 \U0001f600 emoji", "tail <P> spelled", "<S", "<P <M <<S", "line\nbreaks\r\n\n",
    "x" * 5000, "word " * 20_000, "$1 \\$0 \\1 (a)",
]


def _brute_fim(i, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (n, "plain", None, None, text)
    if h[3] % 100 < 20:
        return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    rows = [(k * 40 + i, t, "c", 1) for k in range(12) for i, t in enumerate(TEXTS)] + [(None, "null id here", "c", 1), (3, TEXTS[3], "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, c0 int").repartition(4)
    got = fill_in_middle(docs)
    assert got.columns[:4] == docs.columns
    got = got.withColumn("back", restored(F.col("fim_output"), F.col("fim_form"))).collect()
    assert len(got) == len(rows)
    forms = Counter()
    for r in got:
        assert (r.fim_n, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.fim_output) == _brute_fim(r.doc_id, r.text), (r.doc_id, r.text)
        assert r.back == (r.text or "")
        forms[r.fim_form] += 1
    assert len(forms) == 3
    assert fill_in_middle(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="prefix"):
        fill_in_middle(docs.withColumn("fim_n", F.lit(1)))


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def _brute_audit(rows, least=3, top=200):
    groups, langs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        groups[lang or "", source or ""].update(found)
        langs[lang or ""].update(set(found))
    out = []
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in langs.items()}

    def shares(counts, terms):
        total = sum(counts[t] for t in terms) + len(terms)
        return {t: 1 + 10**9 * (counts[t] + 1) // total for t in terms}

    p = {g: shares(c, kept[g[0]]) for g, c in groups.items()}
    whole = {}
    for lang, terms in kept.items():
        whole[lang] = shares(sum((c for g, c in groups.items() if g[0] == lang), Counter()), terms)
    for (lang, source), mine in p.items():
        pairs = [(sum((mine[t] - q[t]) ** 2 // q[t] for t in mine), g[1]) for g, q in p.items() if g[0] == lang and g[1] != source]
        terms = [((mine[t] - whole[lang][t]) ** 2 // whole[lang][t], t) for t in mine if groups[lang, source][t] and mine[t] > whole[lang][t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


def test_audit(spark, monkeypatch):
    r = np.random.default_rng(7)
    words = ["alpha", "Beta", "gamma9delta", "é", "Éé", "漢", "it's", "x", "ß", "rare"]
    rows = []
    for k in range(160):
        lang, source = ["en", "de", None][k % 3], "hot" if k % 2 else [f"s{k % 14}", None, "S_é"][k % 3]
        rows.append((" ".join(r.choice(words, r.integers(0, 30))), lang, source))
    rows += [(None, "en", "silent"), ("", "xx", "alone"), ("only here", "xx", "two"), ("long " * 50_000, "en", "s1"), (rows[0])]
    docs = spark.createDataFrame([(*x, 1, "c") for x in rows], "text string, lang string, source string, n int, term string").repartition(5)
    want = _brute_audit(rows)
    assert sorted(map(tuple, divergence.audit(docs).collect())) == want
    # several blocks, chunks and spans, and entries passed on early
    monkeypatch.setattr(divergence, "SPAN", 2)
    monkeypatch.setattr(divergence, "HELD_ENTRIES", 5)
    assert sorted(map(tuple, divergence.audit(docs, chunk_terms=2, block_sources=2).collect())) == want
    few = divergence.audit(docs, top_terms=2).filter("part = 'term'").groupBy("lang", "source").count().agg(F.max("count")).first()[0]
    assert few == 2
    assert divergence.audit(docs.limit(0)).count() == 0


def test_shares_are_exact():
    counts, totals = np.array([0, 10**12, 8 * 10**15, 3]), np.array([1, 10**15 + 7, 8 * 10**15 + 1, 7])
    assert divergence._shares(counts, totals).tolist() == [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(counts, totals)]
