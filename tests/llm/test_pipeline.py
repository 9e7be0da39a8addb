"""The corpus pipeline against its stages in plain Python, on a small table."""

from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from orbisloom.llm import toxicity

from . import brute
from .test_operators import gapless, vary


def test_pipeline_matches_plain_python(spark, tmp_path):
    r = np.random.default_rng(8)
    passage = vary(777, 60)
    rows, labels = [], []
    for i in range(240):
        w = vary(2000 + i, 60).split()
        if i % 4 == 0:
            for k in r.choice(60, 5, replace=False):
                w[k] = str(r.choice(["vilest", "rottenest", "foulish"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(300, rows[1][1].upper()), (301, rows[1][1]), (302, rows[2][1] + " end"), (303, vary(5, 20) + " " + passage), (304, passage + " " + vary(6, 30)), (305, None), (306, ""), (307, "word " * 9000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    toxic = {x.doc_id for x in toxicity.score(table, spark.read.parquet(f"{tmp_path}/labels.parquet")).filter("toxic_predicted = 1").collect()}
    assert toxic == {i for i in range(0, 240, 4)}
    kept = [(i, t) for i, t in rows if i not in toxic]
    exact = brute.exact_groups(kept)
    kept = [(i, t) for i, t in kept if exact[i, t][0] == i]
    near = brute.near_groups(kept)
    kept = [(i, t) for i, t in kept if near[i] == i]
    cut = brute.removed_words([t for _, t in kept])
    kept = [(i, b" ".join(w).decode() if n else t) for (i, t), (w, n) in zip(kept, cut)]
    assert any(n for _, n in cut)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter({i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in kept})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = Counter()
    for x in got:
        sizes[x.doc_id] += x.length
    assert sizes == want
    assert gapless(got) <= sum(want.values()) / 2048 * 11 / 9 + 1  # what best fit of falling lengths guarantees


def test_every_stage_but_the_last_returns_the_columns_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3, 1, "x"), (2, None, None, None, None, 2, None)], "doc_id long, text string, lang string, source string, n_chars long, block long, kept string")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == docs.columns and out.count() == frame.count()


def test_stages_tell_rows_of_one_id_apart(spark, tmp_path):
    a, b = vary(31, 60), vary(32, 60)
    rows = [(3, a), (5, a), (5, b), (None, a), (None, b + " only with the null id " + vary(33, 40))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()} == {rows[0], rows[2], rows[4]}
    assert {(r.doc_id, r.text) for r in corpus_pipeline.drop_exact_copies(spark, docs, str(tmp_path)).collect()} == {rows[1], rows[2], rows[4]}
