"""TF-IDF weights and text factors against numpy."""

import numpy as np

from propval.operators import lsa as L


def _dense(weights, size, ids):
    x = np.zeros((len(ids), size))
    for r in weights.collect():
        for e in r["entries"]:
            x[ids.index(r["id"]), e["term_index"]] = e["weight"]
    return x


def test_factors_equal_numpy_svd(spark):
    words = ["sea", "view", "garden", "pool", "villa", "roof", "lake"]
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words, 12))) for i in range(60)] + [(60, None), (61, ""), (62, "?! x")]
    docs = spark.createDataFrame(rows, "id long, text string")
    vocab = L.fit_vocabulary(docs, "text", min_df=2, max_df=1.0).persist()
    weights = L.tfidf_weights(docs, vocab, "id", "text").persist()
    x = _dense(weights, vocab.count(), [r[0] for r in rows])
    v = L.fit_lsa(weights, vocab.count(), k=5)
    _, singular, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.linalg.norm(x @ v, axis=0), singular[:5])
    out = {r["id"]: [r[f"lsa_{j}"] for j in range(5)] for r in L.project(docs.select("id"), weights, "id", v).collect()}
    assert len(out) == len(rows) and out[60] == out[61] == out[62] == [0.0] * 5
    assert np.allclose([out[r[0]] for r in rows], x @ v)


def test_no_vocabulary_gives_zero_factors(spark):
    docs = spark.createDataFrame([(1, "a lonely text"), (2, None)], "id long, text string")
    vocab = L.fit_vocabulary(docs, "text")
    weights = L.tfidf_weights(docs, vocab, "id", "text")
    v = L.fit_lsa(weights, vocab.count())
    out = L.project(docs.select("id"), weights, "id", v).collect()
    assert v.shape == (0, 25) and len(out) == 2 and all(r[f"lsa_{j}"] == 0.0 for r in out for j in range(25))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_document_is_split_counted_and_weighed_once(spark, tmp_path):
    spark.createDataFrame([(1, "sea view villa"), (2, "sea view"), (3, "roof")], "id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    vocab = L.fit_vocabulary(docs, "text", min_df=2, max_df=1.0).persist()
    weights = L.tfidf_weights(docs, vocab, "id", "text")
    plan = _plan(weights).lower()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("udf(") == 1
    norm = plan.index("sqrt(aggregate(entries#")
    assert "array_repeat(" in plan[norm - 20:norm]  # an argument, not part of a lambda that runs for every entry
    assert {r["id"]: len(r["entries"]) for r in weights.collect()} == {1: 3, 2: 3}


def test_factors_need_no_row_per_entry(spark, tmp_path):
    spark.createDataFrame([(1, "sea view villa"), (2, "sea view"), (None, "sea"), (2, "view"), (3, "roof")], "id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    vocab = L.fit_vocabulary(docs, "text", min_df=2, max_df=1.0).persist()
    L.tfidf_weights(docs, vocab, "id", "text").write.parquet(f"{tmp_path}/weights")
    weights = spark.read.parquet(f"{tmp_path}/weights")
    v = np.arange(vocab.count() * 3, dtype=float).reshape(-1, 3)
    out = L.project(docs.select("id"), weights, "id", v)
    assert "Generate" not in _plan(out) and _plan(out).count("Join ") == 1
    want = {}
    for r in weights.collect():
        want[r["id"]] = want.get(r["id"], 0) + sum(e["weight"] * v[e["term_index"]] for e in r["entries"])
    for r in out.collect():  # rows of one id share their factors; a row without an id, or without a term, has none
        got = np.array([r["lsa_0"], r["lsa_1"], r["lsa_2"]])
        assert np.allclose(got, want[r["id"]] if r["id"] in (1, 2) else 0.0)
