"""TF-IDF vocabulary/weights (T19) and LSA factors (T20), Spark-native.

T19: tokens are maximal runs of >= 2 word characters of the lower-cased text,
plus bigrams of consecutive tokens. Term statistics are one groupBy on the
term alone (a document marks the first use of each of its terms, so document
and corpus frequency come from one map-side-combined aggregate). The vocabulary
keeps terms with df >= min_df and df <= max_df * n_docs, then the
``max_features`` most frequent (ties by term), indexed alphabetically. Weights:
(1 + ln tf) * idf with the smoothed idf = ln((1 + n) / (1 + df)) + 1,
L2-normalised per document; each document's row is counted against the
vocabulary by itself (Spark ML's count vectorizer), so no shuffle is needed.

T20: truncated SVD of the (docs x vocab) matrix by its Gram matrix
(``RowMatrix``, one pass over the documents). The driver factorises the
vocab x vocab matrix, bounded by the vocabulary cap.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml.feature import CountVectorizerModel
from pyspark.mllib.linalg import VectorUDT
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propval.functions import rules as R
from propval.functions.regex import java
from propval.operators.stats import attach_scalars
from propval.plans.materialize import shared_path

TOKEN_RUN = r"[\p{L}\p{N}_]{2,}"  # same tokens as \b\w\w+\b with Python's Unicode \w
ENTRIES = "array<struct<term_index:int,weight:double>>"
MAX_VOCABULARY = 5000  # terms: the Gram matrix that the driver factorises holds the square of it


def terms_col(text: str):
    # Python's \w is "alphanumeric or _" = [\p{L}\p{N}_]; maximal runs of >= 2 such characters
    toks = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(java(TOKEN_RUN)), 0)

    def with_bigrams(t):
        n = F.size(t)
        bigrams = F.when(n > 1, F.zip_with(F.slice(t, 1, n - 1), F.slice(t, 2, n - 1),
                                           lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
        return F.concat(t, bigrams)

    return F.flatten(F.transform(F.array(toks), with_bigrams))  # bound to one variable, so that a text is split once


def term_statistics(docs: DataFrame, text: str) -> DataFrame:
    """(term, df, total_tf) over whole texts; rows leave their task as partial sums per term."""
    terms = docs.select(terms_col(text).alias("_t"))
    uses = F.concat(
        F.transform(F.array_distinct("_t"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("doc"), F.lit(0).alias("use"))),
        F.transform("_t", lambda t: F.struct(t.alias("term"), F.lit(0).alias("doc"), F.lit(1).alias("use"))))
    return (terms.select(F.explode(uses).alias("_u")).groupBy("_u.term")
            .agg(F.sum("_u.doc").alias("df"), F.sum("_u.use").alias("total_tf")))


def fit_vocabulary(docs: DataFrame, text: str, max_features: int = R.TFIDF_MAX_FEATURES,
                   min_df: int = R.TFIDF_MIN_DF, max_df: float = R.TFIDF_MAX_DF) -> DataFrame:
    """(term_index, term, df, total_tf, idf)."""
    if max_features > MAX_VOCABULARY:
        raise ValueError(f"max_features is {max_features}; at most {MAX_VOCABULARY} terms can be broadcast and factorised")
    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    stats = attach_scalars(term_statistics(docs, text), n_docs).where(
        (F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("n_docs")))
    top = stats.orderBy(F.col("total_tf").desc(), F.col("term").asc()).limit(max_features)
    idf = F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    # the vocabulary is capped at max_features rows, so a single ordered window is bounded
    w = Window.orderBy("term")
    return top.select((F.row_number().over(w) - 1).alias("term_index"), "term", "df", "total_tf",
                      idf.alias("idf"))


def tfidf_weights(docs: DataFrame, vocab: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc, entries): the document's (term_index, weight) by index; documents without a vocabulary term have no row.

    Sublinear tf, idf and per-document L2 normalisation. Every row is counted and weighed by itself, with no shuffle;
    it holds at most one entry per vocabulary term.
    """
    terms = vocab.orderBy("term_index").select("term", "idf").collect()  # bounded by MAX_VOCABULARY
    if not terms:
        return docs.select(id_col, F.array().cast(ENTRIES).alias("entries")).where("false")
    counter = CountVectorizerModel.from_vocabulary([r["term"] for r in terms], inputCol="_terms", outputCol="_tf")
    counted = counter.transform(docs.select(id_col, terms_col(text).alias("_terms"))).select(id_col, F.unwrap_udt("_tf").alias("_tf"))
    # the counts are sparse: indices in order, values beside them (dense where nearly all terms occur: indices NULL)
    index = F.coalesce("_tf.indices", F.sequence(F.lit(0), F.size("_tf.values") - 1))
    idf = F.lit([r["idf"] for r in terms])
    raw = F.zip_with(index, "_tf.values", lambda i, n: F.struct(
        i.alias("term_index"), F.when(n > 0, (F.lit(1.0) + F.log(n)) * F.get(idf, i)).alias("weight")))
    entries = F.filter(raw, lambda e: e["weight"].isNotNull())
    # a filter on the count would be pushed below it, and every document be counted twice
    rows = counted.select(id_col, F.explode(F.filter(F.array(entries), lambda e: F.size(e) > 0)).alias("entries"))
    # the norm is an argument of zip_with, so a row computes it once: as a column it would be merged into the lambda
    # and be summed anew for every entry
    norm = F.sqrt(F.aggregate("entries", F.lit(0.0), lambda s, e: s + e["weight"] * e["weight"]))
    return rows.select(id_col, F.zip_with("entries", F.array_repeat(norm, F.size("entries")), lambda e, n: F.struct(
        e["term_index"].alias("term_index"), (e["weight"] / n).alias("weight"))).alias("entries"))


def as_vectors(weights: DataFrame, size: int) -> DataFrame:
    """One column ``row`` of the library's sparse vectors.

    A vector is stored as (type, size, indices, values): rows of that form are written and read back as vectors.
    """
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.col("entries.term_index").alias("indices"),
                     F.col("entries.weight").alias("values"))
    path = shared_path(weights.sparkSession, "vectors")
    weights.select(parts.alias("row")).write.parquet(path)
    return weights.sparkSession.read.schema(T.StructType([T.StructField("row", VectorUDT())])).parquet(path)


def fit_lsa(weights: DataFrame, vocab_size: int, k: int = R.LSA_COMPONENTS) -> np.ndarray:
    """Right singular vectors V (vocab x k) of the weights; signs fixed so each column's largest-magnitude
    loading is positive. Columns beyond the rank are zero."""
    out = np.zeros((vocab_size, k))
    if vocab_size == 0 or weights.isEmpty():
        return out
    gram = RowMatrix(as_vectors(weights, vocab_size), numCols=vocab_size).computeGramianMatrix().toArray()
    values, vectors = np.linalg.eigh(gram)
    kept = [i for i in np.argsort(-values, kind="stable")[:k] if values[i] > values.max() * 1e-12]
    for j, i in enumerate(kept):
        v = vectors[:, i]
        out[:, j] = v if v[np.argmax(np.abs(v))] > 0 else -v
    return out


def project(df: DataFrame, weights: DataFrame, id_col: str, v: np.ndarray, prefix: str = "lsa_") -> DataFrame:
    """``df`` with its documents' factors X V as columns lsa_0..lsa_{k-1} (V is bounded and part of the plan).

    Every row of ``df`` stays; one without a vocabulary term has zero factors. A document's factors are added up
    inside its own row, so one row of k numbers leaves the task, and no row per entry is made.
    """
    names = [f"{prefix}{j}" for j in range(v.shape[1])]
    if not v.size:
        return df.select("*", *[F.lit(0.0).alias(n) for n in names])
    loadings = F.from_json(F.lit(json.dumps(v.tolist())), "array<array<double>>")  # a constant: read once, by the optimizer
    factors = F.aggregate("entries", F.array_repeat(F.lit(0.0), len(names)),
                          lambda s, e: F.zip_with(s, F.get(loadings, e["term_index"]), lambda x, y: x + e["weight"] * y))
    rows = weights.select(id_col, factors.alias("_f"))
    sums = rows.groupBy(id_col).agg(*[F.sum(F.col("_f")[j]).alias(n) for j, n in enumerate(names)])
    return df.join(sums, id_col, "left").select(*df.columns, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
