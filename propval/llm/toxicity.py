"""Operator 2: toxicity by subword-bag embeddings averaged into a linear softmax, trained in numpy.

A word's vector is the mean of the vectors of its character n-grams and of the whole word, all hashed into one
table; a document's vector is the mean over its words; a linear softmax gives the class. Table and softmax are
trained jointly (full batches, Adam); each bucket's vector is scaled by the evidence that it tells the classes apart,
and the loss on parts of the sample left out ends the training. A misspelt word that training never saw shares most n-grams with its origin.
As the model is linear from n-gram to logit, it is sent to the executors as one number per bucket.

Training rows are a bounded sample (PER_CLASS documents of each class, half of SAMPLE_BYTES of text for each): of the
labelled documents that have a text by a hash, so the sample does not depend on partitions; texts are whole, and fewer
where they are long. Scoring covers every whole text.

Defined results: null and empty texts score by the softmax's bias; labels with a null id or value, or that are not
0 or 1, are ignored, ids labelled both ways count as 1; without labels of both classes, or if training predicts the
parts of the sample left out no better than the bias alone, every score is just under 0.5 (predicted 0); repeated
rows score alike; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from propval.llm.common import by_bytes, give_back, lean, materialize, small_batches, table

PER_CLASS = 2000  # labelled documents of each class to train on, at most
SAMPLE_BYTES = 24 << 20  # characters of training text, at most
GRAMS = (3, 4, 5)  # lengths of character n-grams
BUCKETS = 1 << 17
DIM = 8
EPOCHS = 100
RATE = 0.05
DECAY = 1e-3  # pull of unused directions to zero, per step
POSITIVE = 0.25  # share of the loss that the documents of class 1 have; under half, for few false alarms
GAIN = 100.0  # fixed factor on document means, which are small for long texts
FOLDS = 4  # parts of the sample left out in turn to find the step that ends the training
PATIENCE = 15  # steps without a smaller loss on the parts left out that end the training
UNDECIDED = -4e-6  # logit of a model that learned nothing: just under 0.5, so that it rejects nothing
CELLS = 1 << 18  # values summed at once in training
WORDS = 250_000  # words remembered at once by a worker
SLICE = 4 << 20  # bytes of text scored at once


def word_buckets(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of <word> and of the word itself, word after word, and where each word's begin."""
    marked = "".join(f"<{w}>" for w in words)
    points = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    size = np.array([len(w) + 2 for w in words], np.int64)
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    room = np.repeat(first + size, size) - np.arange(len(points))  # characters left in the word
    keys, of = [], []
    prime = np.uint64(0x9E3779B97F4A7C15)
    for n in GRAMS:
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ points[k:len(points) - n + 1 + k]) * prime
        at = np.flatnonzero(room[:len(h)] >= n)
        keys.append(h[at])
        of.append(owner[at])
    whole = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    keys.append((whole + np.uint64(7)) * prime)
    of.append(np.arange(len(words)))
    key, of = np.concatenate(keys), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    bucket = ((key[order] >> np.uint64(29)) % np.uint64(buckets)).astype(np.int32)
    counts = np.bincount(of, minlength=len(words))
    return bucket, np.cumsum(counts) - counts


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def folds_of(keys: list[int], labels: np.ndarray, n: int = FOLDS) -> np.ndarray:
    """The inner fold of each document: within a class, distinct texts in the order of their hashes are dealt in turn."""
    out = np.zeros(len(keys), np.int64)
    for k in (0, 1):
        of = np.flatnonzero(labels == k)
        out[of] = np.unique(np.array([keys[i] for i in of], np.int64), return_inverse=True)[1] % n
    return out


def evidence(present: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Scale of each bucket's vector, in (0, 1], per model, from how far its presence differs between the classes.

    A bucket counts by the odds that a difference of z standard deviations is no chance among all buckets met. Nothing
    is cut off: scales are relative to the best bucket's, so that any number of documents trains.
    """
    n0, n1 = np.maximum(n0, 1)[:, None], np.maximum(n1, 1)[:, None]
    pooled = present.sum(1) / (n0 + n1)
    square = (present[:, 1] / n1 - present[:, 0] / n0) ** 2 / (pooled * (1 - pooled) * (1 / n0 + 1 / n1) + 1e-12)
    bound = 2 * np.log(np.maximum((pooled > 0).sum(1, keepdims=True), 2))  # the largest square that chance brings about
    square = np.minimum(square, bound)
    return np.exp((square - square.max(1, keepdims=True)) / 2)


def segment_sums(values: Callable[[int, int], np.ndarray], starts: np.ndarray, size: int) -> np.ndarray:
    """np.add.reduceat over ``size`` values, of which ``values(a, b)`` gives a range: whole segments, about CELLS values at once."""
    out, at = np.empty(len(starts)), 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + CELLS)))
        a, b = int(starts[at]), int(starts[end]) if end < len(starts) else size
        out[at:end] = np.add.reduceat(values(a, b), starts[at:end] - a)
        at = end
    return out


def train(texts: Iterable[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 2) -> tuple[np.ndarray, float]:
    """One weight per bucket and the bias, for label 1 against 0. Classes weigh alike. ``texts`` are read once, in order.

    FOLDS models, each without a part of the documents, and one of all documents train side by side; the step at which
    the parts left out have the least loss ends the training. UNDECIDED if no step beats the bias alone.
    """
    index: dict[str, int] = {}
    cells, hashes = [], []
    for t in texts:
        ws = words_of(t)
        cells.append(np.fromiter((index.setdefault(w, len(index)) for w in ws), np.int32, len(ws)))
        hashes.append(zlib.crc32(t.encode("utf-8", "surrogatepass")))
    if not index:
        return np.zeros(BUCKETS, np.float32), UNDECIDED
    n_docs, lengths = len(cells), np.array([len(c) for c in cells])
    vocabulary, parts, counts = list(index), [], []
    n_words = len(vocabulary)
    index.clear()
    for i in range(0, len(vocabulary), 1 << 13):
        part, first = word_buckets(vocabulary[i:i + (1 << 13)])
        parts.append(part)
        counts.append(np.diff(np.append(first, len(part))))
    bucket, per_word = np.concatenate(parts), np.concatenate(counts)
    del parts, vocabulary
    start = np.cumsum(per_word) - per_word
    y = labels.astype(np.float64)
    fold = folds_of(hashes, labels)
    met = np.zeros((FOLDS, 2, BUCKETS))
    for cell, label, f in zip(cells, labels, fold):
        flags = np.zeros(BUCKETS, bool)
        ws = np.unique(cell)
        for w in range(0, len(ws), 1 << 14):
            part = ws[w:w + (1 << 14)]
            reach = per_word[part]
            at = np.repeat(start[part] - np.cumsum(reach) + reach, reach) + np.arange(reach.sum())
            flags[bucket[at]] = True
        met[f, int(label)] += flags
    # model f learns from all folds but f, the last model from all
    learns = np.array([[f != m for f in fold] for m in range(FOLDS + 1)], np.float64)
    n0, n1 = learns @ (1 - y), learns @ y
    used = np.flatnonzero(met.sum((0, 1)))
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used))
    local = place[bucket]
    met = met[:, :, used]
    scale = evidence(met.sum(0) - np.concatenate([met, np.zeros_like(met[:1])]), n0, n1)
    del met, bucket
    inverse = 1.0 / per_word
    # documents x words as cells with the share of the word in the document
    distinct = []
    for i, c in enumerate(cells):
        distinct.append(np.unique(c, return_counts=True))
        cells[i] = None
    word, n = (np.concatenate([d[i] for d in distinct]) for i in (0, 1))
    doc = np.repeat(np.arange(n_docs, dtype=np.int32), [len(d[0]) for d in distinct])
    share = GAIN * n / np.maximum(lengths, 1)[doc]
    del n, cells, distinct
    weight = learns * np.where(y == 1, POSITIVE / np.maximum(n1, 1)[:, None], (1 - POSITIVE) / np.maximum(n0, 1)[:, None])

    # sums run over sorted cells: buckets of a word, words of a document, and both ways back
    by_bucket = local.astype(np.int64) << 32
    by_bucket |= np.repeat(np.arange(n_words, dtype=np.int32), per_word)
    by_bucket.sort()
    speakers = by_bucket.astype(np.int32)  # the lower half
    del by_bucket
    by_word = np.argsort(word, kind="stable")
    readers, read = doc[by_word], share[by_word]
    del by_word
    # every used bucket has a word and every word a document, so that no segment is empty
    first_speaker, first_reader = (np.cumsum(n) - n for n in (np.bincount(local), np.bincount(word)))
    heads = np.unique(doc, return_index=True)
    give_back()

    def forward(of_bucket: np.ndarray) -> np.ndarray:
        of_word = segment_sums(lambda a, b: of_bucket[local[a:b]], start, len(local)) * inverse
        out = np.zeros(n_docs)
        out[heads[0]] = segment_sums(lambda a, b: share[a:b] * of_word[word[a:b]], heads[1], len(word))
        return out

    def backward(of_doc: np.ndarray) -> np.ndarray:
        on_word = segment_sums(lambda a, b: read[a:b] * of_doc[readers[a:b]], first_reader, len(word)) * inverse
        return segment_sums(lambda a, b: on_word[speakers[a:b]], first_speaker, len(local))

    # two classes: a bucket acts by one number, its vector times the difference of the softmax's columns
    rng = np.random.default_rng(seed)
    params = [[rng.normal(0, 0.1, (DIM, len(used))).astype(np.float32), rng.normal(0, 0.5, DIM), np.zeros(1)]]
    params += [[x.copy() for x in params[0]] for _ in range(FOLDS)]
    moments = [[(np.zeros_like(x), np.zeros_like(x)) for x in own] for own in params]
    least, best, waited = -(POSITIVE * np.log(POSITIVE) + (1 - POSITIVE) * np.log(1 - POSITIVE)), None, 0
    share_of = np.where(y == 1, POSITIVE / max(y.sum(), 1), (1 - POSITIVE) / max((1 - y).sum(), 1))
    for step in range(1, epochs + 1):
        left_out = np.zeros(n_docs)
        for m, (own, memory) in enumerate(zip(params, moments)):
            vectors, soft, bias = own
            logit = forward(soft @ vectors * scale[m]) + bias
            if m < FOLDS:
                left_out[fold == m] = logit[fold == m]
            else:
                now = (soft @ vectors * scale[m], float(bias[0]))
            error = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y) * weight[m]
            on_bucket = backward(error) * scale[m]
            for x, g, (a, v) in zip(own, (np.outer(soft, on_bucket).astype(np.float32), vectors @ on_bucket, error.sum(keepdims=True)), memory):
                a += 0.1 * (g - a)
                v += 0.01 * (g * g - v)
                x -= RATE * (a / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-10) + DECAY * x
        loss = float((share_of * np.logaddexp(0, np.where(y == 1, -left_out, left_out))).sum())
        waited += 1
        if loss < least:
            least, best, waited = loss, now, 0
        elif waited == PATIENCE:
            break
    if best is None:
        return np.zeros(BUCKETS, np.float32), UNDECIDED
    out = np.zeros(BUCKETS, np.float32)
    out[used] = best[0]
    return out, best[1]


class Scorer:
    """Scores of texts; remembers the logit part of words."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.memo = weights, bias, {}

    @property
    def undecided(self) -> bool:
        """True if training learned nothing, so that no text is ever predicted toxic."""
        return self.bias == UNDECIDED and not self.weights.any()

    def learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 1 << 15):
            part = words[i:i + (1 << 15)]
            bucket, start = word_buckets(part, len(self.weights))
            sums = np.add.reduceat(self.weights[bucket].astype(np.float64), start)
            sums *= GAIN / np.diff(np.append(start, len(bucket)))
            self.memo.update(zip(part, sums.tolist()))

    def score(self, texts: list[str | None]) -> np.ndarray:
        logit = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            words = words_of(text)
            if words:
                memo = self.memo
                try:
                    logit[i] += sum(map(memo.__getitem__, words)) / len(words)
                except KeyError:
                    new = [w for w in dict.fromkeys(words) if w not in memo]
                    if len(memo) > WORDS:
                        memo.clear()
                        new = list(dict.fromkeys(words))
                    self.learn(new)
                    logit[i] += sum(map(memo.__getitem__, words)) / len(words)
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -500, 500)))


def whole_texts(sizes: list[int], room: int) -> list[int]:
    """Places of the texts taken: one after the other, each whole, those left aside that no longer fit into ``room``.

    Where none fits, the shortest is taken all the same.
    """
    taken, left = [], room
    for i, n in enumerate(sizes):
        if n <= left:
            taken.append(i)
            left -= n
    return taken or ([min(range(len(sizes)), key=sizes.__getitem__)] if sizes else [])


def pick_sample(docs: DataFrame, labels: DataFrame, per_class: int, most: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels to train on: per class the labelled documents with a text that come first in a hash order.

    ``docs`` has id and text, ``labels`` id and label. At most 2 * per_class rows reach the driver and, half of it for
    each class, ``most`` characters: a text that no longer fits is left aside whole. Repeated rows of an id and text
    count once.
    """
    labels = labels.filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    texts = docs.filter("id is not null and length(text) > 0").withColumn("h", F.xxhash64("id", "text", F.lit(2)))
    known = materialize(texts.select("id", "h", F.length("text").alias("n")).join(labels, "id"), "toxicity-known")
    chosen = []
    for k in (0, 1):
        rows = known.filter(F.col("label") == k).groupBy("id", "h").agg(F.max("n").alias("n")).orderBy("h", "id").limit(per_class).collect()
        chosen += [(rows[i]["id"], rows[i]["h"], k) for i in whole_texts([r["n"] for r in rows], most // 2)]
    if not chosen:
        return [], np.zeros(0)
    kind = known.schema["id"].dataType.simpleString()
    sent = F.broadcast(docs.sparkSession.createDataFrame(chosen, f"id {kind}, h long, label int"))  # 2 * per_class rows
    found = texts.join(sent, ["id", "h"]).select("id", "h", "label", "text")
    rows = found.dropDuplicates(["id", "h"]).orderBy("h", "id").collect()
    return [r["text"] for r in rows], np.array([r["label"] for r in rows])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most: int = SAMPLE_BYTES) -> Scorer:
    """A scorer from ``docs`` (id, text) and ``labels`` (id, label)."""
    texts, y = pick_sample(docs, labels, per_class, most)
    if len(set(y.tolist())) < 2:
        return Scorer(np.zeros(BUCKETS, np.float32), UNDECIDED)
    texts.reverse()
    scorer = Scorer(*train((texts.pop() for _ in range(len(texts))), y))  # a text goes once it is read
    give_back()
    return scorer


def score(docs: DataFrame, keep: list[str], text: str, scorer: Scorer) -> DataFrame:
    """Columns ``keep`` of every row with ``score``."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((scorer.weights, scorer.bias))
    at = keep.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(*sent.value)
        for batch in batches:
            for part in by_bytes(batch, at, SLICE):
                scores = own.score(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], pa.array(scores)], names=[*keep, "score"])

    schema = docs.select(*keep).schema.add("score", "double")
    return docs.select(*keep, *([] if text in keep else [F.col(text).alias("_text")])).mapInArrow(lean(run), schema)


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learned from; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def fit_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Scorer:
    """The scorer of documents (key, text) and ``labels`` (doc_id, toxic), held-out ids left aside."""
    seen = labels.filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    return fit(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), seen)


def q_op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, ["doc_id"], "text", fit_documents(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
