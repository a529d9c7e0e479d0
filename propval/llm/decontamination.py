"""Operator 11: benchmark decontamination with suffix arrays of the training texts.

Training texts are dealt into shards of whole documents. A task sorts all suffixes of a shard's word sequence by
prefix doubling; a suffix ends with its document, or at a word that no test item has, as no match can pass it. Every
test suffix is then looked up in every shard by binary search: each further word narrows its interval of the suffix
array, until none is left. The interval at the window's length gives all places of a window; the last one gives the
longest verbatim match of that test suffix with a place of it. Both arrays are exact to the length of the longest item.

The test set is the stated query set. It is sent out in blocks of bounded bytes; a task searches its shards for
one block after the other and holds one block's vocabulary at a time. Documents are read once and never shuffled.

Defined results: null and empty texts have no words and match nothing; repeated rows and null ids of documents give
one row each; repeated test rows count once, items of equal id are one item, an item without an id marks words but
is not listed; a very long text makes a shard of its own; without test items nothing is hit; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propval.llm.common import numbered, slices, table
from propval.llm.words import words

WINDOW = 10  # words of a window; a shorter item is one window
SHARD_BYTES = 6 << 20  # text bytes of a shard
BLOCK_BYTES = 32 << 20  # text bytes of a block of test items
FOUND = "n_words long, n_hit long, items array<string>, matches array<struct<item:string,item_at:int,doc_at:int,words:int>>"


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (size[0] values), start[1], ..."""
    first = np.cumsum(size) - size
    return np.repeat(start - first, size) + np.arange(int(size.sum()))


class SuffixArray:
    """Non-empty suffixes of a sequence of word numbers, each up to the next 0, in order by their first ``depth`` words.

    The sequence ends with a 0.
    """

    def __init__(self, seq: np.ndarray, depth: int):
        self.seq = seq = seq.astype(np.int64)
        ends = np.flatnonzero(seq == 0)
        at = np.flatnonzero(seq)
        left = ends[np.searchsorted(ends, at)] - at
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq[at], minlength=int(seq.max(initial=0)) + 1))])
        bits = max(int(seq.max(initial=1)).bit_length(), 1)
        h = max(1, 62 // bits)
        key = np.zeros(len(at), np.int64)
        for j in range(h):  # the first h words in one number
            word = seq[np.minimum(at + j, len(seq) - 1)]
            key = (key << bits) | np.where(left > j, word, 0)
        order = np.argsort(key, kind="stable")
        self.sa, left, key = at[order], left[order], key[order]
        rank = np.zeros(len(seq), np.int64)
        head = self._heads(key)
        rank[self.sa] = head + 1  # 0 where a suffix ends
        while h < depth and len(head):
            size = np.bincount(head, minlength=len(head))[head]
            todo = np.flatnonzero((size > 1) & (left >= h))
            if not len(todo):
                break
            sub, group = self.sa[todo], head[todo]
            key = group * (len(head) + 2) + rank[sub + h]
            order = np.argsort(key, kind="stable")
            sub, key = sub[order], key[order]
            self.sa[todo], left[todo] = sub, left[todo][order]
            head[todo] = todo[self._heads(key)]
            rank[sub] = head[todo] + 1
            h *= 2

    @staticmethod
    def _heads(key: np.ndarray) -> np.ndarray:
        """For each place of a sorted array, the first place of the same value."""
        fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        return np.repeat(fresh, np.diff(np.append(fresh, len(key))))

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, target: np.ndarray) -> np.ndarray:
        """First place of [lo, hi) whose word at ``depth`` is not under the target."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.seq[self.sa[mid] + depth] < target[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)

    def narrow(self, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of intervals of suffixes that agree on ``depth`` words whose next word is the given one."""
        if depth == 0:
            word = np.minimum(word, len(self.first) - 1)
            return self.first[word], self.first[np.minimum(word + 1, len(self.first) - 1)]
        lo = self._bound(lo, hi, depth, word)
        return lo, self._bound(lo, hi, depth, word + 1)


@dataclass
class Block:
    """Test items as one sequence of word numbers, each item followed by a 0."""

    vocabulary: dict[bytes, int]
    seq: np.ndarray
    item: np.ndarray  # row of ``names`` of each place
    at: np.ndarray  # offset in the item
    size: np.ndarray  # words of the window that starts at a place, 0 if none does
    names: list[str | None]
    depth: int

    @classmethod
    def of(cls, items: list[tuple[str | None, bytes | None]], window: int) -> Block:
        vocabulary: dict[bytes, int] = {}
        seq, item, at, size, names = [], [], [], [], []
        depth = 0
        for name, data in items:
            found = words(data)
            n = len(found)
            depth = max(depth, n)
            seq += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in found] + [0]
            item += [len(names)] * (n + 1)
            at += range(n + 1)
            size += [window] * (n - window + 1) + [0] * window if n >= window else ([n] + [0] * n if n else [0])
            names.append(name)
        return cls(vocabulary, *(np.array(a, np.int64) for a in (seq, item, at, size)), names, depth)


def search(sa: SuffixArray, block: Block) -> tuple[np.ndarray, ...]:
    """Of every test suffix: its place in the block, the interval of its window (empty if it has none or it does not
    occur), the words of its longest match and one place of that."""
    place = np.flatnonzero(block.seq)
    lo = np.zeros(len(place), np.int64)
    hi = np.full(len(place), len(sa.sa), np.int64)
    win_lo, win_hi, longest, where = (np.zeros(len(place), np.int64) for _ in range(4))
    live = np.arange(len(place))
    depth = 0
    while len(live):
        word = block.seq[place[live] + depth]
        live = live[word > 0]
        a, b = sa.narrow(lo[live], hi[live], depth, word[word > 0])
        live, a, b = live[b > a], a[b > a], b[b > a]
        depth += 1
        lo[live], hi[live], longest[live], where[live] = a, b, depth, sa.sa[a]
        here = live[block.size[place[live]] == depth]
        win_lo[here], win_hi[here] = lo[here], hi[here]
    return place, win_lo, win_hi, longest, where


class Shard:
    """Whole documents as word lists, and what the blocks searched so far mark in them."""

    def __init__(self, texts: list[bytes | None]):
        self.words = [words(t) for t in texts]
        self.n_words = np.array([len(w) for w in self.words], np.int64)
        self.start = np.cumsum(self.n_words + 1) - self.n_words - 1  # a 0 after each document
        self.hit = np.zeros(int(self.n_words.sum()) + len(texts), bool)
        self.items: list[set[str]] = [set() for _ in texts]
        self.matches: list[list[dict]] = [[] for _ in texts]

    def look_up(self, block: Block) -> None:
        seq = np.zeros(len(self.hit), np.int64)
        get = block.vocabulary.get
        for a, w in zip(self.start, self.words):
            seq[a:a + len(w)] = [get(x, 0) for x in w]
        sa = SuffixArray(seq, block.depth)
        place, lo, hi, longest, where = search(sa, block)
        found = np.flatnonzero(hi > lo)
        if not len(found):
            return
        # windows of equal words share an interval: each distinct one marks its places once
        distinct, first, kind = np.unique(lo[found] * (len(seq) + 1) + hi[found], return_index=True, return_inverse=True)
        first = found[first]
        count = hi[first] - lo[first]
        at = sa.sa[_ranges(lo[first], count)]
        size = np.repeat(block.size[place[first]], count)
        edge = np.bincount(at, minlength=len(seq) + 1) - np.bincount(at + size, minlength=len(seq) + 1)
        self.hit |= np.cumsum(edge)[:-1] > 0
        self._list_items(block, kind, block.item[place[found]], len(distinct), np.repeat(np.arange(len(distinct)), count), at)
        self._list_matches(block, place[found], longest[found], where[found])

    def _document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, at, "right") - 1

    def _list_items(self, block: Block, kind: np.ndarray, item: np.ndarray, kinds: int, of: np.ndarray, at: np.ndarray) -> None:
        """Items of every window kind that a document holds."""
        pair = np.unique(kind * len(block.names) + item)
        owner, member = pair // len(block.names), pair % len(block.names)
        begin = np.searchsorted(owner, np.arange(kinds + 1))
        held = np.unique(self._document(at) * kinds + of)
        docs, kind = held // kinds, held % kinds
        edges = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1], [True]]))
        for a, b in zip(edges[:-1], edges[1:]):
            k = kind[a:b]
            rows = np.unique(member[_ranges(begin[k], begin[k + 1] - begin[k])])
            self.items[docs[a]].update(n for n in map(block.names.__getitem__, rows) if n is not None)

    def _list_matches(self, block: Block, place: np.ndarray, longest: np.ndarray, where: np.ndarray) -> None:
        """Each item's longest match in this shard, kept with the document that holds it."""
        item = block.item[place]
        best = np.lexsort((block.at[place], -longest, item))
        best = best[np.concatenate([[True], item[best][1:] != item[best][:-1]])]
        for i, d in zip(best, self._document(where[best])):
            self.matches[d].append({"item": block.names[item[i]], "item_at": int(block.at[place[i]]),
                                    "doc_at": int(where[i] - self.start[d]), "words": int(longest[i])})

    def columns(self) -> list[pa.Array]:
        marked = np.concatenate([[0], np.cumsum(self.hit)])
        n_hit = marked[self.start + self.n_words] - marked[self.start]
        kind = pa.list_(pa.struct([("item", pa.string()), ("item_at", pa.int32()), ("doc_at", pa.int32()), ("words", pa.int32())]))
        return [pa.array(self.n_words), pa.array(n_hit), pa.array([sorted(s) for s in self.items], pa.list_(pa.string())), pa.array(self.matches, kind)]


def _blocks(benchmark: DataFrame, item: str, text: str, window: int) -> list[Broadcast]:
    """The distinct test rows in blocks, each collected and sent out by itself."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("binary").alias("data")).filter("length(data) > 0").distinct()
    total = rows.agg(F.sum(F.length("data").cast("long"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    sc = benchmark.sparkSession.sparkContext
    out = []
    for b in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item", "data"), F.lit(n)) == b)
        out.append(sc.broadcast([(r["item"], bytes(r["data"])) for r in part.sort("item", "data").collect()]))
    return out


def _released(block: Broadcast) -> list:
    """A block's rows, not kept by the worker, which can read them again from the executor's copy."""
    rows = block.value
    if getattr(block, "_path", None):
        vars(block).pop("_value", None)
    return rows


def find_matches(docs: DataFrame, keep: list[str], text: str, benchmark: DataFrame, item: str = "item_id",
                 item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Columns ``keep`` of every document with n_words, n_hit, items (ids as text, sorted) and matches.

    ``matches`` lists the test items whose longest verbatim match within the document's shard lies in the document:
    item, its first word there, the first word in the document, length in words (see ``longest_matches``).
    """
    blocks = _blocks(benchmark, item, item_text, window)
    names = [*keep, "n_words", "n_hit", "items", "matches"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [None, None]  # the block compiled last
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for a, b in slices([len(t or b"") for t in texts], SHARD_BYTES):
                shard = Shard(texts[a:b])
                for i, block in enumerate(blocks):
                    if compiled[0] != i:
                        compiled[:] = i, Block.of(_released(block), window)
                    shard.look_up(compiled[1])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], *shard.columns()], names=names)

    schema = T.StructType([*docs.select(*keep).schema, *T.StructType.fromDDL(FOUND)])
    return docs.select(*keep, F.col(text).cast("binary").alias("_data")).mapInArrow(run, schema)


def longest_matches(found: DataFrame, key: str) -> DataFrame:
    """Of every test item with a window in the training texts: its longest verbatim match and one place of it.

    ``found`` comes from ``find_matches``; ``key`` is one of its columns, reported as ``document``.
    """
    rows = found.select(F.col(key).alias("document"), F.explode("matches").alias("m")).select("document", "m.*")
    best = F.max_by(F.struct("document", "doc_at", "item_at"), F.struct("words", F.xxhash64("document", "doc_at")))
    return rows.groupBy("item").agg(F.max("words").alias("words"), best.alias("b")).select("item", "words", "b.*")


def decontaminate(docs: DataFrame, text: str, benchmark: DataFrame, item: str = "item_id", item_text: str = "text",
                  window: int = WINDOW) -> DataFrame:
    """The documents, all columns, in which no window of a test item occurs."""
    rows, name = numbered(docs)
    found = find_matches(rows, rows.columns, name[text], benchmark, item, item_text, window)
    return found.filter("n_hit = 0").select(*rows.columns).toDF(*docs.columns)


def q_op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole document inside a window of a benchmark item, and the items."""
    found = find_matches(table(spark, sf_dir, "documents"), ["doc_id"], "text", table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
