"""Operator 10: SentencePiece encoding and decoding by batched numpy Viterbi.

A text is cut into words wherever no piece holds the two characters side by side. New words of one length advance
together: hashes of all their substrings probe the sorted hashes of the pieces, and per position a vectorised maximum
over the piece lengths keeps the best path and its back-pointer. Words met before are found by their own hash in a
bounded table of sorted keys, so that a slice of texts is encoded without a step per word.

Unigram models maximise the sum of piece scores. BPE models ask for the merges' result instead of a sum; there a
path may only put a piece behind another if the border between them holds (no merge across it would have come
before the merges that made them), its score is 0 if it does and minus infinity if not, and exactly one path to
each position is left. Runs of spaces, whose pieces share one score, are merged by their own rule.

Defined results: null and empty texts have no ids and decode to the empty text; characters that no piece holds
become byte pieces, or the unknown id in models without them; a space and U+2581 are the same character to the
model, so U+2581 comes back as a space; ids may be null or repeated; no rows give no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propval.llm.common import by_bytes, lean, small_batches, table

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)  # fixed values: kinds of pieces
UNIGRAM, BPE = 1, 2  # fixed values: kinds of models
UNKNOWN_PENALTY = 10.0  # fixed value: an unknown character scores this much less than the worst piece
BASE = 0x9E3779B97F4A7C15  # odd base of the substring hash
LONG = 48  # characters of a word up to which it is encoded in a batch and remembered
WORDS = 200_000  # words remembered at once
PAIRS = 400_000  # borders remembered at once
FRESH = 20_000  # newly decided borders after which they are merged with the sorted ones
SLICE = 1 << 19  # bytes of text handled at once
GROUP = 1 << 14  # words of one length that advance together


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer's fields: integers, floats' bytes, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at:at + n]
            at += n


class Model:
    """Pieces, scores and flags of a model file."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        trainer, normalizer = {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.type, self.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        self.dummy_prefix = bool(normalizer.get(3, 1))
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only models without normalisation, that keep spaces and mark them in front, are read")
        if self.type not in (UNIGRAM, BPE) or USER_DEFINED in self.kinds or UNUSED in self.kinds:
            raise ValueError("only unigram and BPE models without user-defined or unused pieces are read")


class Borders:
    """For BPE: which pieces may stand side by side. Ranks are the order of scores; single characters come first."""

    def __init__(self, ids: dict[str, int], scores: list[float], runs: set[int]):
        order = sorted((t for t in ids.values() if t not in runs), key=lambda t: -scores[t])
        text = {t: p for p, t in ids.items()}
        merged = [t for t in order if len(text[t]) > 1]
        if len({scores[t] for t in merged}) < len(merged):
            raise ValueError("pieces of one score leave their merges' order open")
        self.rank = {text[t]: r for r, t in enumerate(merged)}
        self.halves: dict[str, tuple[str, str]] = {}
        self.sound = {ch for p in ids for ch in p}
        for t in merged:
            p = text[t]
            for cut in range(1, len(p)):
                a, b = p[:cut], p[cut:]
                if (a in self.sound and b in self.sound and self.rank.get(a, -1) < self.rank[p] and self.rank.get(b, -1) < self.rank[p]
                        and self.keeps(a, b, self.rank[p])):
                    self.halves[p] = (a, b)
                    self.sound.add(p)
                    break

    def keeps(self, a: str, b: str, before: float = float("inf")) -> bool:
        """True if no merge crosses the border of a and b before ``before``; later merges are undone first."""
        while True:
            r = self.rank.get(a + b)
            if r is not None and r < before:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                before, a = ra, self.halves[a][1]
            else:
                before, b = rb + 1, self.halves[b][0]


class Encoder:
    """Encoding and decoding of one model."""

    def __init__(self, data: bytes):
        self.model = m = Model(data)
        self.ids = {p: t for t, p in enumerate(m.pieces) if m.kinds[t] == NORMAL}
        self.runs = {t for p, t in self.ids.items() if len(p) > 1 and not p.strip(SPACE)}
        words = [p for p, t in self.ids.items() if t not in self.runs]
        if any(SPACE in p[1:] for p in words):
            raise ValueError("pieces that cross a space are not read")
        self.bpe = m.type == BPE
        self.byte_ids = {int(p[3:5], 16): t for t, p in enumerate(m.pieces) if m.kinds[t] == BYTE}
        self.unknown = m.kinds.index(UNKNOWN) if UNKNOWN in m.kinds else 0
        if self.bpe:
            if self.runs and max(m.scores[t] for t in self.runs) >= min([m.scores[self.ids[p]] for p in words if len(p) > 1], default=0.0):
                raise ValueError("runs of spaces must merge after all other pieces")
            self.borders = Borders(self.ids, m.scores, self.runs)
        elif self.runs:
            raise ValueError("unigram models with pieces for runs of spaces are not read")
        # symbols: pieces by number, then single characters that only occur inside pieces, then the unknown character
        self.symbols = list(m.pieces)
        usable = {p: self.ids[p] for p in words if not self.bpe or p in self.borders.sound}
        if self.bpe:
            for ch in sorted(self.borders.sound - set(self.ids)):
                if len(ch) == 1:
                    usable[ch] = len(self.symbols)
                    self.symbols.append(ch)
        self.lone = len(self.symbols)
        self.symbols.append("�")
        low = min([s for s, k in zip(m.scores, m.kinds) if k == NORMAL], default=0.0) - UNKNOWN_PENALTY
        self.score = np.array([*m.scores, *[0.0] * (self.lone - len(m.scores)), low])
        self.usable, self.longest = usable, max(map(len, usable), default=1)
        by_length: dict[int, list[str]] = {}
        for p in usable:
            by_length.setdefault(len(p), []).append(p)
        self.probe = {}
        for n, ps in by_length.items():
            points = np.frombuffer("".join(ps).encode("utf-32-le"), np.uint32).reshape(-1, n)
            keys = self._prefix(points)[:, n]
            order = np.argsort(keys)
            if len(np.unique(keys)) < len(keys):
                raise ValueError("two pieces share a hash; choose another base")
            self.probe[n] = (keys[order], np.array([usable[p] for p in ps])[order])
        # characters of pieces by number (0: in no piece), and which of them stand side by side inside a piece
        inner = sorted({ch for p in usable for ch in p})
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(ch) for ch in inner]] = np.arange(1, len(inner) + 1)
        self.beside = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for p in usable:
            at = self.number[[ord(ch) for ch in p]]
            self.beside[at[:-1], at[1:]] = True
        self.known: dict[int, bool] = {}  # borders decided since the sorted ones were last merged
        self.pairs, self.held = np.array([-1], np.int64), np.array([False])
        self.single: dict[int, bool] = {}  # borders that long words asked for
        self.spaces: dict[int, list[int]] = {}
        self.forget()

    def forget(self) -> None:
        """Empty the table of words: sorted keys, and where each word's ids are."""
        self.keys, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    @staticmethod
    def _prefix(points: np.ndarray) -> np.ndarray:
        """(words, n + 1) hashes of the words' prefixes."""
        out = np.zeros((len(points), points.shape[1] + 1), np.uint64)
        for i in range(points.shape[1]):
            out[:, i + 1] = out[:, i] * np.uint64(BASE) + points[:, i].astype(np.uint64) + np.uint64(1)
        return out

    def _found(self, points: np.ndarray) -> np.ndarray:
        """(words, end, length - 1) piece numbers of all substrings, -1 where there is none."""
        words, n = points.shape
        prefix, out = self._prefix(points), np.full((words, n + 1, min(n, self.longest)), -1, np.int64)
        power = 1
        for length in range(1, out.shape[2] + 1):
            power = power * BASE & 0xFFFFFFFFFFFFFFFF
            if length not in self.probe:
                continue
            keys, numbers = self.probe[length]
            h = prefix[:, length:] - prefix[:, :-length] * np.uint64(power)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            out[:, length:, length - 1] = np.where(keys[at] == h, numbers[at], -1)
        out[:, 1:, 0] = np.where(out[:, 1:, 0] < 0, self.lone, out[:, 1:, 0])
        return out

    def _holds(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether borders hold; each distinct pair is decided once and then found among the sorted pairs."""
        pairs, back = np.unique(before * len(self.symbols) + after, return_inverse=True)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        out = self.held[at]
        for i in np.flatnonzero(self.pairs[at] != pairs).tolist():
            pair = int(pairs[i])
            held = self.known.get(pair)
            if held is None:
                a, b = divmod(pair, len(self.symbols))
                held = self.known[pair] = a == self.lone or b == self.lone or self.borders.keeps(self.symbols[a], self.symbols[b])
            out[i] = held
        if len(self.known) > FRESH:
            if len(self.pairs) > PAIRS:
                self.pairs, self.held = self.pairs[:1], self.held[:1]
            keys = np.append(self.pairs, np.array(list(self.known), np.int64))
            held = np.append(self.held, np.array(list(self.known.values()), bool))
            sort = np.argsort(keys)
            self.pairs, self.held = keys[sort], held[sort]
            self.known.clear()
        return out[back]

    def viterbi(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words of one length, given as a matrix of code points: all in a row, and how many each word has."""
        words, n = points.shape
        found = self._found(points)
        best, last = np.full((words, n + 1), -np.inf), np.full((words, n + 1), -1, np.int64)
        best[:, 0] = 0.0
        back = np.zeros((words, n + 1), np.int64)
        for end in range(1, n + 1):
            lengths = min(end, self.longest)
            piece = found[:, end, :lengths]  # column: length - 1
            before, ahead = best[:, end - lengths:end][:, ::-1], last[:, end - lengths:end][:, ::-1]
            ok = (piece >= 0) & (before > -np.inf)
            if self.bpe:
                w, c = np.nonzero(ok & (np.arange(lengths)[None] < end - 1))
                if len(w):
                    ok[w, c] = self._holds(ahead[w, c], piece[w, c])
            candidate = np.where(ok, before if self.bpe else before + self.score[piece], -np.inf)
            back[:, end] = candidate.argmax(axis=1) + 1
            best[:, end] = candidate[np.arange(words), back[:, end] - 1]
            last[:, end] = found[np.arange(words), end, back[:, end] - 1]
        if not np.isfinite(best[:, n]).all():
            raise RuntimeError("a word has no path")
        taken, counts = np.zeros((words, n), np.int64), np.zeros(words, np.int64)
        at, rows = np.full(words, n), np.arange(words)
        while len(rows):
            taken[rows, counts[rows]] = last[rows, at[rows]]
            counts[rows] += 1
            at[rows] -= back[rows, at[rows]]
            rows = rows[at[rows] > 0]
        nth = np.arange(n)[None]
        behind = np.maximum(counts[:, None] - 1 - nth, 0)  # paths were found from the end
        return taken[np.arange(words)[:, None], behind][nth < counts[:, None]], counts

    def _border(self, before: int, after: int) -> bool:
        pair = before * len(self.symbols) + after
        held = self.single.get(pair)
        if held is None:
            if len(self.single) > PAIRS:
                self.single.clear()
            held = self.single[pair] = bool(self._holds(np.array([before]), np.array([after]))[0])
        return held

    def walk(self, word: str) -> list[int]:
        """The same path for one long word."""
        n, usable = len(word), self.usable
        best, last, back = [0.0] + [-np.inf] * n, [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for length in range(1, min(end, self.longest) + 1):
                piece = usable.get(word[end - length:end], self.lone if length == 1 else -1)
                if piece < 0 or best[end - length] == -np.inf:
                    continue
                if self.bpe:
                    if end > length and not self._border(last[end - length], piece):
                        continue
                    value = best[end - length]
                else:
                    value = best[end - length] + self.score[piece]
                if value > best[end]:
                    best[end], last[end], back[end] = value, piece, length
        out, at = [], n
        while at:
            out.append(last[at])
            at -= back[at]
        return out[::-1]

    def _ids(self, symbols: list[int], word: str) -> list[int]:
        """Piece ids of a path: characters without a piece become byte pieces or the unknown id."""
        n = len(self.model.pieces)
        if all(s < n for s in symbols):
            return symbols
        out, at, was_unknown = [], 0, False
        for s in symbols:
            text = word[at] if s >= n else self.model.pieces[s]
            at += len(text)
            if s < n:
                out.append(s)
            elif self.byte_ids and self.model.byte_fallback:
                out += [self.byte_ids[b] for b in text.encode()]
            elif not was_unknown:
                out.append(self.unknown)
            was_unknown = s >= n
        return out

    def learn(self, points: np.ndarray, keys: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        """Encode new words, those of one length in one go, and add them to the table."""
        flat, first, count, order = [self.flat], [self.first], [self.count], [self.keys]
        total, pieces = len(self.flat), len(self.model.pieces)
        for n in np.unique(length).tolist():
            of = np.flatnonzero(length == n)
            for i in range(0, len(of), GROUP):
                part = of[i:i + GROUP]
                matrix = points[start[part, None] + np.arange(n)[None]]
                symbols, counts = self.viterbi(matrix)
                if (symbols >= pieces).any():  # characters without a piece
                    ends = np.cumsum(counts)
                    texts = [row.tobytes().decode("utf-32-le") for row in matrix]
                    ids = [self._ids(symbols[e - c:e].tolist(), t) for e, c, t in zip(ends, counts, texts)]
                    counts, symbols = np.array([len(x) for x in ids]), np.concatenate([np.array(x, np.int64) for x in ids])
                flat.append(symbols.astype(np.int32))
                first.append(total + np.cumsum(counts) - counts)
                count.append(counts)
                order.append(keys[part])
                total += len(symbols)
        self.flat, self.first, self.count, self.keys = map(np.concatenate, (flat, first, count, order))
        sort = np.argsort(self.keys)
        self.keys, self.first, self.count = self.keys[sort], self.first[sort], self.count[sort]

    def run_of_spaces(self, n: int) -> list[int]:
        """Ids of n spaces that no word took: neighbours merge from the left as long as a piece holds them."""
        known = self.spaces.get(n)
        if known is None:
            parts = [1] * n
            while True:
                at = next((i for i in range(len(parts) - 1) if SPACE * (parts[i] + parts[i + 1]) in self.ids), None)
                if at is None:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            known = [x for k in parts for x in self._ids([self.usable.get(SPACE, self.lone)] if k == 1 else [self.ids[SPACE * k]], SPACE * k)]
            if len(self.spaces) < 10_000:
                self.spaces[n] = known
        return known

    def _words(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of the words: borders are where texts start and where no piece holds both characters."""
        number = self.number[points]
        border = np.ones(len(points), bool)
        border[1:] = ~self.beside[number[:-1], number[1:]]
        border[starts] = True
        start = np.flatnonzero(border)
        return start, np.diff(np.append(start, len(points)))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        mark = SPACE if self.model.dummy_prefix else ""
        marked = [mark + t.replace(" ", SPACE) if t else "" for t in texts]
        sizes = np.array([len(t) for t in marked], np.int64)
        points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        if not len(points):
            return [np.zeros(0, np.int32) for _ in texts]
        offsets = np.cumsum(sizes) - sizes
        start, length = self._words(points, offsets[sizes > 0])
        # a word's key: its characters' powers of the base, brought to the word's start
        powers = lambda base: np.cumprod(np.append(np.ones(1, np.uint64), np.full(len(points), base, np.uint64)))
        power, back = powers(BASE), powers(pow(BASE, -1, 1 << 64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:-1])])
        key = (sums[start + length] - sums[start]) * back[start]
        short = np.flatnonzero(length <= LONG)
        distinct, example = np.unique(key[short], return_index=True)
        example = short[example]
        if len(self.keys) > WORDS:
            self.forget()
        at = np.searchsorted(self.keys, distinct)
        new = at == len(self.keys)
        new[~new] = self.keys[at[~new]] != distinct[~new]
        if new.any():
            self.learn(points, distinct[new], start[example[new]], length[example[new]])
        place = np.searchsorted(self.keys, key[short])
        first, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        first[short], count[short] = self.first[place], self.count[place]
        flat = [self.flat]
        total = len(self.flat)
        for w in np.flatnonzero(length > LONG).tolist():  # walked one by one, not remembered
            word = points[start[w]:start[w] + length[w]].tobytes().decode("utf-32-le")
            ids = np.array(self._ids(self.walk(word), word), np.int32)
            first[w], count[w] = total, len(ids)
            flat.append(ids)
            total += len(ids)
        flat = np.concatenate(flat) if len(flat) > 1 else self.flat
        ends = np.cumsum(count)
        ids = flat[np.repeat(first - ends + count, count) + np.arange(ends[-1])]
        text_of = np.repeat(np.searchsorted(offsets[sizes > 0], start, "right") - 1, count)
        per_text = np.bincount(text_of, minlength=int((sizes > 0).sum()))
        parts = iter(np.split(ids, np.cumsum(per_text)[:-1]))
        return [self._merged(next(parts)) if n else np.zeros(0, np.int32) for n in sizes.tolist()]

    def _merged(self, ids: np.ndarray) -> np.ndarray:
        """Runs of spaces by their own rule; unknown characters in a row as one, where there are no byte pieces."""
        lone = self.usable.get(SPACE) if self.runs else None
        repeats = np.flatnonzero((ids[1:] == ids[:-1]) & ((ids[1:] == (-1 if lone is None else lone)) | (ids[1:] == self.unknown)))
        if not len(repeats):
            return ids
        out, at = [], 0
        for run in np.split(repeats, np.flatnonzero(np.diff(repeats) > 1) + 1):
            a, n = int(run[0]), len(run) + 1
            unknown = ids[a] == self.unknown
            out += [ids[at:a], np.array([self.unknown] if unknown else self.run_of_spaces(n), np.int32)]
            at = a + n
        return np.concatenate([*out, ids[at:]]).astype(np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids."""
        m, out, raw = self.model, [], bytearray()
        for t in ids.tolist():
            if m.kinds[t] == BYTE:
                raw.append(int(m.pieces[t][3:5], 16))
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            out.append(" ⁇ " if m.kinds[t] == UNKNOWN else "" if m.kinds[t] == CONTROL else m.pieces[t])
        out.append(_utf8(bytes(raw)))
        if self.model.dummy_prefix and out and out[0].startswith(SPACE):
            out[0] = out[0][1:]
        return "".join(out).replace(SPACE, " ")


def _utf8(raw: bytes) -> str:
    """Bytes as text, every byte that is not part of a character as U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        return raw[:e.start].decode() + "�" + _utf8(raw[e.start + 1:])


_ENCODERS: dict[int, Encoder] = {}  # of this worker process


def encoder(data: bytes) -> Encoder:
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(data)
    return _ENCODERS[key]


def _content(docs: DataFrame, path: str):
    """The model file (a few MB, read on the driver) as a broadcast."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, keep: list[str], text: str, model: str, check: bool = False) -> DataFrame:
    """Columns ``keep`` of every row with ``ids``; with ``check`` also whether decoding gives the text back."""
    small_batches(docs.sparkSession)
    content = _content(docs, model)
    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType()))
    schema = schema.add("round_trip", "boolean") if check else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            enc = encoder(content.value)
            for part in by_bytes(batch, len(keep), SLICE):
                texts = part.column(len(keep)).to_pylist()
                ids = enc.encode(texts)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                columns = [*part.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))]
                if check:
                    columns.append(pa.array([enc.decode(x) == (t or "").replace(SPACE, " ") for x, t in zip(ids, texts)]))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(lean(run), schema)


def decode(rows: DataFrame, keep: list[str], ids: str, model: str) -> DataFrame:
    """Columns ``keep`` of every row with ``text``, decoded from an array of ids (null: empty)."""
    small_batches(rows.sparkSession)
    content = _content(rows, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            enc = encoder(content.value)
            texts = [enc.decode(np.array(x or [], np.int32)) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    return rows.select(*keep, F.col(ids).cast("array<int>").alias("_ids")).mapInArrow(lean(run), rows.select(*keep).schema.add("text", "string"))


def q_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document by piece_bpe_32k.model, and whether they decode to its text."""
    import public_tokenizers
    found = encode(table(spark, sf_dir, "documents"), ["doc_id"], "text", public_tokenizers.path("piece_bpe_32k.model"), check=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")
