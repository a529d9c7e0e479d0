"""Operator 1: token counts by finite-state tokenizer compilation.

A byte-level BPE tokenizer file is compiled into two deterministic transducers.

* The splitter (``split_step``) reads character classes and marks where pieces start; a mark may be emitted one character late,
  which is all the look-ahead its pattern needs. Its transition functions form a small monoid. A slice of text is
  cut into chunks; every chunk's state map is a monoid element, built for all chunks at once, and a parallel
  prefix scan composes the elements, so that each chunk knows its start state and the marks follow in a second pass.
* The counter reads a piece's bytes and adds, on each transition, the change in the number of BPE tokens of the
  prefix read so far. Its state holds, for every suffix of the prefix that can still grow into a token, the last
  token before the suffix and the tokens between; states are compiled when first met and all pieces advance together.

BPE is decidable from left to right because a token sequence is the BPE result exactly if every two neighbours
keep their border: no merge across it would have come before the merges that made them (``Merges.keeps``).

Defined results: a null text counts as empty (0 bytes, 0 tokens); special strings of the file found in a text are
one token each, as the library does by default; ids may be null or repeated; no rows give no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propval.llm.common import slices, table

LIMIT = 512
SLICE = 1 << 20  # characters handled at once
CHUNK = 128  # characters of a chunk of the prefix scan
STATES = 1 << 16  # compiled states held at once; more make the table start anew
ALIKE = 256  # tokens below a trie node up to which states are merged by what may follow
SCALAR = 8  # pieces left below which they are walked one by one

# Letters and numbers of later Unicode versions than the tokenizer's own engine knows (first, last).
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9),
    (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81),
    (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED),
    (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)

# ---- the splitter: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+ ----

LETTER, SHORT, FIRST_RV, FIRST_L, LAST_E, NUMBER, SPACE, WHITE, APOSTROPHE, OTHER, END = range(11)
LETTERS = (LETTER, SHORT, FIRST_RV, FIRST_L, LAST_E)
BLANK = (SPACE, WHITE)
(BEGIN, WORD, DIGITS, SIGNS, ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE, QUOTE, QUOTE_RV, QUOTE_L, CLOSED) = range(12)
HERE, BEFORE = 1, 2  # a piece starts at this character; at the one before


def _opens(c: int) -> int:
    """State after a piece's first character."""
    if c in LETTERS:
        return WORD
    return {NUMBER: DIGITS, SPACE: ONE_SPACE, WHITE: ONE_WHITE, APOSTROPHE: QUOTE, OTHER: SIGNS}[c]


def _joined(c: int) -> int:
    """State after a blank's follower that belongs to its piece."""
    return WORD if c in LETTERS else DIGITS if c == NUMBER else SIGNS


def split_step(state: int, c: int) -> tuple[int, int]:
    """Next state and marks of one character class."""
    if c == END:
        return BEGIN, BEFORE if state in (QUOTE_RV, QUOTE_L) else 0
    if (state == WORD and c in LETTERS) or (state == DIGITS and c == NUMBER) or (state == SIGNS and c in (APOSTROPHE, OTHER)):
        return state, 0
    if state in (ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE):
        if c in BLANK:
            return (RUN_SPACE if c == SPACE else RUN_WHITE), 0
        if state == ONE_SPACE:
            return _joined(c), 0
        if state == ONE_WHITE:
            return _opens(c), HERE
        return (_joined(c), BEFORE) if state == RUN_SPACE else (_opens(c), BEFORE | HERE)
    if state == QUOTE:
        if c in (SHORT, FIRST_RV, FIRST_L):
            return {SHORT: CLOSED, FIRST_RV: QUOTE_RV, FIRST_L: QUOTE_L}[c], 0
        return (SIGNS, 0) if c in (APOSTROPHE, OTHER) else (_opens(c), HERE)
    if state in (QUOTE_RV, QUOTE_L):
        if c == (LAST_E if state == QUOTE_RV else FIRST_L):
            return CLOSED, 0
        return (WORD, BEFORE) if c in LETTERS else (_opens(c), BEFORE | HERE)
    return _opens(c), HERE


def class_table() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    text = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for pattern, c in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", WHITE)):
        found = "".join(regex.findall(pattern, text))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = c
    for first, last in LATER:
        out[first:last + 1] = OTHER
    for chars, c in (("stmd", SHORT), ("rv", FIRST_RV), ("l", FIRST_L), ("e", LAST_E), (" ", SPACE), ("'", APOSTROPHE)):
        out[[ord(x) for x in chars]] = c
    return out


class Splitter:
    """Transition tables of the splitter and of the monoid that its classes generate."""

    def __init__(self):
        n_states, n_classes = CLOSED + 1, END + 1
        step = [[split_step(s, c) for c in range(n_classes)] for s in range(n_states)]
        self.next = np.array([[x[0] for x in row] for row in step], np.uint8)
        self.marks = np.array([[x[1] for x in row] for row in step], np.uint8)
        maps = [tuple(range(n_states))]
        index, right = {maps[0]: 0}, []
        for m in maps:  # grows while it is read
            row = []
            for c in range(n_classes):
                after = tuple(int(self.next[s, c]) for s in m)
                if after not in index:
                    index[after] = len(maps)
                    maps.append(after)
                row.append(index[after])
            right.append(row)
        self.maps, self.right = np.array(maps, np.uint8), np.array(right, np.int32)
        self.product = np.array([[index[tuple(b[s] for s in a)] for b in maps] for a in maps], np.int32)
        self.classes = class_table()

    def starts(self, classes: np.ndarray) -> np.ndarray:
        """Positions at which a piece starts, of a sequence of classes read from BEGIN."""
        n = len(classes)
        chunks = -(-n // CHUNK)
        grid = np.full(chunks * CHUNK, END, np.uint8)
        grid[:n] = classes
        grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
        element = np.zeros(chunks, np.int32)
        for row in grid:
            element = self.right[element, row]
        shift = 1  # inclusive scan: after it, element i maps BEGIN to the state at the end of chunk i
        while shift < chunks:
            element = np.concatenate([element[:shift], self.product[element[:-shift], element[shift:]]])
            shift *= 2
        state = np.full(chunks, BEGIN, np.uint8)
        state[1:] = self.maps[element[:-1], BEGIN]
        marks = np.empty((CHUNK, chunks), np.uint8)
        for k, row in enumerate(grid):
            marks[k] = self.marks[state, row]
            state = self.next[state, row]
        marks = marks.T.reshape(-1)[:n]
        here = (marks & HERE) > 0
        here[:-1] |= (marks[1:] & BEFORE) > 0
        return np.flatnonzero(here)


# ---- the counter ----

def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where printable, else 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merge rules of a byte-level BPE: rank, halves and bytes of every token."""

    def __init__(self, model: dict):
        letters = byte_letters()
        rules = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ids: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.rank, self.left, self.right = [-1] * 256, list(range(256)), list(range(256))
        self.rule: dict[tuple[int, int], int] = {}
        code = lambda t: bytes(letters[ch] for ch in t)
        for r, (a, b) in enumerate(rules):
            x, y = code(a), code(b)
            if x + y in self.ids:
                raise ValueError("two rules make one token; this compiler needs one rule for each")
            self.ids[x + y] = len(self.rank)
            self.rule[self.ids[x], self.ids[y]] = r
            self.rank.append(r)
            self.left.append(self.ids[x])
            self.right.append(self.ids[y])
        sound = [True] * 256
        for t in range(256, len(self.rank)):
            a, b = self.left[t], self.right[t]
            sound.append(sound[a] and sound[b] and self.keeps(a, b, self.rank[t]))
        self.sound = sound

    def keeps(self, a: int, b: int, before: float = float("inf")) -> bool:
        """True if no merge crosses the border of neighbours a and b before the time ``before``.

        Time runs backwards: of both tokens the one made later is undone, and the pair that stood there just
        before must not have had a rule of an earlier time. Equal rules fire from the left.
        """
        rule, rank = self.rule, self.rank
        while True:
            r = rule.get((a, b))
            if r is not None and r < before:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                before, a = rank[a], self.right[a]
            else:
                before, b = rank[b] + 1, self.left[b]


class Counter:
    """The lazily compiled transducer from bytes to changes of the token count."""

    def __init__(self, merges: Merges, states: int = STATES):
        self.merges, self.limit = merges, states
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for text, t in merges.ids.items():
            if not merges.sound[t]:
                continue
            node = 0
            for b in text:
                at = self.child.get(node << 8 | b)
                if at is None:
                    at = self.child[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = at
            self.token[node] = t
        self.below: list[list[int]] = [[] for _ in self.token]  # children of each node
        for key, at in self.child.items():
            self.below[key >> 8].append(at)
        self.size = [0] * len(self.token)  # tokens below each node; children have larger numbers than their parents
        for node in range(len(self.token) - 1, -1, -1):
            self.size[node] = sum(self.size[c] + (self.token[c] >= 0) for c in self.below[node])
        self.border: dict[tuple[int, int], bool] = {}
        self.alike: dict[tuple[int, int], int] = {}
        self.allowed: dict[tuple[int, tuple], int] = {}
        self.reset()

    def stand_in(self, node: int, before: int) -> int:
        """A token that allows the same tokens below ``node`` to follow as ``before`` does; -2 if none can.

        States that differ only in such tokens are one state. Large subtrees keep the token itself.
        """
        if self.size[node] > ALIKE or before < 0:
            return before
        known = self.alike.get((node, before))
        if known is None:
            allowed, todo = [], [node]
            while todo:
                for c in self.below[todo.pop()]:
                    if self.token[c] >= 0 and self.merges.keeps(before, self.token[c]):
                        allowed.append(self.token[c])
                    if self.inner[c]:
                        todo.append(c)
            known = self.allowed.setdefault((node, tuple(allowed)), before) if allowed else -2
            if len(self.alike) > 4 * self.limit:
                self.alike.clear()
            self.alike[node, before] = known
        return known

    def reset(self) -> None:
        self.names: dict[tuple, int] = {}
        self.forms: list[tuple] = []
        self.table = np.full((1024, 256), -1, np.int32)  # next state << 8 | change + 128
        self.name(((0, -1, 0),))

    def name(self, form: tuple) -> int:
        at = self.names.get(form)
        if at is None:
            at = self.names[form] = len(self.forms)
            self.forms.append(form)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return at

    def keeps(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        known = self.border.get((a, b))
        if known is None:
            if len(self.border) > 4 * self.limit:
                self.border.clear()
            known = self.border[a, b] = self.merges.keeps(a, b)
        return known

    def compile(self, state: int, byte: int) -> int:
        """One transition. A state's parts are (trie node of a growing suffix, token before it, tokens from here)."""
        grown, last, change = [], -1, 0
        for node, before, tokens in self.forms[state]:
            at = self.child.get(node << 8 | byte)
            if at is None:
                continue
            t = self.token[at]
            if last < 0 and t >= 0 and self.keeps(before, t):
                last, change = t, tokens + 1
            if self.inner[at]:
                kin = self.stand_in(at, before)
                if kin != -2:
                    grown.append((at, kin, tokens))
        form = (*[(n, b, k - change) for n, b, k in grown], (0, last, 0))
        packed = self.name(form) << 8 | change + 128
        self.table[state, byte] = packed
        return packed

    def counts(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """BPE tokens of the pieces data[start : start + length]."""
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        total, state = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        active = np.searchsorted(-length, 0)  # pieces are read while longer than k
        k = 0
        while active > SCALAR:
            byte = data[start[:active] + k]
            packed = self.table[state[:active], byte]
            missing = np.flatnonzero(packed < 0)
            if len(missing):
                if len(self.forms) >= self.limit:
                    state[:active] = self._restart(state[:active])
                    missing = np.arange(active)
                for key in np.unique(state[missing] << 8 | byte[missing]).tolist():
                    self.compile(key >> 8, key & 255)
                packed = self.table[state[:active], byte]
            total[:active] += (packed & 255) - 128
            state[:active] = packed >> 8
            k += 1
            active = np.searchsorted(-length, -k)
        for i in range(active):
            at, n = int(state[i]), 0
            for byte in data[start[i] + k:start[i] + length[i]].tolist():
                packed = int(self.table[at, byte])
                if packed < 0:
                    if len(self.forms) >= self.limit:
                        state[i] = at
                        state[i:active] = self._restart(state[i:active])
                        at = int(state[i])
                    packed = self.compile(at, byte)
                n += (packed & 255) - 128
                at = packed >> 8
            total[i] += n
        out = np.empty_like(total)
        out[order] = total
        return out

    def _restart(self, live: np.ndarray) -> np.ndarray:
        """Forget all states but those in use; their new numbers."""
        used, back = np.unique(live, return_inverse=True)
        forms = [self.forms[s] for s in used]
        self.reset()
        return np.array([self.name(f) for f in forms], np.int64)[back]


class Compiled:
    """A compiled tokenizer file: token counts of texts."""

    def __init__(self, content: str, states: int = STATES):
        spec = json.loads(content)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if (spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
                or model.get("type") != "BPE" or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix")
                or model.get("end_of_word_suffix")):
            raise ValueError("only plain byte-level BPE files are compiled")
        added = [t for t in spec.get("added_tokens", [])]
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added):
            raise ValueError("added tokens that look at their neighbours are not compiled")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.splitter, self.counter = Splitter(), Counter(Merges(model), states)

    def _segments(self, text: str) -> Iterator[tuple[str, int]]:
        """Stretches of a text that are split on their own, with the special tokens that follow each.

        Very long stretches are cut before a space between a visible character and a letter, where a piece
        starts in any case.
        """
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from ((s, 0) for s in self._cut(text[at:m.start()]))
            yield "", 1
            at = m.end()
        yield from ((s, 0) for s in self._cut(text[at:] if at else text))

    @staticmethod
    def _cut(text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE:
            cut = re.compile(r"\S(?= [A-Za-z])").search(text, at + SLICE)
            if not cut:
                break
            yield text[at:cut.end()]
            at = cut.end()
        if at < len(text):
            yield text[at:] if at else text

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and tokens of each text."""
        n_bytes, n_tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        parts, of = [], []
        for i, text in enumerate(texts):
            for part, special in self._segments(text) if text else ():
                n_tokens[i] += special
                if part:
                    parts.append(part)
                    of.append(i)
            n_bytes[i] = len(text.encode()) if text else 0
        owner = np.array(of, np.int64)
        for a, b in slices([len(p) for p in parts], SLICE):
            np.add.at(n_tokens, owner[a:b], self._count_slice(parts[a:b]))
        return n_bytes, n_tokens

    def _count_slice(self, parts: list[str]) -> np.ndarray:
        joined = "\n".join(parts) + "\n"  # one character for each end
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        classes = self.splitter.classes[points]
        classes[ends] = END
        starts = self.splitter.starts(classes)
        wide = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        offset = np.concatenate([[0], np.cumsum(wide)])
        stops = np.empty_like(starts)  # a piece ends at the next start or at its part's end
        part = np.searchsorted(ends, starts, "right")
        stops[:-1], stops[-1:] = starts[1:], len(points)
        stops = np.minimum(stops, ends[part])
        data = np.frombuffer(joined.encode(), np.uint8)
        tokens = self.counter.counts(data, offset[starts], offset[stops] - offset[starts])
        return np.bincount(part, tokens, len(parts)).astype(np.int64)


_COMPILED: dict[int, Compiled] = {}  # of this worker process


def compiled(content: str) -> Compiled:
    key = hash(content)
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Compiled(content)
    return _COMPILED[key]


def token_counts(docs: DataFrame, keep: list[str], text: str, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """Columns ``keep`` of every row with n_bytes, n_tokens and over_limit of its whole text.

    ``tokenizer`` is the path of a file on the driver (a few MB), sent to the executors.
    """
    with open(tokenizer, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_tokens = compiled(content.value).count(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                                             names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    schema = docs.select(*keep).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def q_op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, tokens and whether they exceed 512 of every whole document, by byte_bpe_50k.json."""
    import public_tokenizers
    return token_counts(table(spark, sf_dir, "documents"), ["doc_id"], "text", public_tokenizers.path("byte_bpe_50k.json"))
