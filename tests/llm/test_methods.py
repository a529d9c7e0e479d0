"""The methods themselves: exactness against brute force, recall, held-out accuracy, damage."""

import gzip
import hashlib
import io

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from propval.llm import components as cc
from propval.llm import multi_index, sentencepiece_viterbi, simhash, token_counts, topk, toxicity, warc
from tests.llm.test_ops_on_odd_rows import components

SF = "/root/testdata/sf0.01"


def texts(spark, n=400):
    found = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(n).collect()]
    rng = np.random.default_rng(1)
    odd = list("aest'rvlmdhino  \n\t1!é日Ⅳ́▁")
    return found + ["".join(rng.choice(odd, rng.integers(0, 60))) for _ in range(4000)] + [
        "".join(map(chr, rng.choice([*range(1, 0x300), *range(0x2000, 0x3100), 0x1F642], 40))) for _ in range(500)]


# ---- operator 1

def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, all_texts = Tokenizer.from_file(path), texts(spark)
    with open(path, encoding="utf-8") as f:
        own = token_counts.Compiled(f.read(), states=4000)  # small, so that the table starts anew many times
    n_bytes, n_tokens = own.count(all_texts)
    assert n_tokens.tolist() == [len(e.ids) for e in lib.encode_batch(all_texts, add_special_tokens=False)]
    assert n_bytes.tolist() == [len(t.encode()) for t in all_texts]
    hard = ["a" * 30_000, "word " * 300_000, "日" * 20_000]
    assert own.count(hard)[1].tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in hard]


def test_splitter_classes_equal_the_library():
    pre = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).pre_tokenizer
    table = token_counts.class_table()
    for c in [*range(0x3400), *range(0xA000, 0xABFF), *range(0x10000, 0x1FFFF, 7)]:
        one = lambda a: len(pre.pre_tokenize_str(a + chr(c))) == 1  # noqa: B023, E731
        kind = token_counts.LETTER if one("a") else token_counts.NUMBER if one("1") else token_counts.OTHER if one("!") else token_counts.WHITE
        own = table[c]
        own = token_counts.LETTER if own in token_counts.LETTERS else {token_counts.APOSTROPHE: token_counts.OTHER, token_counts.SPACE: token_counts.WHITE}.get(own, own)
        assert own == kind, hex(c)


def test_prefix_scan_equals_a_serial_walk():
    s, rng = token_counts.Splitter(), np.random.default_rng(3)
    for n in (1, 127, 128, 129, 5000):
        classes = rng.integers(0, token_counts.END + 1, n).astype(np.uint8)
        state, here = token_counts.BEGIN, np.zeros(n, bool)
        for i, c in enumerate(classes.tolist()):
            state, marks = token_counts.split_step(state, c)
            here[i] |= bool(marks & token_counts.HERE)
            if marks & token_counts.BEFORE:
                here[i - 1] = True
        assert s.starts(classes).tolist() == np.flatnonzero(here).tolist()


# ---- operator 2

def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghiklmnoprstuvw"), rng.integers(2, 9))) for _ in range(3000)]
    bad = ["grumblefrotz", "snarkwobble", "dreckmuffin"]

    def doc(toxic, spell):
        ws = list(rng.choice(words, rng.integers(20, 200)))
        for _ in range(max(1, len(ws) // 40) if toxic else 0):
            w = str(rng.choice(bad))
            ws[rng.integers(0, len(ws))] = w[:3] + w[4:] if spell else w
        return " ".join(ws)

    y = np.arange(600) % 2
    scorer = toxicity.Scorer(*toxicity.train([doc(t, False) for t in y], y))
    assert np.mean((scorer.score([doc(t, False) for t in y]) >= 0.5) == y) > 0.97
    assert np.mean((scorer.score([doc(t, True) for t in y]) >= 0.5) == y) > 0.9  # misspellings never seen
    assert scorer.score(["", None])[0] == scorer.score([None])[0]


def test_toxicity_learns_from_few_labels():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghiklmnoprstuvw"), rng.integers(2, 9))) for _ in range(3000)]

    def doc(toxic):
        ws = list(rng.choice(words, 60))
        for _ in range(3 if toxic else 0):
            ws[rng.integers(0, len(ws))] = "grumblefrotz"
        return " ".join(ws)

    y = np.arange(40) % 4 == 0  # no bucket reaches 7 standard deviations in 40 documents
    scorer = toxicity.Scorer(*toxicity.train([doc(t) for t in y], y.astype(int)))
    new = np.arange(200) % 2
    found = scorer.score([doc(t) for t in new]) >= 0.5
    assert found[new == 1].mean() > 0.9 and found[new == 0].mean() < 0.05


# ---- operator 3

def test_search_block_equals_brute_force():
    rng = np.random.default_rng(2)
    v = np.floor(1024 * rng.normal(size=(500, 24)) * rng.gamma(1, 1, (500, 1)))
    v[100:110] = v[100]
    ids, turn = np.arange(500) * 3, np.linalg.svd(v.T @ v)[0]
    q = v[:40]
    exact = (q @ v.T).astype(int)
    for floor in (-np.inf, 0.0):
        floors = np.full(40, floor) if floor else np.sort(np.where(np.eye(40, 500), -10**12, exact))[:, -10].astype(float)
        got = {i: list(zip(ids[js].tolist(), s.tolist())) for i, js, s in topk.search_block(q, ids[:40], floors, v, ids, turn)}
        for i in range(40):
            best = sorted((-exact[i, j], ids[j]) for j in range(500) if j != i)[:10]
            assert got[i] == [(j, -s) for s, j in best]


def test_top_k_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 8)) * rng.gamma(2, 1, (2000, 1))
    x[500:600] = x[500]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    from pyspark.sql import functions as F
    got = {}
    for r in topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    v = np.floor(1024 * x).astype(int)
    assert set(got) == set(range(0, 2000, 100))
    for q in got:
        s = v @ v[q]
        best = sorted((-s[j], j) for j in range(2000) if j != q)[:10]
        assert sorted(got[q]) == [(n + 1, j, -score) for n, (score, j) in enumerate(best)]


def test_top_k_sends_no_vectors_between_tasks(spark, monkeypatch):
    """Groups of one query block each: what is left to shuffle are the found pairs (before: blocks met by a shuffled join)."""
    from pyspark.sql import functions as F
    x = np.random.default_rng(5).normal(size=(1200, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    want = topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect()
    for name, value in (("BLOCK", 64), ("QUERIES", 8), ("GROUP_BYTES", 1)):
        monkeypatch.setattr(topk, name, value)
    out = topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "qvecs" not in plan
    assert sorted(out.collect()) == sorted(want) and len(want) == 600


# ---- operator 5

def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 10, dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.25 * rng.normal(size=(n, dim))
    return x.astype(np.float32)


def test_multi_index_recall_and_counts(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 32)  # many blocks in a cell
    x = clustered(3000, 32, 6)
    x[:200] = x[0] + 0.01 * np.random.default_rng(1).normal(size=(200, 32))
    x[200:260] = x[200]
    label = np.arange(3000) % 3
    df = spark.createDataFrame([(i, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(x, label))], "v long, e array<float>, l int")
    got = {r.vec_id: r for r in multi_index.near_vectors(df, "v", "e", "l").collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None]) & ~np.eye(3000, dtype=bool)
    true = near.sum(1)
    found = np.array([got[i].n_links for i in range(3000)])
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum() and true.sum() > 10_000
    if found.sum() == true.sum():
        want = components(range(3000), list(zip(*np.nonzero(near))))
        assert all(got[i].component_id == want[i] for i in range(3000))


def test_multi_sequence_visits_cells_in_order():
    a, b = np.array([0.0, 0.3, 0.1]), np.array([0.2, 0.0])
    cells = multi_index.multi_sequence(a, b, 0.31)
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums) and set(cells) == {(0, 0), (0, 1), (1, 1), (2, 0), (2, 1)}


# ---- operator 6

def archive(records):
    return b"".join(warc.member(r) + warc.EMPTY_MEMBER for r in records)


def rec(i, payload, refers=None):
    return warc.record(str(i), "http://x", payload, hashlib.sha256(payload).hexdigest(), refers)


def test_salvage_goes_on_behind_damage():
    records = [rec(i, bytes([65 + i]) * 500 + b"\x1f\x8b\x08 WARC/1.1\r\n") for i in range(6)] + [rec(9, b"x" * 200, "1")]
    data = archive(records)
    clean = list(warc.salvage(data))
    assert [r["record_id"] for r in clean] == ["0", "1", "2", "3", "4", "5", "9"] and clean[-1]["refers_to"] == "1"
    assert gzip.GzipFile(fileobj=io.BytesIO(data)).read() == b"".join(records)  # a plain multi-member file
    start, stop = clean[2]["start"], clean[2]["stop"]
    hit = bytearray(data)
    hit[start + 40] ^= 0xFF
    found = list(warc.salvage(bytes(hit)))
    gaps = [r for r in found if r["record_type"] == "gap"]
    assert [r["record_id"] for r in found if r["record_type"] != "gap"] == ["0", "1", "3", "4", "5", "9"]
    assert [(g["start"], g["stop"]) for g in gaps] == [(start, stop)]
    torn = list(warc.salvage(b"\x00junk" + data[:-40]))
    assert torn[0]["record_type"] == "gap" and torn[0]["start"] == 0 and torn[0]["stop"] == 5 and torn[-1]["record_type"] == "gap"
    assert [r["record_id"] for r in torn if r["record_type"] != "gap"][:6] == ["0", "1", "2", "3", "4", "5"]


def test_salvage_of_plain_records_and_bad_digests():
    good = [rec(i, bytes([97 + i]) * 300) for i in range(3)]
    bad = good[1].replace(b"b" * 300, b"c" * 300)
    found = list(warc.salvage(good[0] + bad + good[2]))
    assert [r["record_type"] for r in found] == ["response", "gap", "response"] and found[1]["reason"] == "block digest"
    assert list(warc.salvage(b"")) == []
    assert [r["record_type"] for r in warc.salvage(b"nothing here")] == ["gap"]
    found = list(warc.salvage(warc.member(bad) + warc.member(good[2])))
    assert [r["record_type"] for r in found] == ["gap", "response"]


def test_warc_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i % 3}</p>" * 40) for i in range(50)], "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"), "page_id", "url", "html")
    back = warc.read_warc(spark, str(tmp_path / "w"), with_payload=True)
    rows = back.collect()
    assert len(rows) == 50 and sum(r.record_type == "response" for r in rows) == 3
    assert {r.payload for r in rows if r.record_type == "response"} == {f"<p>{i}</p>" * 40 for i in range(3)}


# ---- operator 7

@pytest.mark.parametrize("radius", [0, 1, 3, 4, 6])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.concatenate([base, *[base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, 40)).astype(np.uint64), axis=0) for k in (1, 3, 4, 5, 7)]])
    fps = np.unique(fps)
    distance = np.unpackbits((fps[:, None] ^ fps[None]).view(np.uint8).reshape(len(fps), len(fps), 8), axis=2).sum(2)
    linked = [(int(fps[a]), int(fps[b])) for a, b in zip(*np.nonzero(distance <= radius)) if a != b]
    want = components([int(f) for f in fps], linked)
    a, b = simhash.link_block(fps, None, radius)
    assert components([int(f) for f in fps], list(zip(a.tolist(), b.tolist()))) == want
    parts = [fps[i:i + 50] for i in range(0, len(fps), 50)]
    a, b = simhash.link_small(parts, radius)
    within = [(x, y) for x, y in linked for p in parts if x in p and y in p]
    assert components([int(f) for f in fps], list(zip(a.tolist(), b.tolist()))) == components([int(f) for f in fps], within)
    a, b = simhash.link_block(fps[:90], fps[90:], radius)
    left = set(fps[:90].tolist())
    across = [(x, y) for x, y in linked if (x in left) != (y in left)]
    assert components([int(f) for f in fps], list(zip(a.tolist(), b.tolist()))) == components([int(f) for f in fps], across)


@pytest.mark.parametrize("classes", [10, 10**6, 10**9])
def test_band_tables_miss_no_pair(classes):
    rng = np.random.default_rng(1)
    tables = simhash.band_tables(classes, 4)
    for _ in range(2000):
        flips = set(rng.choice(64, 4, replace=False).tolist())
        assert any(all(not flips & set(range(a, a + w)) for a, w in bands) for bands in tables)


def test_near_duplicates_in_large_buckets(spark):
    rng = np.random.default_rng(5)
    near = np.unique(np.uint64(0x0123456789ABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)))
    far = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    fps = np.unique(np.concatenate([near, far]))
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    links = [(r.a, r.b) for r in simhash.fingerprint_links(df, len(fps), 4, block=100).collect()]
    groups = components([int(f) for f in fps.view(np.int64)], links)
    assert len({groups[int(f)] for f in near.view(np.int64)}) == 1 and len(set(groups.values())) == len(fps) - len(near) + 1


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000), (2000, 2001), (2001, 2000), (None, 5), (5, None)] + [(3000, 3000 + i) for i in range(1, 500)]
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(301)}, 2000: 2000, 2001: 2000, **{i: 3000 for i in range(3000, 3500)}}


# ---- operator 10

def test_pieces_equal_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, all_texts = sentencepiece.SentencePieceProcessor(model_file=path), texts(spark)
    with open(path, "rb") as f:
        own = sentencepiece_viterbi.Encoder(f.read())
    got = own.encode(all_texts)
    want = lib.encode(all_texts, num_threads=1)
    assert [x.tolist() for x in got] == want
    assert [own.decode(x) for x in got] == lib.decode(want)
    assert [own.decode(x) for x in got] == [t.replace("▁", " ") for t in all_texts]


def message(number, value):
    if isinstance(value, int):
        return bytes([number << 3]) + varint(value)
    return bytes([number << 3 | 2]) + varint(len(value)) + value


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def unigram_model(pieces):
    import struct
    body = b""
    for p, score, kind in pieces:
        body += message(1, message(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + message(3, kind))
    return body + message(2, message(3, 1)) + message(3, message(3, 1) + message(4, 0) + message(5, 1))


def test_unigram_paths_equal_brute_force():
    pieces = [("<unk>", 0.0, 2), ("▁", -4.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("▁a", -3.2, 1), ("ab", -4.1, 1), ("▁ab", -5.3, 1), ("ba", -3.9, 1), ("aba", -6.0, 1), ("bb", -7.5, 1)]
    enc = sentencepiece_viterbi.Encoder(unigram_model(pieces))
    score = {p: s for p, s, k in pieces if k == 1}

    def best(word):
        table = [(0.0, [])] + [(-np.inf, [])] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(j):
                s = score.get(word[i:j], -17.5 if j - i == 1 else None)
                if s is not None and table[i][0] + s > table[j][0]:
                    table[j] = (table[i][0] + s, table[i][1] + [word[i:j]])
        return table[-1][0]

    rng = np.random.default_rng(0)
    for _ in range(300):
        word = "▁" + "".join(rng.choice(list("aab"), rng.integers(1, 12)))
        points = np.array([[ord(c) for c in word]], np.uint32)
        for path in (enc.viterbi(points)[0].tolist(), enc.walk(word)):
            assert "".join(enc.symbols[s] for s in path) == word
            assert sum(score[enc.symbols[s]] for s in path) == pytest.approx(best(word))
    assert enc.encode(["abzzab"])[0].tolist().count(0) == 1  # unknown characters in a row are one unknown id
