"""Decontamination, importance resampling and phrase mining against brute force, on small tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from propval.llm import collocations, decontamination, importance, mixing, secret_scan
from tests.llm.conftest import DOC_SCHEMA, DOCS, by_key, plain, write

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return WORD.findall(lower(text))


PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
BENCH = [(1, PASSAGE), (1, PASSAGE), (2, "Short ITEM"), (3, ""), (4, None), (None, "no id here"), (10, PASSAGE + " thirteen"), (5, "naïve 日本語")]
TEXTS = [
    (20, "x " + PASSAGE.upper() + " y"), (21, PASSAGE.replace("five", "5")), (22, "a short, item; b short item"), (23, "no-id: here no id here"),
    (24, (PASSAGE + " ") * 3), (25, " ".join(PASSAGE.split()[1:11])), (26, "naïve! 日本語 naïve 日本語"), (27, " ".join(PASSAGE.split()[:9])),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("new")
    rng = np.random.default_rng(5)
    vocab = ["red", "blue", "New", "york", "is", "a", "of", "the", "state", "united", "states", "é"]
    noise = [(100 + i, " ".join(rng.choice(vocab, 40)) + rng.choice([".", ",\n", " "]) + " ".join(rng.choice(vocab, 9)),
              [None, "en", "de"][i % 3], "s", 9) for i in range(60)]
    docs = DOCS + [(i, t, "en", "a", len(t)) for i, t in TEXTS] + noise + noise[:7]
    write(spark, folder, "documents", docs, DOC_SCHEMA)
    write(spark, folder, "benchmark", BENCH, "item_id long, text string")
    return str(folder), docs


def windows(text):
    w = words(text)
    return [tuple(w[i:i + 10]) for i in range(max(len(w) - 9, 1))] if w else []


def test_op11_against_brute_force(spark, tables):
    folder, docs = tables
    want = []
    for d, t, *_ in docs:
        w, hit, items = words(t), set(), set()
        for item, text in BENCH:
            for win in windows(text):
                for p in range(len(w) - len(win) + 1):
                    if tuple(w[p:p + len(win)]) == win:
                        hit |= set(range(p, p + len(win)))
                        if item is not None:
                            items.add(str(item))
        want.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    got = plain(decontamination.q_op11(spark, folder))
    assert by_key(got) == by_key(want) and sum(r[5] for r in got) >= 7


def test_op11_in_blocks_and_small_shards(spark, tables, monkeypatch):
    folder, _ = tables
    whole = by_key(plain(decontamination.q_op11(spark, folder)))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 30)
    monkeypatch.setattr(decontamination, "SHARD_BYTES", 200)
    assert by_key(plain(decontamination.q_op11(spark, folder))) == whole


def test_op11_longest_matches_and_removal(spark, tables):
    folder, docs = tables
    df, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    found = decontamination.find_matches(df, ["doc_id"], "text", bench)
    best = {r["item"]: r for r in decontamination.longest_matches(found, "doc_id").collect()}
    assert best["1"]["words"] == 12 and best["10"]["words"] == 12 and best["2"]["words"] == 2
    text = {d: words(t) for d, t, *_ in docs}
    for item, row in best.items():
        told = words(next(t for i, t in BENCH if str(i) == str(item)) if item else "no id here")
        run = told[row["item_at"]:row["item_at"] + row["words"]]
        assert text[row["document"]][row["doc_at"]:row["doc_at"] + row["words"]] == run
    kept = decontamination.decontaminate(df, "text", bench)
    assert kept.columns == df.columns and not {20, 22, 24, 25, 26} & {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert kept.count() == found.filter("n_hit = 0").count()


@pytest.mark.parametrize("depth", [1, 3, 40])
def test_suffix_array_order(depth):
    rng = np.random.default_rng(depth)
    seq = np.append(rng.integers(0, 3, 400), 0)
    seq[100:180] = 1
    seq[200:250] = seq[300:350]
    sa = decontamination.SuffixArray(seq, depth)

    def suffix(p):
        return tuple(seq[p:p + np.flatnonzero(seq[p:] == 0)[0]])[:depth]

    assert sorted(sa.sa) == list(np.flatnonzero(seq))
    told = [suffix(p) for p in sa.sa]
    assert told == sorted(told)


def test_span_crc():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 3000, 500)
    stop = start + np.concatenate([rng.integers(1, 100, 400), rng.integers(1, 2000, 100)])
    crc = importance.SpanCrc(reach=17)
    assert crc(data, start, stop).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, stop)]


def feature_buckets(text):
    w = words(text)
    return [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def test_op12_against_brute_force(spark, tables, monkeypatch):
    monkeypatch.setattr(importance, "SLICE_WORDS", 50)  # long texts in parts
    folder, docs = tables
    s, t = Counter(), Counter()
    for d in docs:
        s.update(feature_buckets(d[1]))
    for _, text in BENCH:
        t.update(feature_buckets(text))
    ns, nt = sum(s.values()), sum(t.values())
    rows = []
    for d, text, *_ in docs:
        f = feature_buckets(text)
        weight = sum(math.floor(1000 * math.log(((t[b] + 1) * (ns + 10000)) / ((s[b] + 1) * (nt + 10000)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[:5 * len(able) // 100]):
        r[4] = i + 1
    got = by_key(plain(importance.q_op12(spark, folder)))
    assert got == by_key([tuple(r[:5]) for r in rows]) and sum(r[4] is not None for r in got) == 5 * len(able) // 100 > 2


def test_op12_draw_keeps_columns(spark, tables):
    df = spark.read.parquet(f"{tables[0]}/documents.parquet")
    bench = spark.read.parquet(f"{tables[0]}/benchmark.parquet")
    drawn = importance.draw(df, "doc_id", "text", bench, "text", share=50)
    assert drawn.columns == df.columns and drawn.count() == 50 * sum(len(words(d[1])) >= 20 for d in tables[1]) // 100


def phrases(docs):
    f = {}
    for _, text, lang, *_ in docs:
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    return f


def brute_collocations(docs, top=2000, least=10):
    out = []
    for lang, f in phrases(docs).items():
        long = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in long.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in long.items()):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(c for p, c in f.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return out


@pytest.mark.parametrize("budget, block", [(10**6, 10**6), (40, 300), (3, 50)])
def test_op13_against_brute_force(spark, tables, monkeypatch, budget, block):
    folder, docs = tables
    monkeypatch.setattr(collocations, "BLOCK_WORDS", block)  # groups of every level: whole cells, split prefixes, single leaves
    found = collocations.collocations(spark.read.parquet(f"{folder}/documents.parquet"), "lang", "text", budget=budget)
    assert by_key(plain(found)) == by_key(brute_collocations(docs))


def test_op13_top_and_exact_products(spark):
    big = 3_000_000_000
    nodes = spark.createDataFrame([("x", "a", None, None, big * 7), ("x", "b", None, None, big * 5), ("x", "a", "b", None, big * 3)],
                                  "lang string, w1 string, w2 string, w3 string, f long")
    row = collocations.scored(nodes).collect()[0]
    assert row["score"] == 1000000 * (big * 3) ** 2 // (big * 7 * big * 5)


def test_subtree_counts_are_leaf_totals():
    packed = pa.table({"lang": ["x", "x"], "w1": ["a", "a"], "tails": ["b c 2\nb . 1", "b c 5\n. . 4"]})
    rows = {(r["w1"], r["w2"], r["w3"]): (r["f"], r["whole"]) for r in collocations.subtree(packed, 2, 8).to_pylist()}
    assert rows == {("a", None, None): (12, False), ("a", "b", None): (8, True)}


def test_op4_finds_random_strings_of_every_alphabet(spark):
    rng = np.random.default_rng(11)
    words_ = ["report", "config", "Server", "monthly", "data", "table", "user", "profile", "north", "gate", "export", "final", "backup"]
    prose = [(i, " ".join(rng.choice(words_, 60)), "prose") for i in range(300)]
    held = [(1000 + i, f"the value {''.join(rng.choice(list(a), 32))} ends", k) for k, a in secret_scan.ALPHABETS.items() for i in range(60)]
    held += [(2000 + i, f"at services/production/configuration/{''.join(rng.choice(list(secret_scan.ALPHABETS['base62']), 32))}", "path") for i in range(60)]
    names = ["_".join(rng.choice(words_, 4)) for _ in range(200)] + ["2024-01-15_backup_2024-01-16", "services/production/configuration"] * 20
    names += [str(x) for x in rng.integers(10**15, 10**18, 100)] + [f"{y}-{m:02d}-{d:02d}_{y}{m:02d}{d:02d}" for y in range(1990, 2020, 3) for m in (1, 12) for d in (3, 28)]
    plain_ = [(5000 + i, f"see {w} there", "plain") for i, w in enumerate(names)]
    docs = spark.createDataFrame(prose + held + plain_, "doc_id long, text string, kind string")
    found = secret_scan.find_secrets(docs, "text", ["doc_id", "text", "kind"])
    rows = found.select("kind", "text", F.size("spans").alias("n"), secret_scan.redact(F.col("text"), F.col("spans")).alias("left")).collect()
    share = {k: np.mean([r.n > 0 for r in rows if r.kind == k]) for k in {r.kind for r in rows}}
    assert all(share[k] >= 0.9 for k in (*secret_scan.ALPHABETS, "path")) and share["plain"] < 0.01 and share["prose"] < 0.01
    assert all(r.left.startswith("at services/production/conf") for r in rows if r.kind == "path")


def test_op4_scores_what_lies_beside_base_spans(spark):
    rng = np.random.default_rng(3)
    side = ["".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz"), 24)) for _ in range(2)]
    text = f"key {side[0]}{'0123456789abcdef' * 2}{side[1]} end"
    docs = spark.createDataFrame([(1, text), (2, "plain words only here")], "doc_id long, text string")
    left = secret_scan.find_secrets(docs, "text", ["doc_id", "text"]).select("doc_id", secret_scan.redact(F.col("text"), F.col("spans")).alias("t"))
    kept = {r.doc_id: r.t for r in left.collect()}
    assert kept[2] == "plain words only here" and not re.search(r"[A-Za-z0-9]{8}", kept[1].replace("[secret]", ""))


def test_op8_any_number_of_sources(spark):
    """More sources than a driver's network could hold; every one ends near its target."""
    docs = spark.range(60_000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.pmod(F.xxhash64("id"), F.lit(9)) + 1).cast("int")).alias("text"),
        F.concat(F.lit("site"), F.col("id") % 25_000).alias("source"))
    rows = mixing.mix_documents(docs, ["source"])
    by = rows.groupBy("source").agg(F.sum("size").alias("size"), F.first("source_size").alias("told"), F.first("target").alias("target"),
                                    F.sum("taken").alias("taken"), F.max("size").alias("most"), F.max(F.col("taken") / F.col("size")).alias("times")).collect()
    assert len(by) == 25_000 and all(r["size"] == r["told"] and r["times"] <= 2 and abs(r["taken"] - r["target"]) <= r["most"] for r in by)
    total = sum(r["size"] for r in by)
    assert sum(r["target"] for r in by) == pytest.approx(1.5 * total) and abs(sum(r["taken"] for r in by) - 1.5 * total) < 0.02 * total


def test_op8_flows_by_connected_part_equal_one_network(spark, tmp_path):
    rng = np.random.default_rng(2)
    patterns = [((f"{g}{a}", f"{g}{b}") if a != b else (f"{g}{a}",), int(rng.integers(5, 60))) for g in "xyz" for a in range(4) for b in range(a, 4)]
    patterns += [(("alone",), 30), (("unwanted",), 7)]
    quotas = {f"{g}{i}": int(rng.integers(10, 160)) for g in "xyz" for i in range(4)} | {"alone": 45}
    spark.createDataFrame([(i, sorted(m), n) for i, (m, n) in enumerate(patterns)], "_p long, _pattern array<string>, _size long").write.parquet(f"{tmp_path}/p")
    spark.createDataFrame(list(quotas.items()), "_member string, _quota long").write.parquet(f"{tmp_path}/q")
    got = {r["_p"]: r["_words"] for r in mixing.routed(spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/q"), 2).collect()}
    want = mixing.route([(sorted(m), n) for m, n in patterns], quotas, 2)

    def cost(words):  # the second copy of a pattern's words costs one each
        return sum(max(0, w - n) for w, (_, n) in zip(words, patterns))

    given = [got[i] for i in range(len(patterns))]
    assert sum(given) == sum(want) and cost(given) == cost(want) and given[-2:] == [45, 0]
    assert all(0 <= w <= 2 * n for w, (_, n) in zip(given, patterns))


def test_op8_boundary_bucket():
    rng = np.random.default_rng(4)
    for _ in range(200):
        sizes = rng.integers(1, 40, rng.integers(1, 9))
        need = int(rng.integers(0, sizes.sum() + 1))
        rows = mixing._fill(pd.DataFrame({"_p": 0, "_u": rng.random(len(sizes)), "_size": sizes, "_n": 1, "_need": need}))
        took = int((rows["_size"] * rows["_chosen"]).sum())
        best = min(abs(need - sum(c)) for k in range(len(sizes) + 1) for c in itertools.combinations(sizes.tolist(), k))
        assert rows["_chosen"].isin([0, 1]).all() and best <= abs(took - need) <= sizes.max() / 2
