"""FM-index, MaxScore and importance resampling against plain Python, on odd tables and with small limits."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("kindred.llm")
from kindred.llm import fm_index, maxscore, resample  # noqa: E402
from kindred.llm.lexical import split  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def odd_tables(spark, seed=3):
    """Documents with copies, ties, nulls, no words, one very long text and names that clash; items that occur and do not."""
    rng = random.Random(seed)
    some = ["the", "The", "of", "ÉCOLE", "naïve", "日本", "x1", "a" * 90, "b" * 5000, "é", "İx"]
    say = lambda n: " ".join(rng.choice(some) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))
    items = [(k, say(rng.choice([1, 3, 9, 10, 11, 25])), "z") for k in range(25)] + [(90, None, "z"), (91, "", "z"), (92, "...", "z"), (3, say(12), "z"), (None, say(4), "z")]
    docs = [(k, say(rng.randrange(60)), "e", 1) for k in range(60)]
    docs += [(100 + k, say(3) + " " + (items[k][1] or "") + " " + say(4), "e", 1) for k in range(25)]
    docs += [(200, None, "e", 1), (201, "", None, 1), (202, " .,;", None, 1), (203, say(3000), None, 1), (204, "nothing in common", None, 1), (None, say(30), None, 1)]
    docs += [docs[7]] * 3 + [(300 + k, docs[70][1], "e", 1) for k in range(9)]
    d = spark.createDataFrame(docs, "doc_id long, text string, starts string, score int").repartition(3, "doc_id")
    b = spark.createDataFrame(items, "item_id long, text string, phrase string")
    return [r[:2] for r in docs], [r[:2] for r in items], d, b


def hits(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[a : a + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w = words(t)
        hit, met = set(), set()
        for n in {len(x) for x in wins}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in wins:
                    hit |= set(range(a, a + n))
                    met |= wins[tuple(w[a : a + n])]
        listed = sorted(str(m) for m in met if m is not None)
        out.append((d, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [{}, {"shard_bytes": 2000, "piece": 50}, {"block": 40, "shard_bytes": 20000}])
def test_contamination(spark, limits):
    docs, items, d, b = odd_tables(spark)
    got = fm_index.judge(d, b, **limits)
    assert sorted((tuple(r) for r in got.collect()), key=str) == hits(docs, items)


def test_contamination_of_empty_tables(spark):
    _, _, d, b = odd_tables(spark)
    assert fm_index.judge(d.limit(0), b).count() == 0
    assert not any(r.contaminated for r in fm_index.judge(d, b.limit(0)).collect())


def test_suffixes_of_copies_and_runs():
    rng = np.random.default_rng(1)
    for _ in range(40):
        x = np.r_[np.tile(rng.integers(1, 4, rng.integers(1, 40)), rng.integers(1, 5)), 0]
        assert fm_index.suffix_order(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def test_shard_finds_and_locates():
    rng = np.random.default_rng(2)
    for _ in range(30):
        texts = [rng.integers(1, 6, rng.integers(1, 40)).astype(np.uint64) for _ in range(rng.integers(1, 6))]
        shard = fm_index.Shard.load(fm_index.Shard.build(texts, 4).dump())
        phrases, lens = rng.integers(1, 7, (30, 3)).astype(np.uint64), rng.integers(1, 4, 30)
        for p, n, low, high in zip(phrases, lens, *shard.find(phrases, lens), strict=True):
            at = shard.locate(np.arange(low, high))
            assert sorted(at) == [s + i for s, t in zip(shard.starts, texts, strict=True) for i in range(len(t) - n + 1) if (t[i : i + n] == p[:n]).all()]


def ranks(docs, items, k):
    held = [(d, words(t)) for d, t in docs]
    held = [(d, w) for d, w in held if w]
    n, total = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for i, t in items:
        found = []
        for d, w in held:
            m = 50 + 50 * len(w) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * w.count(x) // (1000 * w.count(x) + 20 * m)) for x in set(words(t)) if x in w)
            if s > 0:
                found.append((-s, d is None, d))
        out += [(i, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [{}, {"k": 5, "shard_bytes": 1500}, {"k": 3, "block": 7, "shard_bytes": 4000}])
def test_ranked_search(spark, limits):
    docs, items, d, b = odd_tables(spark, 5)
    got = maxscore.rank(d, b, **limits)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranks(docs, items, limits.get("k", 50))


def test_search_of_empty_tables(spark):
    _, _, d, b = odd_tables(spark)
    for got in (maxscore.rank(d.limit(0), b), maxscore.rank(d, b.limit(0)), maxscore.rank(d.filter("text is null"), b)):
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_maxscore_probes_few_and_loses_none():
    rng = np.random.default_rng(4)
    probed = added = full = 0
    for _ in range(60):
        lists = []
        for bound in (5, 20, 400, 900):
            docs = np.flatnonzero(rng.random(2000) < (0.9 if bound < 100 else 0.02))
            scores = rng.integers(1, bound + 1, len(docs))
            lists.append((docs, scores, int(scores.max())))
        total = np.zeros(2000, np.int64)
        for docs, scores, _ in lists:
            total[docs] += scores
        threshold, seen = int(np.sort(total)[-10]), {}
        docs, scores = maxscore.match(lists, 2000, threshold, seen)
        assert docs.tolist() == np.flatnonzero(total >= threshold).tolist() and scores.tolist() == total[docs].tolist()
        probed, added, full = probed + seen.get("probed", 0), added + seen["added"], full + sum(len(p[0]) for p in lists)
    assert probed + added < full / 10


def drawn(docs, items, share=25, least=20):
    feats = lambda t: (lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])(words(t))
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = np.zeros(10000, np.int64), np.zeros(10000, np.int64)
    for into, rows in ((s, docs), (t, items)):
        for _, text in rows:
            for f in feats(text):
                into[bucket(f)] += 1
    n_s, n_t = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((b + 1) * (n_s + 10000) / ((a + 1) * (n_t + 10000)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    out = []
    for d, text in docs:
        f = feats(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    place = {id(r): k + 1 for k, r in enumerate(able) if k < share * len(able) // 100}
    return sorted(((*r[:4], place.get(id(r))) for r in out), key=str)


@pytest.mark.parametrize("salts", [None, 5])
def test_resampling(spark, monkeypatch, salts):
    docs, items, d, b = odd_tables(spark, 8)
    if salts:
        monkeypatch.setattr(resample, "PER_SALT", 20)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    d.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/odd-{salts}")
    try:
        got = resample.resample(spark.read.parquet(path), b).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=str) == drawn(docs, items)


def test_resampling_of_empty_tables(spark):
    docs, _, d, b = odd_tables(spark, 8)
    assert resample.resample(d.limit(0), b).count() == 0
    assert sorted((tuple(r) for r in resample.resample(d, b.limit(0)).collect()), key=str) == drawn(docs, [])


def test_crcs_of_runs():
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 63, 64, 65, 200]))) for _ in range(rng.randrange(9))).encode() for _ in range(50)]
    w = split(texts)
    flat = [x for t in texts for x in t.split()]
    owner = np.repeat(np.arange(len(texts)), np.diff(w.bounds))
    for k, (place, crc) in enumerate(resample.run_crcs(w, 3), 1):
        assert place.tolist() == [i for i in range(len(flat) - k + 1) if owner[i] == owner[i + k - 1]]
        assert crc.tolist() == [zlib.crc32(b" ".join(flat[i : i + k])) for i in place.tolist()]
