"""Small tests of the corpus operators against brute force, and of their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("kindred.llm")
from kindred.llm import binpack, block_mix, html_tree, mpeg_audio, prefix_tokens, pu_quality, quality_cascade, queries, rtree_join, simple8b, url_filter  # noqa: E402
from kindred.llm.wordbpe import word_bpe  # noqa: E402

TEXTS = [None, "", " \n\t ", "One word", "Ünï 日本 İx it're <|endoftext|> !!!'s 12", "a b c " * 40, "word " * 3000, "x" * 5000, "a b c " * 40]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with results."""
    rows = [(k if k != 3 else None, t, None if k == 4 else f"s{k % 2}", "clash", -1) for k, t in enumerate(TEXTS)]
    rows.append(rows[5])
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens string, kept int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(t):
    return (t or "").encode().split()


def test_media_round_trip_and_resync(docs, none):
    for n in (0, 1, 191, 192, 935, 936, 40_000):
        p = random.Random(n).randbytes(n)
        info = mpeg_audio.parse(b"junk\xff\xfb" + mpeg_audio.encode(p))
        assert info.payload == p and info.crc_bad == 0 and info.vbr == "xing" and info.vbr_frames == info.frames == len(info.offsets)
        assert info.samples == 1152 * info.frames
    broken = bytearray(mpeg_audio.encode(b"z" * 4000))
    at = mpeg_audio.parse(bytes(broken)).offsets[1]
    broken[at + 5] ^= 1
    assert mpeg_audio.parse(bytes(broken)).crc_bad == 1
    stored = mpeg_audio.with_media(docs)
    rows = mpeg_audio.with_media_info(stored, carry=("n_bytes",)).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        t = (TEXTS[r.doc_id if r.doc_id is not None else 3] or "").encode()
        payload = t + b" " * (-len(t) % 192 if t else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert mpeg_audio.with_media(none).count() == 0 and mpeg_audio.parse(b"").frames == 0


def test_tokens_and_prefixes_equal_the_library(docs, none):
    path = queries.tokenizer_path()
    lib = word_bpe(path).library
    ids, n = word_bpe(path).encode([(t or "").encode() for t in TEXTS])
    ends = np.r_[0, np.cumsum(n)]
    for k, t in enumerate(TEXTS):
        assert ids[ends[k] : ends[k + 1]].tolist() == lib.encode(t or "", add_special_tokens=False).ids
    stored, totals = prefix_tokens._for(path).changes([(t or "").encode() for t in TEXTS])
    for t, s, total in zip(TEXTS, stored, totals, strict=True):
        counts = prefix_tokens.counts_from(s)
        assert counts[-1] == total and len(counts) == len(t or "") + 1
        for at in {0, 1, 2, 3, 5, 8, 13, len(t or "") // 2, len(t or "")}:
            if at <= min(len(t or ""), 600):
                assert counts[at] == len(lib.encode((t or "")[:at], add_special_tokens=False).ids)
    df = prefix_tokens.with_prefix_counts(docs, path)
    assert df.count() == len(TEXTS) + 1 and prefix_tokens.with_prefix_counts(none, path).count() == 0
    got = {r.doc_id: (r.keep_chars, r.tokens_at) for r in prefix_tokens.ask(df, budget=4, at=3).collect()}
    assert got[5] == (8, 2) and got[1] == (0, 0)


def test_quality_measures_by_brute_force(docs, none):
    for r in quality_cascade.judge(docs).collect():
        t = TEXTS[r.doc_id if r.doc_id is not None else 3]
        w = words(t)
        seen, cover = {}, set()
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        for places in seen.values():
            if len(places) > 1:
                cover |= {p + d for p in places for d in range(3)}
        assert (r.n_words, r.n_repeat_words) == (len(w), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and (not r.base_failed or not r.kept)
    assert quality_cascade.judge(none).count() == 0 and quality_cascade.keep(docs).columns == docs.columns


def test_mix_meets_targets(spark, docs, none):
    assert block_mix.targets([100, 100, 10], share=1.5) == pytest.approx([200, 95, 20])
    for n in (1, 2, 3, 17, 1000):
        assert sorted(block_mix.permute(np.arange(n), np.full(n, n), np.full(n, 3)).tolist()) == list(range(n))
    rows = block_mix.taken(block_mix.mix(docs)).collect()
    assert len(rows) == len(TEXTS) + 1 and all(r.taken <= 2 * r["size"] for r in rows)
    assert block_mix.mix(none) is None
    big = spark.range(300).selectExpr("id as doc_id", "repeat('w ', cast(id % 90 as int)) as text", "concat('s', id % 3) as source")
    total = {}
    for r in block_mix.taken(block_mix.mix(big)).collect():
        total.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(a - b) <= 64 for a, b in total.values())


def test_id_files(docs, none):
    rng = np.random.default_rng(1)
    for a in (rng.integers(0, 49408, 5000), np.array([2**63, 5, 2**61, 0], np.uint64), np.zeros(3000, np.uint64)):
        w, f, e = simple8b.encode_words(a)
        assert (simple8b.decode_words(w, f, e, len(a)) == a.astype(np.uint64)).all()
    path = queries.tokenizer_path()
    rows = sorted(simple8b.round_trip(docs, path, 2).collect(), key=lambda r: r.start)
    assert len(rows) == len(TEXTS) + 1 and rows[0].doc_id is None
    at = 0
    for r in rows:
        t = TEXTS[r.doc_id if r.doc_id is not None else 3]
        ids = [*word_bpe(path).library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert simple8b.round_trip(none, path, 2).count() == 0


def test_join_by_brute_force(spark, docs, none):
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([2, 6, 60, 200]))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 20)):
                copy[rng.randrange(len(copy))] = f"W{rng.randrange(500)}"
            texts.append(" ".join(copy))
    texts += ["", None, "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for k, num in ((3, 90), (5, 80)):
        sets = []
        for t in texts:
            w = [x.lower() for x in words(t)]
            sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
        label = list(range(len(texts)))
        for _ in texts:
            for i, a in enumerate(sets):
                for j in range(i):
                    if a and sets[j] and 100 * len(a & sets[j]) >= num * len(a | sets[j]):
                        label[i] = label[j] = min(label[i], label[j])
        got = {r.doc_id: (r.component_id, r.n_shingles) for r in rtree_join.classes(df, k, num, 100).collect()}
        assert got == {i: (label[i], len(sets[i])) for i in range(len(texts))}
    assert rtree_join.classes(docs).count() == len(TEXTS) + 1 and rtree_join.classes(none).count() == 0
    kept = rtree_join.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [0, 1, 2, 4, 5, 6, 7]


def test_packing_is_exact_and_tight(docs, none):
    for seed in range(8):
        r = random.Random(seed)
        counts = {r.randint(1, 2048): r.randint(1, 60) for _ in range(r.randint(0, 50))}
        runs, bins = binpack.plan(counts)
        fill, placed = {}, {}
        for length, rank, n, per, first, offset in runs:
            assert rank == placed.get(length, 0)
            placed[length] = rank + n * per
            for b in range(first, first + n):
                assert fill.get(b, 0) == offset
                fill[b] = offset + per * length
        assert placed == counts and len(fill) == bins and max(fill.values(), default=0) <= 2048
    rows = binpack.pack(docs, queries.tokenizer_path(), 0).collect()
    assert sum(r.length for r in rows if r.doc_id == 6) == 3001 and max(r.length for r in rows) <= 2048
    assert binpack.pack(none, queries.tokenizer_path(), 0).count() == 0


def test_url_rules_and_terms(spark):
    urls = [None, "", "no scheme casino", "http://A.Example.COM/en/7x?q", "http://com/en/1", "https://x.example.net/de/81#a", "https://y.net/de/1", "http://free.org/es/", "http://cheap-pills.example.com/fr", "http://cheapest-pills.io/", "http://casinos.io/", "http://my-casino.io"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got[0] == got[1] == ("", "", None, "allow") and got[2][3] == "block"
    assert got[3] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[4][2:] == ("com/en/", "block")
    assert got[5][2:] == ("example.net/de/8", "block") and got[6][2:] == ("net/de/", "allow") and got[7][2:] == ("org/es/", "block")
    assert [got[k][3] for k in (8, 9, 10, 11)] == ["block", "allow", "allow", "block"]


def test_html_main_text(spark):
    page = '<html><head><title>T</title><script>var a="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav><div class="wrap"><article><h1>H&eacute;ad</h1><p><b>One,  two<br>three<p>Next <i>par</i>t &amp more</article><div class="comments"><p>Nice, very, nice, indeed</p></div></div><aside>Side, bar, text</aside><form>Name</form><footer>End &copy;'
    assert html_tree.extract(page) == "Héad One, two three Next part & more"
    assert html_tree.extract(None) == html_tree.extract("") == html_tree.extract("<nav>x</nav>") == ""
    assert html_tree.extract("<p>cut off <b>he") == "cut off he"
    assert html_tree.extract("<div>" * 3000 + "deep text" + "</div>" * 10) == "deep text"
    df = spark.createDataFrame([(1, None, None), (2, "u", page)], "page_id long, url string, html string")
    assert {r.page_id: r.n_chars for r in html_tree.with_text(df).collect()} == {1: 0, 2: 36}


def test_classifier_holds_out(spark, docs, none):
    docs_big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scorer = pu_quality.train(docs_big, labels)
    rows = pu_quality.score(docs_big, scorer).join(labels.select("doc_id", "quality"), "doc_id").withColumn("out", pu_quality.fold("doc_id") == 0).filter("out").collect()
    right = sum((r.score >= 0.3) == (r.quality == 1) for r in rows)
    assert len(rows) > 30 and right / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in pu_quality.score(docs, scorer).collect()) and pu_quality.score(none, scorer).count() == 0
    flat = pu_quality.train(docs_big, labels.limit(0))
    assert pu_quality.score(docs, flat).first().score == 0.5
