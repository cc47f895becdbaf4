"""Queries that SQL cannot express, row by row against plain Python on a small folder of tables."""

import random
import zlib

import numpy as np
import pytest

pytest.importorskip("kindred.llm")
from kindred.llm import block_mix, html_tree, pu_quality, quality_cascade, queries  # noqa: E402
from kindred.llm.wordbpe import word_bpe  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def ids_of(text, end):
    return [*word_bpe(queries.tokenizer_path()).library.encode(text or "", add_special_tokens=False).ids, end]


def test_packing_row_by_row(spark, docs):
    got = {(r.doc_id, r.piece): r for r in queries.op7_binpack(spark, DATA).collect()}
    want = {}
    for i, text, _ in docs:
        ids = ids_of(text, 0)
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {k: (r.start, r.length, r.ids_crc32) for k, r in got.items()} == want
    rows = {}
    for r in got.values():
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in rows.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got.values())
    large = sum(r.length > 1024 for r in got.values())
    assert len(rows) <= 1.02 * max(-(-total // 2048), large) + 1


def test_id_files_row_by_row(spark, docs):
    at = 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op5_simple8b(spark, DATA).collect()}
    for i, text, _ in sorted(docs, key=lambda x: x[0]):
        ids = ids_of(text, 2)
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_mix_by_walking_the_blocks(spark, docs):
    """Sizes, targets and uses of every block counted anew from the slots."""
    plan = block_mix.mix(spark.read.parquet(f"{DATA}/documents.parquet"))
    rows = {r.doc_id: r for r in block_mix.taken(plan).collect()}
    sizes, by = {}, {}
    for i, text, source in docs:
        sizes[i] = len((text or "").encode().split())
        by.setdefault(source, []).append(i)
    names = sorted((s for s in by if s is not None)) + [None] * (None in by)
    words = [sum(sizes[i] for i in by[s]) for s in names]
    goal = block_mix.targets(words)
    uses = {}
    for r in plan.slots.collect():
        uses[r.source_no, r.block] = uses.get((r.source_no, r.block), 0) + 1
    starts = {r.doc_id: (r.source_no, r.start) for r in plan.rows.collect()}
    for k, s in enumerate(names):
        at = 0
        for i in sorted(by[s], key=lambda i: starts[i][1]):
            assert starts[i] == (k, at)
            want = sum(uses.get((k, (at + w) // block_mix.BLOCK), 0) for w in range(sizes[i]))
            assert (rows[i]["size"], rows[i].source_size, rows[i].taken) == (sizes[i], words[k], want) and want <= 2 * sizes[i]
            assert rows[i].target == pytest.approx(goal[k])
            at += sizes[i]
        assert abs(sum(rows[i].taken for i in by[s]) - goal[k]) <= block_mix.BLOCK
    again = {r.doc_id: r.taken for r in block_mix.taken(block_mix.mix(spark.read.parquet(f"{DATA}/documents.parquet"))).collect()}
    assert again == {i: r.taken for i, r in rows.items()}


def test_risk_is_as_low_as_another_minimiser_finds():
    """Full-batch descent with backtracking on the same risk, where it is smooth."""
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.4
    x = rng.normal(size=(4000, 3)) + np.where(truth[:, None], 1.5, -0.5)
    pos, unl = x[truth][:800], x
    scorer = pu_quality.fit(pos, unl, 0.4, decay=0.0)
    raw = lambda v: np.log(scorer(v) / (1 - scorer(v)))
    reached = pu_quality.risk(raw(pos), raw(unl), 0.4)
    w, step = np.zeros(4), 1.0
    one = lambda v: np.c_[v, np.ones(len(v))]
    value = pu_quality.risk(one(pos) @ w, one(unl) @ w, 0.4)
    for _ in range(4000):
        grad = np.zeros(4)
        for k in range(4):
            d = np.eye(4)[k] * 1e-5
            grad[k] = (pu_quality.risk(one(pos) @ (w + d), one(unl) @ (w + d), 0.4) - pu_quality.risk(one(pos) @ (w - d), one(unl) @ (w - d), 0.4)) / 2e-5
        while step > 1e-9 and (new := pu_quality.risk(one(pos) @ (w - step * grad), one(unl) @ (w - step * grad), 0.4)) >= value:
            step /= 2
        if step <= 1e-9 or value - new < 1e-9:
            break
        w, value, step = w - step * grad, new, step * 1.5
    assert reached <= value + 0.02


def test_rules_of_equal_rejection_go_by_cost():
    rule = lambda n: quality_cascade.Rule(n, None)
    found = [(rule("dear"), 0.5, 0.1), (rule("cheap"), 0.01, 0.1), (rule("none"), 0.001, 0.0), (rule("often"), 0.5, 0.9)]
    assert [r.name for r, _, _ in quality_cascade.in_order(found, 100)] == ["cheap", "none", "often", "dear"]


def test_dear_rule_goes_last_in_every_run(spark):
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{DATA}/documents.parquet")
    dear = F.length(F.regexp_replace(F.regexp_replace("text", r"(\w+)\s+(?=\w)", "$1 "), r"[^\p{L}]+", "")) < 0
    rules = [quality_cascade.Rule("dear", dear), quality_cascade.Rule("cheap", F.col("n_words") < 0)]
    for _ in range(3):
        assert [r.name for r, _, _ in quality_cascade.plan(df, rules)] == ["cheap", "dear"]


ARTICLE = "<p>" + "Words of an article, with commas, and more of them. " * 8 + "</p>"


@pytest.mark.parametrize("page", [
    f'<article class="post has-sidebar">{ARTICLE}</article>', f'<div id="search-results">{ARTICLE}</div>', f'<div class="no-comments">{ARTICLE}</div>', f'<main class="sidebar">{ARTICLE}</main>',
    f'<div class="wrap"><div class="post">{ARTICLE}</div><div class="comments"><p>I like it, very much</p></div><div class="cookie-notice">We use cookies</div></div>',
    f'<div class="sidebar-layout"><article>{ARTICLE}</article><div class="sidebar">side text</div></div><div class="ad">Buy now</div>',
])
def test_names_are_evidence_only(page):
    assert html_tree.extract(page) == " ".join(("Words of an article, with commas, and more of them. " * 8).split())


def test_pages_with_nulls_repeats_and_clashing_names(spark):
    rows = [(1, None, None, "x"), (2, "u", "<article>" + ARTICLE * 200 + "</article>", "y"), (2, "u", "<article>" + ARTICLE * 200 + "</article>", "y"), (None, None, "", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_tree.with_text(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, *[len(got[1].text)] * 2] and len(got[1].text) > 80_000
    assert html_tree.with_text(df.limit(0)).count() == 0


def test_pipeline_stages_on_small_empty_and_odd_tables(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.limit(60).unionByName(spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", None, 0)], docs.schema))
    for name, stage in pipeline.STAGES:
        for given in (odd, docs.limit(0)):
            out = stage(spark, given, DATA)
            if name != "packing":
                assert out.columns == docs.columns, name
            n = out.count()
            assert n == 0 if given is not odd else n > 0, name
