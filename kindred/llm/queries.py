"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binpack, block_mix, fm_index, html_tree, maxscore, mpeg_audio, prefix_tokens, pu_quality, quality_cascade, resample, rtree_join, simple8b, url_filter

#: Tokens above which a document is over the limit.
TOKEN_LIMIT = 2048
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = mpeg_audio.with_media(table(spark, sf_dir, "documents"))
    columns = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature duration_samples sample_rate n_frames seek_offsets".split()
    return mpeg_audio.with_media_info(stored, carry=("n_bytes",)).select(*columns)


def op2_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.judge(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as t,
         list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[ \t\n\x0B\f\r]+', '', 'g') <> '') as ls
  from documents),
win as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g
        from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w) q),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) q where c > 1),
cov as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from rep) q group by doc_id),
m as (
  select w.doc_id, t, cast(len(ws) as bigint) as n_words,
         cast(length(regexp_replace(t, '[ \t\n\x0B\f\r]+', '', 'g')) as bigint) as word_chars,
         cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
         cast(coalesce(cov.n, 0) as bigint) as n_repeat_words,
         length(regexp_replace(t, '[^\p{L}]+', '', 'g')) as letters,
         length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) as upper_letters,
         length(t) - length(regexp_replace(t, '[!?]', '', 'g')) as shouts,
         len(string_split(t, chr(10))) as n_lines
  from w left join cov on w.doc_id = cov.doc_id),
b as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or n_symbols * 10 > n_words * 3 or word_chars < n_words * 2 or word_chars > n_words * 20
            or n_dup_lines * 2 > n_lines or shouts * 4 > n_words or letters * 10 < word_chars * 6
            or upper_letters * 2 > letters) as kept
from b
"""


def op3_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_tokens.with_prefix_counts(table(spark, sf_dir, "documents"), tokenizer_path())
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op4_block_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plan = block_mix.mix(docs)
    if plan is None:
        return spark.createDataFrame([], "doc_id long, size long, source_size long, target double, taken long")
    return block_mix.taken(plan).select("doc_id", "size", "source_size", "target", "taken")


def op5_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op6_rtree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rtree_join.classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_binpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.with_text(table(spark, sf_dir, "pages"))


def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer = pu_quality.train(docs, table(spark, sf_dir, "labels"))
    scored = pu_quality.score(docs, scorer)
    return scored.select(
        "doc_id",
        (pu_quality.fold("doc_id") == pu_quality.HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= pu_quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mpeg_audio": op1_mpeg_audio,
    "op2_quality_cascade": op2_quality_cascade,
    "op3_prefix_tokens": op3_prefix_tokens,
    "op4_block_mix": op4_block_mix,
    "op5_simple8b": op5_simple8b,
    "op6_rtree_join": op6_rtree_join,
    "op7_binpack": op7_binpack,
    "op8_url_filter": op8_url_filter,
    "op9_html_tree": op9_html_tree,
    "op10_pu_quality": op10_pu_quality,
    "op11_resample": op11_resample,
    "op12_fm_index": op12_fm_index,
    "op13_maxscore": op13_maxscore,
}
ORACLE_SQL: dict[str, str] = {"op2_quality_cascade": OP2_SQL, "op8_url_filter": url_filter.sql(), "op11_resample": resample.SQL, "op12_fm_index": fm_index.SQL, "op13_maxscore": maxscore.SQL}
