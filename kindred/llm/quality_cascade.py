"""Quality rules as a short-circuit cascade, in DataFrame functions only.

``with_base`` adds the base measures of every text. ``plan`` takes a bounded sample of whole texts, those of smallest
text hash, and tries each rule on those that pass the base test: its selectivity is the share that it rejects (all
rules in one job), its cost the seconds that ``REPEATS`` evaluations of the sample take beyond a job that evaluates
nothing. Rules are ordered by rejection per cost; half a document more is counted as rejected, so that rules that
reject nothing come by cost, the cheapest first. ``verdict`` nests the rules in that order in one CASE, so a document
is tested until its first failure only. As a document is kept when no rule rejects it, the order decides the time
that the cascade takes and never its result.

Defined results: a null text has no words, all measures 0, and fails the base test; an empty table gives an empty
result; repeated rows give repeated results; the input's other columns are not read, so their names cannot clash. A
table without a text that passes the base test orders the rules by cost 0, as they were given.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, discard, materialise

#: Rows of the sample that orders the rules, evaluations of it in a timed job, and timed jobs; they change no result.
SAMPLE_ROWS, REPEATS, RUNS = 500, 4, 3
MIN_WORDS, MOST_REPEATED_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
_SPLIT = "[ \\t\\n\\x0B\\f\\r]+"
_BLANK = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Rule:
    """``reject`` is a column expression over ``text`` and the measures; true rejects the document."""

    name: str
    reject: Column


def default_rules() -> list[Rule]:
    """Rules that clean prose of any language passes with room to spare."""
    words, chars = F.col("n_words"), F.col("word_chars")
    letters = F.length(F.regexp_replace(F.col("text"), r"[^\p{L}]+", ""))
    upper = F.length(F.regexp_replace(F.col("text"), r"[^\p{Lu}]+", ""))
    shouts = F.length(F.col("text")) - F.length(F.translate(F.col("text"), "!?", ""))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > words * 3),
        Rule("mean_word_length", (chars < words * 2) | (chars > words * 20)),
        Rule("duplicate_lines", F.col("n_dup_lines") * 2 > F.size(F.split(F.col("text"), "\n"))),
        Rule("shouting", shouts * 4 > words),
        Rule("few_letters", letters * 10 < chars * 6),
        Rule("capitals", upper * 2 > letters),
    ]


def with_base(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words: long, and _fence for :func:`base_failed`).

    Repeated windows, exactly and without a shuffle: each 3-word window becomes a long of hash bits above and its
    position below; sorting the longs brings equal hashes together; windows whose hash bits have a neighbour are
    compared as strings; the positions of true repeats, sorted, give the words that they cover."""
    text = F.col("text")
    df = df.select(col(id_col).alias("_id"), col(text_col).alias("text"))
    df = df.withColumn("_w", F.filter(F.split(F.coalesce(text, F.lit("")), _SPLIT, -1), lambda w: w != ""))
    n = F.size("_w")
    low = F.expr("greatest(1, cast(ceil(log2(size(_w) + 1)) as int))")
    df = df.withColumn("_low", low).withColumn(
        "_s",
        F.when(
            n >= 4,
            F.expr(
                "sort_array(transform(sequence(0, size(_w) - 3), i -> "
                "shiftleft(xxhash64(_w[i], _w[i + 1], _w[i + 2]), _low) | cast(i as bigint)))"
            ),
        ),
    )
    near = F.expr(
        "filter(transform(_s, (x, k) -> if("
        "(k > 0 and shiftright(_s[k - 1], _low) = shiftright(x, _low)) or "
        "(k < size(_s) - 1 and shiftright(_s[k + 1], _low) = shiftright(x, _low)), "
        "cast(x & (shiftleft(1L, _low) - 1) as int), -1)), x -> x >= 0)"
    )
    df = df.withColumn("_c", F.coalesce(near, F.array().cast("array<int>")))
    sure = F.expr("array_sort(transform(_c, i -> struct(concat_ws(' ', _w[i], _w[i + 1], _w[i + 2]) as g, i as i)))")
    df = df.withColumn("_g", F.when(F.size("_c") > 0, sure))
    places = F.expr(
        "sort_array(transform(filter(transform(_g, (x, k) -> named_struct('i', x.i, 'r', "
        "(k > 0 and _g[k - 1].g = x.g) or (k < size(_g) - 1 and _g[k + 1].g = x.g))), x -> x.r), x -> x.i))"
    )
    df = df.withColumn("_p", places)
    covered = F.expr("aggregate(_p, named_struct('n', 0L, 'b', -3), (a, x) -> named_struct('n', a.n + least(3, x - a.b), 'b', x), a -> a.n)")
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.length(F.translate(x, _BLANK, "")) > 0)
    df = df.withColumn("_l", lines)
    full = F.coalesce(text, F.lit(""))
    return df.select(
        F.col("_id").alias(id_col),
        "text",
        n.cast("long").alias("n_words"),
        F.length(F.translate(full, _BLANK, "")).cast("long").alias("word_chars"),
        (F.length(full) - F.length(F.translate(full, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.monotonically_increasing_id().alias("_fence"),  # keeps filters above from being merged into the measures
    )


def base_failed() -> Column:
    """True for too few words, or too many of them in repeated windows."""
    return (F.col("_fence") < 0) | (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT)


def plan(df: DataFrame, rules: list[Rule], text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, cost in seconds, share rejected) on the sample, from the most rejection per cost to the least."""
    texts = df.select(F.xxhash64(col(text_col)).alias("k"), col(text_col).alias("text"))
    least = texts.select("k").distinct().orderBy("k").limit(rows).collect()  # numbers only: texts stay where they are
    drawn = texts.filter(F.col("k") <= max((r["k"] for r in least), default=0)).groupBy("k").agg(F.min("text").alias("text"))
    sample = materialise(with_base(drawn, "k").filter(~base_failed()), "sample")
    rejects = [F.coalesce(rule.reject, F.lit(False)) for rule in rules]
    row = sample.agg(F.count("*").alias("n"), *[F.count_if(r).alias(f"r{k}") for k, r in enumerate(rejects)]).first()
    again = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def seconds(reject: Column) -> float:
        taken = []
        for _ in range(RUNS):  # the first run also compiles
            began = time.perf_counter()
            again.agg(F.count_if(reject)).collect()
            taken.append(time.perf_counter() - began)
        return min(taken)

    found = []
    if row["n"]:
        idle = seconds(F.col("n_words") < 0)
        found = [(rule, max(1e-3, seconds(r) - idle), row[f"r{k}"] / row["n"]) for k, (rule, r) in enumerate(zip(rules, rejects, strict=True))]
    discard(sample)
    return in_order(found, row["n"]) if row["n"] else [(rule, 0.0, 0.0) for rule in rules]


def in_order(found: list[tuple[Rule, float, float]], n: int) -> list[tuple[Rule, float, float]]:
    """By rejection per cost on a sample of ``n`` texts; equals stay in the order given."""
    return sorted(found, key=lambda x: -(x[2] * n + 0.5) / (n + 1) / x[1])


def verdict(rules: list[Rule]) -> Column:
    """Whether a document is kept: false from the first rule that rejects it on, later ones are not evaluated."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.reject, F.lit(False)), F.lit(False)).otherwise(out)
    return F.when(base_failed(), F.lit(False)).otherwise(out)


def judge(df: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row."""
    measured = with_base(df, id_col, text_col)
    ordered = [rule for rule, _, _ in plan(df, rules or default_rules(), text_col, rows)]
    return measured.select(
        col(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), verdict(ordered).alias("kept"),
    )


def keep(df: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``df``, all their columns, whose text the cascade keeps."""
    tagged = df.select(F.struct(*[col(c) for c in df.columns]).alias("row"), col(text_col).alias("text"))
    measured = with_base(tagged, "row", "text")
    ordered = [rule for rule, _, _ in plan(df, rules or default_rules(), text_col, rows)]
    return measured.filter(verdict(ordered)).select("row.*")
