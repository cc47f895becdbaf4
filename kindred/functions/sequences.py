"""Column functions on arrays, maps and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flatten(x: Column, levels: int = 1) -> Column:
    for _ in range(levels):
        x = F.flatten(x)
    return x


def grouper(x: Column, n: int, fill: Column) -> Column:
    """Chunks of ``n`` elements, the last one filled up."""
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / n).cast("int") - 1, F.lit(0))), lambda i: F.slice(x, i * n + 1, F.lit(n)))
    full = F.transform(chunks, lambda c: F.concat(c, F.array_repeat(fill, n - F.size(c))))
    return F.when(F.size(x) == 0, F.slice(full, 1, 0)).otherwise(full)


def interleave(a: Column, b: Column) -> Column:
    """a0 b0 a1 b1 ...; raises if the lengths differ."""
    same = F.flatten(F.zip_with(a, b, lambda x, y: F.array(x, y)))
    return F.when(F.size(a) == F.size(b), same).otherwise(F.raise_error(F.lit("sequences of different lengths")))


def invert_map(m: Column) -> Column:
    """Values to keys; keys of equal values: the last one in key order stays."""
    entries = F.sort_array(F.transform(F.map_entries(m), lambda e: F.struct(e["value"].alias("k"), e["key"].alias("v"))))
    last = F.filter(entries, lambda e, i: (i == F.size(entries) - 1) | (F.get(entries, i + 1)["k"] != e["k"]))
    return F.map_from_entries(last)


def change_log_base(value: Column, old: float, new: float) -> Column:
    """A logarithm to base ``old`` as one to base ``new`` in the reading value / log_new(old)."""
    return value / (F.ln(F.lit(float(old))) / F.ln(F.lit(float(new))))


def first_items(x: Column) -> Column:
    return F.transform(x, lambda t: t[0])


def product(x: Column) -> Column:
    """Product of an array; of an empty one 1."""
    return F.aggregate(x, F.lit(1.0), lambda a, v: a * v)


def exponential_growth(p: Column, r: Column, t: Column) -> Column:
    return p * F.exp(r * t)


def logistic_growth(p: Column, r: Column, k: Column, t: Column) -> Column:
    return p * k / (p + (k - p) * F.exp(-r * t))


def richards(a: Column, c: Column, m: Column, b: Column, t: Column, g: Column) -> Column:
    """Richards curve at generation ``g``: a is the lower asymptote, c the rise, m the time of greatest growth."""
    return a + c / F.pow(1 + t * F.exp(-b * (g - m)), 1 / t)


# Sparse sequences: a map of places to values; a place without an entry has the reference value.


def sparse_get(m: Column, k: Column, ref: Column) -> Column:
    return F.coalesce(F.element_at(m, k), ref)


def sparse_slice(m: Column, start: int, stop: int) -> Column:
    """Half-open slice, places counted from its start."""
    inside = F.map_filter(m, lambda k, v: (k >= start) & (k < stop))
    return F.transform_keys(inside, lambda k, v: k - start)


def sparse_set(m: Column, k: Column, v: Column, ref: Column) -> Column:
    """The entry set; the reference value removes it."""
    rest = F.map_filter(m, lambda q, w: q != k)
    return F.when(v == ref, rest).otherwise(F.map_concat(rest, F.create_map(k, v)))


def sparse_clear(m: Column, start: int, stop: int) -> Column:
    return F.map_filter(m, lambda k, v: (k < start) | (k >= stop))


def sparse_from_dense(x: Column, ref: Column) -> Column:
    pairs = F.transform(x, lambda v, i: F.struct(i.alias("k"), v.alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda e: e["v"] != ref))


def sparse_to_dense(m: Column, size: Column, ref: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(F.element_at(m, i), ref))


def sparse_take(m: Column, places: Column, ref: Column) -> Column:
    """Values at a list of places, in its order."""
    return F.transform(places, lambda k: F.coalesce(F.element_at(m, k), ref))


def sparse_mask(m: Column, mask: Column, ref: Column) -> Column:
    """Values where an array of booleans holds, in order of place."""
    return sparse_take(m, _places(mask), ref)


def _places(mask: Column) -> Column:
    kept = F.filter(F.transform(mask, lambda b, i: F.struct(b.alias("b"), i.alias("i"))), lambda e: F.coalesce(e["b"], F.lit(False)))
    return F.transform(kept, lambda e: e["i"])


def sparse_put(m: Column, places: Column, values: Column, ref: Column) -> Column:
    """Values written at a list of places; of a place named twice the last value stays. Raises if the lengths differ."""
    n = F.size(places)
    pairs = F.zip_with(F.sequence(F.lit(0), n - 1), F.arrays_zip(places.alias("k"), values.alias("v")), lambda i, e: F.struct(e["k"].alias("k"), e["v"].alias("v"), i.alias("i")))
    last = F.filter(pairs, lambda e: (e["i"] == n - F.array_position(F.reverse(places), e["k"])) & (e["v"] != ref))
    written = F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))
    rest = F.map_filter(m, lambda k, v: ~F.array_contains(places, k))
    done = F.when(n == 0, m).otherwise(F.map_concat(rest, written))
    return F.when(n == F.size(values), done).otherwise(F.raise_error(F.lit("places and values of different lengths")))


def sparse_put_slice(m: Column, start: int, stop: int, values: Column, ref: Column) -> Column:
    """Values written over the half-open slice."""
    return sparse_put(m, F.when(F.lit(stop > start), F.sequence(F.lit(start), F.lit(stop - 1))).otherwise(F.array().cast("array<int>")), values, ref)


def sparse_put_mask(m: Column, mask: Column, value: Column, ref: Column) -> Column:
    """One value written wherever the mask holds."""
    places = _places(mask)
    return sparse_put(m, places, F.array_repeat(value, F.size(places)), ref)


def sparse_compare(m: Column, value: Column, ref: Column, how: str) -> tuple[Column, Column]:
    """(map of booleans, its reference value): every place compared with one value ('<', '<=', '>', '>=', '==', '!=')
    without making the sequence dense: places that differ from the reference's answer are kept."""
    test = {"<": lambda x: x < value, "<=": lambda x: x <= value, ">": lambda x: x > value, ">=": lambda x: x >= value, "==": lambda x: x == value, "!=": lambda x: x != value}[how]
    answers = F.transform_values(m, lambda k, v: test(v))
    return F.map_filter(answers, lambda k, v: v != test(ref)), test(ref)


def sparse_compare_both(a: Column, b: Column, ref_a: Column, ref_b: Column, how: str) -> tuple[Column, Column]:
    """(map of booleans, its reference value) of two sequences compared place by place."""
    test = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "==": lambda x, y: x == y, "!=": lambda x, y: x != y}[how]
    answers = F.map_zip_with(a, b, lambda k, x, y: test(F.coalesce(x, ref_a), F.coalesce(y, ref_b)))
    return F.map_filter(answers, lambda k, v: v != test(ref_a, ref_b)), test(ref_a, ref_b)


def sparse_not(m: Column, ref: Column) -> tuple[Column, Column]:
    """(map, reference value) of the negation of a sequence of booleans."""
    return F.transform_values(m, lambda k, v: ~v), ~ref


def sparse_equal(a: Column, b: Column, size: Column, ref_a: Column, ref_b: Column) -> Column:
    return F.zip_with(sparse_to_dense(a, size, ref_a), sparse_to_dense(b, size, ref_b), lambda x, y: x == y)


def sparse_any(m: Column) -> Column:
    return F.size(m) > 0


def sparse_all(m: Column, size: Column) -> Column:
    return F.size(m) == size


def density(m: Column, size: Column) -> Column:
    return F.size(m) / size
