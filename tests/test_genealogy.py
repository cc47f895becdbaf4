import pytest
from pyspark.sql import functions as F

from kindred.operators import genealogy as G
from kindred.operators import individuals as P

COUSINS = [("f", "1", None, None, 0), ("f", "2", None, None, 1), ("f", "3", "1", "2", 0), ("f", "4", None, None, 1), ("f", "5", "1", "2", 0), ("f", "6", None, None, 1), ("f", "7", "3", "4", 0), ("f", "8", "5", "6", 1), ("f", "9", "7", "8", 0)]
INCEST = [("r", "1", None, None, 0), ("r", "2", None, None, 1), ("r", "3", "1", "2", 0), ("r", "4", "1", "2", 1), ("r", "5", "3", "4", 0), ("r", "6", "3", "4", 1), ("r", "7", "5", "6", 0), ("r", "8", "5", "6", 1), ("r", "9", "7", "8", 0)]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(COUSINS + INCEST, "fam string, id string, father string, mother string, sex int")


def test_inbreeding_of_known_pedigrees(people):
    got = {(r.fam, r.id): r.inbreeding for r in G.inbreeding(people).collect()}
    assert got[("f", "9")] == 0.0625
    assert [got[("r", str(i))] for i in range(1, 10)] == [0, 0, 0, 0, 0.25, 0.25, 0.375, 0.375, 0.5]


def test_kinship_fraternity_and_paths(people, spark):
    kin = {(r.fam, r.id1, r.id2): r.kinship for r in G.kinship(people).collect()}
    assert kin[("f", "7", "8")] == 0.0625 and kin[("f", "5", "7")] == 0.125 and kin[("f", "3", "5")] == 0.25 and kin[("f", "1", "1")] == 0.5
    assert ("f", "1", "2") not in kin and kin[("r", "7", "7")] == (1 + 0.375) / 2
    pairs = spark.createDataFrame([("f", "7", "8"), ("f", "1", "2"), ("f", "1", "7"), ("f", "3", "3")], "fam string, id1 string, id2 string")
    path = {(r.id1, r.id2): r.kinship for r in G.path_kinship(people, pairs, G.inbreeding(people)).collect()}
    assert path == {("7", "8"): 0.0625, ("1", "2"): 0, ("1", "7"): 0.125, ("3", "3"): 0.5}
    frat = {(r.id1, r.id2): r.fraternity for r in G.fraternity(people, G.kinship(people), spark.createDataFrame([("f", "3", "5"), ("f", "7", "8"), ("f", "1", "3")], "fam string, id1 string, id2 string")).collect()}
    assert frat == {("3", "5"): 0.25, ("7", "8"): 0, ("1", "3"): 0}


def test_depth_lineage_siblings(people):
    depth = {(r.fam, r.id): r.depth for r in G.depth(people).collect()}
    assert [depth[("f", i)] for i in "1437"] == [0, 0, 1, 2]
    assert {(r.id, r.line) for r in G.lineage(people.filter("fam = 'f'"), "mother").collect() if r.id in "379"} == {("3", "2"), ("7", "4"), ("9", "6")}
    sibs = {(r.id, r.sibling) for r in G.siblings(people.filter("fam = 'f'")).collect()}
    assert ("3", "5") in sibs and ("3", "3") in sibs and ("3", "7") not in sibs
    assert {r.id for r in P.marry_in_founders(people.filter("fam = 'f'"), G.depth(people)).collect()} == {"4", "6"}
    assert {r.fam: r.bits for r in P.bit_size(people).collect()} == {"f": 6, "r": 12}


def test_matrix_is_symmetric_and_positive(people):
    import numpy as np

    rows = G.additive(people.filter("fam = 'r'")).collect()
    m = np.zeros((9, 9))
    for r in rows:
        m[int(r.id1) - 1, int(r.id2) - 1] = r.value
    assert np.array_equal(m, m.T) and (np.linalg.eigvalsh(m) > 0).all() and m[8, 8] == 1.5


def test_one_known_parent_and_unknown_parent(spark):
    one = spark.createDataFrame([("a", "1", None, None, 0), ("a", "2", "1", None, 1)], "fam string, id string, father string, mother string, sex int")
    assert {(r.id1, r.id2): r.value for r in G.additive(one).collect()} == {("1", "1"): 1, ("1", "2"): 0.5, ("2", "1"): 0.5, ("2", "2"): 1}
    lost = spark.createDataFrame([("a", "2", "1", None, 1)], "fam string, id string, father string, mother string, sex int")
    with pytest.raises(KeyError):
        P.connect(lost)


def test_mitochondrial_matrix(people):
    m = {(r.id1, r.id2) for r in G.mitochondrial(people.filter("fam = 'f'")).collect()}
    assert ("2", "5") in m and ("3", "5") in m and ("7", "8") not in m and ("9", "9") in m
    assert G.mitochondrial(people, people.filter(F.lit(False))).count() == 0


def test_kinship_of_asked_pairs(people, spark):
    every = people.select("fam", F.col("id").alias("id1")).join(people.select("fam", F.col("id").alias("id2")), "fam")
    whole = {(r.fam, r.id1, r.id2): r.value / 2 for r in G.additive(people).collect()}
    got = {(r.fam, r.id1, r.id2): r.kinship for r in G.kinship_of(people, every).collect()}
    assert len(got) == 162 and all(v == whole.get(k, 0.0) for k, v in got.items())
    assert {(r.fam, r.id1, r.id2): r.kinship for r in G.kinship_of(people, every, G.inbreeding(people)).collect()} == got
    some = spark.createDataFrame([("f", "8", "7"), ("f", "8", "7"), ("f", "1", "no"), ("no", "1", "1"), ("f", "1", "2"), ("f", None, "2")], "fam string, id1 string, id2 string")
    few = G.kinship_of(people, some).collect()
    lost = [r for r in few if r.id2 == "no" or r.fam == "no" or r.id1 is None]
    assert {r.kinship for r in lost} == {None} and len(lost) == 3
    assert sorted((r.fam, r.id1, r.id2, r.kinship) for r in few if r not in lost) == [("f", "1", "2", 0.0)] + [("f", "8", "7", 0.0625)] * 2
    assert G.kinship_of(people, some.limit(0)).count() == 0


def test_kinship_of_asked_pairs_in_a_deep_looped_pedigree(spark):
    """Seven generations of four with random parents, some unknown, against the tabular method on dense matrices."""
    import random

    import numpy as np

    rng, rows, a = random.Random(3), [], np.zeros((28, 28))
    for i in range(28):
        above = range(max(0, i // 4 * 4 - 8), i // 4 * 4)
        f, m = (rng.choice(above) if above and rng.random() < 0.9 else None for _ in range(2))
        if f is not None and f == m:
            m = None
        for j in range(i):
            a[i, j] = a[j, i] = ((a[j, f] if f is not None else 0) + (a[j, m] if m is not None else 0)) / 2
        a[i, i] = 1 + (a[f, m] / 2 if f is not None and m is not None else 0)
        rows.append(("d", i, f, m, 0))
    deep = spark.createDataFrame(rows, "fam string, id int, father int, mother int, sex int")
    asked = [("d", rng.randrange(28), rng.randrange(28)) for _ in range(60)] + [("d", 27, 27)]
    got = G.kinship_of(deep, spark.createDataFrame(asked, "fam string, id1 int, id2 int")).collect()
    assert len(got) == 61 and all(abs(r.kinship - a[r.id1, r.id2] / 2) < 1e-12 for r in got)
    between = G.paths_between(deep, spark.createDataFrame([("d", 12, 13)], "fam string, id1 int, id2 int"))
    assert all(max(r.path) <= 13 for r in between.collect())
