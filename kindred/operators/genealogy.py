"""Ancestry: closures, depth, lineages, descent paths, kinship, inbreeding, fraternity and relationship matrices.

Descent weights L(i, a), the sum over descent paths from a to i of one half to the number of steps, are summed by
generation, so looped pedigrees do not multiply paths. With D(a) = 1 for a founder, 3/4 - F(p)/4 with one known parent
and 1/2 - (F(f) + F(m))/4 with both, the additive relationship is A(i, j) = sum over a of L(i, a) D(a) L(j, a).
Everything joins within families, so families are the unit of distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import apart, cut
from .individuals import is_founder

#: Generations after which a pedigree is taken to contain a cycle.
MOST_GENERATIONS = 1000


def edges(individuals: DataFrame) -> DataFrame:
    """(fam, id, parent, via): via 0 is the father's side, 1 the mother's."""
    both = F.array(F.struct(F.col("father").alias("p"), F.lit(0).alias("v")), F.struct(F.col("mother").alias("p"), F.lit(1).alias("v")))
    return individuals.select("fam", "id", F.explode(both).alias("x")).filter("x.p is not null").select("fam", "id", F.col("x.p").alias("parent"), F.col("x.v").alias("via"))


def descent(individuals: DataFrame) -> DataFrame:
    """(fam, id, anc, steps, n, w): paths from each ancestor by length; everyone is their own ancestor at 0 steps."""
    start = individuals.select("fam", "id", F.col("id").alias("anc"), F.lit(0).alias("steps"), F.lit(1).cast("long").alias("n"), F.lit(1.0).alias("w"))
    up = edges(individuals).select("fam", F.col("id").alias("anc"), "parent")
    out, frontier = start, start
    for step in range(1, MOST_GENERATIONS):
        moved = frontier.join(apart(up), ["fam", "anc"]).groupBy("fam", "id", "parent").agg(F.sum("n").alias("n"), (F.sum("w") * 0.5).alias("w"))
        frontier = cut(moved.select("fam", "id", F.col("parent").alias("anc"), F.lit(step).alias("steps"), "n", "w"))
        if not frontier.head(1):
            return out
        out = out.unionByName(frontier)
    raise ValueError("the pedigree has a cycle")


def ancestors(individuals: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(fam, id, ancestor)"""
    paths = descent(individuals) if paths is None else paths
    return paths.filter("steps > 0").select("fam", "id", F.col("anc").alias("ancestor")).distinct()


def descendants(individuals: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(fam, id, descendant)"""
    return ancestors(individuals, paths).select("fam", F.col("ancestor").alias("id"), F.col("id").alias("descendant"))


def depth(individuals: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(fam, id, depth): 0 for founders, else one more than the deeper parent."""
    paths = descent(individuals) if paths is None else paths
    return paths.groupBy("fam", "id").agg(F.max("steps").alias("depth"))


def common_ancestors(individuals: DataFrame, pairs: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(fam, id1, id2, ancestor) for the given pairs."""
    found = ancestors(individuals, paths)
    one = pairs.join(apart(found.withColumnRenamed("id", "id1")), ["fam", "id1"])
    return one.join(apart(found.withColumnRenamed("id", "id2")), ["fam", "id2", "ancestor"]).select("fam", "id1", "id2", "ancestor")


def siblings(individuals: DataFrame, include_half: bool = False) -> DataFrame:
    """(fam, id, sibling): same father and mother, or either of them; everyone with parents is their own sibling."""
    e = edges(individuals)
    meet = e.join(e.select("fam", "via", "parent", F.col("id").alias("sibling")), ["fam", "via", "parent"]).groupBy("fam", "id", "sibling").agg(F.count("*").alias("n"))
    return meet.filter(F.col("n") >= (1 if include_half else 2)).select("fam", "id", "sibling")


def half_siblings(individuals: DataFrame) -> DataFrame:
    """(fam, id, sibling): exactly one parent in common."""
    return siblings(individuals, True).join(siblings(individuals), ["fam", "id", "sibling"], "left_anti")


def lineage(individuals: DataFrame, via: str = "mother") -> DataFrame:
    """(fam, id, line): the founder at the end of the mothers (matriline) or of the fathers (patriline)."""
    up = individuals.select("fam", F.col("id").alias("line"), F.col(via).alias("_up"))
    current = individuals.select("fam", "id", F.col("id").alias("line"))
    for _ in range(MOST_GENERATIONS):
        moved = current.join(apart(up), ["fam", "line"]).select("fam", "id", F.coalesce("_up", "line").alias("line"), F.col("_up").isNotNull().alias("_moved"))
        moved = cut(moved)
        current = moved.select("fam", "id", "line")
        if not moved.filter("_moved").head(1):
            return current
    raise ValueError("the pedigree has a cycle")


def closed_up(individuals: DataFrame, asked: DataFrame) -> DataFrame:
    """(fam, id): the asked persons (fam, id) and all their ancestors, one row each."""
    up = edges(individuals).select("fam", "id", "parent")
    out = frontier = asked.select("fam", "id").distinct()
    for _ in range(MOST_GENERATIONS):
        frontier = cut(frontier.join(apart(up), ["fam", "id"]).select("fam", F.col("parent").alias("id")).distinct())
        if not frontier.head(1):
            return cut(out.distinct())
        out = out.unionByName(frontier)
    raise ValueError("the pedigree has a cycle")


def paths_down(individuals: DataFrame, starts: DataFrame | None = None, through: DataFrame | None = None) -> DataFrame:
    """(fam, start, end, path): every path of descent as an array of ids, from ``starts`` (fam, id) or from everyone,
    over persons of ``through`` (fam, id) alone if given.

    Paths multiply in looped pedigrees: name the starts there, and the persons that paths may lead to."""
    begin = (individuals if starts is None else starts).select("fam", F.col("id").alias("start"), F.col("id").alias("end"), F.array("id").alias("path"))
    down = edges(individuals if through is None else individuals.join(through.select("fam", "id"), ["fam", "id"], "left_semi"))
    down = down.select("fam", F.col("parent").alias("end"), F.col("id").alias("_child"))
    out, frontier = begin, begin
    for _ in range(MOST_GENERATIONS):
        frontier = cut(frontier.join(apart(down), ["fam", "end"]).select("fam", "start", F.col("_child").alias("end"), F.concat("path", F.array("_child")).alias("path")))
        if not frontier.head(1):
            return out
        out = out.unionByName(frontier)
    raise ValueError("the pedigree has a cycle")


def paths_between(individuals: DataFrame, pairs: DataFrame) -> DataFrame:
    """(fam, id1, id2, anc, path): direct descent either way, and up to a common ancestor and down again with no
    person twice. Only paths between asked persons and their ancestors are listed."""
    asked = pairs.select("fam", F.explode(F.array("id1", "id2")).alias("id"))
    reach = closed_up(individuals, asked)
    down = cut(paths_down(individuals, reach, reach))
    x = down.select("fam", F.col("start").alias("anc"), F.col("end").alias("id1"), F.col("path").alias("_p"))
    y = down.select("fam", F.col("start").alias("anc"), F.col("end").alias("id2"), F.col("path").alias("_q"))
    met = pairs.join(apart(x), ["fam", "id1"]).join(apart(y), ["fam", "id2", "anc"])
    path = F.concat(F.reverse("_p"), F.slice("_q", 2, F.size("_q")))
    return met.withColumn("path", path).filter(F.size(F.array_distinct("path")) == F.size("path")).select("fam", "id1", "id2", "anc", "path")


def path_kinship(individuals: DataFrame, pairs: DataFrame, inbreeding_of: DataFrame) -> DataFrame:
    """(fam, id1, id2, kinship) by summing over paths; with oneself 1/2 whatever one's own inbreeding."""
    f = inbreeding_of.select("fam", F.col("id").alias("anc"), "inbreeding")
    term = F.pow(F.lit(0.5), F.size("path")) * (1 + F.coalesce("inbreeding", F.lit(0.0)))
    found = paths_between(individuals, pairs.filter("id1 <> id2")).join(apart(f), ["fam", "anc"], "left").groupBy("fam", "id1", "id2").agg(F.sum(term).alias("_k"))
    return pairs.join(apart(found), ["fam", "id1", "id2"], "left").select("fam", "id1", "id2", F.when(F.col("id1") == F.col("id2"), 0.5).otherwise(F.coalesce("_k", F.lit(0.0))).alias("kinship"))


def _weights(paths: DataFrame) -> DataFrame:
    return paths.groupBy("fam", "id", "anc").agg(F.sum("w").alias("w"))


def inbreeding(individuals: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(fam, id, inbreeding): the kinship of the parents, 0 where one is unknown."""
    return coefficients(individuals, paths)[0]


def coefficients(individuals: DataFrame, paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(fam, id, inbreeding) and (fam, anc, d), the weights D; generation by generation, as the weights of ancestors
    need their own coefficients first."""
    paths = cut(descent(individuals) if paths is None else paths)
    known = depth(individuals, paths)
    weights = cut(_weights(paths))
    people = cut(individuals.select("fam", "id", "father", "mother").join(apart(known), ["fam", "id"]))
    founders = people.filter(is_founder())
    out = founders.select("fam", "id", F.lit(0.0).alias("inbreeding"))
    d = founders.select("fam", F.col("id").alias("anc"), F.lit(1.0).alias("d"))
    deepest = people.agg(F.max("depth")).first()[0] or 0
    wf = weights.select("fam", F.col("id").alias("father"), "anc", F.col("w").alias("_wf"))
    wm = weights.select("fam", F.col("id").alias("mother"), "anc", F.col("w").alias("_wm"))
    for level in range(1, deepest + 1):
        here = people.filter((F.col("depth") == level) & ~is_founder())
        through = here.join(apart(wf), ["fam", "father"]).join(apart(wm), ["fam", "mother", "anc"]).join(apart(d), ["fam", "anc"])
        theta = through.groupBy("fam", "id").agg((F.sum(F.col("_wf") * F.col("d") * F.col("_wm")) / 2).alias("_t"))
        new = here.select("fam", "id").join(apart(theta), ["fam", "id"], "left").select("fam", "id", F.coalesce("_t", F.lit(0.0)).alias("inbreeding"))
        d = d.unionByName(cut(mendelian(here, out)))
        out = out.unionByName(cut(new))
    return out, d


def mendelian(individuals: DataFrame, inbreeding_of: DataFrame) -> DataFrame:
    """(fam, anc, d): share of a person's alleles that is new to the pedigree."""
    f = inbreeding_of.select("fam", F.col("id").alias("_p"), "inbreeding")
    one = individuals.join(apart(f.withColumnRenamed("_p", "father").withColumnRenamed("inbreeding", "_f")), ["fam", "father"], "left")
    both = one.join(apart(f.withColumnRenamed("_p", "mother").withColumnRenamed("inbreeding", "_m")), ["fam", "mother"], "left")
    part = F.coalesce("_f", F.lit(0.0)) + F.coalesce("_m", F.lit(0.0))
    d = F.when(is_founder(), 1.0).when(F.col("father").isNull() | F.col("mother").isNull(), 0.75 - part / 4).otherwise(0.5 - part / 4)
    return both.select("fam", F.col("id").alias("anc"), d.alias("d"))


def additive(individuals: DataFrame, subset: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """(fam, id1, id2, value): non-zero entries of A, both triangles; ``subset`` (fam, id) limits rows and columns."""
    paths = cut(descent(individuals) if paths is None else paths)
    d = coefficients(individuals, paths)[1]
    weights = _weights(paths)
    if subset is not None:
        weights = weights.join(apart(subset.select("fam", "id")), ["fam", "id"], "left_semi")
    weights = cut(weights)
    x = weights.join(apart(d), ["fam", "anc"]).select("fam", "anc", F.col("id").alias("id1"), (F.col("w") * F.col("d")).alias("_x"))
    y = weights.select("fam", "anc", F.col("id").alias("id2"), F.col("w").alias("_y"))
    return x.join(apart(y), ["fam", "anc"]).groupBy("fam", "id1", "id2").agg(F.sum(F.col("_x") * F.col("_y")).alias("value"))


def kinship(individuals: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(fam, id1, id2, kinship) of related pairs, id1 <= id2; with oneself (1 + F) / 2."""
    return additive(individuals, paths=paths).filter("id1 <= id2").select("fam", "id1", "id2", (F.col("value") / 2).alias("kinship"))


def kinship_of(individuals: DataFrame, pairs: DataFrame, inbreeding_of: DataFrame | None = None) -> DataFrame:
    """(fam, id1, id2, kinship) of the asked pairs (fam, id1, id2), 0 for strangers; with oneself (1 + F) / 2.

    A pair's relationship is an entry of A v with v the indicator of ``id1``: one sweep up the generations gathers v's
    ancestors with their weights, those are multiplied by D, and one sweep down, over ancestors of asked persons only,
    brings the sums to ``id2``. A sweep has at most a row for each distinct ``id1``, person and generation, whatever the number
    of paths, pairs and common ancestors. ``inbreeding_of`` (fam, id, inbreeding) of the persons above the pairs saves
    working it out. Repeated pairs give repeated rows; a pair with a person that is not in the table has a null kinship."""
    asked = pairs.select("fam", F.explode(F.array("id1", "id2")).alias("id"))
    reach = closed_up(individuals, asked)
    here = cut(individuals.join(apart(reach), ["fam", "id"], "left_semi").select("fam", "id", "father", "mother"))
    d = coefficients(here)[1] if inbreeding_of is None else mendelian(here, inbreeding_of)
    links = edges(here).select("fam", "id", "parent")

    def swept(begin: DataFrame, here_of: str, to: str) -> DataFrame:
        steps = links.select("fam", F.col(here_of).alias("at"), F.col(to).alias("_to"))
        out = frontier = begin
        for _ in range(MOST_GENERATIONS):
            moved = frontier.join(apart(steps), ["fam", "at"]).groupBy("fam", "source", F.col("_to").alias("at")).agg((F.sum("w") * 0.5).alias("w"))
            frontier = cut(moved)
            if not frontier.head(1):
                return cut(out.groupBy("fam", "source", "at").agg(F.sum("w").alias("w")))
            out = out.unionByName(frontier)
        raise ValueError("the pedigree has a cycle")

    known = here.select("fam", F.col("id").alias("source"))
    sources = pairs.select("fam", F.col("id1").alias("source")).distinct().join(apart(known), ["fam", "source"], "left_semi")
    up = swept(sources.select("fam", "source", F.col("source").alias("at"), F.lit(1.0).alias("w")), "id", "parent")
    weighed = up.join(apart(d.withColumnRenamed("anc", "at")), ["fam", "at"]).select("fam", "source", "at", (F.col("w") * F.col("d")).alias("w"))
    down = swept(weighed, "parent", "id").select("fam", F.col("source").alias("id1"), F.col("at").alias("id2"), (F.col("w") / 2).alias("_k"))
    there = here.select("fam", "id", F.lit(True).alias("_in"))
    out = pairs.join(apart(down), ["fam", "id1", "id2"], "left")
    for side, seen in (("id1", "_in1"), ("id2", "_in2")):
        out = out.join(apart(there.select("fam", F.col("id").alias(side), F.col("_in").alias(seen))), ["fam", side], "left")
    return out.select("fam", "id1", "id2", F.when(F.col("_in1") & F.col("_in2"), F.coalesce("_k", F.lit(0.0))).alias("kinship"))


def fraternity(individuals: DataFrame, kin: DataFrame, pairs: DataFrame) -> DataFrame:
    """(fam, id1, id2, fraternity): probability of sharing both alleles by descent; 0 where a parent is unknown."""
    both = kin.unionByName(kin.filter("id1 <> id2").select("fam", F.col("id2").alias("id1"), F.col("id1").alias("id2"), "kinship"))
    parents = individuals.select("fam", "id", "father", "mother")
    out = pairs.join(apart(parents.select("fam", F.col("id").alias("id1"), F.col("father").alias("_f1"), F.col("mother").alias("_m1"))), ["fam", "id1"])
    out = out.join(apart(parents.select("fam", F.col("id").alias("id2"), F.col("father").alias("_f2"), F.col("mother").alias("_m2"))), ["fam", "id2"])
    for name, a, b in (("mm", "_m1", "_m2"), ("ff", "_f1", "_f2"), ("mf", "_m1", "_f2"), ("fm", "_f1", "_m2")):
        out = out.join(apart(both.select("fam", F.col("id1").alias(a), F.col("id2").alias(b), F.col("kinship").alias(name))), ["fam", a, b], "left")
    k = {n: F.coalesce(F.col(n), F.lit(0.0)) for n in ("mm", "ff", "mf", "fm")}
    return out.select("fam", "id1", "id2", (k["mm"] * k["ff"] + k["mf"] * k["fm"]).alias("fraternity"))


def dominance(individuals: DataFrame, kin: DataFrame | None = None) -> DataFrame:
    """(fam, id1, id2, value): fraternity of pairs that have any, 1 on the diagonal; both triangles."""
    kin = cut(kinship(individuals) if kin is None else kin)
    known = kin.filter("id1 <> id2").select("fam", "id1", "id2")
    pairs = fraternity(individuals, kin, known).filter("fraternity > 0").withColumnRenamed("fraternity", "value")
    turned = pairs.select("fam", F.col("id2").alias("id1"), F.col("id1").alias("id2"), "value")
    diagonal = individuals.select("fam", F.col("id").alias("id1"), F.col("id").alias("id2"), F.lit(1.0).alias("value"))
    return pairs.unionByName(turned).unionByName(diagonal)


def mitochondrial(individuals: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """(fam, id1, id2, value 1.0): pairs of one matriline, both triangles and the diagonal."""
    line = lineage(individuals, "mother")
    if subset is not None:
        line = line.join(subset.select("fam", "id"), ["fam", "id"], "left_semi")
    line = cut(line)
    return line.withColumnRenamed("id", "id1").join(apart(line.withColumnRenamed("id", "id2")), ["fam", "line"]).select("fam", "id1", "id2", F.lit(1.0).alias("value"))


def related(kin: DataFrame, threshold: Column | float = 0.0) -> DataFrame:
    return kin.filter(F.col("kinship") > threshold)
