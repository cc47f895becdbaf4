"""Recombination, founder haplotypes, gene dropping, mating and haplotype pools.

Haplotypes are long rows (keys, hap, chrom_idx, marker_idx, allele). A gamete takes, at each marker, the haplotype that
a running count of switches tells: between markers d cM apart a switch has the Haldane probability (1 - exp(-d/50))/2."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SimulationError
from ..operators.genealogy import MOST_GENERATIONS, depth, descent, edges
from ..operators.individuals import is_founder
from ..plans.tables import apart, cut, discard
from .random import choice, uniform
from .trait import Trait

LOCUS = ["chrom_idx", "marker_idx"]


def switches(markers: DataFrame) -> DataFrame:
    """(locus, r): chance of a switch before the marker; one half at the first of a chromosome."""
    w = Window.partitionBy("chrom_idx").orderBy("marker_idx")
    step = F.col("cm") - F.lag("cm").over(w)
    return markers.select(*LOCUS, F.when(step.isNull(), 0.5).otherwise((1 - F.exp(-2 * step / 100)) / 2).alias("r"))


def strands(gametes: DataFrame, keys: list[str], markers: DataFrame, seed: int | str) -> DataFrame:
    """(keys, locus, strand 0 or 1) for each gamete: which haplotype of the parent is passed on."""
    w = Window.partitionBy(*keys, "chrom_idx").orderBy("marker_idx")
    grid = gametes.select(*keys).join(switches(markers))
    turn = (uniform(seed, *keys, *LOCUS) < F.col("r")).cast("int")
    return grid.withColumn("_t", turn).select(*keys, *LOCUS, (F.sum("_t").over(w) % 2).cast("int").alias("strand"))


def equilibrium_haplotypes(who: DataFrame, keys: list[str], markers: DataFrame, seed: int | str) -> DataFrame:
    """(keys, hap, locus, allele): independent alleles, 2 with the minor frequency, else 1."""
    if markers.filter("maf is null or maf < 0").head(1):
        raise ValueError("a marker has no frequency")
    haps = who.select(*keys, F.explode(F.array(F.lit(0), F.lit(1))).alias("hap"))
    grid = haps.join(markers.select(*LOCUS, "maf"))
    return grid.select(*keys, "hap", *LOCUS, F.when(uniform(seed, *keys, "hap", *LOCUS) < F.col("maf"), 2).otherwise(1).alias("allele"))


def founder_labels(who: DataFrame, keys: list[str], markers: DataFrame) -> DataFrame:
    """(keys, hap, locus, allele): each founder haplotype its own label ``id/hap``, so equal means equal by descent."""
    haps = who.select(*keys, F.explode(F.array(F.lit(0), F.lit(1))).alias("hap"))
    return haps.join(markers.select(*LOCUS)).select(*keys, "hap", *LOCUS, F.concat_ws("/", F.col("id").cast("string"), F.col("hap").cast("string")).alias("allele"))


def gene_drop(individuals: DataFrame, markers: DataFrame, founders: DataFrame, seed: int | str = 1, reps: int | DataFrame = 1, pins: DataFrame | None = None) -> DataFrame:
    """(rep, fam, id, hap, locus, allele): founder haplotypes dropped through the pedigree, all replicates in one pass,
    one join for each generation. ``founders`` has (fam, id, hap, locus, allele), and rep if they differ by replicate.
    ``pins`` (of :func:`descent_pins`) fix the strand of some gametes at markers of a chromosome. ``reps`` is their number, or a
    frame (rep) of those to draw: a replicate's draws depend on its number only."""
    spark = individuals.sparkSession
    replicates = spark.range(reps).select(F.col("id").cast("int").alias("rep")) if isinstance(reps, int) else reps.select("rep")
    if "rep" not in founders.columns:
        founders = founders.join(replicates)
    shape = ["rep", "fam", "id", "hap", *LOCUS, "allele"]
    known = cut(founders.select(*shape))
    levels = cut(depth(individuals))
    deepest = levels.agg(F.max("depth")).first()[0] or 0
    ways = edges(individuals).join(apart(levels), ["fam", "id"])
    for level in range(1, deepest + 1):
        gametes = ways.filter(F.col("depth") == level).select("fam", "id", "parent", F.col("via").alias("hap")).join(replicates)
        chosen = strands(gametes, ["rep", "fam", "id", "hap", "parent"], markers, f"{seed}/drop")
        if pins is not None:
            chosen = _pinned(chosen, pins, markers, f"{seed}/drop")
        source = known.select("rep", "fam", F.col("id").alias("parent"), F.col("hap").alias("strand"), *LOCUS, "allele")
        made = chosen.join(apart(source), ["rep", "fam", "parent", "strand", *LOCUS]).select(*shape)
        known = known.unionByName(cut(made))
    return known


def genotypes_of(haplotypes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, locus, a0, a1) from haplotype rows."""
    return haplotypes.groupBy(*keys, *LOCUS).agg(F.max(F.when(F.col("hap") == 0, F.col("allele"))).alias("a0"), F.max(F.when(F.col("hap") == 1, F.col("allele"))).alias("a1"))


def constrain(haplotypes: DataFrame, constraints: DataFrame) -> DataFrame:
    """Founder haplotypes with alleles set by (fam, id, hap, locus, allele) rows."""
    fixed = constraints.select("fam", "id", "hap", *LOCUS, F.col("allele").alias("_set"))
    return haplotypes.join(apart(fixed), ["fam", "id", "hap", *LOCUS], "left").withColumn("allele", F.coalesce("_set", "allele")).drop("_set")


def ibd_sharing(dropped: DataFrame, who: DataFrame) -> DataFrame:
    """(rep, fam, locus, id1, id2, shared): labels in common of pairs of ``who`` (fam, id), id1 < id2, 0 to 2."""
    own = genotypes_of(dropped.join(apart(who.select("fam", "id")), ["fam", "id"], "left_semi"), ["rep", "fam", "id"])
    x = own.withColumnsRenamed({"id": "id1", "a0": "_a", "a1": "_b"})
    y = own.withColumnsRenamed({"id": "id2", "a0": "_c", "a1": "_d"})
    a, b, c, d = (F.col(n) for n in ("_a", "_b", "_c", "_d"))
    both = ((a == c) & (b == d)) | ((a == d) & (b == c))
    one = (a == c) | (a == d) | (b == c) | (b == d)
    return x.join(apart(y), ["rep", "fam", *LOCUS]).filter("id1 < id2").select("rep", "fam", *LOCUS, "id1", "id2", F.when(both, 2).when(one, 1).otherwise(0).alias("shared"))


def constrained_drop(individuals: DataFrame, markers: DataFrame, founders: DataFrame, accept: Callable[[DataFrame], DataFrame], seed: int | str = 1, reps: int = 1, attempts: int = 1000, first: int = 4) -> DataFrame:
    """Gene drop by rejection: ``accept`` maps dropped haplotypes (rep) to the replicates (rep) that meet the constraints, family
    by family if it gives (rep, fam). Each takes its first accepted try. Tries are drawn for what is still open only,
    ``first`` of them and then twice as many each time; accepted tries are written to the shared folder. Raises if any
    replicate is open after ``attempts`` tries. Try t of replicate r has the draws of replicate r * attempts + t."""
    if reps < 1:
        return gene_drop(individuals, markers, founders, seed, 0)
    open_ = cut(individuals.select("fam").distinct().select("fam", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))).alias("_r")), "open")
    taken, done, step = [], 0, first
    while open_.head(1):
        if done == attempts:
            raise SimulationError("some replicates met no accepted try")
        tries = min(step, attempts - done)
        wanted = open_.select("_r", "fam", F.explode(F.sequence(F.lit(done), F.lit(done + tries - 1))).alias("_t")).withColumn("rep", F.col("_r") * attempts + F.col("_t"))
        here = individuals.join(open_.select("fam").distinct(), "fam", "left_semi")
        mine = founders.join(open_.select("fam").distinct(), "fam", "left_semi")
        tried = gene_drop(here, markers, mine, seed, wanted.select("rep").distinct())
        tried = cut(tried.join(wanted.select("rep", "fam"), ["rep", "fam"], "left_semi"), "tries")
        good = accept(tried)
        whole = "fam" not in good.columns
        met = good.select("rep").distinct().join(wanted, "rep") if whole else good.select("rep", "fam").distinct().join(wanted, ["rep", "fam"])
        won = cut(met.groupBy("_r", "fam").agg(F.min("rep").alias("rep")), "won")
        taken.append(cut(tried.join(won, ["rep", "fam"]).withColumn("rep", F.col("_r").cast("int")).drop("_r"), "accepted"))
        left = cut(open_.join(won, ["_r", "fam"], "left_anti"), "open")
        discard(tried, won, open_)
        open_, done, step = left, done + tries, step * 2
    discard(open_)
    return reduce(DataFrame.unionByName, taken)


def drop_until_trait(individuals: DataFrame, markers: DataFrame, founders: DataFrame, trait: Trait, affected: DataFrame, seed: int | str = 1, reps: int = 1, accuracy: float = 0.9, attempts: int = 1000, first: int = 4) -> DataFrame:
    """(rep, fam, id, hap, locus, allele): replicates in which the trait foretells, in each family, at least the share
    ``accuracy`` of the known affections (fam, id, affected 0 or 1, null unknown). ``founders`` may have alleles or be labels
    filled in before; a family without any known affection raises, as it can never be judged."""
    known = affected.filter("affected is not null").select("fam", "id", F.col("affected").cast("double").alias("_y"))
    if individuals.select("fam").distinct().join(known, "fam", "left_anti").head(1):
        raise SimulationError("a family has no known affection")

    def accept(dropped: DataFrame) -> DataFrame:
        """(rep, fam) that fit: the noise of a replicate depends on its number."""
        calls = genotypes_of(dropped, ["rep", "fam", "id"]).withColumn("_fam", F.col("fam"))
        told = trait.predict(calls.withColumn("fam", F.concat_ws(":", "rep", "fam")), f"{seed}/trait").withColumnRenamed("value", "_v")
        whose = calls.select("rep", F.col("_fam").alias("fam"), "id").distinct().withColumn("_key", F.concat_ws(":", "rep", "fam"))
        both = whose.join(known, ["fam", "id"]).join(told.withColumnRenamed("fam", "_key"), ["_key", "id"], "left")
        return both.groupBy("rep", "fam").agg(F.avg(F.coalesce((F.col("_v") == F.col("_y")).cast("double"), F.lit(0.0))).alias("_a")).filter(F.col("_a") >= accuracy).select("rep", "fam")

    return constrained_drop(individuals, markers, founders, accept, seed, reps, attempts, first)


def descent_pins(individuals: DataFrame, constraints: DataFrame, seed: int | str = 1) -> DataFrame:
    """(rep-free pins: fam, id, hap, chrom_idx, pin_idx, pin): the strand that gametes must show for ``constraints``
    (fam, id, ancestor, chrom_idx, marker_idx, chromatid 0 or 1) to hold: the person carries that haplotype of the
    ancestor. Of several lines of descent one is drawn at each person whose parents both lead to the ancestor.

    Raises if a person does not descend from the ancestor, or if two constraints ask one gamete for different things at
    one marker."""
    up = edges(individuals).select("fam", F.col("id").alias("at"), "parent", "via")
    lead = descent(individuals).select("fam", F.col("id").alias("parent"), F.col("anc").alias("ancestor")).distinct()
    ways = cut(up.join(apart(lead), ["fam", "parent"]))  # (fam, at, parent, via, ancestor): steps that lead to an ancestor
    asked = cut(constraints.select("fam", "id", "ancestor", *LOCUS, "chromatid").distinct())
    who = ["fam", "id", "ancestor", *LOCUS, "chromatid"]
    frontier, taken = asked.withColumn("at", F.col("id")), None
    for _ in range(MOST_GENERATIONS):
        step = frontier.join(apart(ways), ["fam", "at", "ancestor"]).groupBy(*who, "at").agg(F.min(F.struct(uniform(f"{seed}/line", "fam", "id", "at", "via").alias("u"), "via", "parent")).alias("x"))
        step = cut(step.select(*who, "at", "x.via", "x.parent"))
        if not step.head(1):
            break
        taken = step if taken is None else taken.unionByName(step)
        frontier = step.filter("parent <> ancestor").select(*who, F.col("parent").alias("at"))
    if taken is None:
        if asked.head(1):
            raise SimulationError("a constrained person does not descend from the ancestor")
        taken = asked.withColumns({"at": F.col("id"), "via": F.lit(0), "parent": F.col("id")})
    if asked.join(apart(taken.filter("parent = ancestor").select(*who)), who, "left_anti").head(1):
        raise SimulationError("a constrained person does not descend from the ancestor")
    above = taken.select(*who, F.col("at").alias("parent"), F.col("via").alias("_v"))
    need = taken.join(apart(above), [*who, "parent"], "left").withColumn("pin", F.when(F.col("parent") == F.col("ancestor"), F.col("chromatid")).otherwise(F.col("_v")))
    pins = cut(need.select("fam", F.col("at").alias("id"), F.col("via").alias("hap"), "chrom_idx", F.col("marker_idx").alias("pin_idx"), F.col("pin").cast("int").alias("pin")).distinct())
    if pins.groupBy("fam", "id", "hap", "chrom_idx", "pin_idx").count().filter("count > 1").head(1):
        raise SimulationError("constraints contradict each other")
    return pins


def _pinned(chosen: DataFrame, pins: DataFrame, markers: DataFrame, seed: int | str) -> DataFrame:
    """Strands of pinned gametes. Where the first pin of a chromosome is missed, all strands are turned over: both are as
    likely and switches do not depend on them, so this is a draw from all gametes that meet the pin, without tries that
    fail. From the first pin on to the last one the strands are drawn anew where there are several (:func:`_between`)."""
    keys = ["rep", "fam", "id", "hap", "parent", "chrom_idx"]
    gamete = ["fam", "id", "hap", "chrom_idx"]
    every = pins.groupBy(*gamete).agg(F.sort_array(F.collect_list(F.struct("pin_idx", "pin"))).alias("_pins"))
    first = every.select(*gamete, F.col("_pins")[0]["pin_idx"].alias("pin_idx"), F.col("_pins")[0]["pin"].alias("pin"))
    joined = chosen.join(apart(first), gamete, "left")
    shown = F.max(F.when(F.col("marker_idx") == F.col("pin_idx"), F.col("strand"))).over(Window.partitionBy(*keys))
    turned = F.when(F.col("pin") != shown, 1 - F.col("strand")).otherwise(F.col("strand"))
    met = joined.withColumn("strand", turned).drop("pin_idx", "pin")
    several = every.filter(F.size("_pins") > 1)
    if not several.head(1):
        return met
    free = met.join(apart(several.select(*gamete)), gamete, "left_anti")
    return free.select(*keys, "marker_idx", "strand").unionByName(_between(met, several, markers, keys, gamete, seed))


def _between(met: DataFrame, several: DataFrame, markers: DataFrame, keys: list[str], gamete: list[str], seed: int | str) -> DataFrame:
    """(keys, marker_idx, strand) of gametes with several pins on a chromosome: the strands are a chain of two states, and
    between pins each step is drawn given the state before it and the next pin. Over a distance x the state changes with
    chance q(x) = (1 - exp(-x / 50)) / 2, so the chance of a step is known in closed form (forward filtering, and sampling from
    the state reached). The draws are those of the free chain."""
    place = markers.select(*LOCUS, F.col("cm").cast("double").alias("cm"))
    at = several.select(*gamete, F.explode("_pins").alias("p")).select(*gamete, F.col("p.pin_idx").alias("marker_idx"), F.col("p.pin").alias("pin"))
    at = at.join(place, LOCUS).groupBy(*gamete).agg(F.sort_array(F.collect_list(F.struct(F.col("marker_idx").alias("i"), "cm", "pin"))).alias("_pins"))
    same = at.filter("exists(sequence(1, size(_pins) - 1), k -> _pins[k].cm = _pins[k - 1].cm and _pins[k].pin <> _pins[k - 1].pin)")
    if same.head(1):
        raise SimulationError("constraints contradict each other: two pins of a gamete at one place of the map")
    rows = met.join(apart(at), gamete).join(place, LOCUS)
    rows = rows.withColumn("u", uniform(seed, "rep", "fam", "id", "hap", "parent", *LOCUS))
    rows = rows.withColumn("next", F.expr("get(filter(_pins, p -> p.i >= marker_idx), 0)")).withColumn("first", F.expr("_pins[0].i"))
    chain = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("marker_idx").alias("i"), "cm", "u", "strand", "next"))).alias("m"), F.first("first").alias("first"))
    q = lambda x: (1 - F.exp(-x / 50)) / 2

    def walk(state, m):
        before = F.element_at(state["cms"], -1)
        r, rest, whole = q(m["cm"] - before), q(m["next"]["cm"] - m["cm"]), q(m["next"]["cm"] - before)
        odd = F.element_at(state["out"], -1) != m["next"]["pin"]
        turns = F.when(m["next"].isNull(), r).when(whole == 0, 0.0).when(odd, r * (1 - rest) / F.greatest(whole, F.lit(1e-300))).otherwise(r * rest / (1 - whole))
        drawn = F.when(m["u"] < turns, 1 - F.element_at(state["out"], -1)).otherwise(F.element_at(state["out"], -1))
        strand = F.when(m["i"] <= F.col("first"), m["strand"]).otherwise(drawn)
        return F.struct(F.array_append(state["out"], strand).alias("out"), F.array(m["cm"]).alias("cms"))

    start = F.struct(F.array(F.expr("m[0].strand")).alias("out"), F.array(F.expr("m[0].cm")).alias("cms"))
    out = chain.withColumn("out", F.aggregate(F.expr("slice(m, 2, size(m))"), start, walk)["out"])
    return out.select(*keys, F.explode(F.arrays_zip(F.col("m.i").alias("marker_idx"), F.col("out").alias("strand"))).alias("x")).select(*keys, "x.marker_idx", "x.strand")


def descent_drop(individuals: DataFrame, markers: DataFrame, constraints: DataFrame, seed: int | str = 1, reps: int = 1) -> DataFrame:
    """(rep, fam, id, hap, locus, allele): founder labels dropped so that all descent constraints hold."""
    labels = founder_labels(individuals.filter(is_founder()), ["fam", "id"], markers)
    return gene_drop(individuals, markers, labels, seed, reps, descent_pins(individuals, constraints, seed))


def ibd_states(dropped: DataFrame, who: DataFrame) -> DataFrame:
    """(rep, fam, locus, id1, id2, shared): as :func:`ibd_sharing`, and each person with themselves: 2 where both labels
    are the same, else 0."""
    own = genotypes_of(dropped.join(apart(who.select("fam", "id")), ["fam", "id"], "left_semi"), ["rep", "fam", "id"])
    alone = own.select("rep", "fam", *LOCUS, F.col("id").alias("id1"), F.col("id").alias("id2"), F.when(F.col("a0") == F.col("a1"), 2).otherwise(0).alias("shared"))
    return ibd_sharing(dropped, who).unionByName(alone)


def random_mating(people: DataFrame, size: int, seed: int | str = 1) -> DataFrame:
    """(child, father, mother, sex): uniform parents of each sex for ``size`` children."""
    ranked = _ranked(people)
    n = {r["sex"]: r["n"] for r in ranked.groupBy("sex").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        raise SimulationError("mating takes both sexes")
    child = people.sparkSession.range(size).select(F.col("id").alias("child"))
    drawn = child.select("child", choice(F.lit(n[0]), f"{seed}/f", "child").alias("_f"), choice(F.lit(n[1]), f"{seed}/m", "child").alias("_m"), choice(F.lit(2), f"{seed}/s", "child").cast("int").alias("sex"))
    return _parents(drawn, ranked)


def monogamous_mating(people: DataFrame, size: int, seed: int | str = 1) -> DataFrame:
    """(child, father, mother, sex): both sexes in a hashed order make couples; children pick a couple."""
    ranked = _ranked(people, seed)
    n = {r["sex"]: r["n"] for r in ranked.groupBy("sex").agg(F.count("*").alias("n")).collect()}
    couples = min(n.get(0, 0), n.get(1, 0))
    if not couples:
        raise SimulationError("mating takes both sexes")
    child = people.sparkSession.range(size).select(F.col("id").alias("child"))
    pick = choice(F.lit(couples), f"{seed}/c", "child")
    return _parents(child.select("child", pick.alias("_f"), pick.alias("_m"), choice(F.lit(2), f"{seed}/s", "child").cast("int").alias("sex")), ranked)


def _ranked(people: DataFrame, seed: int | str | None = None) -> DataFrame:
    """(id, sex, _k): places from 0 among those of a sex, in order of id or of a hash; counted within slices of ids or
    hashes and by the slices before them, so that no task gets all people of a sex."""
    u = F.col("id").cast("double") if seed is None else uniform(f"{seed}/o", "id")
    sliced = people.filter("sex in (0, 1)").select("id", "sex", u.alias("_u"), F.floor(F.col("id") / 100_000 if seed is None else u * 4096).alias("_b"))
    before = F.sum("_n").over(Window.partitionBy("sex").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    first = sliced.groupBy("sex", "_b").agg(F.count("*").alias("_n")).select("sex", "_b", F.coalesce(before, F.lit(0)).alias("_s"))
    inner = F.row_number().over(Window.partitionBy("sex", "_b").orderBy("_u", "id")) - 1
    return sliced.withColumn("_i", inner).join(first, ["sex", "_b"]).select("id", "sex", (F.col("_s") + F.col("_i")).cast("long").alias("_k"))


def _parents(drawn: DataFrame, ranked: DataFrame) -> DataFrame:
    f = ranked.filter("sex = 0").select(F.col("_k").alias("_f"), F.col("id").alias("father"))
    m = ranked.filter("sex = 1").select(F.col("_k").alias("_m"), F.col("id").alias("mother"))
    return drawn.join(apart(f), "_f").join(apart(m), "_m").select("child", "father", "mother", "sex")


def pool_start(spark, markers: DataFrame, size: int, seed: int | str = 1) -> DataFrame:
    """(hap_id, locus, allele): ``size`` equilibrium haplotypes of each chromosome."""
    ids = spark.range(size).select(F.col("id").alias("hap_id"))
    grid = ids.join(markers.select(*LOCUS, "maf"))
    return grid.select("hap_id", *LOCUS, F.when(uniform(f"{seed}/p", "hap_id", *LOCUS) < F.col("maf"), 2).otherwise(1).alias("allele"))


def pool_step(pool: DataFrame, markers: DataFrame, size: int, old_size: int, generation: int, seed: int | str = 1) -> DataFrame:
    """The next generation of a pool: each haplotype recombines two random ones."""
    new = pool.sparkSession.range(size).select(F.col("id").alias("hap_id"))
    s = f"{seed}/{generation}"
    chosen = strands(new, ["hap_id"], markers, f"{s}/x")
    parents = [choice(F.lit(old_size), f"{s}/{k}", "hap_id", "chrom_idx") for k in (0, 1)]
    source = chosen.withColumn("_from", F.when(F.col("strand") == 0, parents[0]).otherwise(parents[1]))
    old = pool.select(F.col("hap_id").alias("_from"), *LOCUS, "allele")
    return source.join(old, ["_from", *LOCUS]).select("hap_id", *LOCUS, "allele")


def pool_evolve(pool: DataFrame, markers: DataFrame, size: int, growth: Callable[[int], int], generations: int, seed: int | str = 1) -> tuple[DataFrame, int]:
    """(pool, size) after so many generations whose sizes ``growth`` tells."""
    for g in range(generations):
        new = growth(g + 1)
        pool, size = cut(pool_step(pool, markers, new, size, g, seed)), new
    return pool, size


def pool_fix(pool: DataFrame, chrom_idx: int, marker_idx: int, value: int) -> DataFrame:
    here = (F.col("chrom_idx") == chrom_idx) & (F.col("marker_idx") == marker_idx)
    return pool.withColumn("allele", F.when(here, value).otherwise(F.col("allele")))


def pool_founders(who: DataFrame, keys: list[str], pool: DataFrame, size: int, seed: int | str = 1) -> DataFrame:
    """(keys, hap, locus, allele): founder haplotypes drawn from the pool, each chromosome by itself."""
    haps = who.select(*keys, F.explode(F.array(F.lit(0), F.lit(1))).alias("hap")).join(pool.select("chrom_idx").distinct())
    picked = haps.withColumn("hap_id", choice(F.lit(size), f"{seed}/d", *keys, "hap", "chrom_idx"))
    return picked.join(pool, ["hap_id", "chrom_idx"]).select(*keys, "hap", *LOCUS, "allele")


def spans(dropped: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hap, chrom_idx, anc, start, stop): runs of one founder label, half-open."""
    w = Window.partitionBy(*keys, "hap", "chrom_idx").orderBy("marker_idx")
    new = F.when(F.lag("allele").over(w).eqNullSafe(F.col("allele")), 0).otherwise(1)
    marked = dropped.withColumn("_n", new).withColumn("_g", F.sum("_n").over(w))
    return marked.groupBy(*keys, "hap", "chrom_idx", "_g").agg(F.first("allele").alias("anc"), F.min("marker_idx").alias("start"), (F.max("marker_idx") + 1).alias("stop")).drop("_g")


def delabel(spanned: DataFrame, founders: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hap, locus, allele): founder alleles over each inherited span."""
    label = F.concat_ws("/", F.col("id").cast("string"), F.col("hap").cast("string"))
    source = founders.select(label.alias("anc"), *LOCUS, "allele")
    wide = spanned.withColumn("marker_idx", F.explode(F.sequence("start", F.col("stop") - 1)))
    return wide.join(apart(source), ["anc", *LOCUS]).select(*keys, "hap", *LOCUS, "allele")


def founders_of(individuals: DataFrame) -> DataFrame:
    return individuals.filter(is_founder())


def proportion(df: DataFrame, predicate: Column) -> float:
    """Share of rows for which the predicate holds."""
    return df.agg(F.avg(predicate.cast("double"))).first()[0] or 0.0
