import gzip
import lzma

import pytest
from pyspark.sql import functions as F

from kindred.errors import FileFormatError
from kindred.sources import pedigrees, text, variants


@pytest.fixture
def put(tmp_path):
    def write(name, content):
        path = tmp_path / name
        path.write_text(content)
        return str(path)

    return write


def test_compressed_lines(spark, tmp_path):
    body = "alpha\nbeta\ngamma\n"
    for name, opener in (("t.gz", gzip.open), ("t.xz", lzma.open), ("t.lzma", lambda p, m: lzma.open(p, m, format=lzma.FORMAT_ALONE))):
        with opener(tmp_path / name, "wb") as f:
            f.write(body.encode())
        assert [(r.line, r.value) for r in text.read_lines(spark, str(tmp_path / name)).orderBy("line").collect()][:3] == [(0, "alpha"), (1, "beta"), (2, "gamma")]


def test_pedigree(spark, put):
    path = put("p.ped", "1 1 0 0\t1 2\n1 2 0 0  2 1\n1\t3 1 2 2 A\n1 4 1 2 0 X\n")
    rows = {r.id: r for r in pedigrees.read_ped(spark, path).collect()}
    assert rows["3"].father == "1" and rows["1"].father is None
    assert [(rows[i].sex, rows[i].affected) for i in "1234"] == [(0, 1), (1, 0), (1, 1), (None, None)]
    with pytest.raises(KeyError):
        pedigrees.read_ped(spark, put("q.ped", "1 1 9 0 1 2\n"))


def test_plink(spark, put, tmp_path):
    put("x.ped", "1 1 0 0 1 -9 1 2 1 1 2 0 0 2\n1 2 0 0 2 -9 2 2 2 2 1 2 0 0\n")
    put("x.map", "1 a 0 10\n1 b 1 20\n2 c 0 5\n2 d 2 9\n")
    people, markers, genotypes = pedigrees.read_plink(spark, prefix=str(tmp_path / "x"))
    got = {(r.id, r.chrom_idx, r.marker_idx): (r.a0, r.a1) for r in genotypes.collect()}
    assert got[("1", 0, 0)] == ("1", "2") and got[("1", 1, 0)] == ("2", None) and got[("2", 1, 1)] == (None, None) and markers.count() == 4 and people.count() == 2
    with pytest.raises(FileFormatError):
        pedigrees.read_map(spark, put("y.map", "1 a 0 10\n1 b 1 5\n"))


def test_vcf(spark, put):
    path = put("v.vcf", "##x\n#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT A B\n1\t5\trs\tG\tA\t9\tPASS\tAF=0.5,0.1;DB\tGT:DP\t0|1:3\t1/1:2\n20\t7\t.\tT\t.\t.\tq10\tNS=2\tGT\t.|.\t0\n20\t8\t.\tT\tA,C\t3\tPASS\t.\tDP:GT\t4:0|2\t5:1\n")
    ids, markers, calls = variants.read_vcf(spark, path, frequency_key="AF")
    assert ids == ["A", "B"] and [(r.chrom_idx, r.marker_idx, r.maf) for r in markers.orderBy("chrom_idx", "marker_idx").collect()] == [(0, 0, 0.5), (1, 0, 0.0), (1, 1, 0.0)]
    assert {(r.id, r.chrom_idx, r.marker_idx, r.hap): r.allele for r in calls.collect()} == {("A", 0, 0, 1): 1, ("B", 0, 0, 0): 1, ("B", 0, 0, 1): 1, ("A", 1, 0, 0): None, ("A", 1, 0, 1): None, ("A", 1, 1, 1): 2, ("B", 1, 1, 0): 1}
    assert variants.read_vcf(spark, path, require_pass=True)[1].count() == 2


def test_other_formats(spark, put):
    traits, genotypes = variants.read_beagle(spark, put("b.bgl", "I id p1 p1 p2 p2\nA dis 2 2 1 1\nM m1 A G G 0\n"), put("b.markers", "m1 10 A G\n"))
    assert {(r.id, r.name): r.value for r in traits.collect()} == {("p1", "dis"): 1.0, ("p2", "dis"): 0.0}
    assert {r.id: (r.a0, r.a1, r.marker_idx) for r in genotypes.collect()} == {"p1": ("A", "G", 0), "p2": ("G", None, 0)}
    g = variants.read_germline(spark, put("g.match", "f1 a f1 b 1 100 2000 rs1 rs2 50 1.9 MB 0 1 1\nf1 a f2 c 1 100 2000 rs1 rs2 50 2.5 cM 0 1 1\n")).orderBy("id2").collect()
    assert (g[0].bp_start, g[0].length, g[1].bp_start, g[1].length) == (100, 1.9, None, 2.5)
    k = pedigrees.read_kinship(spark, put("k.txt", "1 b a 0.25\n")).first()
    assert (k.id1, k.id2, k.kinship) == ("a", "b", 0.25)
    m = variants.read_genomesimla(spark, put("s.loc", "chr\n2\na x 0.1 0.5 10\nb x 0.2 0.25 20\n")).orderBy("marker_idx").collect()
    assert [(r.label, r.cm) for r in m] == [("a", 0.5), ("b", 0.75)]
    geno, ibd = variants.read_constraints(spark, put("c.txt", "# c\ngenotype 1 2 0 3 2 P set\nibd 1 5 1 0 3 M\n"))
    assert geno.first().allele == 2 and ibd.first().ancestor == "1"


def test_phenotypes_round_trip(spark, put, tmp_path):
    df = pedigrees.read_phenotypes(spark, put("p.csv", "famid,id,affected,size\n1,a,1,X\n1,b,None,2.5\n1,c,tall,\n"))
    got = {(r.id, r.name): (r.value, r.label) for r in df.collect()}
    assert got[("a", "affected")] == (1.0, None) and got[("a", "size")] == (None, None) and got[("b", "affected")] == (None, None) and got[("c", "affected")] == (None, "tall")
    pedigrees.write_phenotypes(df, str(tmp_path / "out"))
    back = pedigrees.read_phenotypes(spark, str(tmp_path / "out")).filter(F.col("value").isNotNull())
    assert back.count() == 2


def test_folders_of_beagle_and_genomesimla_files(spark, put, tmp_path):
    for name in ("g", "m", "s"):
        (tmp_path / name).mkdir()
    put("g/1.bgl", "I id p1 p1 p2 p2\nA dis 2 2 1 1\nM m1 A A G 0\n")
    put("g/2.bgl", "I id q1 q1 p1 p1\nA dis 1 1 2 2\nM m1 C C A A\nM m2 T T 0 0\n")
    put("m/1.markers", "m1 90 A G\n")
    put("m/2.markers", "m2 10 C T\n")
    traits, genotypes = variants.read_beagle(spark, str(tmp_path / "g"), str(tmp_path / "m"))
    assert sorted((r.id, r.value) for r in traits.collect()) == [("p1", 1.0), ("p2", 0.0), ("q1", 0.0)]
    assert sorted((r.id, r.label, r.a0, r.a1, r.marker_idx) for r in genotypes.collect()) == [
        ("p1", "m1", "A", "A", 0), ("p1", "m1", "A", "A", 0), ("p1", "m2", None, None, 1), ("p2", "m1", "G", None, 0), ("q1", "m1", "C", "C", 0), ("q1", "m2", "T", "T", 1),
    ]
    put("s/a.loc", "c1\n2\na x 0.1 0.5 10\nb x 0.2 0.25 20\n")
    put("s/b.loc", "c2\n1\nd x 0.3 1.5 7\n")
    got = sorted((r.chrom, r.marker_idx, r.label, r.cm) for r in variants.read_genomesimla(spark, str(tmp_path / "s")).collect())
    assert got == [("c1", 0, "a", 0.5), ("c1", 1, "b", 0.75), ("c2", 0, "d", 1.5)]


def test_vcf_of_many_samples_plans_quickly(spark, put):
    import time

    n = 20_000
    calls = ["0|0"] * n
    calls[17_003] = "0|1"
    path = put("wide.vcf", "##x\n#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT " + " ".join(f"s{k}" for k in range(n)) + "\n1\t5\trs\tG\tA\t9\tPASS\t.\tGT\t" + "\t".join(calls) + "\n")
    began = time.time()
    ids, _, found = variants.read_vcf(spark, path)
    assert len(ids) == n and [(r.id, r.hap, r.allele) for r in found.collect()] == [("s17003", 1, 1)]
    assert time.time() - began < 60
