from pyspark.sql import functions as F

from methylake.functions import expr as X
from methylake.operators import alignments as A
from methylake.operators import coverage as C
from methylake.operators import genome as G


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_exact_round_is_printf(spark):
    rows = [(float(m), float(n)) for n in range(1, 130) for m in range(n + 1)]
    df = spark.createDataFrame(rows, "m double, n double").withColumn("x", F.col("m") / F.col("n") * 100)
    for digits in (1, 2, 6):
        got = df.select("x", X.exact_round(F.col("x"), digits).alias("r")).collect()
        assert [r.r for r in got] == [float(f"{r.x:.{digits}f}") for r in got]


def test_exact_round_named_values(spark):
    df = spark.createDataFrame([(12.25,), (0.25,), (12.35,), (0.05,)], "x double")
    assert [r[0] for r in df.select(X.exact_round(F.col("x"), 1)).collect()] == [12.2, 0.2, 12.3, 0.1]
    assert spark.createDataFrame([(2.675,)], "x double").select(X.exact_round(F.col("x"), 2)).first()[0] == 2.67


def test_text_window_is_clamped(spark):
    s = F.lit("ACGT")
    r = one(spark, a=X.text_window(s, F.lit(-2), 3), b=X.text_window(s, F.lit(-10), 1), c=X.text_window(s, F.lit(4), 2), d=X.text_window(s, F.lit(1), 2))
    assert tuple(r) == ("GT", "A", "", "CG")


def test_complements(spark):
    r = one(spark, a=X.revcomp(F.lit("ACGN")), b=X.revcomp_any_case(F.lit("acGt")), c=X.revcomp_iupac(F.lit("ARYN")))
    assert tuple(r) == ("NCGT", "ACGT", "NRYT")


def test_cigar(spark):
    ops = X.cigar_ops(F.lit("3S5M2D3M1I"))
    r = one(spark, r=X.ref_span(ops), q=X.read_span(ops), b=X.aligned_blocks(ops))
    assert (r.r, r.q) == (10, 12)
    assert [tuple(x) for x in r.b] == [(3, 0, 5), (8, 7, 3)]


def test_trimmed_span_keeps_a_gap_at_the_boundary(spark):
    ops = X.cigar_ops(F.lit("5M2D3M"))
    r = one(spark, a=X.trimmed_span(ops, 3, F.lit(True)), b=X.trimmed_span(ops, 4, F.lit(True)), c=X.trimmed_span(ops, 5, F.lit(False)))
    assert tuple(r) == (7, 4, 5)


def test_strand_errors(spark):
    import pytest

    with pytest.raises(Exception, match="bad XR/XG"):
        spark.createDataFrame([("AA", "CT")], "xr string, xg string").select(X.strand(F.col("xr"), F.col("xg"))).collect()


def test_mapq_alone_and_tied(spark):
    r = one(spark, a=X.mapq(F.lit(100), F.lit(0), F.lit(None).cast("int")), b=X.mapq(F.lit(100), F.lit(0), F.lit(0)), c=X.mapq(F.lit(100), F.lit(-20), F.lit(None).cast("int")))
    assert tuple(r) == (42, 1, 0)


def test_umis(spark):
    r = one(spark, a=X.umi_tail(F.lit("x:1:ACG+T")), b=X.umi_bclconvert(F.lit("r:ACGT_1:N:0:ACG+T")), c=X.canonical_umi(F.lit("tta+acg")), d=X.umi_tail(F.lit("x")))
    assert tuple(r) == ("ACG+T", "ACGT", "ACG+TTA", None)


def test_filters(spark):
    df = spark.createDataFrame([("HHhHH",), ("HHzHH",), ("HHH",), ("HHZH",), ("ZZZZ",)], "xm string")
    assert [r[0] for r in df.select(A.unconverted_run(F.col("xm"))).collect()] == [False, False, True, True, False]
    df = spark.createDataFrame([("HHHH",), ("Hhhhh",)], "xm string")
    assert [r[0] for r in df.select(A.unconverted_share(F.col("xm"), 20)).collect()] == [False, True]


def test_genome_edges(spark):
    g = spark.createDataFrame([("1", "GGCCA"), ("2", "C"), ("3", "")], "chr string, seq string")
    # the last base and the first two Gs are never reported
    assert {(r.chr, r.pos, r.strand, r.tri) for r in G.cytosine_positions(g).collect()} == {("1", 3, "+", "CCA")}


def test_drach_wraps_around_the_start(spark):
    g = spark.createDataFrame([("1", "ACAAA")], "chr string, seq string")
    cov = spark.createDataFrame([("1", 2, 9, 1)], "chr string, pos long, m long, u long")
    assert [tuple(r) for r in C.drach_report(g, cov).collect()] == [("1", 2, "+", 9, 1, "AA", "CAA")]


def test_tiles_do_not_change_positions(spark):
    seq = "ACGTTGCACCGGGATCCGCGTATACGCGC" * 20
    g = spark.createDataFrame([("1", seq)], "chr string, seq string")
    whole = G.cytosine_positions(g, ffs=True).collect()
    core, G.tiles.__defaults__ = G.tiles.__defaults__, (7, 6)
    try:
        assert sorted(G.cytosine_positions(g, ffs=True).collect()) == sorted(whole)
    finally:
        G.tiles.__defaults__ = core


def test_call_string(spark):
    r = one(spark, ct=A.call_string(F.lit("CTCAC"), F.lit("CCCACGT")), ga=A.call_string(F.lit("GAG"), F.lit("TCGGG"), "GA"), slam=A.call_string(F.lit("TC"), F.lit("TTAA"), slam=True))
    assert (r.ct, r.slam) == ("HhH.Z", "zZ")
    assert len(r.ga) == 3


def test_empty_inputs(spark):
    g = spark.createDataFrame([], "chr string, seq string")
    cov = spark.createDataFrame([], "chr string, pos long, m long, u long")
    assert C.cytosine_report(g, cov).count() == 0
    assert C.context_summary(g, cov).count() == 64
    assert A.consistency(spark.createDataFrame([], "id long, xm string")).count() == 0


def test_partitioning_changes_nothing(spark):
    rows = [(0, i, "OT", "1", i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "file_ord int, ord long, strand string, chr string, key_pos long")
    a = A.mark_duplicates(df, "strand", "chr", "key_pos").where("not duplicate").select("ord")
    b = A.mark_duplicates(df.repartition(7), "strand", "chr", "key_pos").where("not duplicate").select("ord")
    assert sorted(a.collect()) == sorted(b.collect()) == [(i,) for i in range(5)]


def test_cytosines_are_cut_once(spark):
    # a base's 3-mer isn't cut, turned or matched again for each condition on it, and no pattern is a regular expression
    g = spark.createDataFrame([("1", "CCGATTGCAACG")], "chr string, seq string")
    plan = G.cytosine_positions(g)._jdf.queryExecution().executedPlan().toString()
    rows = plan[: plan.index("Generate explode")]
    assert rows.count("translate") == 0 and rows.count("LIKE") == 0 and rows.count("substring(rc") == 1
    assert sorted(tuple(r) for r in G.cytosine_positions(g).collect()) == [("1", 1, "+", "CHG", "CCG", "G"), ("1", 2, "+", "CG", "CGA", "CCG"), ("1", 3, "-", "CG", "CGG", "TCG"), ("1", 7, "-", "CHH", "CAA", "GCA"), ("1", 8, "+", "CHH", "CAA", "GCA")]
