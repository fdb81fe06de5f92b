"""Every query of the methylation operators against its twin in SQL, on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from methylake.operators import alignments as A
from methylake.operators import coverage as C
from methylake.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE[name])
    names = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(names)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=key)
    got = sorted((tuple(map(plain, r)) for r in df.select(*(f"`{n}`" for n in names)).collect()), key=key)
    assert got == want


# e * 2654435761 ends in 0xffff and lies above 2**53, so that the double nearest to it is a multiple of 65536
LARGE = [e for e in range(4_000_000, 6_000_000) if e * 2654435761 % 65536 == 65535]


@pytest.mark.parametrize("name", ["best_alignment_pe", "best_alignment_se", "combined_index_choice", "first_ambiguous", "run_counters"])
def test_scores_of_large_ids(spark, tmp_path, name):
    reads = ", ".join(f"({e // 4 * 4})" for e in LARGE)
    duckdb.sql(f"copy (select first + event_id as event_id, * exclude (event_id, first) from '{SF}/events.parquet', (values {reads}) r(first) where event_id < 4) to '{tmp_path}/events.parquet'")
    want = duckdb.sql(ORACLE[name].replace("FROM events", f"FROM '{tmp_path}/events.parquet'"))
    got = QUERIES[name](spark, str(tmp_path)).select(*(f"`{n}`" for n in want.columns)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_merge_samples_sums_once(spark):
    # each sum by position holds its keys in the task's memory: one before the shuffle, one after it
    plan = QUERIES["merge_samples"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2


def test_overlap_shuffles_no_call(spark):
    # alignments are dealt once, and sums of calls once
    plan = QUERIES["extract_calls_pe_overlap"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 0 and plan.count("Exchange") == 2


@pytest.mark.parametrize("trim", [(0, 0, 0, 0), (1, 2, 0, 0), (2, 3, 1, 4)])
def test_pairs_as_calls_joined(spark, trim):
    rows = [(i, "1", xr, "CT", 10, c, "z.XhZ.xxHz", 10 + s, "10M", "ZzHx.hhXxZ") for i, (xr, c, s) in enumerate((x, c, s) for x in ("CT", "GA") for c in ("10M", "4M3D6M", "2S5M1I2M") for s in (-6, 0, 3, 30))]
    pairs = spark.createDataFrame(rows, "id int, chr string, xr string, xg string, start1 int, cigar1 string, xm1 string, start2 int, cigar2 string, xm2 string")
    mates = [pairs.select("id", "chr", "xr", "xg", *(F.col(f"{c}{k}").alias(c) for c in ("start", "cigar", "xm"))) for k in (1, 2)]
    calls = A.extract_calls(mates[0], *trim[:2]).withColumn("mate", F.lit(1)).unionByName(A.extract_calls(mates[1], *trim[2:]).withColumn("mate", F.lit(2)))
    want = A.drop_overlap(calls, pairs.select("id", "start1", "cigar1", (F.col("xr") == "CT").alias("forward")), trim[1])
    got = A.extract_pairs(pairs, *trim)
    assert 0 < want.count() < calls.count()
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["discordant_cpgs", "merge_cpgs"])
def test_cpgs_come_from_coverage(spark, name):
    # no row for every base of the genome: the only rows made are tiles
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "explode(sequence(" not in plan.replace(" ", "")


def test_covered_cpgs_as_of_report(spark):
    texts = ["CGCGTACGNCG", "CGG", "CG", "ACG", "GCGC", "NCGN", "C", "", "TTCGCGCG" * 30]
    genome = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("none", "ACGT")], "chr string, seq string")
    rows = [(str(i), p + 1, (p * 7 + k) % 3, (p + k) % 2) for i, t in enumerate(texts) for k in (0, 1) for p in range(len(t) + 2) if p % 2 == k]
    cov = spark.createDataFrame(rows, "chr string, pos long, m long, u long")
    want = C.paired_cpgs(C.cytosine_report(genome, cov)).where("m1 + u1 + m2 + u2 > 0")
    got = C.covered_cpgs(genome, cov).select(want.columns)
    assert want.count() > 50
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["five_base_call", "methylation_call", "slam_call"])
def test_calls_without_lambdas(spark, name):
    # a lambda is interpreted for every base
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan


def test_calls_of_odd_texts(spark):
    rows = [("CTC", "CCGGA"), ("", "AC"), ("CC", "C"), (None, "CCC"), ("C", None), ("CCTC", "CNCXGN"), ("éC", "CCGé"), ("TTTC", "TTATCC")]
    df = spark.createDataFrame(rows, "r string, w string").coalesce(1)
    kinds = [A.call_string(F.col("r"), F.col("w"), **k) for k in ({}, {"genome_conversion": "GA"}, {"five_base": True}, {"slam": True})]
    got = [[r[0] for r in df.select(k).collect()] for k in kinds]
    assert got[0] == ["Xz.", "", "H.", None, None, "U.u.", ".Z", "...."]
    assert got[3] == ["...", "", "..", None, None, "....", "..", "zz.Z"]
    assert all([x is None for x in g] == [False, False, False, True, True, False, False, False] and [len(x or "") for x in g] == [3, 0, 2, 0, 0, 4, 2, 4] for g in got)
