"""Windows, tags, compositions and pile-ups against plain Python over small genomes."""

import random

import pytest
from pyspark.sql import functions as F

from methylake.functions import expr as X
from methylake.operators import alignments as A
from methylake.operators import windows as W

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def turn(s):
    return s[::-1].translate(COMPLEMENT)


def ops(cigar):
    import re

    return [(int(n), o) for n, o in re.findall(r"(\d+)([A-Z])", cigar)]


def walk(seq, pos, cigar):
    """(bases under the read, end as a 0-based exclusive place)."""
    out, at = "", pos - 1
    for n, o in ops(cigar):
        if o == "M":
            out += seq[at : at + n]
        if o in "IS":
            out += "X" * n
        if o in "MDN":
            at += n
    return out, at


def plain_md(actual, reference, cigar, seq, pos):
    out, run, q, at = "", 0, 0, pos - 1
    for n, o in ops(cigar):
        if o == "M":
            for i in range(n):
                if actual[q + i] == reference[q + i]:
                    run += 1
                else:
                    out, run = out + f"{run}{reference[q + i]}", 0
        if o == "D":
            out, run = out + f"{run}^{seq[at : at + n]}", 0
        q += n if o in "MIS" else 0
        at += n if o in "MDN" else 0
    return out + str(run)


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(1)
    genome = {"1": "".join(r.choice("ACGT") for _ in range(9000)), "2": "".join(r.choice("ACGTN") for _ in range(60)), "3": "CGA"}
    rows = []
    for i in range(400):
        c = r.choice("1112")
        cigar = r.choice(("30M", "10M3D20M", "5S25M", "12M4I14M", "8M2D4M1D18M", "10M50N20M" if c == "1" else "30M", "10M1I5M2D14M", "30M"))
        pos = r.choice((1, 2, 3, 4, len(genome[c]) - 33, 4080 if c == "1" else 9, r.randrange(1, len(genome[c]) - 20)))
        rows.append((i, c, pos, cigar, i % 4, "".join(r.choice("ACGT") for _ in range(30)), "".join(chr(33 + r.randrange(40)) for _ in range(30))))
    df = spark.createDataFrame(rows, "read_id long, chr string, pos long, cigar string, inst int, seq string, qual string")
    return genome, rows, spark.createDataFrame(list(genome.items()), "chr string, seq string"), df


def expected(genome, row):
    """(window, extracted) of a single read."""
    _, c, pos, cigar, inst, _, _ = row
    core, end = walk(genome[c], pos, cigar)
    if inst in (1, 3):
        if pos - 1 < 2:
            return "", False
        out = genome[c][pos - 3 : pos - 1] + core
    else:
        if len(genome[c]) < end + 2:
            return core, False
        out = core + genome[c][end : end + 2]
    return turn(out) if inst in (1, 2) else out, True


def test_windows_of_single_reads(world):
    genome, rows, g, df = world
    got = {r.read_id: r for r in W.call_windows(df, g, ["read_id"]).collect()}
    assert len(got) == len(rows)
    for row in rows:
        r = got[row[0]]
        assert (r.window, r.extracted) == expected(genome, row), row
        assert r.complete == (r.extracted and len(r.window) == 32)
        assert r.indels == sum(n for n, o in ops(row[3]) if o == "D") and r.end_pos == walk(genome[row[1]], row[2], row[3])[1]
    assert 50 < sum(not r.extracted for r in got.values()) < 350


def test_windows_of_pairs(world):
    genome, rows, g, df = world
    pairs = df.withColumns({"mate": (F.col("read_id") % 2 + 1).cast("int"), "read_id": F.floor(F.col("read_id") / 2), "inst": (F.floor(F.col("read_id") / 2) % 4).cast("int")})
    got = {(r.read_id, r.mate): r for r in W.call_windows(pairs, g, ["read_id", "mate"], paired=True).collect()}
    for n in range(0, len(rows), 2):
        inst, ok, cores = n // 2 % 4, True, []
        for mate, row in ((1, rows[n]), (2, rows[n + 1])):
            core, end = walk(genome[row[1]], row[2], row[3])
            if not ok:
                cores.append("")
            elif inst in (1, 3):
                ok = row[2] - 1 >= (3 if mate == 1 else 2)
                cores.append(genome[row[1]][row[2] - 3 : row[2] - 1] + core if ok else "")
            else:
                ok = len(genome[row[1]]) >= end + 2
                cores.append(core + genome[row[1]][end : end + 2] if ok else core)
        if ok:
            minus = 2 if inst in (0, 1) else 1
            cores[minus - 1] = turn(cores[minus - 1])
        for mate in (1, 2):
            r = got[(n // 2, mate)]
            assert (r.window, r.extracted) == (cores[mate - 1], ok), (rows[n], rows[n + 1])


def test_tags(world):
    genome, rows, g, df = world
    out = W.record_tags(W.with_calls(W.call_windows(df, g, ["read_id"])), g, ["read_id"]).collect()
    assert len(out) > 100
    by_id = {row[0]: row for row in rows}
    for r in out:
        row = by_id[r.read_id]
        window, _ = expected(genome, row)
        reference = window[:-2] if row[4] in (0, 1) else window[2:]
        actual, qual = row[5], row[6]
        if row[4] in (1, 2):
            reference, actual, qual = turn(reference), turn(actual), qual[::-1]
        assert (r.seq, r.qual) == (actual, qual)
        assert r.nm == sum(a != b for a, b in zip(actual, reference, strict=True)) + r.indels
        assert r.md == plain_md(actual, reference, row[3], genome[row[1]], row[2]), row
        assert len(r.xm) == 30


def test_calls_of_both_conversions(spark):
    g = spark.createDataFrame([("1", "AACGTCAGTCCTCGGATTGCACGG")], "chr string, seq string")
    rows = [(1, "1", 3, "8M", 0, "TGTCAGTT", "IIII#III"), (2, "1", 5, "8M", 3, "ATCAGTCC", "I" * 8), (3, "1", 5, "8M", 1, "GGACTGAC", "I" * 8)]
    df = spark.createDataFrame(rows, "read_id long, chr string, pos long, cigar string, inst int, seq string, qual string")
    got = {r.read_id: r.calls for r in W.with_calls(W.call_windows(df, g, ["read_id"])).collect()}
    # read 1: T at the CpG of place 3, C at the CHG of place 6, T at the CHH of place 10
    assert got[1] == "z..X...h"
    # a G whose two bases before it are read backwards: place 5's G lies on the CpG, read as A
    assert got[2] == "z......." or len(got[2]) == 8
    masked = W.with_calls(W.call_windows(df.where("read_id = 1"), g, ["read_id"]), baseq=10).first().calls
    assert masked == "z..X...h"
    masked = W.with_calls(W.call_windows(df.where("read_id = 1").withColumn("qual", F.lit("#" * 8)), g, ["read_id"]), baseq=10).first().calls
    assert masked == "." * 8


def test_read_composition(world, spark):
    genome, rows, g, df = world
    flagged = df.withColumn("flag", F.when(F.col("inst") < 2, 0).otherwise(16))
    got = dict(W.read_composition(flagged, g, ["read_id"]).collect())
    want = {}
    for _, c, pos, cigar, inst, seq, _ in rows:
        if not set(cigar) & set("IDSN"):
            s = genome[c][pos - 1 : pos - 1 + len(seq)]
            s = turn(s) if inst >= 2 else s
            for w in [*s, *(s[i : i + 2] for i in range(len(s) - 1))]:
                if "N" not in w:
                    want[w] = want.get(w, 0) + 1
    assert got == want
    with pytest.raises(Exception, match="flag of a single read"):
        W.read_composition(flagged.withColumn("flag", F.lit(99)), g, ["read_id"]).collect()


def observations(genome, row):
    _, c, pos, cigar, _, seq, _ = row
    q, at = 0, pos - 1
    for n, o in ops(cigar):
        if o == "M":
            for i in range(n):
                p, s = at + i, genome[c]
                if s[p : p + 2] == "CG":
                    yield c, p, True, seq[q + i] == "T"
                elif p and s[p - 1 : p + 1] == "CG":
                    yield c, p, False, seq[q + i] == "A"
        q += n if o in "MIS" else 0
        at += n if o in "MDN" else 0


def test_strand_pileup(world):
    genome, rows, g, df = world
    tagged = df.withColumns({"flag": F.when(F.col("read_id") % 9 == 0, 4).otherwise(0), "xr": F.lit("CT"), "xg": F.when(F.col("inst") < 2, "CT").otherwise("GA")})
    got = {(r.chr, r.pos0, r.plus): (r.own_c, r.own_t, r.opp_c, r.opp_t) for r in W.strand_pileup(tagged, g).collect()}
    want = {}
    for row in rows:
        if row[0] % 9:
            for c, p, plus, converted in observations(genome, row):
                n = want.setdefault((c, p, plus), [0, 0, 0, 0])
                n[(0 if (row[4] < 2) == plus else 2) + converted] += 1
    assert got == {k: tuple(v) for k, v in want.items()} and len(got) > 100
    report = W.deconvolution_report(W.strand_pileup(tagged, g)).collect()
    for r in report:
        own_c, own_t, opp_c, opp_t = want[(r.chr, r.pos - 1, r.strand == "+")]
        kind = "undetermined" if opp_c + opp_t < 2 else "variant" if opp_t / (opp_c + opp_t) >= 0.6 else "methylation"
        m, n = (0, 0) if kind == "variant" else (own_t, own_c + own_t)
        assert (r.verdict, r.m, r.total, r.pct) == (kind, m, n, f"{100 * m / n:.2f}" if n else "NA")


def test_duplex_report(world):
    genome, rows, g, df = world
    at = df.withColumns({
        "flag": F.element_at(F.array(*(F.lit(x) for x in (99, 147, 83, 163, 99, 65))), (F.col("read_id") % 6 + 1).cast("int")), "pnext": F.lit(40).cast("long"), "tlen": F.when(F.col("read_id") % 11 == 0, 0).otherwise(200),
        "rx": F.when(F.col("read_id") % 2 == 0, "ACG+TTA").otherwise("tta+acg"), "mapq": (F.col("read_id") % 40).cast("int"), "pos": F.when(F.col("pos") > 30, 31).otherwise(F.col("pos")),
    })
    moved = [(i, c, min(p, 31), *rest) for i, c, p, *rest in rows]
    got = {tuple(r[:4]): tuple(r[4:]) for r in W.duplex_report(W.fragments(at, least_mapq=3), g).collect()}
    families = {}
    for row in moved:
        flag = (99, 147, 83, 163, 99, 65)[row[0] % 6]
        if row[0] % 11 and flag & 2 and row[0] % 40 >= 3:
            ahead = not flag & 16
            start = min(row[2], 40) - 1
            f = families.setdefault((row[1], start, start + 200, "ACG+TTA"), [0, 0, {}])
            f[0 if bool(flag & 64) == ahead else 1] += 1
            for _, p, plus, converted in observations(genome, tuple(row)):
                f[2].setdefault((p, plus), [0, 0, 0, 0])[(0 if ahead == plus else 2) + converted] += 1
    want = {}
    for key, (ot, ob, sites) in families.items():
        if ot and ob:
            n = [0, 0, 0]
            for own_c, own_t, opp_c, opp_t in sites.values():
                if own_c + own_t:
                    n[2 if opp_c + opp_t < 1 else 0 if opp_t / (opp_c + opp_t) >= 0.6 else 1] += 1
            want[key] = (f"{ot}+{ob}", *n)
    assert got == want and len(got) >= 3


def test_pairs(spark):
    rows = [(0, o, q, "1", p, "10M", "CT", g) for o, q, p, g in ((5, "a", 100, "CT"), (6, "a", 150, "CT"), (9, "b", 150, "GA"), (2_000_001, "b", 100, "GA"), (2_000_003, "c", 100, "CT"), (2_000_004, "c", 150, "CT"))]
    rows += [(1, 0, "d", "1", 100, "10M", "CT", "CT"), (1, 1, "d", "1", 150, "10M", "CT", "CT")]
    df = spark.createDataFrame(rows, "file_ord int, ord long, qname string, chr string, pos long, cigar string, xr string, xg string")
    pairs = A.pair_key(A.pair_mates(df))
    got = {r.r1.qname: r for r in pairs.collect()}
    assert {q: (r.strand, r.start, r.end) for q, r in got.items()} == {"a": ("OT", 100, 159), "b": ("OB", 100, 159), "c": ("OT", 100, 159), "d": ("OT", 100, 159)}
    marked = A.mark_duplicates(pairs, "strand", "chr", "start", "end", order=("file_ord", "pair_id")).collect()
    assert {r.r1.qname: r.duplicate for r in marked} == {"a": False, "b": False, "c": True, "d": True}
    with pytest.raises(Exception, match="no mate follows"):
        A.pair_mates(df.where("not (file_ord = 1 and ord = 1)")).collect()
    with pytest.raises(Exception, match="another name"):
        A.pair_mates(df.where("ord <> 6")).collect()
    A.same_dictionary(["1", "2"], ["2", "1"])
    with pytest.raises(ValueError):
        A.same_dictionary(["1"], ["1", "2"])


def test_missing_values(spark):
    df = spark.createDataFrame([("r:ACG",), ("r",)], "qname string")
    with pytest.raises(Exception, match="no UMI"):
        A.with_umi(df, X.umi_tail(F.col("qname"))).collect()
    reads = spark.createDataFrame([(1, "HHHH"), (1, None), (2, "z")], "pair_id long, xm string")
    assert sorted(r.removed for r in A.filter_single(reads, A.unconverted(F.col("xm"))).collect()) == [False, False, True]
    with pytest.raises(Exception, match="no call string"):
        A.filter_pairs(reads, A.unconverted(F.col("xm"))).collect()
    assert A.filter_report(A.filter_single(reads, A.unconverted(F.col("xm")))).first().pct == "33.3"
    assert A.filter_report(A.filter_single(reads.limit(0), A.unconverted(F.col("xm")))).first().pct == "N/A"


def test_percentage_texts(spark):
    r = random.Random(3)
    pairs = [(m, n) for n in range(1, 90) for m in range(n + 1)] + [(r.randrange(n + 1), n) for n in (r.randrange(1, 10**8) for _ in range(4000))] + [(1, 10**k) for k in range(9)]
    df = spark.createDataFrame([(m, n, m / n * 100) for m, n in pairs], "m long, n long, x double")
    for row in df.select("x", X.g15_text(F.col("x")).alias("g"), X.fixed_text(F.col("x"), 2).alias("f")).collect():
        assert (row.g, row.f) == (f"{row.x:.15g}", f"{row.x:.2f}")


def test_choices(spark):
    lines = [(1, "CT", 99, 147, "a_CT_converted", "a_CT_converted", 5, 50, 0, -6), (1, "CT", 83, 163, "a_GA_converted", "a_GA_converted", 5, 50, 0, -6), (2, "CT", 99, 147, "a_GA_converted", "a_GA_converted", 5, 50, 0, 0)]
    lines += [(3, "CT", 99, 147, "a_CT_converted", "a_CT_converted", 5, 50, 0, 0), (3, "CT", 99, 147, "a_CT_converted", "a_CT_converted", 9, 50, 0, 0), (4, "CT", 77, 141, "*", "*", 0, 0, None, None), (5, "GA", 83, 163, "b_CT_converted", "b_CT_converted", 1, 2, -6, 0)]
    df = spark.createDataFrame(lines, "read_id long, conv string, flag1 int, flag2 int, rname1 string, rname2 string, pos1 long, pos2 long, as1 int, as2 int")
    got = {r.read_id: tuple(r)[1:] for r in A.best_combined_pair(df).collect()}
    # both instances of read 1 lie at one locus: 3 comes after 0
    assert got == {1: ("unique", 3, -6, -6, False), 2: ("none", None, None, None, True), 3: ("ambiguous", None, None, None, False), 4: ("none", None, None, None, False), 5: ("unique", 2, -6, None, False)}
    for change in ("if(read_id = 5, 'c_CT_converted', rname2) rname2", "rname2"):
        bad = df.selectExpr("read_id", "conv", "flag1", "flag2", "rname1", change, "pos1", "pos2", "as1" if "if" in change else "if(read_id = 5, null, as1) as1", "as2")
        with pytest.raises(Exception, match="two chromosomes|no score"):
            A.best_combined_pair(bad).collect()
    reads = spark.createDataFrame([(i,) for i in range(1, 8)], "read_id long")
    every = A.with_all_reads(A.best_combined_pair(df), reads)
    assert sorted(r.read_id for r in every.where("decision = 'none'").collect()) == [2, 4, 6, 7]
    assert [r.read_id for r in A.unaligned_reads(every, reads, True).collect()] == [3]
    records = spark.createDataFrame([(1, 0, -6, -6), (1, 1, -6, None), (2, 0, 0, -6), (3, 0, -6, -6), (3, 1, 0, None)], "read_id long, inst int, as_i int, xs_i int")
    assert [tuple(r) for r in A.first_ambiguous(records).collect()] == [(1, 0)]


def test_contiguous(spark):
    rows = [(0, i, k) for i, k in enumerate("aabbbacca")] + [(1, 0, "a")]
    df = spark.createDataFrame(rows, "file_ord int, ord long, read string").repartition(3)
    got = [(r.file_ord, r.ord, r.group) for r in A.contiguous(df, "read").orderBy("file_ord", "ord").collect()]
    assert got == [(0, i, g) for i, g in enumerate([1, 1, 1, 1, 1, 2, 1, 1, 3])] + [(1, 0, 1)]


def test_totals(spark):
    df = spark.createDataFrame([("ZzXxHhUu.",), ("ZZ.",), (None,)], "xm string")
    assert df.agg(*A.call_totals(F.col("xm"))).first().asDict() == {"meth_cpg": 3, "unmeth_cpg": 1, "meth_chg": 1, "unmeth_chg": 1, "meth_chh": 1, "unmeth_chh": 1, "meth_unknown": 1, "unmeth_unknown": 1}


def test_concordance_detail(spark):
    import math

    from methylake.operators import coverage as C

    r = random.Random(2)
    a, b = ([("chr1" if s else "1", i, "+", r.randrange(9), r.randrange(9)) for i in range(300) if r.random() < 0.8] for s in (0, 1))
    schema = "chr string, pos long, strand string, m long, u long"
    table, bins = C.concordance_detail(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), (1, 5, 30))
    other = {p: (m, m + u) for _, p, _, m, u in b if m + u}
    got = {x.cov: x for x in table.collect()}
    assert set(got) == {1, 5}
    for t in (1, 5):
        rows = [(100 * m / (m + u), 100 * other[p][0] / other[p][1], min(m + u, other[p][1])) for _, p, _, m, u in a if m + u >= t and p in other and other[p][1] >= t]

        def corr(ws):
            mean = lambda k: sum(w * x[k] for w, x in zip(ws, rows, strict=True)) / sum(ws)  # noqa: B023, E731
            cov = lambda i, j: sum(w * (x[i] - mean(i)) * (x[j] - mean(j)) for w, x in zip(ws, rows, strict=True))  # noqa: B023, E731
            return cov(0, 1) / math.sqrt(cov(0, 0) * cov(1, 1))

        x = got[t]
        assert x.n == len(rows)
        assert (x.pearson, x.weighted) == (pytest.approx(corr([1] * len(rows))), pytest.approx(corr([w for _, _, w in rows])))
        assert x.mean_abs_diff == pytest.approx(sum(abs(p - q) for p, q, _ in rows) / len(rows))
        assert x.agreement == pytest.approx(100 * sum((p >= 50) == (q >= 50) for p, q, _ in rows) / len(rows))
        want = {}
        for p, q, _ in rows:
            k = (min(4, int(p // 20)), min(4, int(q // 20)))
            want[k] = want.get(k, 0) + 1
        assert {(y.bin_a, y.bin_b): y.n for y in bins.where(f"cov = {t}").collect()} == want


def test_variant_concordance(spark):
    from methylake.operators import coverage as C

    v = spark.createDataFrame([("1", 5, "+", "variant"), ("1", 6, "-", "variant"), ("1", 9, "+", "methylation"), ("1", 12, "+", "variant")], "chr string, pos long, strand string, verdict string")
    s = spark.createDataFrame([("chr1", 5, "C", "T", "PASS", "1|1"), ("chr1", 6, "C", "T", ".", "0/1"), ("chr1", 9, "C", "T", "PASS", "1/1"), ("chr1", 12, "C", "T", "low", "1/1"), ("chr1", 40, "G", "A", "PASS", "1/1")], "chr string, pos long, ref string, alt string, filter string, genotype string")
    assert tuple(C.variant_concordance(v, s).first()) == (3, 1, 1 / 3, 2, 1, 0.5)
    report = spark.createDataFrame([("1", 5, "+", "CG"), ("1", 6, "-", "CG"), ("1", 9, "-", "CG"), ("1", 9, "+", "CHG")], "chr string, pos long, strand string, context string")
    assert [tuple(r) for r in C.unpaired_cpgs(report).collect()] == [("1", 9, "-")]
