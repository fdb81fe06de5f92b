"""Coverage tables (chr, pos, m, u): from calls, merged over samples, joined to the genome, reported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from methylake.functions.expr import exact_round, percent, plain_name, ucsc_name
from methylake.operators.genome import as_cytosines, as_drach, as_gpc, at_positions, bases, chromosomes, tile_of, tiles, with_turned


def consistent_calls(calls: DataFrame) -> DataFrame:
    """Calls (meth, call) whose sign fits their letter: + with Z, X, H and - with z, x, h."""
    return calls.where("(meth = '+' and call in ('Z', 'X', 'H')) or (meth = '-' and call in ('z', 'x', 'h'))")


def call_counts(calls: DataFrame) -> DataFrame:
    """(chr, pos, m, u) of each consistent call: a coverage table not yet summed by position, for what sums it anyway."""
    return consistent_calls(calls).select("chr", "pos", *((F.col("meth") == sign).cast("long").alias(n) for sign, n in (("+", "m"), ("-", "u"))))


def coverage(calls: DataFrame, cutoff: int = 1) -> DataFrame:
    """(chr, pos, m, u, pct) of consistent calls with at least cutoff calls at a position; partial sums before the shuffle."""
    out = call_counts(calls).groupBy("chr", "pos").agg(F.sum("m").alias("m"), F.sum("u").alias("u"))
    return out.where(F.col("m") + F.col("u") >= cutoff).withColumn("pct", percent(F.col("m"), F.col("u")))


def bedgraph(cov: DataFrame, ucsc: bool = False) -> DataFrame:
    """(chr, start0, end, pct): half-open 0-based positions, names as UCSC has them on request."""
    return cov.select((ucsc_name(F.col("chr")) if ucsc else F.col("chr")).alias("chr"), (F.col("pos") - 1).alias("start0"), F.col("pos").alias("end"), "pct")


# Fixed value: the end of the names of the temporary files whose order is the order of chromosomes.
TEMPORARY = ".methXtractor.temp"


def ordered(cov: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """cov with order_key and in its file order: chromosomes by the bytes of their temporary file's name, then position.
    owners: (chr, file), whose file names begin those names."""
    if owners is not None:
        cov = cov.join(owners.select("chr", F.col("file").alias("_owner")), "chr", "left")
    owner = F.concat(F.coalesce("_owner", F.lit("")), F.lit(".chr")) if owners is not None else F.lit("chr")
    key = F.concat(owner, F.translate("chr", "|/", "__"), F.lit(TEMPORARY))
    cov = cov.withColumn("order_key", key).drop("_owner")
    return cov.orderBy(F.col("order_key").cast("binary"), "pos")


def merge_samples(samples: list[DataFrame]) -> DataFrame:
    """(chr, pos, m, u, pct) summed over coverage tables, pct to two decimals; positions without a call are left out.
    A table may have a position more than once, as call_counts() has: sums by sample first would be held in a task's
    memory beside the sums over samples."""
    union = samples[0].select("chr", "pos", "m", "u")
    for s in samples[1:]:
        union = union.unionByName(s.select("chr", "pos", "m", "u"))
    out = union.groupBy("chr", "pos").agg(F.sum("m").alias("m"), F.sum("u").alias("u")).where("m + u > 0")
    return out.withColumn("pct", exact_round(percent(F.col("m"), F.col("u")), 2))


def _chromosomes(cov: DataFrame) -> DataFrame:
    """Chromosomes of a coverage table. The sums are asked for so that the table's own shuffle is used again."""
    return cov.groupBy("chr").agg(F.max(F.col("m") + F.col("u")).alias("_most")).where("_most is not null").select("chr")


def covered(genome: DataFrame, cov: DataFrame) -> DataFrame:
    """The C and G bases of the genome that cov has, placed, with m and u. Only chromosomes with coverage are cut into tiles."""
    return at_positions(genome.join(_chromosomes(cov), "chr", "left_semi"), cov.select("chr", "pos", "m", "u"))


def all_covered(genome: DataFrame, cov: DataFrame, text: str = "") -> DataFrame:
    """Every C and G base of the genome's tiles that hold a text, placed, with m and u, zeros where there is no coverage.
    cov has a position once. Coverage is grouped by tile before the join, so what is shuffled is tiles, and bases come into
    being after it."""
    rows = cov.where("pos > 0").select("chr", tile_of(F.col("pos")).alias("tile"), F.struct((F.col("pos") - 1).alias("p"), "m", "u").alias("c"))
    tiled = tiles(genome).where(F.col("text").contains(text)) if text else tiles(genome)
    near = with_turned(tiled.join(rows.groupBy("chr", "tile").agg(F.collect_list("c").alias("cov")), ["chr", "tile"], "left"))
    near = near.select("*", *(F.col(f"cov.{c}").alias(f"_{c}") for c in ("p", "m", "u"))).drop("cov")
    at = F.array_position("_p", F.col("i"))
    return bases(near).withColumns({c: F.when(at > 0, F.get(f"_{c}", (at - 1).cast("int"))).otherwise(0).cast("long") for c in ("m", "u")}).drop("_p", "_m", "_u")


def uncovered_chromosomes(genome: DataFrame, cov: DataFrame) -> DataFrame:
    """Chromosomes of the genome without any row in cov."""
    return chromosomes(genome).select("chr").join(cov.select("chr").distinct(), "chr", "left_anti")


def cytosine_report(genome: DataFrame, cov: DataFrame, cx: bool = False, threshold: int = 0, nome: bool = False, ffs: bool = False, zero_based: bool = False) -> DataFrame:
    """(chr, pos, strand, m, u, context, tri[, tetra, penta, hexa]) for every cytosine of the genome.

    Without cx only CpGs. A chromosome without coverage is reported only at threshold 0 and not with nome; nome keeps
    CpGs whose upstream 3-mer is ACG or TCG.
    """
    least = max(threshold, 1) if nome else threshold
    if least > 0:
        at = covered(genome, cov)
    else:
        at = all_covered(genome, cov, "" if cx else "CG")
    out = as_cytosines(at, ffs).where(F.col("m") + F.col("u") >= least)
    if not cx:
        out = out.where("context = 'CG'")
    if nome:
        out = out.where("context <> 'CG' or upstream in ('ACG', 'TCG')")
    return out.select("chr", (F.col("pos") - int(zero_based)).alias("pos"), "strand", "m", "u", "context", "tri", *(["tetra", "penta", "hexa"] if ffs else []))


def context_summary(genome: DataFrame, cov: DataFrame, threshold: int = 0) -> DataFrame:
    """64 rows (upstream, c_context, full_context, m, u, pct): calls by the base before a cytosine and its 3-mer, over covered chromosomes."""
    # positions without coverage add nothing, so the inner join gives the same sums as the full walk
    at = as_cytosines(covered(genome, cov)).where(F.col("m") + F.col("u") >= threshold)
    sums = at.groupBy(F.substring("upstream", 1, 1).alias("upstream"), F.col("tri").alias("c_context")).agg(F.sum("m").alias("m"), F.sum("u").alias("u"))
    rows = [(a, f"C{b}{c}", f"{a}C{b}{c}") for a in "ACGT" for b in "ACGT" for c in "ACGT"]
    spine = genome.sparkSession.createDataFrame(rows, "upstream string, c_context string, full_context string")
    out = F.broadcast(spine).join(sums, ["upstream", "c_context"], "left").fillna(0, ["m", "u"])
    return out.select("upstream", "c_context", "full_context", "m", "u", percent(F.col("m"), F.col("u")).alias("pct"))


def _given(threshold: int) -> int:
    """A threshold of covered positions, which is 1 or more."""
    if threshold < 1:
        raise ValueError(f"threshold {threshold}: must be 1 or more")
    return threshold


def gpc_report(genome: DataFrame, cov: DataFrame, threshold: int = 1, nome: bool = False) -> DataFrame:
    """(chr, pos, strand, m, u, context, tri) of covered GpC cytosines; nome leaves out those in CG context."""
    out = as_gpc(covered(genome, cov)).where(F.col("m") + F.col("u") >= _given(threshold))
    return (out.where("context <> 'CG'") if nome else out).select("chr", "pos", "strand", "m", "u", "context", "tri")


def drach_report(genome: DataFrame, cov: DataFrame, threshold: int = 1) -> DataFrame:
    """(chr, pos, strand, m, u, drach, tri) of covered cytosines in DRACH motifs."""
    return as_drach(covered(genome, cov)).where(F.col("m") + F.col("u") >= _given(threshold)).select("chr", "pos", "strand", "m", "u", "drach", "tri")


def _strands_beside(rows: DataFrame) -> DataFrame:
    """(chr, pos, m1, u1, m2, u2, n) of rows of CpGs on either strand: + at pos and - at pos + 1, zeros for one that is missing."""
    plus = F.col("strand") == "+"
    side = lambda here, c: F.coalesce(F.sum(F.when(here, F.col(c))), F.lit(0))
    sums = [side(here, c).alias(f"{c}{i}") for i, here in ((1, plus), (2, ~plus)) for c in ("m", "u")]
    return rows.groupBy("chr", F.when(plus, F.col("pos")).otherwise(F.col("pos") - 1).alias("pos")).agg(*sums, F.count(F.lit(1)).alias("n"))


def paired_cpgs(report: DataFrame) -> DataFrame:
    """CpG report rows of both strands side by side: (chr, pos, m1, u1, m2, u2), + at pos and - at pos + 1; a table that is
    so already, as covered_cpgs(), stays."""
    if "m1" in report.columns:
        return report
    return _strands_beside(report.where("context = 'CG'")).where("n = 2").drop("n")


def covered_cpgs(genome: DataFrame, cov: DataFrame) -> DataFrame:
    """The pairs of paired_cpgs() of a whole CpG report that have calls, without making that report: only covered CpGs are
    rows. A - strand row always has its + row beside it; a + row's partner lacks its 3-mer at the first base only."""
    at = as_cytosines(covered(genome, cov)).where("context = 'CG' and m + u > 0 and (strand = '-' or pos > 1)")
    return _strands_beside(at).drop("n")


def _discordant(limit: int):
    top, bottom = exact_round(percent(F.col("m1"), F.col("u1")), 6), exact_round(percent(F.col("m2"), F.col("u2")), 6)
    return F.coalesce((F.col("m1") + F.col("u1") > 0) & (F.col("m2") + F.col("u2") > 0) & (F.abs(top - bottom) > limit), F.lit(False))


def merge_cpgs(report: DataFrame, discordance: int | None = None) -> DataFrame:
    """(chr, start, end, pct, m, u) of both strands' calls pooled, from a report or from covered_cpgs(); CpGs without calls, and discordant ones if a limit is given, are left out."""
    pairs = paired_cpgs(report)
    if discordance is not None:
        pairs = pairs.where(~_discordant(discordance))
    m, u = F.col("m1") + F.col("m2"), F.col("u1") + F.col("u2")
    return pairs.where(m + u > 0).select("chr", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), percent(m, u).alias("pct"), m.alias("m"), u.alias("u"))


def discordant_cpgs(report: DataFrame, discordance: int) -> DataFrame:
    """(chr, pos, strand, pct, m, u) of both strands of CpGs whose percentages differ by more than discordance, from a report
    or from covered_cpgs()."""
    rows = F.array(
        F.struct(F.col("pos"), F.lit("+").alias("strand"), F.col("m1").alias("m"), F.col("u1").alias("u")),
        F.struct((F.col("pos") + 1).alias("pos"), F.lit("-").alias("strand"), F.col("m2").alias("m"), F.col("u2").alias("u")),
    )
    out = paired_cpgs(report).where(_discordant(discordance)).select("chr", F.inline(rows))
    return out.select("chr", "pos", "strand", percent(F.col("m"), F.col("u")).alias("pct"), "m", "u")


def rollup(cov: DataFrame, *keys: str) -> DataFrame:
    """Calls and positions rolled up over keys (an extension)."""
    return cov.rollup(*keys).agg(F.count(F.lit(1)).alias("positions"), F.sum("m").alias("m"), F.sum("u").alias("u"))


def concordance(a: DataFrame, b: DataFrame, least: int = 1) -> DataFrame:
    """One row (n, pearson, mean_abs_diff, agreement): two coverage tables at the positions that both cover least times."""
    x = a.where(F.col("m") + F.col("u") >= least).select("chr", "pos", percent(F.col("m"), F.col("u")).alias("x"))
    y = b.where(F.col("m") + F.col("u") >= least).select("chr", "pos", percent(F.col("m"), F.col("u")).alias("y"))
    both = x.join(y, ["chr", "pos"])
    return both.agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("pearson"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_abs_diff"), F.avg(((F.col("x") >= 50) == (F.col("y") >= 50)).cast("double")).alias("agreement"))


def concordance_detail(a: DataFrame, b: DataFrame, least: tuple[int, ...] = (1, 5, 10)) -> tuple[DataFrame, DataFrame]:
    """Two reports (chr, pos, strand, m, u), compared where both cover a position `least` times or more:
    (cov, n, pearson, weighted, mean_abs_diff, agreement) and (cov, bin_a, bin_b, n) of bins of 20 %.

    Names of chromosomes count without a leading chr; weights are the smaller coverage; agreement is in percent. Moments
    are summed around 50 %, in one pass, so few digits are lost; a correlation without variance is NaN."""
    side = lambda t, x, c: t.where("m + u > 0").select(plain_name(F.col("chr")).alias("chr"), "pos", "strand", (F.lit(100.0) * F.col("m") / (F.col("m") + F.col("u"))).alias(x), (F.col("m") + F.col("u")).alias(c))
    both = side(a, "x", "cx").join(side(b, "y", "cy"), ["chr", "pos", "strand"]).withColumn("w", F.least("cx", "cy"))
    both = both.withColumn("cov", F.explode(F.filter(F.array(*(F.lit(t) for t in least)), lambda t: F.col("w") >= t)))
    x, y, w = F.col("x") - 50, F.col("y") - 50, F.col("w").cast("double")

    def r(weight):
        s = {k: F.sum(weight * v) for k, v in {"1": F.lit(1.0), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}.items()}
        return (s["xy"] - s["x"] * s["y"] / s["1"]) / F.sqrt(F.greatest((s["xx"] - s["x"] * s["x"] / s["1"]) * (s["yy"] - s["y"] * s["y"] / s["1"]), F.lit(0.0)))

    rows = F.count(F.lit(1))
    safe = lambda c: F.coalesce(F.when(F.min("x") == F.max("x"), None).when(F.min("y") == F.max("y"), None).otherwise(c), F.lit(float("nan")))
    table = both.groupBy("cov").agg(rows.alias("n"), safe(r(F.lit(1.0))).alias("pearson"), safe(r(w)).alias("weighted"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_abs_diff"), (100.0 * F.count_if((F.col("x") >= 50) == (F.col("y") >= 50)) / rows).alias("agreement"))
    bins = [F.least(F.lit(4), F.floor(F.col(c) / 20)).cast("int").alias(f"bin_{n}") for c, n in (("x", "a"), ("y", "b"))]
    return table, both.groupBy("cov", *bins).agg(rows.alias("n"))


def variant_concordance(verdicts: DataFrame, snvs: DataFrame) -> DataFrame:
    """One row (variants, true_variants, precision, covered, found, recall): verdicts (chr, pos, strand, verdict) against
    snvs (chr, pos, ref, alt, filter, genotype).

    Only passed C>T and G>A count. A variant is true where there is such a change of its strand's cytosine; recall is
    over homozygous changes at places that have a verdict. Without any the rates are null."""
    s = snvs.where("filter in ('PASS', '.') and ((ref = 'C' and alt = 'T') or (ref = 'G' and alt = 'A'))")
    s = s.select(plain_name(F.col("chr")).alias("chr"), "pos", "ref", (F.replace("genotype", F.lit("|"), F.lit("/")) == "1/1").alias("hom"))
    both = verdicts.select(plain_name(F.col("chr")).alias("chr"), "pos", "strand", "verdict").join(s, ["chr", "pos"], "left")
    is_variant, hom = F.col("verdict") == "variant", F.coalesce("hom", F.lit(False))
    fits = F.coalesce(((F.col("strand") == "+") & (F.col("ref") == "C")) | ((F.col("strand") == "-") & (F.col("ref") == "G")), F.lit(False))
    out = both.agg(F.count_if(is_variant).alias("variants"), F.count_if(is_variant & fits).alias("true_variants"), F.count_if(hom).alias("covered"), F.count_if(hom & is_variant).alias("found"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.select("variants", "true_variants", rate("true_variants", "variants").alias("precision"), "covered", "found", rate("found", "covered").alias("recall"))


def unpaired_cpgs(report: DataFrame) -> DataFrame:
    """CpG rows of a report without the other strand's row beside them: (chr, pos, strand); there is none in a whole report
    but where a chromosome's edge cuts a CpG."""
    rows = report.where("context = 'CG'").select("chr", "pos", "strand", F.when(F.col("strand") == "+", F.col("pos")).otherwise(F.col("pos") - 1).alias("cpg"))
    return rows.groupBy("chr", "cpg").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"), F.min("strand").alias("strand")).where("n = 1").select("chr", "pos", "strand")


def owner_files(calls: DataFrame) -> DataFrame:
    """(chr, file): the first file, by file_ord, that calls a chromosome."""
    return calls.groupBy("chr").agg(F.min(F.struct("file_ord", "file")).alias("o")).select("chr", F.col("o.file").alias("file"))


def last_of_block(cov: DataFrame) -> DataFrame:
    """Coverage rows in file order (file, ord): a chromosome that comes again is a block of its own, and the last value at
    a position of a block counts. (file, block, chr, pos, m, u)."""
    w = Window.partitionBy("file").orderBy("ord")
    blocks = cov.withColumn("new", F.coalesce((F.col("chr") != F.lag("chr").over(w)).cast("int"), F.lit(1))).withColumn("block", F.sum("new").over(w))
    return blocks.groupBy("file", "block", "chr", "pos").agg(F.max_by(F.struct("m", "u"), "ord").alias("v")).select("file", "block", "chr", "pos", "v.m", "v.u")


def nome_per_read(genome: DataFrame, calls: DataFrame) -> DataFrame:
    """(read, chr, start, end, meth_cg, unmeth_cg, meth_gpc, unmeth_gpc) of reads' calls (read, ord, chr, pos, meth, call, start, end).

    chr, start and end are those of a read's first call; start lies after end on a reverse read. A read counts only
    where start > 3 and its length and 2 more bases fit from start on. The last call at a position wins; ord is unique in a read. CpG calls
    count where the 3-mer one base before is ACG or TCG, others where it starts with GC; their letter must fit the
    genome's context. A read without such calls has zeros, as one whose end is 2 or less.
    """
    size = F.abs(F.col("end") - F.col("start")) + 1
    reads = calls.groupBy("read").agg(F.min_by(F.struct("chr", "start", "end"), "ord").alias("f")).select("read", "f.*")
    reads = reads.join(chromosomes(genome), "chr").where((F.col("start") > 3) & (F.col("chr_len") >= F.col("start") + size + 2))
    reads = reads.select("read", "chr", F.least("start", "end").alias("start"), F.greatest("start", "end").alias("end"))
    last = calls.groupBy("read", "pos").agg(F.max_by(F.struct("meth", "call"), "ord").alias("c")).select("read", "pos", "c.*")
    inside = reads.join(last, "read").where(F.col("pos").between(F.col("start"), F.col("end")) & (F.col("start") > 2))
    motif = F.when(F.col("context") == "CG", F.when(F.col("upstream").isin("ACG", "TCG"), "z")).when(F.col("upstream").startswith("GC"), F.when(F.col("context") == "CHG", "x").otherwise("h"))
    sites = as_cytosines(at_positions(genome, inside.select("chr", "pos", "read", "meth", "call")))
    hits = sites.withColumn("letter", motif).where(F.lower("call") == F.col("letter"))
    n = lambda meth, cpg: F.count_if((F.col("meth") == meth) & ((F.col("letter") == "z") == F.lit(cpg)))
    sums = hits.groupBy("read").agg(n("+", True).alias("meth_cg"), n("-", True).alias("unmeth_cg"), n("+", False).alias("meth_gpc"), n("-", False).alias("unmeth_gpc"))
    return reads.join(sums, "read", "left").fillna(0, ["meth_cg", "unmeth_cg", "meth_gpc", "unmeth_gpc"])
