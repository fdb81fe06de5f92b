"""Alignments against the genome: the bases they lie on, call windows, record tags, read composition and pile-ups.

Alignments meet the genome in equi-joins on (chromosome, tile), with as many rows as the tiles they touch, mostly one;
only a key and the places go through such a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from methylake.functions.expr import aligned_blocks, canonical_umi, cigar_ops, clean_cigar, fixed_text, percent, ref_span, revcomp, revcomp_any_case, strand
from methylake.operators.alignments import call_string, verdict
from methylake.operators.genome import tiles, word_counts

#: Bases of a tile that alignments meet.
WIDTH = 1 << 12

# Conversions of the read and of the genome by instance; for pairs of mate 1, mate 2 and the genome.
SINGLE = (("CT", "CT"), ("CT", "GA"), ("GA", "CT"), ("GA", "GA"))
PAIRED = (("CT", "GA", "CT"), ("GA", "CT", "GA"), ("GA", "CT", "CT"), ("CT", "GA", "GA"))


def _cores(genome: DataFrame) -> DataFrame:
    """(chr, tile, tile_start, core_len, chr_len, core) of tiles of WIDTH bases."""
    return tiles(genome, WIDTH).select("chr", "tile", "tile_start", "core_len", "chr_len", F.substring("text", F.col("pad") + 1, F.col("core_len")).alias("core"))


def genome_slices(df: DataFrame, genome: DataFrame, key: list[str], first: Column, last: Column) -> DataFrame:
    """df with slice, the bases from 0-based first to last (exclusive), clipped to the chromosome, and chr_len; both are
    null where the genome has no such chromosome or no such base. key: columns that name a row."""
    at = df.select(*key, "chr", F.greatest(first, F.lit(0)).cast("long").alias("a"), last.cast("long").alias("b")).where("b > a")
    at = at.withColumn("tile", F.explode(F.sequence(F.floor(F.col("a") / WIDTH), F.floor((F.col("b") - 1) / WIDTH)))).join(_cores(genome), ["chr", "tile"])
    begin, end = F.greatest(F.col("a") - F.col("tile_start"), F.lit(0)), F.least(F.col("b") - F.col("tile_start"), F.col("core_len"))
    at = at.where(begin < end).select(*key, "chr_len", F.struct("tile", F.substring("core", (begin + 1).cast("int"), (end - begin).cast("int")).alias("text")).alias("p"))
    parts = at.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("p"))["text"], "").alias("slice"), F.first("chr_len").alias("chr_len"))
    return df.join(parts, key, "left")


def _choose(index: Column, values) -> Column:
    out = F.when(F.lit(False), "")
    for i, v in enumerate(values):
        out = out.when(index == i, v)
    return out


def _walk(ops: Column, slice_: Column, lead: Column) -> Column:
    """The bases that a CIGAR's M runs lie on, from `lead` bases into the slice on, with X for each base of I and S; D
    and N are left out, other operations raise."""
    zero = F.struct(F.lit(0).alias("r"), F.lit("").alias("t"))

    def step(acc, o):
        op, n = o["op"], o["len"]
        text = F.when(op == "M", F.substring(slice_, lead + acc["r"] + 1, n)).when(op.isin("I", "S"), F.repeat(F.lit("X"), n)).when(op.isin("D", "N"), "")
        text = text.otherwise(F.raise_error(F.concat(F.lit("CIGAR operation "), op)))
        return F.struct((acc["r"] + F.when(op.isin("M", "D", "N"), n).otherwise(0)).alias("r"), F.concat(acc["t"], text).alias("t"))

    return F.aggregate(ops, zero, step, lambda acc: acc["t"])


def call_windows(df: DataFrame, genome: DataFrame, key: list[str], paired: bool = False, pbat: bool = False) -> DataFrame:
    """Alignments (key, chr, pos, cigar, seq, inst[, mate]) with window, read_conv, genome_conv, minus, end_pos, indels,
    extracted and complete.

    window: the genome's bases under the read and two more, after it for instances 0 and 2 and before it for 1 and 3, X
    under inserted and clipped bases, turned to the read's strand. At a chromosome's edge, where the two bases lack, it is
    not turned and extracted is false: two bases before need a place of 2 or more (of 3 or more for mate 1 of a pair).
    A pair is extracted if both mates are; the other mate's window is then empty. complete: extracted, and the window is
    as long as the read and 2 more; only such reads are written. pbat adds 2 to the instance of single reads.
    """
    index = F.col("inst") + (2 if pbat and not paired else 0)
    first = F.col("pos") - 1
    df = df.withColumn("_ops", cigar_ops(F.col("cigar"))).withColumn("_span", ref_span(F.col("_ops")))
    df = genome_slices(df, genome, key, first - 2, first + F.col("_span") + 2)
    lead, before = F.least(first, F.lit(2)).cast("int"), index.isin(1, 3)
    core = _walk(F.col("_ops"), F.col("slice"), lead)
    room = F.when(before, first >= (F.when(F.col("mate") == 1, 3).otherwise(2) if paired else 2)).otherwise(F.col("chr_len") >= first + F.col("_span") + 2)
    two = F.when(before, F.substring("slice", lead - 1, F.lit(2))).otherwise(F.substring("slice", lead + F.col("_span") + 1, F.lit(2)))
    df = df.withColumns({"_room": F.coalesce(room, F.lit(False)), "_core": F.when(before & ~room, "").otherwise(core), "_two": two})
    if paired:
        pair = Window.partitionBy(*(c for c in key if c != "mate"))
        df = df.withColumns({"extracted": F.bool_and("_room").over(pair), "_begun": (F.col("mate") == 1) | F.min(F.when(F.col("mate") == 1, F.col("_room"))).over(pair)})
        turned = F.when(F.col("mate") == 2, index.isin(0, 1)).otherwise(index.isin(2, 3))
        reads = F.when(F.col("mate") == 1, _choose(index, [p[0] for p in PAIRED])).otherwise(_choose(index, [p[1] for p in PAIRED]))
        genomes = _choose(index, [p[2] for p in PAIRED])
    else:
        df = df.withColumns({"extracted": F.col("_room"), "_begun": F.lit(True)})
        turned = index.isin(1, 2)
        reads, genomes = (_choose(index, [p[i] for p in SINGLE]) for i in (0, 1))
    whole = F.when(before, F.concat("_two", "_core")).otherwise(F.concat("_core", "_two"))
    window = F.when(~F.col("_begun"), "").when(~F.col("_room"), F.col("_core")).when(F.col("extracted") & turned, revcomp(whole)).otherwise(whole)
    deleted = F.aggregate("_ops", F.lit(0), lambda acc, o: acc + F.when(o["op"] == "D", o["len"]).otherwise(0))
    out = df.withColumns({"window": F.coalesce(window, F.lit("")), "read_conv": reads, "genome_conv": genomes, "minus": turned, "end_pos": F.col("pos") + F.col("_span") - 1, "indels": deleted})
    return out.withColumn("complete", F.col("extracted") & (F.length("window") == F.length("seq") + 2)).drop("_ops", "_span", "_room", "_core", "_two", "_begun", "slice", "chr_len")


def mask_low_quality(seq: Column, qual: Column, least: int, offset: int = 33) -> Column:
    """seq with N where the quality is below least; 0 masks nothing. Only calls are made from it."""
    if not least:
        return seq
    return F.array_join(F.zip_with(F.split(seq, ""), F.split(qual, ""), lambda b, q: F.when(F.ascii(q) < offset + least, "N").otherwise(b)), "")


def with_calls(df: DataFrame, five_base: bool = False, slam: bool = False, baseq: int = 0, offset: int = 33) -> DataFrame:
    """Rows of call_windows() that are complete, with calls: the call string in the read's own direction."""
    read = mask_low_quality(F.col("seq"), F.col("qual"), baseq, offset) if baseq else F.col("seq")
    made = [call_string(read, F.col("window"), kind, five_base, slam) for kind in ("CT", "GA")]
    return df.where("complete").withColumn("calls", F.when(F.col("read_conv") == "CT", made[0]).otherwise(made[1]))


def md_text(actual: Column, reference: Column, ops: Column, aligned: Column) -> Column:
    """The MD value of a read against its reference (X where the read is inserted or clipped); aligned: all bases of the
    reference from the alignment's start to its end. Runs of matches as their length, mismatches as the reference's base,
    deletions as ^ and their bases."""
    marks = F.array_join(F.zip_with(F.split(actual, ""), F.split(reference, ""), lambda a, b: F.when(a == b, "=").otherwise(b)), "")
    zero = F.struct(F.lit(0).alias("q"), F.lit(0).alias("r"), F.lit("").alias("t"))

    def step(acc, o):
        op, n = o["op"], o["len"]
        # deleted bases in lower case end where a mark follows
        text = F.when(op == "M", F.substring(marks, acc["q"] + 1, n)).when(op == "D", F.concat(F.lit("^"), F.lower(F.substring(aligned, acc["r"] + 1, n)))).otherwise("")
        return F.struct((acc["q"] + F.when(op.isin("M", "I", "S"), n).otherwise(0)).alias("q"), (acc["r"] + F.when(op.isin("M", "D", "N"), n).otherwise(0)).alias("r"), F.concat(acc["t"], text).alias("t"))

    path = F.aggregate(ops, zero, step, lambda acc: acc["t"])
    run = lambda x: F.length(F.regexp_extract(x, "^=*", 0)).cast("string")
    events = F.transform(F.regexp_extract_all(path, F.lit("=*(?:\\^[a-z]+|[A-Z])"), F.lit(0)), lambda e: F.concat(run(e), F.upper(F.regexp_replace(e, "^=*", ""))))
    return F.concat(F.array_join(events, ""), F.length(F.regexp_extract(path, "=*$", 0)).cast("string"))


def record_tags(df: DataFrame, genome: DataFrame, key: list[str]) -> DataFrame:
    """Rows of with_calls() (key, chr, pos, cigar, seq, qual, window, calls, ...) with seq, qual and xm turned to the
    genome's strand where the read lies on the other one, xr, xg, nm and md."""
    minus = F.col("minus")
    trimmed = F.when(F.col("read_conv") == "CT", F.expr("left(window, length(window) - 2)")).otherwise(F.expr("substring(window, 3)"))
    df = df.withColumn("_ops", cigar_ops(F.col("cigar")))
    df = genome_slices(df, genome, key, F.col("pos") - 1, F.col("pos") - 1 + ref_span(F.col("_ops")))
    df = df.withColumns({"_ref": F.when(minus, revcomp_any_case(trimmed)).otherwise(trimmed), "seq": F.when(minus, revcomp_any_case(F.col("seq"))).otherwise(F.col("seq"))})
    same = F.size(F.filter(F.zip_with(F.split("seq", ""), F.split("_ref", ""), lambda a, b: a == b), lambda x: x))
    return df.withColumns({
        "nm": F.length("seq") - same + F.col("indels"), "md": md_text(F.col("seq"), F.col("_ref"), F.col("_ops"), F.col("slice")), "xr": F.col("read_conv"), "xg": F.col("genome_conv"),
        "xm": F.when(minus, F.reverse("calls")).otherwise(F.col("calls")), "qual": F.when(minus, F.reverse("qual")).otherwise(F.col("qual")),
    }).drop("_ops", "_ref", "slice", "chr_len")


# -- composition of reads -------------------------------------------------------------------------------------


def read_composition(records: DataFrame, genome: DataFrame, key: list[str], paired: bool = False) -> DataFrame:
    """(word, n) of the genome's bases under reads (key, chr, pos, cigar, seq, flag) without insertions, deletions, clips
    or skips, on the read's strand. A single read's flag is 0 or, on the other strand, 16, others raise; of pairs 99 and
    147 are as they are and all others on the other strand."""
    rows = records.where(clean_cigar(F.col("cigar")))
    flag = F.col("flag")
    bad = F.raise_error(F.concat(F.lit("flag of a single read: "), flag.cast("string"))).cast("boolean")
    turned = ~flag.isin(99, 147) if paired else F.when(flag == 0, F.lit(False)).when(flag == 16, F.lit(True)).otherwise(bad)
    at = genome_slices(rows.withColumn("_turned", turned), genome, key, F.col("pos") - 1, F.when(F.col("pos") > 0, F.col("pos") - 1 + F.length("seq")))
    return word_counts(at.where("slice is not null").select(F.when(F.col("_turned"), revcomp(F.col("slice"))).otherwise(F.col("slice")).alias("seq"), F.lit("").alias("right")))


# -- pile-ups -------------------------------------------------------------------------------------------------


def cpg_observations(records: DataFrame, genome: DataFrame, *keep: str) -> DataFrame:
    """(keep, chr, pos0, plus, converted): every aligned base of records (chr, pos, cigar, seq, ...) on a cytosine of a CpG;
    plus: on the C, else on the G, which is the other strand's; converted: it is a T, or on the other strand an A."""
    blocks = records.select(*keep, "chr", "pos", "seq", F.inline(aligned_blocks(cigar_ops(F.col("cigar")))))
    begin = F.col("pos") - 1 + F.col("ref")
    blocks = blocks.select(*keep, "chr", begin.alias("_from"), (begin + F.col("len")).alias("_to"), F.substring("seq", F.col("read") + 1, F.col("len")).alias("part")).where("_to > _from")
    blocks = blocks.withColumn("tile", F.explode(F.sequence(F.floor(F.col("_from") / WIDTH), F.floor((F.col("_to") - 1) / WIDTH))))
    at = blocks.join(tiles(genome, WIDTH).select("chr", "tile", "tile_start", "core_len", "pad", "text"), ["chr", "tile"])
    low, high = F.greatest(F.col("_from"), F.col("tile_start")), F.least(F.col("_to"), F.col("tile_start") + F.col("core_len"))
    at = at.where(low < high).withColumn("pos0", F.explode(F.sequence(low, high - 1)))
    o = (F.col("pos0") - F.col("tile_start") + F.col("pad") + 1).cast("int")
    base = F.upper(F.substring("part", (F.col("pos0") - F.col("_from") + 1).cast("int"), F.lit(1)))
    two = F.substring("text", o, F.lit(2))
    plus = F.when(two == "CG", True).when(F.when(o > 1, F.substring("text", o - 1, F.lit(2))) == "CG", False)
    at = at.select(*keep, "chr", "pos0", plus.alias("plus"), base.alias("base")).where("plus is not null and base <> ''")
    return at.select(*keep, "chr", "pos0", "plus", (F.col("base") == F.when(F.col("plus"), "T").otherwise("A")).alias("converted"))


def _pile(observed: DataFrame, own: Column, *key: str) -> DataFrame:
    n = lambda x: F.count_if(x)
    c = F.col("converted")
    return observed.groupBy(*key, "chr", "pos0", "plus").agg(n(own & ~c).alias("own_c"), n(own & c).alias("own_t"), n(~own & ~c).alias("opp_c"), n(~own & c).alias("opp_t"))


def strand_pileup(records: DataFrame, genome: DataFrame) -> DataFrame:
    """(chr, pos0, plus, own_c, own_t, opp_c, opp_t) of mapped records (chr, pos, cigar, seq, flag, xr, xg) of the strands
    OT and OB: own bases are OT's on the + cytosine and OB's on the - one."""
    rows = records.where("(flag & 4) = 0").withColumn("strand", strand(F.col("xr"), F.col("xg"))).where("strand in ('OT', 'OB')")
    return _pile(cpg_observations(rows, genome, "strand"), (F.col("strand") == "OT") == F.col("plus"))


def deconvolution_report(pile: DataFrame, least: int = 2, share: float = 0.6) -> DataFrame:
    """(chr, pos, strand, verdict, m, total, pct) of a pile-up, positions from 1; pct is a text with two decimals or NA."""
    out = verdict(pile, least, share)
    pct = F.coalesce(fixed_text(percent(F.col("m"), F.col("total") - F.col("m")), 2), F.lit("NA"))
    return out.select("chr", (F.col("pos0") + 1).alias("pos"), F.when(F.col("plus"), "+").otherwise("-").alias("strand"), "verdict", "m", "total", pct.alias("pct"))


def fragments(records: DataFrame, umi: bool = True, least_mapq: int = 0) -> DataFrame:
    """Mapped primary records of proper pairs with a template length, of least_mapq or more, with their family (chr,
    start0, end, umi), ot, whether the molecule's strand is OT, and coverage_forward, the record's own direction.
    records: (chr, pos, pnext, tlen, flag, mapq, rx, ...). The UMI is the canonical one of rx, empty without."""
    flag = F.col("flag")
    rows = records.where((flag.bitwiseAND(4 | 256 | 2048) == 0) & (flag.bitwiseAND(2) > 0) & (F.col("tlen") != 0) & (F.col("pnext") > 0))
    if least_mapq:
        rows = rows.where(F.coalesce("mapq", F.lit(255)) >= least_mapq)
    ahead = flag.bitwiseAND(16) == 0
    start = F.least("pos", "pnext") - 1
    key = F.coalesce(canonical_umi(F.col("rx")), F.lit("")) if umi else F.lit("")
    return rows.withColumns({"start0": start, "end": start + F.abs("tlen"), "umi": key, "coverage_forward": ahead, "ot": (flag.bitwiseAND(64) > 0) == ahead})


def duplex_report(rows: DataFrame, genome: DataFrame, share: float = 0.6) -> DataFrame:
    """(chr, start0, end, umi, members, variant, methylation, undetermined) of the families of fragments() that have
    records of both strands: sites by verdict, from an opposite depth of 1 on; sites without own coverage don't count."""
    key = ["chr", "start0", "end", "umi"]
    n = rows.groupBy(*key).agg(F.count_if("ot").alias("n_ot"), F.count_if(~F.col("ot")).alias("n_ob")).where("n_ot > 0 and n_ob > 0")
    inside = rows.join(n.select(*key), key, "left_semi")
    seen = cpg_observations(inside, genome, "start0", "end", "umi", "coverage_forward")
    sites = verdict(_pile(seen, F.col("coverage_forward") == F.col("plus"), "start0", "end", "umi").where("own_c + own_t > 0"), 1, share)
    kinds = ("variant", "methylation", "undetermined")
    tally = sites.groupBy(*key).agg(*(F.count_if(F.col("verdict") == k).alias(k) for k in kinds))
    out = n.join(tally, key, "left").fillna(0, list(kinds))
    members = F.concat(F.col("n_ot").cast("string"), F.lit("+"), F.col("n_ob").cast("string"))
    return out.select("chr", "start0", "end", F.when(F.col("umi") == "", "NA").otherwise(F.col("umi")).alias("umi"), members.alias("members"), *kinds)
