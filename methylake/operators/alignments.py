"""Operators over tagged alignments and raw aligner records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from methylake.functions.expr import aligned_blocks, cigar_ops, exact_round, fixed_text, forward, mapq, occurrences, percent, read_span, ref_span, strand, trimmed_span

# Contexts of the call letters.
CONTEXTS = {"z": "CpG", "x": "CHG", "h": "CHH"}


def mapped(df: DataFrame) -> DataFrame:
    return df.where("(flag & 4) = 0")


def primary(df: DataFrame) -> DataFrame:
    """Neither secondary nor supplementary."""
    return df.where("(flag & 2304) = 0")


def skip_upto(df: DataFrame, skip: int = 0, upto: int = 0) -> DataFrame:
    """Rows with ord (1-based) in (skip, upto]; 0 is no bound."""
    df = df.where(F.col("ord") > skip) if skip else df
    return df.where(F.col("ord") <= upto) if upto else df


def short_reads(df: DataFrame, cutoff: int = 10_000) -> DataFrame:
    """Reads whose line, its newline included, is at most cutoff long."""
    return df.where(F.length("seq") + 1 <= cutoff)


def spans(df: DataFrame) -> DataFrame:
    """df with ref_span, read_span and end (start + ref_span - 1) of its cigar."""
    ops = cigar_ops(F.col("cigar"))
    return df.withColumns({"ref_span": ref_span(ops), "read_span": read_span(ops)}).withColumn("end", F.col("start") + F.col("ref_span") - 1)


def extract_calls(df: DataFrame, ignore5=0, ignore3=0, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each call of alignments (id, chr, start, cigar, xm, xr, xg): (id, chr, strand, pos, read_pos, ctx, methylated,
    call), and the columns of keep.

    read_pos is 0-based from the read's 5' end after ignore5 bases; inserted and clipped bases have no call; letters
    U, u and . are none. An unknown letter is an error.
    """
    s = strand(F.col("xr"), F.col("xg"))
    rows = df.select("id", "chr", "start", "xm", s.alias("strand"), *keep, aligned_blocks(cigar_ops(F.col("cigar"))).alias("blocks"))
    rows = rows.select("id", "chr", "start", "xm", "strand", *keep, F.inline("blocks"))
    size = F.length("xm")
    rows = rows.select("id", "chr", "strand", *keep, size.alias("n"), "read", (F.col("start") + F.col("ref")).alias("at"), F.substring("xm", F.col("read") + 1, F.col("len")).alias("part"))
    rows = rows.select("*", F.posexplode(F.split("part", "")).alias("k", "call")).where("call not in ('.', 'U', 'u', '')")
    q = F.col("read") + F.col("k")
    rows = rows.withColumn("p", F.when(forward(F.col("strand")), q).otherwise(F.col("n") - 1 - q))
    rows = rows.where((F.col("p") >= ignore5) & (F.col("p") < F.col("n") - ignore3))
    low = F.lower("call")
    ctx = F.when(low == "z", "CpG").when(low == "x", "CHG").when(low == "h", "CHH").otherwise(F.raise_error(F.concat(F.lit("bad call "), F.col("call"))))
    return rows.select("id", "chr", "strand", (F.col("at") + F.col("k")).cast("long").alias("pos"), (F.col("p") - ignore5).alias("read_pos"), ctx.alias("ctx"), (F.col("call") != low).alias("methylated"), "call", *keep)


def mbias(calls: DataFrame, read: int = 1) -> DataFrame:
    """(read, ctx, position, m, u, pct) for positions 1 to the largest over all contexts; positions without calls have zeros and no percentage."""
    sums = calls.groupBy("ctx", (F.col("read_pos") + 1).cast("int").alias("position")).agg(F.sum(F.col("methylated").cast("long")).alias("m"), F.sum((~F.col("methylated")).cast("long")).alias("u"))
    spine = sums.agg(F.max("position").alias("n")).where("n is not null").select(F.explode(F.sequence(F.lit(1), F.col("n"))).alias("position"), F.array(*(F.lit(c) for c in CONTEXTS.values())).alias("c")).select("position", F.explode("c").alias("ctx"))
    out = spine.join(sums, ["ctx", "position"], "left").fillna(0, ["m", "u"])
    return out.select(F.lit(read).alias("read"), "ctx", "position", "m", "u", percent(F.col("m"), F.col("u")).alias("pct"))


def splitting_totals(calls: DataFrame) -> DataFrame:
    """(ctx, m, u, pct) of all calls."""
    out = calls.groupBy("ctx").agg(F.sum(F.col("methylated").cast("long")).alias("m"), F.sum((~F.col("methylated")).cast("long")).alias("u"))
    return out.withColumn("pct", percent(F.col("m"), F.col("u")))


def routed(calls: DataFrame, comprehensive: bool = False, merge_non_cpg: bool = False) -> DataFrame:
    """calls with the split file each goes to: context and strand, or fewer of them by mode."""
    ctx = F.when(F.col("ctx") == "CpG", "CpG").otherwise("Non_CpG") if merge_non_cpg else F.col("ctx")
    return calls.withColumn("route", F.concat(ctx, F.lit("_context")) if comprehensive else F.concat_ws("_", ctx, "strand"))


def _bounds(start1, cigar1, ahead, ignore3: int) -> tuple:
    """Where mate 1 begins and ends after its 3' trimming."""
    ops = cigar_ops(cigar1)
    kept, old = trimmed_span(ops, ignore3, ahead), ref_span(ops)
    begin = F.when(ahead, start1).otherwise(start1 + old - kept)
    return begin, F.when(ahead, F.when(kept > 0, start1 + kept - 1).otherwise(start1)).otherwise(start1 + old - 1)


def _outside(calls: DataFrame) -> DataFrame:
    """Calls with forward, b1 and e1 of their pair: mate 1's, and mate 2's past mate 1's end or before its start."""
    return calls.where((F.col("mate") == 1) | F.when(F.col("forward"), F.col("pos") > F.col("e1")).otherwise(F.col("pos") < F.col("b1"))).drop("forward", "b1", "e1")


def drop_overlap(calls: DataFrame, pairs: DataFrame, ignore3: int = 0) -> DataFrame:
    """Calls (id, mate, pos, ...) without mate 2's where mate 1 has been: pairs (id, start1, cigar1, forward). On a forward
    pair mate 2 keeps positions after mate 1's end, else those before its start; mate 1 ends after its 3' trimming. Every
    call is shuffled by id; extract_pairs() takes pairs before they are cut into calls."""
    begin, end = _bounds(F.col("start1"), F.col("cigar1"), F.col("forward"), ignore3)
    return _outside(calls.join(pairs.select("id", "forward", begin.alias("b1"), end.alias("e1")), "id"))


def extract_pairs(pairs: DataFrame, ignore5: int = 0, ignore3: int = 0, ignore5_r2: int = 0, ignore3_r2: int = 0) -> DataFrame:
    """extract_calls() of both mates of pairs (id, chr, xr, xg, start1, cigar1, xm1, start2, cigar2, xm2), with mate, without
    the calls that drop_overlap() leaves out. Mate 1's bounds go with mate 2, so no call is shuffled."""
    ahead = forward(strand(F.col("xr"), F.col("xg")))
    begin, end = _bounds(F.col("start1"), F.col("cigar1"), ahead, ignore3)
    mates = F.array(*(F.struct(F.lit(i).alias("mate"), *(F.col(f"{c}{i}").alias(c) for c in ("start", "cigar", "xm"))) for i in (1, 2)))
    rows = pairs.select("id", "chr", "xr", "xg", ahead.alias("forward"), begin.alias("b1"), end.alias("e1"), mates.alias("mates"))
    rows = rows.select("id", "chr", "xr", "xg", "forward", "b1", "e1", F.inline("mates"))
    trim = [F.when(F.col("mate") == 1, one).otherwise(two) for one, two in ((ignore5, ignore5_r2), (ignore3, ignore3_r2))]
    return _outside(extract_calls(rows.withColumns({"_t5": trim[0], "_t3": trim[1]}), F.col("_t5"), F.col("_t3"), keep=("mate", "forward", "b1", "e1", "_t5", "_t3")).drop("_t5", "_t3"))


# -- deduplication --------------------------------------------------------------------------------------------


def position_key(df: DataFrame) -> DataFrame:
    """Single-end reads with key_pos: the start of a forward read, the reference end of another."""
    return spans(df).withColumn("strand", strand(F.col("xr"), F.col("xg"))).withColumn("key_pos", F.when(forward(F.col("strand")), F.col("start")).otherwise(F.col("end")))


def mark_duplicates(df: DataFrame, *key: str, order: tuple[str, ...] = ("file_ord", "ord")) -> DataFrame:
    """df with duplicate: not the first row of its key in the order of unique columns. The first ones are found with sums
    in each task before the shuffle, and the rows of a crowded key may be dealt to several tasks in the join back."""
    first = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key))).agg(F.min(F.struct(*order)).alias("_first"))
    on = [df[k].eqNullSafe(first[f"_k{i}"]) for i, k in enumerate(key)]
    return df.join(first, on).select(*(df[c] for c in df.columns), (F.struct(*(df[c] for c in order)) > F.col("_first")).alias("duplicate"))


def with_umi(df: DataFrame, umi) -> DataFrame:
    """df with umi; a read without one is an error, as no read may be taken for a copy of another without a UMI."""
    missing = F.raise_error(F.concat(F.lit("no UMI in the name of "), F.col("qname")))
    return df.withColumn("umi", F.coalesce(umi, missing))


def pair_mates(df: DataFrame, size: int = 1 << 20) -> DataFrame:
    """(file_ord, pair_id, r1, r2) of records (file_ord, ord, qname, ...) that follow each other in their file, mate 1 being
    the first of two whatever its flag. Names that differ, or a last record without a mate, are errors. ord is unique and
    ascends in a file but may have gaps, so records are counted in ranges of ord, no file being sorted as a whole."""
    part = F.floor(F.col("ord") / size)
    ranges = df.groupBy("file_ord", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file_ord").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("file_ord", "_part", before.alias("_before"))
    at = df.select("file_ord", part.alias("_part"), "ord", F.struct(*df.columns).alias("r")).join(ranges, ["file_ord", "_part"])
    place = F.col("_before") + F.row_number().over(Window.partitionBy("file_ord", "_part").orderBy("ord")) - 1
    at = at.select("file_ord", F.floor(place / 2).alias("pair_id"), (place % 2).alias("m"), "r")
    pairs = at.groupBy("file_ord", "pair_id").agg(*(F.max_by("r", F.when(F.col("m") == i, 1)).alias(f"r{i + 1}") for i in (0, 1)))
    alone, apart = (F.raise_error(F.concat(F.lit(t), F.col("r1.qname"))).cast("boolean") for t in ("no mate follows ", "the mate of another name follows "))
    return pairs.where(F.when(F.col("r2").isNull(), alone).when(F.col("r1.qname") != F.col("r2.qname"), apart).otherwise(F.lit(True)))


def pair_key(pairs: DataFrame) -> DataFrame:
    """Pairs (file_ord, pair_id, r1, r2), mates with chr, pos, cigar, xr and xg, with strand (mate 1's), chr, start and end:
    from mate 1's start to mate 2's reference end on a forward strand, else from mate 2's start to mate 1's end."""
    s = strand(F.col("r1.xr"), F.col("r1.xg"))
    ends = [F.col(f"r{i}.pos") + ref_span(cigar_ops(F.col(f"r{i}.cigar"))) - 1 for i in (1, 2)]
    ahead = forward(F.col("strand"))
    out = pairs.withColumns({"strand": s, "chr": F.col("r1.chr")})
    return out.withColumns({"start": F.when(ahead, F.col("r1.pos")).otherwise(F.col("r2.pos")), "end": F.when(ahead, ends[1]).otherwise(ends[0])})


def same_dictionary(a: list[str], b: list[str]) -> None:
    """Raises unless two files have the same chromosomes, in whatever order: files are only deduplicated together then."""
    missing, extra = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    if missing or extra:
        raise ValueError(f"chromosomes differ: missing {missing}, extra {extra}")


def duplicate_counts(marked: DataFrame, *key: str) -> DataFrame:
    """One row (total, removed, positions): rows, duplicates, and keys that have any."""
    per = marked.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"), F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("positions"))


# -- filters on call strings ----------------------------------------------------------------------------------


def unconverted(xm, threshold: int = 3):
    """Whether a read has threshold methylated non-CpG calls or more."""
    return occurrences(xm, "HX") >= threshold


def unconverted_run(xm, threshold: int = 3):
    """Whether a read has a run of threshold methylated non-CpG calls; z, h and x end a run, other letters don't."""
    return F.regexp_replace(xm, "[^HXzhx]", "").rlike(f"[HX]{{{threshold}}}")


def unconverted_share(xm, cutoff: int, least: int = 5):
    """Whether a read with least non-CpG calls or more has a methylated share, to one decimal, of cutoff or more."""
    m, total = occurrences(xm, "HX"), occurrences(xm, "HXhx")
    return (total >= least) & F.coalesce(exact_round(m.cast("double") / F.when(total > 0, total).cast("double") * 100, 1) >= cutoff, F.lit(False))


def filter_single(df: DataFrame, fails) -> DataFrame:
    """df with removed: whether a read fails; one without a call string is kept."""
    return df.withColumn("removed", F.coalesce(fails, F.lit(False)))


def filter_pairs(df: DataFrame, fails, key: str = "pair_id") -> DataFrame:
    """df (one row a mate, with xm) with removed: any mate of the pair fails. A mate without a call string is an error."""
    bad = F.raise_error(F.concat(F.lit("no call string in pair "), F.col(key).cast("string"))).cast("boolean")
    return df.withColumn("removed", F.bool_or(F.when(F.col("xm").isNull(), bad).otherwise(fails)).over(Window.partitionBy(key)))


def filter_report(filtered: DataFrame) -> DataFrame:
    """(total, removed, pct) of rows with removed: pct is a text with one decimal, N/A without rows."""
    n, m = F.count(F.lit(1)), F.count_if("removed")
    out = filtered.agg(n.alias("total"), m.alias("removed"))
    return out.withColumn("pct", F.coalesce(fixed_text(percent(F.col("removed"), F.col("total") - F.col("removed")), 1), F.lit("N/A")))


def consistency(df: DataFrame, chh: bool = False, least: int = 5, lower: int = 10, upper: int = 90) -> DataFrame:
    """(id, m, u, bucket) of reads (id, xm), mates summed: discarded under least calls, then unmethylated, methylated or mixed by the percentage to one decimal."""
    up, low = ("H", "h") if chh else ("Z", "z")
    sums = df.groupBy("id").agg(F.sum(occurrences(F.col("xm"), up)).alias("m"), F.sum(occurrences(F.col("xm"), low)).alias("u"))
    pct = exact_round(percent(F.col("m"), F.col("u")), 1)
    bucket = F.when(F.col("m") + F.col("u") < least, "discarded").when(F.col("m") + F.col("u") == 0, "skipped").when(pct <= lower, "all_unmeth").when(pct >= upper, "all_meth").otherwise("mixed_meth")
    return sums.select("id", "m", "u", bucket.alias("bucket"))


# -- methylation calling --------------------------------------------------------------------------------------


def call_string(read, window, genome_conversion: str = "CT", five_base: bool = False, slam: bool = False):
    """The call string of a read against its window of read length + 2 bases (two more after it for CT, before it for GA).

    Genome C with read C is methylated, with T unmethylated (G and A for GA); the context comes from the two following
    (or preceding) bases; N or X there gives U. five_base swaps the two; slam calls T kept z and T read as C Z. Texts are
    looked up as bytes in Arrow batches: a lambda in the JVM is interpreted for every base.
    """
    base, kept, changed, other = ("C", "C", "T", "G") if genome_conversion == "CT" else ("G", "G", "A", "C")
    order = (0, 1, 2) if genome_conversion == "CT" else (2, 1, 0)
    high, low = (changed, kept) if five_base else (kept, changed)
    if slam:
        base, high, low = ("T", "C", "T") if genome_conversion == "CT" else ("A", "G", "A")

    def letter(r: int, g0: int, g1: int, g2: int) -> str:
        # g1 and g2: 1 is the other base, 2 is N or X; r: 1 is high, 2 is low
        call = "z" if slam or g1 == 1 else "u" if g1 == 2 else "x" if g2 == 1 else "u" if g2 == 2 else "h"
        return "." if not g0 or not r else call.upper() if r == 1 else call

    codes = "".join(letter(k % 3, k // 27, k // 9 % 3, k // 3 % 3) for k in range(54)).encode()
    kinds = {base: 27}, {other: 9, "N": 18, "X": 18}, {other: 3, "N": 6, "X": 6}, {low: 2, high: 1}
    tables = [bytes(k.get(chr(c), 0) for c in range(256)) for k in kinds]

    # a function made here goes to the workers as it is, so they need not have this package
    def calls(reads, windows):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        at0, at1, at2, at_read = (np.frombuffer(t, np.uint8) for t in tables)
        out_of = np.frombuffer(codes, np.uint8)

        def flat(texts):
            # a character is one byte: another than ASCII is none of the bases
            texts = pc.replace_substring_regex(texts.cast(pa.large_string()), r"[^\x00-\x7f]", "?").fill_null("")
            _, offsets, data = texts.buffers()
            where = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            return where, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)

        begins, r = flat(reads)
        starts, w = flat(windows)
        begin = begins[0]
        made = np.empty(begins[-1] - begin, np.uint8)
        for a, b, c, d in zip(begins[:-1], begins[1:], starts[:-1], starts[1:], strict=True):
            n, g = b - a, w[c:d]
            if len(g) < n + 2:  # bases that a window lacks are none
                g = np.concatenate([g, np.zeros(n + 2 - len(g), np.uint8)])
            g0, g1, g2 = (g[k : k + n] for k in order)
            made[a - begin : b - begin] = out_of[at0[g0] + at1[g1] + at2[g2] + at_read[r[a:b]]]
        out = pa.Array.from_buffers(pa.large_string(), len(reads), [None, pa.py_buffer((begins - begin).tobytes()), pa.py_buffer(made)])
        return pc.if_else(pc.and_(reads.is_valid(), windows.is_valid()), out, pa.scalar(None, pa.large_string())).cast(reads.type)

    return F.arrow_udf(calls, "string")(read, window)


# -- choice among aligner instances ---------------------------------------------------------------------------


def _choice(records: DataFrame, *locus: str) -> DataFrame:
    """(read_id, decision, inst, score, second) from records (read_id, inst, scan, score, second, *locus), one of each instance.

    In the order of scan, a read is ambiguous when a record of the best score has an equal second score of its own.
    Else the stored records, those at least as good as all before them and without such a tie, the last at each
    locus, decide: none, one, a tie of the two best, or the best with the larger of its own and the runner-up's score.
    """
    w = Window.partitionBy("read_id").orderBy("scan")
    r = records.withColumn("prior", F.max("score").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("top", F.max("score").over(Window.partitionBy("read_id")))
    tied = F.coalesce(F.col("second") == F.col("score"), F.lit(False))
    r = r.withColumn("amb", tied & (F.col("score") == F.col("top"))).withColumn("stored", ~tied & (F.col("prior").isNull() | (F.col("score") >= F.col("prior"))))
    loci = r.groupBy("read_id", *locus).agg(F.bool_or("amb").alias("amb"), F.max_by(F.struct("score", "second", "inst", "scan"), F.when(F.col("stored"), F.col("scan"))).alias("v"), F.bool_or("stored").alias("any"))
    ranked = F.reverse(F.array_sort(F.collect_list(F.when(F.col("any"), F.struct(F.col("v.score").alias("score"), (-F.col("v.scan")).alias("k"), F.col("v.second").alias("second"), F.col("v.inst").alias("inst"))))))
    d = loci.groupBy("read_id").agg(F.bool_or("amb").alias("amb"), ranked.alias("s"))
    n, best, runner = F.size("s"), F.try_element_at("s", F.lit(1)), F.try_element_at("s", F.lit(2))
    decision = F.when(F.col("amb"), "ambiguous").when(n == 0, "none").when((n > 1) & (best["score"] == runner["score"]), "ambiguous").otherwise("unique")
    second = F.when(n == 1, best["second"]).otherwise(F.greatest(best["second"], runner["score"]))
    unique = F.col("decision") == "unique"
    return d.withColumn("decision", decision).select("read_id", "decision", *(F.when(unique, c).alias(a) for c, a in ((best["inst"], "inst"), (best["score"], "score"), (second, "second"))))


def reject(decisions: DataFrame, *instances: int) -> DataFrame:
    """decisions where a unique choice of one of the instances is rejected, as a directional library does."""
    gone = (F.col("decision") == "unique") & F.col("inst").isin(*instances)
    return decisions.select("read_id", F.when(gone, "rejected").otherwise(F.col("decision")).alias("decision"), *(F.when(~gone, F.col(c)).alias(c) for c in ("inst", "score", "second")))


def best_single(records: DataFrame) -> DataFrame:
    """(read_id, decision, inst, score, second) from the first record of each instance: (read_id, inst, chr, pos, as_i, xs_i)."""
    return _choice(records.select("read_id", "inst", F.col("inst").alias("scan"), F.col("as_i").alias("score"), F.col("xs_i").alias("second"), "chr", "pos"), "chr", "pos")


# The instances of a pair in the order in which they are looked at.
PAIR_SCAN = (0, 3, 1, 2)


def best_pair(records: DataFrame, mate1_second: bool = True) -> DataFrame:
    """(read_id, decision, inst, score, second) from the first pair of each instance: (read_id, inst, chr, pos1, pos2,
    as1, xs1, as2, xs2). Scores are sums over the mates; where one mate has a second score, the other's defaults to its
    own score, and without mate1_second mate 1's is never used. Such pairs meet in a locus whatever their mates' order,
    pairs without a second score only in the same order."""
    xs1 = F.col("xs1") if mate1_second else F.lit(None).cast("int")
    second = F.when(xs1.isNotNull() | F.col("xs2").isNotNull(), F.coalesce(xs1, "as1") + F.coalesce("xs2", "as2"))
    scan = F.array_position(F.array(*(F.lit(i) for i in PAIR_SCAN)), F.col("inst")).cast("int")
    low = F.when(second.isNotNull(), F.least("pos1", "pos2")).otherwise(F.col("pos1"))
    high = F.when(second.isNotNull(), F.greatest("pos1", "pos2")).otherwise(F.col("pos2"))
    rows = records.select("read_id", "inst", scan.alias("scan"), (F.col("as1") + F.col("as2")).alias("score"), second.alias("second"), "chr", low.alias("low"), high.alias("high"))
    return _choice(rows, "chr", "low", "high")


def _combined(records: DataFrame) -> DataFrame:
    """The choice of best_combined among records (read_id, inst, locus, score, rank): of a locus's instances the one with
    the largest rank wins."""
    r = records.withColumn("top", F.max("score").over(Window.partitionBy("read_id")))
    best = F.col("score") == F.col("top")
    valid = best & F.col("inst").isNotNull()
    d = r.groupBy("read_id").agg(
        F.max("top").alias("score"), F.count_if(best).alias("n"), F.coalesce(F.bool_or(best & F.col("inst").isNull()), F.lit(False)).alias("odd"), F.count_if(valid).alias("good"),
        F.min(F.when(valid, F.col("locus"))).alias("l1"), F.max(F.when(valid, F.col("locus"))).alias("l2"), F.max_by("inst", F.when(valid, F.col("rank"))).alias("inst"), F.max(F.when(F.col("score") < F.col("top"), F.col("score"))).alias("next"),
    )
    decision = F.when(F.col("good") == 0, "none").when(F.col("odd") | (F.col("l1") != F.col("l2")), "ambiguous").otherwise("unique")
    unique = F.col("decision") == "unique"
    second = F.when(F.col("n") > 1, F.col("score")).otherwise(F.col("next"))
    d = d.withColumn("decision", decision)
    return d.select("read_id", "decision", *(F.when(unique, c).alias(a) for c, a in ((F.col("inst"), "inst"), (F.col("score"), "score"), (second, "second"))), (F.col("odd") & (F.col("good") == 0)).alias("spurious"))


def _converted_chromosome(rname, mapped):
    """(chromosome, conversion) of a converted chromosome's name; another name of a mapped line raises."""
    genome = F.regexp_extract(rname, "_(CT|GA)_converted$", 1)
    bad = F.raise_error(F.concat(F.lit("not a converted chromosome: "), rname))
    return F.regexp_replace(rname, "_(CT|GA)_converted$", ""), F.when(mapped & (genome == ""), bad).otherwise(genome)


def best_combined(records: DataFrame) -> DataFrame:
    """(read_id, decision, inst, score, second, spurious) from lines against one genome of both conversions:
    (read_id, conv of the read, flag, rname, pos, as_i).

    A line is of an instance when the read's conversion, its direction and the converted genome fit, else spurious.
    Of the lines with the best score, spurious ones alone give none (spurious true), along with others ambiguous; two
    loci are ambiguous; else the largest instance at the locus is it. second is the score of the second line. Unmapped
    lines only keep their read. A read's lines meet in one shuffle.
    """
    reverse, ct = F.col("flag").bitwiseAND(16) > 0, F.col("conv") == "CT"
    mapped = F.col("flag").bitwiseAND(4) == 0
    chrom, genome = _converted_chromosome(F.col("rname"), mapped)
    inst = F.when(genome == "CT", F.when(ct & ~reverse, 0).when(~ct & reverse, 2)).when(genome == "GA", F.when(ct & reverse, 1).when(~ct & ~reverse, 3))
    return _combined(records.select("read_id", inst.alias("inst"), inst.alias("rank"), F.when(mapped, F.col("as_i")).alias("score"), F.struct(chrom.alias("chr"), "pos").alias("locus")))


def best_combined_pair(records: DataFrame) -> DataFrame:
    """As best_combined, for pairs of lines (read_id, conv of mate 1, flag1, flag2, rname1, rname2, pos1, pos2, as1, as2),
    the score being the mates' sum and the instance that of a pair. A pair of two unmapped lines only keeps its read;
    a best pair without a score or with mates on two chromosomes is an error. Of a locus's instances the last in
    PAIR_SCAN wins."""
    reverse, ct = F.col("flag1").bitwiseAND(16) > 0, F.col("conv") == "CT"
    mapped = (F.col("flag1").bitwiseAND(4) == 0) | (F.col("flag2").bitwiseAND(4) == 0)
    chrom, genome = _converted_chromosome(F.col("rname1"), mapped)
    other = F.regexp_replace("rname2", "_(CT|GA)_converted$", "")
    inst = F.when(genome == "CT", F.when(ct & ~reverse, 0).when(~ct & reverse, 2)).when(genome == "GA", F.when(ct & reverse, 3).when(~ct & ~reverse, 1))
    rank = F.array_position(F.array(*(F.lit(i) for i in PAIR_SCAN)), inst)
    lacks, apart = (F.raise_error(F.concat(F.lit(t), F.col("read_id").cast("string"))) for t in ("no score of pair ", "mates on two chromosomes: "))
    score = F.when(mapped, F.when(F.col("as1").isNull() | F.col("as2").isNull(), lacks.cast("int")).otherwise(F.col("as1") + F.col("as2")))
    locus = F.struct(F.when(mapped & (chrom != other), apart).otherwise(chrom).alias("chr"), "pos1", "pos2")
    return _combined(records.select("read_id", inst.alias("inst"), rank.alias("rank"), score.alias("score"), locus.alias("locus")))


def with_all_reads(decisions: DataFrame, reads: DataFrame) -> DataFrame:
    """decisions with a row of none for each of reads (read_id) that no instance has a record of."""
    return reads.select("read_id").join(decisions, "read_id", "left").withColumn("decision", F.coalesce("decision", F.lit("none")))


def first_ambiguous(records: DataFrame) -> DataFrame:
    """(read_id, inst) of the first record with the best score of reads that are ambiguous within an instance: (read_id,
    inst, as_i, xs_i); of other reads there is none."""
    r = records.withColumn("top", F.max("as_i").over(Window.partitionBy("read_id"))).where(F.col("as_i") == F.col("top"))
    out = r.groupBy("read_id").agg(F.min("inst").alias("inst"), F.coalesce(F.bool_or(F.col("xs_i") == F.col("as_i")), F.lit(False)).alias("amb"))
    return out.where("amb").select("read_id", "inst")


def unaligned_reads(decisions: DataFrame, reads: DataFrame, ambiguous: bool) -> DataFrame:
    """The reads (read_id, ...) of the decision ambiguous, or else of none."""
    return reads.join(decisions.where(F.col("decision") == ("ambiguous" if ambiguous else "none")).select("read_id"), "read_id", "left_semi")


def contiguous(df: DataFrame, *key: str, file: str = "file_ord", order: str = "ord") -> DataFrame:
    """df with group: the number, within a file and key, of the run of neighbouring rows that a row is in; a key that
    comes again after another is a new run. order is dense in a file. A row meets the one before it in an equi-join,
    and only rows of one key are ever sorted together."""
    before = df.select(F.col(file).alias("_file"), (F.col(order) + 1).alias("_next"), F.lit(True).alias("_same"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)))
    on = [df[file] == before["_file"], df[order] == before["_next"], *(df[k].eqNullSafe(before[f"_k{i}"]) for i, k in enumerate(key))]
    at = df.join(before, on, "left").select(*(df[c] for c in df.columns), F.col("_same").isNull().cast("long").alias("_begins"))
    return at.withColumn("group", F.sum("_begins").over(Window.partitionBy(file, *key).orderBy(order))).drop("_begins")


def run_counters(decisions: DataFrame) -> DataFrame:
    """(decision, n) of all reads."""
    return decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def call_totals(calls) -> list:
    """Sums of a column of call strings, by letter: methylated and unmethylated z, x, h and u."""
    names = {"Z": "meth_cpg", "z": "unmeth_cpg", "X": "meth_chg", "x": "unmeth_chg", "H": "meth_chh", "h": "unmeth_chh", "U": "meth_unknown", "u": "unmeth_unknown"}
    return [F.coalesce(F.sum(occurrences(calls, letter).cast("long")), F.lit(0)).alias(n) for letter, n in names.items()]


def alignment_counters(windows: DataFrame) -> DataFrame:
    """(inst, extracted, discarded) of windows.call_windows() rows: reads past both edge guards, and those without."""
    return windows.groupBy("inst").agg(F.count_if("extracted").alias("extracted"), F.count_if(~F.col("extracted")).alias("discarded"))


def with_mapq(df: DataFrame, **options) -> DataFrame:
    return df.withColumn("mapq", mapq(F.col("length"), F.col("score"), F.col("second"), **options))


def template_length(start1, end1, start2, end2, flag1=None, dovetail: bool = False):
    """TLEN of both mates: (mate 1, mate 2)."""
    left = start1 <= start2
    flag1 = F.lit(0) if flag1 is None else flag1
    turned = F.lit(dovetail)
    outer, other = end2 - start1 + 1, end1 - start2 + 1
    whole1, whole2 = end1 - start1 + 1, end2 - start2 + 1
    one = F.when(left, F.when(end2 >= end1, F.when((flag1 == 83) & turned, -outer).otherwise(outer)).otherwise(whole1))
    one = one.otherwise(F.when(end1 >= end2, F.when((flag1 == 99) & turned, other).otherwise(-other)).otherwise(-whole2))
    return one, -one


# -- two strands of a molecule --------------------------------------------------------------------------------


def verdict(pile: DataFrame, least: int = 2, share: float = 0.6) -> DataFrame:
    """pile (own_c, own_t, opp_c, opp_t) with verdict: undetermined under least opposite bases, variant from the share on,
    else methylation; methylation counts (m, total) are the own strand's, but nothing for a variant."""
    depth = F.col("opp_c") + F.col("opp_t")
    v = F.when(depth < least, "undetermined").when(F.col("opp_t").cast("double") / F.when(depth > 0, depth).cast("double") >= share, "variant").otherwise("methylation")
    out = pile.withColumn("verdict", v)
    counted = F.col("verdict") != "variant"
    return out.withColumns({"m": F.when(counted, F.col("own_t")).otherwise(0).cast("long"), "total": F.when(counted, F.col("own_c") + F.col("own_t")).otherwise(0).cast("long")})


def families(df: DataFrame) -> DataFrame:
    """(chr, start, end, umi, ot, ob, paired) of molecules (chr, start, end, umi canonical, strand OT or OB)."""
    n = lambda s: F.sum((F.col("strand") == s).cast("long"))
    out = df.groupBy("chr", "start", "end", "umi").agg(n("OT").alias("ot"), n("OB").alias("ob"))
    return out.withColumn("paired", (F.col("ot") > 0) & (F.col("ob") > 0))


def consensus(df: DataFrame) -> DataFrame:
    """(family, pos, base, qual) of paired families' bases (family, pos, kind, strand, base, qual), kind plus, minus or other.

    The best-quality base of each strand is taken. At a CpG cytosine the own strand's base stands unless the opposite
    one shows the converted base too, then N; elsewhere agreement keeps the base, else the better quality, else N.
    """
    best = df.groupBy("family", "pos", "kind", "strand").agg(F.max(F.struct("qual", "base")).alias("b"))
    side = lambda s: F.max(F.when(F.col("strand") == s, F.col("b")))
    both = best.groupBy("family", "pos", "kind").agg(side("OT").alias("ot"), side("OB").alias("ob"))
    ot, ob = F.col("ot"), F.col("ob")

    def cpg(own, opposite, converted):
        base = F.when(own.isNull(), "N").when(F.coalesce(opposite["base"] == converted, F.lit(False)), "N").otherwise(own["base"])
        return F.struct(base.alias("base"), F.when(own.isNull(), F.coalesce(opposite["qual"], F.lit(0))).otherwise(own["qual"]).alias("qual"))

    generic = F.struct(
        F.when(ot.isNull(), ob["base"]).when(ob.isNull() | (ot["base"] == ob["base"]), ot["base"]).when(ot["qual"] == ob["qual"], "N").when(ot["qual"] > ob["qual"], ot["base"]).otherwise(ob["base"]).alias("base"),
        F.greatest(ot["qual"], ob["qual"]).alias("qual"),
    )
    out = F.when(F.col("kind") == "plus", cpg(ot, ob, "T")).when(F.col("kind") == "minus", cpg(ob, ot, "A")).otherwise(generic)
    return both.select("family", "pos", out.alias("c")).select("family", "pos", "c.base", "c.qual")


def duplex(df: DataFrame, *key: str) -> DataFrame:
    """Rows of keys that both strands have: a semi-join on the few columns of the key."""
    both = df.groupBy(*key).agg(F.count_distinct("strand").alias("n")).where("n > 1").select(*key)
    return df.join(both, list(key), "left_semi")
