"""Column expressions over bases, call strings, CIGARs and tags. All run inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strands by (read conversion, genome conversion).
STRANDS = {("CT", "CT"): "OT", ("GA", "CT"): "CTOT", ("CT", "GA"): "OB", ("GA", "GA"): "CTOB"}


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# -- bases ----------------------------------------------------------------------------------------------------


def revcomp(seq: Column) -> Column:
    """Reverse complement of upper-case ACGT; other letters stay (the report flavour)."""
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def revcomp_any_case(seq: Column) -> Column:
    """Reverse complement that also turns lower-case bases into upper-case complements (the output flavour)."""
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCATGCA")


def revcomp_iupac(seq: Column) -> Column:
    """Reverse complement over the IUPAC letters (the unaligned-BAM flavour)."""
    return F.translate(F.reverse(F.upper(seq)), "ACGTURYKMBVDH", "TGCAAYRMKVBHD")


def convert_read(seq: Column, kind: str) -> Column:
    """A read in upper case with C->T (kind CT) or G->A (kind GA)."""
    return F.translate(F.upper(seq), kind[0], kind[1])


def convert_genome(seq: Column, kind: str, slam: bool = False) -> Column:
    """Genome conversion: letters outside ACGTN become N, then C->T or G->A; with slam T->C or A->G."""
    a, b = (kind[1], kind[0]) if slam else (kind[0], kind[1])
    return F.translate(F.regexp_replace(F.upper(seq), "[^ATCGN]", "N"), a, b)


def occurrences(text: Column, letters: str) -> Column:
    """How many characters of text are among letters."""
    return F.length(text) - F.length(F.translate(text, letters, ""))


def converted_bases(seq: Column, kind: str, slam: bool = False) -> Column:
    """Substitutions that convert_genome makes."""
    return occurrences(F.upper(seq), kind[1] if slam else kind[0]).cast("long")


def text_window(seq: Column, offset: Column, n: int) -> Column:
    """n letters from a 0-based offset; a negative one counts from the end, clamped; past the end is empty."""
    size = F.length(seq)
    begin = F.when(offset < 0, F.greatest(size + offset, F.lit(0))).otherwise(offset)
    return F.when(begin >= size, F.lit("")).otherwise(F.substring(seq, begin + 1, F.lit(n)))


def context(tri: Column) -> Column:
    """CG, CHG or CHH of a 3-mer, else null; N is a wildcard in the last place and not in a CG."""
    whole = tri.startswith("C") & (F.length(tri) == 3)  # patterns would be regular expressions, for every base
    return F.when(tri.startswith("CG"), "CG").when(whole & tri.endswith("G"), "CHG").when(whole, "CHH")


# -- read names and tags --------------------------------------------------------------------------------------


def fix_id(name: Column, cut: bool = False) -> Column:
    """Read ids: runs of blanks and tabs become _, or the id is cut at the first one."""
    return F.regexp_extract(name, "^[^ \\t]*", 0) if cut else F.regexp_replace(name, "[ \\t]+", "_")


def mate_suffix(name: Column, mate: int) -> Column:
    return F.concat(name, F.lit(f"/{mate}/{mate}"))


def strand(xr: Column, xg: Column) -> Column:
    """OT, CTOT, OB or CTOB; other tags are an error."""
    out = F.when(F.lit(False), "")
    for (r, g), s in STRANDS.items():
        out = out.when((xr == r) & (xg == g), s)
    return out.otherwise(F.raise_error(F.concat(F.lit("bad XR/XG: "), F.coalesce(xr, F.lit("?")), F.lit("/"), F.coalesce(xg, F.lit("?")))))


def forward(s: Column) -> Column:
    """Whether a strand is of the forward class."""
    return s.isin("OT", "CTOB")


def umi_tail(name: Column) -> Column:
    """The last :-token of word characters or +; null if there is none."""
    return F.nullif(F.regexp_extract(name, ":([A-Za-z0-9_+]+)$", 1), F.lit(""))


def umi_bclconvert(name: Column) -> Column:
    """The UMI before _d:N:d:index; null if there is none."""
    return F.nullif(F.regexp_extract(name, ":([CAGTN+]+)_[0-9]:N:[0-9]:([CAGTN+]+)$", 1), F.lit(""))


def barcode(name: Column) -> Column:
    return F.nullif(F.split_part(name, F.lit("_"), F.lit(1)), F.lit(""))


def barcode_umi(name: Column) -> Column:
    return F.nullif(F.split_part(name, F.lit("_"), F.lit(2)), F.lit(""))


def canonical_umi(umi: Column) -> Column:
    """The smaller of a UMI and what the other strand of its molecule carries: halves around + swapped, else the reverse complement."""
    u = F.upper(umi)
    other = F.when(u.contains("+"), F.concat(F.substring_index(u, "+", -1), F.lit("+"), F.substring_index(u, "+", 1))).otherwise(revcomp(u))
    return F.least(u, other)


def ucsc_name(chrom: Column) -> Column:
    return F.when(chrom == "MT", "chrM").when(chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))


def plain_name(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "^chr", "")


def phred64_to_33(qual: Column) -> Column:
    return F.array_join(F.transform(F.split(qual, ""), lambda c: F.char(F.ascii(c) - 31)), "")


def solexa_to_33(qual: Column) -> Column:
    return F.array_join(F.transform(F.split(qual, ""), lambda c: F.char(F.ascii(c) - 26)), "")


# -- CIGAR ----------------------------------------------------------------------------------------------------


def cigar_ops(cigar: Column) -> Column:
    """array<struct<len int, op string>>"""
    return F.transform(
        F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), 1),
        lambda x: F.struct(F.regexp_extract(x, "^[0-9]+", 0).cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")),
    )


def _span(ops: Column, kinds: tuple[str, ...]) -> Column:
    return F.aggregate(ops, F.lit(0), lambda acc, o: acc + F.when(o["op"].isin(*kinds), o["len"]).otherwise(0))


def ref_span(ops: Column) -> Column:
    return _span(ops, ("M", "D", "N", "=", "X"))


def read_span(ops: Column) -> Column:
    return _span(ops, ("M", "I", "S", "=", "X"))


def aligned_blocks(ops: Column) -> Column:
    """array<struct<read int, ref int, len int>>: 0-based read and reference offsets of each M, = or X run."""
    zero = F.struct(F.lit(0).alias("q"), F.lit(0).alias("r"), F.array().cast("array<struct<read:int,ref:int,len:int>>").alias("b"))

    def step(acc, o):
        match = o["op"].isin("M", "=", "X")
        block = F.array(F.struct(acc["q"].alias("read"), acc["r"].alias("ref"), o["len"].alias("len")))
        return F.struct(
            (acc["q"] + F.when(match | o["op"].isin("I", "S"), o["len"]).otherwise(0)).alias("q"),
            (acc["r"] + F.when(match | o["op"].isin("D", "N"), o["len"]).otherwise(0)).alias("r"),
            F.when(match, F.concat(acc["b"], block)).otherwise(acc["b"]).alias("b"),
        )

    return F.aggregate(ops, zero, step, lambda acc: acc["b"])


def clean_cigar(cigar: Column) -> Column:
    return ~cigar.rlike("[IDSN]")


def trimmed_span(ops: Column, n: int, from_right: Column) -> Column:
    """Reference bases that are left when n read bases are dropped from one end. D and N met while bases remain to be
    dropped go too; one that ends up at the new boundary stays."""
    def step(acc, o):
        left, span = acc["left"], acc["span"]
        match, ins, gap = o["op"].isin("M", "=", "X"), o["op"].isin("I", "S"), o["op"].isin("D", "N")
        drop = F.least(left, o["len"])
        return F.struct(
            F.when(match | ins, left - drop).otherwise(left).alias("left"),
            (span + F.when(match, o["len"] - drop).when(gap & (left == 0), o["len"]).otherwise(0)).alias("span"),
        )

    ordered = F.when(from_right, F.reverse(ops)).otherwise(ops)
    return F.aggregate(ordered, F.struct(F.lit(n).alias("left"), F.lit(0).alias("span")), step, lambda a: a["span"])


# -- numbers --------------------------------------------------------------------------------------------------


def percent(m: Column, u: Column) -> Column:
    """m / (m + u) * 100 as a double, null without calls."""
    return F.when(m + u > 0, m.cast("double") / (m + u).cast("double") * 100)


def exact_round(x: Column, digits: int) -> Column:
    """Rounding of the exact binary value of a double, half to even, as C's %.Nf does.

    Scaled by a power of ten, a value at a tie may have been moved onto it or off it by that multiplication; the
    product's own error, x * 10**n - scaled in exact decimals of x, says where the binary value lies.
    """
    power = F.lit(10.0**digits)
    scaled = x * power
    down = F.floor(scaled).cast("double")
    # candidates' middle as a double; 0.5 steps are exact below 2**52
    middle = (down + 0.5) / power
    lower, upper = down / power, (down + 1) / power
    tie = F.when(down % 2 == 0, lower).otherwise(upper)
    # the middle is itself a double only where its binary expansion ends; else it was rounded and no tie is possible
    ends = (middle * F.lit(2.0**20)) == F.floor(middle * F.lit(2.0**20))
    return F.when(x < middle, lower).when(x > middle, upper).when(ends, tie).otherwise(_lean(x, down, digits, lower, upper))


def _lean(x: Column, down: Column, digits: int, lower: Column, upper: Column) -> Column:
    """x is the double nearest to a middle that no double equals: its exact decimals say on which side it lies.
    Decimal strings of 2**-k sums end, so x - floor(x), scaled by 2**52, is a whole number and compares exactly."""
    whole = F.floor(x).cast("decimal(38,0)")
    part = ((x - F.floor(x)) * F.lit(2.0**52)).cast("decimal(20,0)")
    # part / 2**52 against (2 * down + 1) / (2 * 10**n) - whole
    ten = 10**digits
    left = part * F.lit(2 * ten).cast("decimal(10,0)")
    right = (F.lit(2).cast("decimal(2,0)") * down.cast("decimal(14,0)") + 1 - whole.cast("decimal(12,0)") * F.lit(2 * ten).cast("decimal(10,0)")) * F.lit(2**52).cast("decimal(17,0)")
    return F.when(left > right, upper).otherwise(lower)


def fixed_text(x: Column, digits: int) -> Column:
    """A double of up to 100 as C's %.Nf prints it; null stays null."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", exact_round(x, digits)))


#: Decimal exponents of the percentages that g15_text prints: from 100 down to what a depth of 10**8 gives.
_DECADES = range(2, -7, -1)


def g15_text(x: Column) -> Column:
    """A double from 0 to 100, and 0 or 1e-6 at least, as C's %.15g prints it: 15 significant digits, rounded on the exact
    binary value, without trailing zeros, with an exponent below 0.0001."""
    out = F.when(x == 0, "0")
    for e in _DECADES:
        out = out.when(x >= 10.0**e, _g15(x, e))
    return out.otherwise(F.raise_error(F.concat(F.lit("not a percentage: "), x.cast("string"))))


def _g15(x: Column, e: int) -> Column:
    """g15_text where 10**e <= x < 10**(e + 1). x * 2**s is a whole number, so x * 10**n rounds exactly."""
    n = 14 - e
    s = 52 - math.floor(math.log2(10.0**e))
    down = F.floor(x * F.lit(10.0**n)).cast("long") - 1  # the product may lie a little above or below
    exact = (x * F.lit(2.0**s)).cast("decimal(20,0)") * F.lit(str(10**n)).cast("decimal(22,0)") * F.lit(2).cast("decimal(1,0)")
    middle = lambda k: (F.lit(2).cast("decimal(1,0)") * (down + k).cast("decimal(17,0)") + 1) * F.lit(str(2**s)).cast("decimal(22,0)")
    # each middle between whole numbers that x lies above, or on it above an odd one, moves it up by one
    steps = sum((F.when((exact > middle(k)) | ((exact == middle(k)) & ((down + k) % 2 != 0)), 1).otherwise(0) for k in range(3)), F.lit(0))
    digits = down + steps
    if e < -4:
        whole, rest = F.floor(digits / 10**14).cast("string"), F.lpad((digits % 10**14).cast("string"), 14, "0")
        tail = F.lit(f"e-{-e:02d}")
    else:
        whole, rest = F.floor(digits.cast("decimal(20,0)") / F.lit(str(10**n)).cast("decimal(19,0)")).cast("string") if n > 0 else digits.cast("string"), F.lpad((digits % 10**n).cast("string"), n, "0")
        tail = F.lit("")
    # digits that round up to a further one are the next power of ten
    return F.when(digits == 10**15, f"{10.0 ** (e + 1):.15g}").otherwise(F.concat(F.regexp_replace(F.concat(whole, F.lit("."), rest), "\\.?0+$", ""), tail))


def sam_flag(inst: Column) -> Column:
    """FLAG of a single-end read by its instance: 16 where its conversion and its strand differ."""
    return F.when(inst.isin(0, 2), 0).when(inst.isin(1, 3), 16)


# FLAGs of mate 1 and mate 2 by paired-end index.
PAIR_FLAGS = ((99, 147), (163, 83), (147, 99), (83, 163))


def pair_flags(inst: Column) -> tuple[Column, Column]:
    out = [F.when(F.lit(False), 0), F.when(F.lit(False), 0)]
    for i, pair in enumerate(PAIR_FLAGS):
        out = [c.when(inst == i, f) for c, f in zip(out, pair, strict=True)]
    return out[0], out[1]


# Fixed values of the mapping quality: (least fraction, value) ladders.
_ALONE = ((0.8, 42), (0.7, 40), (0.6, 24), (0.5, 23), (0.4, 8), (0.3, 3))
_ALONE_LOCAL = ((0.8, 44), (0.7, 42), (0.6, 41), (0.5, 36), (0.4, 28), (0.3, 24))
_FAR = ((0.9, 39, 33), (0.8, 38, 27), (0.7, 37, 26), (0.6, 36, 22))
_NEAR = ((0.5, 35, 0.84, 25, 0.68, 16, 5), (0.4, 34, 0.84, 21, 0.68, 14, 4), (0.3, 32, 0.88, 18, 0.67, 15, 3), (0.2, 31, 0.88, 17, 0.67, 11, 0), (0.1, 30, 0.88, 12, 0.67, 7, 0))
_FAR_LOCAL = ((0.9, 40), (0.8, 39), (0.7, 38), (0.6, 37))
_NEAR_LOCAL = ((0.5, 35, 25, 20), (0.4, 34, 21, 19), (0.3, 33, 18, 16), (0.2, 32, 17, 12), (0.1, 31, 14, 9))


def mapq(length: Column, score: Column, second: Column, intercept: float = 0.0, slope: float = -0.2, local: bool = False, mate_length: Column | None = None) -> Column:
    """Mapping quality of the best score over the minimum score, with the second-best score where there is one."""
    def least(n: Column) -> Column:
        return F.lit(intercept) + F.lit(slope) * (F.log(n.cast("double")) if local else n.cast("double"))

    low = least(length) if mate_length is None else least(length) + least(mate_length)
    span = F.abs(low)
    over = score.cast("double") - low
    apart = F.abs(F.abs(score.cast("double")) - F.abs(second.cast("double")))

    def ladder(steps, rest: int) -> Column:
        out = F.when(F.lit(False), 0)
        for f, v in steps:
            out = out.when(over >= span * f, v)
        return out.otherwise(rest)

    alone = ladder(_ALONE_LOCAL, 22) if local else ladder(_ALONE, 0)
    both = F.when(F.lit(False), 0)
    if local:
        for f, v in _FAR_LOCAL:
            both = both.when(apart >= span * f, v)
        for f, equal, high, rest in _NEAR_LOCAL:
            both = both.when(apart >= span * f, F.when(over == span, equal).when(over >= span * 0.5, high).otherwise(rest))
        both = both.when(apart > 0, F.when(over >= span * 0.5, 11).otherwise(2)).otherwise(F.when(over >= span * 0.5, 1).otherwise(0))
    else:
        for f, equal, rest in _FAR:
            both = both.when(apart >= span * f, F.when(over == span, equal).otherwise(rest))
        for f, equal, f1, v1, f2, v2, rest in _NEAR:
            both = both.when(apart >= span * f, F.when(over == span, equal).when(over >= span * f1, v1).when(over >= span * f2, v2).otherwise(rest))
        both = both.when(apart > 0, F.when(over >= span * 0.67, 6).otherwise(2)).otherwise(F.when(over >= span * 0.67, 1).otherwise(0))
    return F.when(second.isNull(), alone).otherwise(both)
