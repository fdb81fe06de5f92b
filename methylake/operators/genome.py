"""Genome tables: tiles with a halo, cytosine positions, motifs and base composition.

A genome is (chr, seq), a row for each chromosome, or the stretches that sources.text.genome_stretches reads: (chr,
chr_len, start, left, seq, right, tail), where no row holds a whole chromosome. Either is cut in one walk into tiles of
CORE bases with HALO bases of context on both sides, so every motif window is a substring of its own tile, and anything
that has a position meets its tile in an equi-join on (chr, tile).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methylake.functions.expr import context, convert_genome, converted_bases, occurrences, revcomp

CORE, HALO = 64, 6


def stretches(genome: DataFrame) -> DataFrame:
    """(chr, chr_len, start, left, seq, right, tail) of either form of a genome; empty chromosomes have none. left and
    right: HALO bases before and after seq; tail: the chromosome's last two bases, for windows that wrap around its start."""
    if "left" in genome.columns:
        return genome
    none = F.lit("")
    return genome.where(F.length("seq") > 0).select("chr", F.length("seq").cast("long").alias("chr_len"), F.lit(0).cast("long").alias("start"), none.alias("left"), "seq", none.alias("right"), F.right("seq", F.lit(2)).alias("tail"))


def chromosomes(genome: DataFrame) -> DataFrame:
    """(chr, chr_len) of either form of a genome."""
    return genome.select("chr", "chr_len").distinct() if "left" in genome.columns else genome.select("chr", F.length("seq").cast("long").alias("chr_len"))


def tiles(genome: DataFrame, core: int = CORE, halo: int = HALO) -> DataFrame:
    """(chr, tile, chr_len, tile_start, core_len, pad, text, tail): pad bases of halo precede the core in text. Cutting
    is one walk over a sequence, however long."""
    cut = stretches(genome).withColumn("c", F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{core}}}"), F.lit(0)))
    n = F.size("c")
    before = F.concat(F.array("left"), F.slice(F.transform("c", lambda x: F.right(x, F.lit(halo))), F.lit(1), n - 1))
    after = F.concat(F.slice(F.transform("c", lambda x: F.left(x, F.lit(halo))), F.lit(2), n), F.array("right"))
    cut = cut.select("chr", "chr_len", "start", "tail", F.posexplode(F.arrays_zip(F.col("c"), before.alias("before"), after.alias("after"))).alias("k", "z"))
    start = F.col("start") + F.col("k").cast("long") * core
    return cut.select("chr", F.floor(start / core).alias("tile"), "chr_len", start.alias("tile_start"), F.length("z.c").alias("core_len"), F.length("z.before").alias("pad"), F.concat("z.before", "z.c", "z.after").alias("text"), "tail")


def tile_of(pos, core: int = CORE):
    """The tile of a 1-based position."""
    return F.floor((pos - 1) / core)


def placed(at: DataFrame, kinds: str) -> DataFrame:
    """Rows with tile columns and k, a place in the core, with o (1-based place in text), i (0-based one in the
    chromosome) and base, where that is one of kinds."""
    at = at.withColumn("o", (F.col("pad") + F.col("k") + 1).cast("int")).withColumn("base", F.substring("text", F.col("o"), F.lit(1)))
    return at.where(F.col("base").isin(*kinds)).withColumn("i", F.col("tile_start") + F.col("k"))


def bases(tiled: DataFrame, kinds: str = "CG") -> DataFrame:
    """A row for each base of a kind."""
    return placed(tiled.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("core_len") - 1))), kinds)


def at_positions(genome: DataFrame, rows: DataFrame, kinds: str = "CG") -> DataFrame:
    """rows (chr, pos, ...) with the columns of placed(), where the genome has a base of a kind at pos: one equi-join
    on (chr, tile) of the rows and the tiles, neither of which is exploded."""
    at = rows.withColumn("tile", tile_of(F.col("pos"))).join(tiles(genome), ["chr", "tile"]).withColumn("k", F.col("pos") - 1 - F.col("tile_start"))
    return placed(at.where((F.col("k") >= 0) & (F.col("k") < F.col("core_len"))).drop("pos"), kinds)


def with_turned(tiled: DataFrame) -> DataFrame:
    """tiles with rc, the reverse complement of text, and rc_len: made once a tile, not for each of its bases."""
    return tiled.withColumns({"rc": revcomp(F.col("text")), "rc_len": F.length("text")})


def around(before: int, n: int):
    """n bases of the tile's text from `before` bases before the place on; shorter where the chromosome ends, empty where it has not begun."""
    begin = F.col("o") - before
    return F.when(F.col("i") < before, F.lit("")).otherwise(F.substring("text", begin, F.lit(n)))


def as_cytosines(at: DataFrame, ffs: bool = False) -> DataFrame:
    """Places of C and G with pos, strand, context, tri, upstream[, tetra, penta, hexa], where that is a cytosine with a
    context; other columns stay.

    pos is 1-based; G bases are cytosines of the - strand. Positions without a full 3-mer and the last base of a
    chromosome are left out, as are 3-mers without a context.
    """
    plus, i = F.col("base") == "C", F.col("i")
    # the base before and the 3-mer are one piece of text, cut once; at the first base upstream wraps to the chromosome's
    # last base and is that alone. A 3-mer that begins with C always has a context
    minus = F.substring("rc", F.col("rc_len") - F.col("o"), F.lit(4)) if "rc" in at.columns else revcomp(F.substring("text", F.col("o") - 2, F.lit(4)))
    four = F.when(~plus, minus).when(i == 0, F.concat(F.right("tail", F.lit(1)), F.substring("text", F.col("o"), F.lit(3)))).otherwise(F.substring("text", F.col("o") - 1, F.lit(4)))
    out = at.where((i + 1 < F.col("chr_len")) & F.when(plus, i + 2 < F.col("chr_len")).otherwise(i >= 2)).withColumn("four", four)
    out = out.withColumns({"tri": F.substring("four", 2, 3), "upstream": F.when(i == 0, F.right("tail", F.lit(1))).otherwise(F.left("four", F.lit(3))), "strand": F.when(plus, "+").otherwise("-"), "pos": (i + 1).cast("long")})
    out = out.withColumn("context", context(F.col("tri"))).drop("four")
    if not ffs:
        return out
    left = F.col("chr_len") - i
    wrap = F.when(i >= 2, around(2, 6)).otherwise(F.right("tail", (F.lit(2) - i).cast("int")))
    return out.withColumns({
        "tetra": F.when(plus, F.when(left >= 4, around(0, 4)).otherwise("")).otherwise(F.when(i >= 3, revcomp(around(3, 4))).otherwise("")),
        "penta": F.when(plus, F.when(left >= 5, around(0, 5)).otherwise("")).otherwise(F.when(i >= 4, revcomp(around(4, 5))).otherwise("")),
        "hexa": F.when(plus, F.when(left >= 4, wrap).otherwise("")).otherwise(F.when(i >= 3, revcomp(around(3, 6))).otherwise("")),
    })


def cytosine_positions(genome: DataFrame, ffs: bool = False) -> DataFrame:
    """Every cytosine of both strands with a context: (chr, pos, strand, context, tri, upstream[, tetra, penta, hexa])."""
    return as_cytosines(bases(with_turned(tiles(genome))), ffs).select("chr", "pos", "strand", "context", "tri", "upstream", *(["tetra", "penta", "hexa"] if ffs else []))


def as_gpc(at: DataFrame) -> DataFrame:
    """Places of C and G with pos, strand, context and tri, where they are a cytosine of a GC; a GC of which either
    cytosine has an edge or an unknown context has none. The G is the - strand's cytosine."""
    g = F.col("base") == "G"
    following = F.substring("text", F.col("o") + 1, F.lit(1))
    at = at.where(F.when(g, following == "C").otherwise(around(1, 1) == "G"))
    top = F.when(g, F.substring("text", F.col("o") + 1, F.lit(3))).otherwise(around(0, 3))
    at = at.withColumns({"top": top, "bottom": revcomp(F.when(g, around(2, 3)).otherwise(around(3, 3)))}).where("length(top) = 3 and length(bottom) = 3")
    at = at.withColumns({"ct": context(F.col("top")), "cb": context(F.col("bottom"))}).where("ct is not null and cb is not null")
    return at.withColumns({
        "pos": (F.col("i") + 1).cast("long"), "strand": F.when(g, "-").otherwise("+"), "context": F.when(g, F.col("cb")).otherwise(F.col("ct")), "tri": F.when(g, F.col("bottom")).otherwise(F.col("top")),
    })


def gpc_sites(genome: DataFrame) -> DataFrame:
    """Both cytosines of every GC: (chr, pos, strand, context, tri)."""
    return as_gpc(bases(tiles(genome).where(F.col("text").contains("GC")))).select("chr", "pos", "strand", "context", "tri")


def as_drach(at: DataFrame) -> DataFrame:
    """Places of C and G with pos, strand, drach and tri, where they are the cytosine of a DRACH motif. Its first bases
    may be missing only by wrapping around the start; a missing last base passes."""
    plus, i = F.col("base") == "C", F.col("i")
    at = at.where(F.when(plus, around(1, 1) == "A").otherwise((F.substring("text", F.col("o") + 1, F.lit(1)) == "T") & (i >= 2)))
    drach = F.when(plus, F.when(i >= 3, around(3, 5)).otherwise(F.right("tail", (F.lit(3) - i).cast("int")))).otherwise(revcomp(around(1, 5)))
    at = at.withColumns({"drach": drach, "tri": F.when(plus, around(0, 3)).otherwise(revcomp(around(2, 3))), "pos": (i + 1).cast("long"), "strand": F.when(plus, "+").otherwise("-")})
    d, r, h = (F.substring("drach", k, 1) for k in (1, 2, 5))
    return at.where((F.length("tri") == 3) & (d != "C") & r.isin("A", "G") & (h != "G"))


def drach_sites(genome: DataFrame) -> DataFrame:
    """Cytosines of DRACH motifs: (chr, pos, strand, drach, tri)."""
    return as_drach(bases(tiles(genome).where(F.col("text").contains("AC") | F.col("text").contains("GT")))).select("chr", "pos", "strand", "drach", "tri")


def converted(genome: DataFrame, slam: bool = False) -> DataFrame:
    """(chr, seq, bases) of both converted copies; names end in _CT_converted or _GA_converted, with slam too."""
    copies = [genome.select(F.concat("chr", F.lit(f"_{k}_converted")).alias("chr"), convert_genome(F.col("seq"), k, slam).alias("seq"), converted_bases(F.col("seq"), k, slam).alias("bases")) for k in ("CT", "GA")]
    return copies[0].unionByName(copies[1])


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) of the bases other than N of seq and of the overlapping pairs without N that begin in it, right following
    it; words that don't occur are left out. Words are counted in whole texts, without a row for a base: an equal pair XX
    as often as there are X less the runs of X."""
    rows = rows.select("seq", F.concat("seq", F.left("right", F.lit(1))).alias("text"))
    runs = lambda x: occurrences(F.col("text"), x) - F.regexp_count("text", F.lit(f"{x}+"))
    n = {x: occurrences(F.col("seq"), x) for x in "ACGT"}
    n |= {a + b: runs(a) if a == b else (F.length("text") - F.length(F.replace("text", F.lit(a + b), F.lit("")))) / 2 for a in "ACGT" for b in "ACGT"}
    sums = rows.agg(*(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(w) for w, c in n.items()))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(w).alias("word"), F.col(w).alias("n")) for w in n)))).where("n > 0")


def composition(genome: DataFrame) -> DataFrame:
    """(word, n) of a genome's bases other than N and of overlapping pairs without N, of those that occur."""
    return word_counts(stretches(genome))


# The order of words in the composition report.
WORDS = ("A", "C", "G", "T", "AA", "AC", "AG", "AT", "CA", "CC", "CG", "CT", "GA", "GC", "GG", "GT", "TA", "TC", "TG", "TT")


def composition_report(sample: DataFrame, genomic: DataFrame) -> DataFrame:
    """(word, count_sample, pct_sample, count_genomic, pct_genomic, coverage) from two composition tables of 20 rows;
    percentages are of words of the same length, coverage is sample over genomic count."""
    spark = sample.sparkSession
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    both = F.broadcast(words).join(sample.withColumnRenamed("n", "s"), "word", "left").join(genomic.withColumnRenamed("n", "g"), "word", "left").fillna(0, ["s", "g"])
    totals = both.groupBy(F.length("word").alias("l")).agg(F.sum("s").alias("ts"), F.sum("g").alias("tg"))
    both = both.join(F.broadcast(totals), F.length("word") == F.col("l"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b).cast("double"))
    return both.select("word", F.col("s").alias("count_sample"), (ratio("s", "ts") * 100).alias("pct_sample"), F.col("g").alias("count_genomic"), (ratio("g", "tg") * 100).alias("pct_genomic"), ratio("s", "g").alias("coverage"))
