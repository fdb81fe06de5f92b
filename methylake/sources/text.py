"""Scans of text formats: reads, genomes, alignments, calls and coverage, plain or gzipped, whole folders at a time.

Lines get their number within their file without a global sort: each input split counts its own lines, and only the
table of splits, one row for each, is summed up in file order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from methylake.operators.genome import HALO

#: The order in which extensions of genome files are tried, and the genome file that is always skipped.
GENOME_TIERS = (".fa", ".fa.gz", ".fasta", ".fasta.gz")
SKIPPED_GENOME = "Mus_musculus.NCBIM37.fa"

#: Bases of a stretch of a genome, a multiple of a tile.
STRETCH = 1 << 16


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, id, value): lines without their ends; id ascends within a block, the offset of an input split."""
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.text(path, lineSep="\n").select(*at, F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("value"))


def numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, ord, value): ord is the line's number in its file, from 0."""
    rows = lines(spark, path)
    blocks = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", (before - F.col("first")).alias("shift"))
    return rows.join(blocks, ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("ord"), "value")


def _records(rows: DataFrame, size: int) -> DataFrame:
    """(file, ord, l0, l1, ...): every size lines as one record; a truncated last one goes."""
    part = [F.max(F.when(F.col("ord") % size == i, F.col("value"))).alias(f"l{i}") for i in range(size)]
    out = rows.groupBy("file", F.floor(F.col("ord") / size).alias("record")).agg(F.count(F.lit(1)).alias("n"), *part)
    return out.where(F.col("n") == size).drop("n").withColumnRenamed("record", "ord")


def _checked(df: DataFrame, good, message: str) -> DataFrame:
    """df, whose first record of each file must be good: reading another one raises."""
    return df.where(F.when((F.col("ord") == 0) & ~good, F.raise_error(F.concat(F.lit(message), F.col("file"))).cast("boolean")).otherwise(F.lit(True)))


def fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, ord, id, seq, qual) of four-line records; the first one's lines must start with @ and +."""
    r = _checked(_records(numbered(spark, path), 4), F.col("l0").startswith("@") & F.col("l2").startswith("+"), "not FASTQ: ")
    return r.select("file", "ord", F.substring("l0", 2, 2**31 - 1).alias("id"), F.col("l1").alias("seq"), F.col("l3").alias("qual"))


def fasta_reads(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, ord, id, seq, qual) of two-line records; every quality is I."""
    r = _checked(_records(numbered(spark, path), 2), F.col("l0").startswith(">"), "not FASTA: ")
    return r.select("file", "ord", F.substring("l0", 2, 2**31 - 1).alias("id"), F.col("l1").alias("seq"), F.regexp_replace("l1", ".", "I").alias("qual"))


def genome_files(spark: SparkSession, folder: str) -> list[str]:
    """The genome files of a folder: of the first extension that any has, by name without regard to case."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]
    found = next((x for tier in GENOME_TIERS if (x := [n for n in names if n.endswith(tier)])), [])
    if not found:
        raise FileNotFoundError(f"no genome files in {folder}")
    return [f"{folder.rstrip('/')}/{n}" for n in sorted(found, key=str.lower) if n != SKIPPED_GENOME]


def _genome_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, id, chr, name, seq): FASTA lines with their chromosome; name on header lines, seq on others, upper case.

    A line's chromosome is the last header above it: within its split by a window over the split, else the last header
    of an earlier split, so no window spans a file.
    """
    name = F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>(\S*)", 1))
    rows = lines(spark, path).withColumn("name", name)
    here = Window.partitionBy("file", "block").orderBy("id")
    blocks = rows.groupBy("file", "block").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("id"))).alias("newest"))
    carried = F.last("newest", True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", carried.alias("carried"))
    rows = rows.withColumn("chr", F.last("name", True).over(here)).join(blocks, ["file", "block"]).withColumn("chr", F.coalesce("chr", "carried")).where("chr is not null")
    return rows.select("file", "block", "id", "chr", "name", F.when(F.col("name").isNull(), F.upper(F.trim("value"))).alias("seq"))


def _once(out, count: str = "n"):
    """out, for a chromosome with one header; another one raises."""
    twice = F.raise_error(F.concat(F.lit("chromosome name used twice: "), F.col("chr")))
    return F.when(F.col(count) > 1, twice).otherwise(out)


def genome(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(chr, seq) of FASTA files, for genomes of short chromosomes: names end at white space, bases in upper case; a name
    twice raises. One row holds one chromosome; genome_stretches() has no such row."""
    rows = _genome_lines(spark, path)
    piece = F.when(F.col("seq").isNotNull(), F.struct("file", "block", "id", "seq"))
    out = rows.groupBy("chr").agg(F.count("name").alias("n"), F.array_sort(F.collect_list(piece)).alias("p"))
    return out.select("chr", _once(F.array_join(F.col("p.seq"), "")).alias("seq"))


def genome_stretches(spark: SparkSession, path: str | list[str], size: int = STRETCH) -> DataFrame:
    """(chr, chr_len, start, left, seq, right, tail) of FASTA files: stretches of size bases of each chromosome with HALO
    bases of both sides, as operators.genome takes them; empty chromosomes have none, a name twice raises.

    A line's place in its chromosome is a sum within its split and one over the chromosome's few splits. Lines are dealt
    by (chromosome, stretch), so no task and no row holds a chromosome.
    """
    rows = _genome_lines(spark, path)
    n = F.coalesce(F.length("seq"), F.lit(0)).cast("long")
    here = Window.partitionBy("file", "block", "chr").orderBy("id")
    rows = rows.withColumns({
        "n": n, "before": F.coalesce(F.sum(n).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "two": F.when(n > 0, F.right(F.concat(F.coalesce(F.last(F.when(n > 0, F.col("seq")), True).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit("")), "seq"), F.lit(2))),
    })
    blocks = rows.groupBy("file", "block", "chr").agg(F.sum("n").alias("sum"), F.count("name").alias("headers"), F.max_by("two", F.when(F.col("n") > 0, F.col("id"))).alias("two"))
    order = Window.partitionBy("chr").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = blocks.select("file", "block", "chr", F.coalesce(F.sum("sum").over(order), F.lit(0)).alias("shift"))
    parts = F.array_sort(F.collect_list(F.struct("file", "block", F.coalesce("two", F.lit("")).alias("two"))))
    whole = blocks.groupBy("chr").agg(F.sum("sum").alias("chr_len"), F.sum("headers").alias("headers"), F.right(F.array_join(parts["two"], ""), F.lit(2)).alias("tail"))

    at = rows.where("n > 0").join(shifts, ["file", "block", "chr"]).select("chr", (F.col("shift") + F.col("before")).alias("at"), "seq", "n")
    first, last = F.floor(F.greatest(F.col("at") - HALO, F.lit(0)) / size), F.floor((F.col("at") + F.col("n") - 1 + HALO) / size)
    at = at.withColumn("stretch", F.explode(F.sequence(first, last)))
    # of a long line only the part that a stretch needs
    begin = F.greatest(F.col("at"), F.col("stretch") * size - HALO)
    end = F.least(F.col("at") + F.col("n"), (F.col("stretch") + 1) * size + HALO)
    at = at.select("chr", "stretch", F.struct(begin.alias("at"), F.substring("seq", (begin - F.col("at") + 1).cast("int"), (end - begin).cast("int")).alias("seq")).alias("p"))
    at = at.groupBy("chr", "stretch").agg(F.array_sort(F.collect_list("p")).alias("p"))
    start = F.col("stretch") * size
    pad = (start - F.col("p")[0]["at"]).cast("int")
    at = at.select("chr", start.alias("start"), pad.alias("pad"), F.array_join("p.seq", "").alias("text")).where(F.length("text") > F.col("pad"))
    out = at.join(whole, "chr")
    return out.select(
        "chr", _once(F.col("chr_len"), "headers").alias("chr_len"), "start", F.substring("text", F.lit(1), F.col("pad")).alias("left"), F.substring("text", F.col("pad") + 1, F.lit(size)).alias("seq"),
        F.substring("text", F.col("pad") + size + 1, F.lit(HALO)).alias("right"), "tail",
    )


def _tag(name: str, kind: str = "Z"):
    t = F.filter("f", lambda x, i: (i > 10) & x.startswith(f"{name}:{kind}:"))
    v = F.substring(F.try_element_at(t, F.lit(1)), 6, 2**31 - 1)
    return (v.try_cast("int") if kind == "i" else v).alias(name.lower())


def whole_alignments(out: DataFrame) -> DataFrame:
    """The mapped records of out; a missing XM, XR or XG, or an XM not as long as SEQ, raises."""
    out = out.where(F.col("flag").bitwiseAND(4) == 0)
    whole = F.coalesce((F.length("xm") == F.length("seq")) & F.col("xr").isNotNull() & F.col("xg").isNotNull(), F.lit(False))
    return out.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("XM, XR or XG missing or of the wrong length: "), F.col("qname"))).cast("boolean")))


def sam(spark: SparkSession, path: str | list[str], mapped_only: bool = True) -> DataFrame:
    """Alignments of SAM text: file, ord, the eleven columns and the tags nm, md, xm, xr, xg, rx, cb, ur.

    With mapped_only, unmapped records go first and the others must have XM, as long as SEQ, XR and XG. ord ascends
    within a file, header lines counted.
    """
    f = numbered(spark, path).where(~F.col("value").startswith("@") & (F.col("value") != "")).withColumn("f", F.split("value", "\t"))
    kinds = [("qname", "string"), ("flag", "int"), ("chr", "string"), ("pos", "long"), ("mapq", "int"), ("cigar", "string"), ("rnext", "string"), ("pnext", "long"), ("tlen", "int"), ("seq", "string"), ("qual", "string")]
    out = f.select("file", "ord", *(F.col("f")[i].cast(k).alias(n) for i, (n, k) in enumerate(kinds)), _tag("NM", "i"), *(_tag(t) for t in ("MD", "XM", "XR", "XG", "RX", "CB", "UR")))
    return whole_alignments(out) if mapped_only else out


def paired_end(spark: SparkSession, path: str, program: str) -> bool | None:
    """Whether the header's last @PG line of a program names both -1 and -2; None without such a line."""
    pg = lines(spark, path).where(F.col("value").startswith("@PG\t") & F.array_contains(F.split("value", "\t"), f"ID:{program}"))
    words = F.split("value", r"\s+")
    last = pg.agg(F.max_by(F.array_contains(words, "-1") & F.array_contains(words, "-2"), F.struct("file", "block", "id")).alias("x")).first()
    return last["x"]


def reject_sorted(spark: SparkSession, path: str, paired: bool) -> None:
    """Raises for SAM of pairs whose header says that it is sorted by coordinate: mates must follow each other."""
    head = lines(spark, path).where(F.col("value").startswith("@HD\t") & F.array_contains(F.split("value", "\t"), "SO:coordinate"))
    if paired and not head.isEmpty():
        raise ValueError(f"{path} is sorted by coordinate; its mates don't follow each other")


def chromosome_names(spark: SparkSession, path: str) -> list[str]:
    """The names of the @SQ lines of SAM, in their order."""
    rows = numbered(spark, path).where(F.col("value").startswith("@SQ\t")).orderBy("ord").select(F.regexp_extract("value", "\tSN:([^\t]*)", 1)).collect()
    return [r[0] for r in rows]


def calls(spark: SparkSession, path: str | list[str], prefix: str = "CpG", no_header: bool = True) -> DataFrame:
    """(file, ctx, strand, read_id, meth, chr, pos, call) of five-column call files whose names start with prefix.

    Context and strand come from the name. Lines of another shape go, and without no_header the first line of each file
    whatever its shape; a position below 1 raises.
    """
    name = F.col("_metadata.file_name")
    if no_header:
        rows = spark.read.text(path).select(name.alias("file"), "value")
    else:
        rows = numbered(spark, path).where("ord > 0").select(F.regexp_extract("file", "[^/]*$", 0).alias("file"), "value")
    f = rows.select("file", F.split("value", "\t").alias("f")).where(F.col("file").startswith(prefix) & (F.size("f") == 5))
    pos = F.col("f")[3].try_cast("long")
    pos = F.when(pos >= 1, pos).otherwise(F.raise_error(F.concat(F.lit("bad position: "), F.array_join("f", " "))).cast("long"))
    part = lambda i: F.nullif(F.regexp_extract("file", r"^([A-Za-z]+(?:_CpG)?)_(CTOT|CTOB|OT|OB)?", i), F.lit(""))
    return f.select("file", part(1).alias("ctx"), part(2).alias("strand"), F.col("f")[0].alias("read_id"), F.col("f")[1].alias("meth"), F.col("f")[2].alias("chr"), pos.alias("pos"), F.col("f")[4].alias("call"))


def read_calls(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, read_id, meth, chr, pos, call, read_start, read_end, orient) of eight-column call files; other lines go."""
    f = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.split("value", "\t").alias("f")).where(F.size("f") >= 8)
    n = {"pos": 3, "read_start": 5, "read_end": 6}
    text = {"read_id": 0, "meth": 1, "chr": 2, "call": 4, "orient": 7}
    out = f.select("file", *(F.col("f")[i].alias(k) for k, i in text.items()), *(F.col("f")[i].try_cast("long").alias(k) for k, i in n.items()))
    return out.dropna(subset=list(n)).select("file", "read_id", "meth", "chr", "pos", "call", "read_start", "read_end", "orient")


def coverage(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(chr, pos, m, u) of coverage files: chromosome, start, end, percentage and the counts; blank lines go, bad numbers raise."""
    f = spark.read.text(path).select(F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("f"), "value").where(F.trim("value") != "")
    return f.select(F.col("f")[0].alias("chr"), *(F.col("f")[i].cast("long").alias(k) for k, i in (("pos", 1), ("m", 4), ("u", 5))))
