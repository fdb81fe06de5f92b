"""Writers of text formats. Rows are written as a folder of parts whose order by name is the order of the rows, and the
parts are then put together, byte by byte, into one file: gzip files put together are one gzip file."""

from __future__ import annotations

import gzip as zip_format

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from methylake.functions.expr import fixed_text, g15_text, percent
from methylake.operators.alignments import routed
from methylake.operators.coverage import ordered


def _files(spark: SparkSession, folder: str):
    """(file system, names of the entries of a folder, in order)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def merge_parts(spark: SparkSession, folder: str, target: str, header: str = "", gzip: bool = True) -> None:
    """Puts the part files of a folder, in the order of their names, behind a header into one file, and deletes the
    folder. Bytes stream through the driver and are never held."""
    jvm, path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path
    system, names = _files(spark, folder)
    out = system.create(path(target), True)
    try:
        if header:
            raw = header.encode()
            out.write(zip_format.compress(raw, mtime=0) if gzip else raw)
        for name in names:
            if name.startswith("part-"):
                part = system.open(path(f"{folder}/{name}"))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
                finally:
                    part.close()
    finally:
        out.close()
    system.delete(path(folder), True)


def _line(*columns: Column | str) -> Column:
    cells = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    return F.concat_ws("\t", *cells).alias("value")


def _one_file(df: DataFrame, path: str, *columns: Column | str, gzip: bool = True, header: str = "") -> None:
    """df's rows, in their order, as one file of tab-separated lines."""
    df.select(_line(*columns)).write.mode("overwrite").text(f"{path}.parts", compression="gzip" if gzip else "none")
    merge_parts(df.sparkSession, f"{path}.parts", path, header, gzip)


# Fixed value: the first line of a bedGraph file.
TRACK = "track type=bedGraph\n"


def write_bedgraph(cov: DataFrame, path: str, owners: DataFrame | None = None) -> None:
    """A gzip file of a track line, then chromosome, start from 0, end and percentage with 15 digits, in the order of
    coverage.ordered()."""
    _one_file(ordered(cov, owners), path, "chr", F.col("pos") - 1, "pos", g15_text(percent(F.col("m"), F.col("u"))), header=TRACK)


def write_coverage(cov: DataFrame, path: str, zero_based: bool = False, owners: DataFrame | None = None) -> None:
    """Chromosome, start, end, percentage with 15 digits, methylated, unmethylated, as one gzip file; zero_based starts at 0
    and is not compressed."""
    _one_file(ordered(cov, owners), path, "chr", F.col("pos") - 1 if zero_based else F.col("pos"), "pos", g15_text(percent(F.col("m"), F.col("u"))), "m", "u", gzip=not zero_based)


def write_merged_cpgs(merged: DataFrame, path: str, zero_based: bool = False, gzip: bool = False) -> None:
    """coverage.merge_cpgs() rows in order: chromosome, start, end, percentage with six digits, counts."""
    start = F.col("start") - 1 if zero_based else F.col("start")
    _one_file(merged.orderBy(F.col("chr").cast("binary"), "start"), path, "chr", start, "end", fixed_text(F.col("pct"), 6), "m", "u", gzip=gzip)


def write_fastq(reads: DataFrame, path: str) -> None:
    """Four lines a read: id, seq, a plus sign, qual."""
    reads.select(F.concat(F.lit("@"), "id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")).write.mode("overwrite").text(path, compression="gzip")


def sam_header(chromosomes: list[tuple[str, int]], program: str = "") -> str:
    """The header of unsorted SAM: the chromosomes in the genome's order and the @PG line's fields, if any."""
    lines = ["@HD\tVN:1.0\tSO:unsorted", *(f"@SQ\tSN:{c}\tLN:{n}" for c, n in chromosomes), *([f"@PG\t{program}"] if program else [])]
    return "".join(line + "\n" for line in lines)


def _sam_line() -> Column:
    tags = [F.when(F.col(t.lower()).isNotNull(), F.concat(F.lit(f"{t}:{'i' if t == 'NM' else 'Z'}:"), F.col(t.lower()))) for t in ("NM", "MD", "XM", "XR", "XG", "RX", "CB", "UR")]
    fixed = [F.col(c).cast("string") for c in ("qname", "flag", "chr", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")]
    return F.concat_ws("\t", *fixed, *tags).alias("value")


def write_sam(records: DataFrame, path: str) -> None:
    """A folder of SAM records without a header, with those of the tags NM, MD, XM, XR, XG, RX, CB and UR that a record has."""
    records.select(_sam_line()).write.mode("overwrite").text(path)


def write_sam_file(records: DataFrame, path: str, chromosomes: list[tuple[str, int]], program: str = "") -> None:
    """One SAM file with its header; records in their order."""
    records.select(_sam_line()).write.mode("overwrite").text(f"{path}.parts")
    merge_parts(records.sparkSession, f"{path}.parts", path, sam_header(chromosomes, program), gzip=False)


def _split_files(df: DataFrame, folder: str, by: str, order: list, name, header: str, gzip: bool) -> list[str]:
    """df (value and the columns of by and order) as one file for each value of by that occurs, in order, named name(value);
    their names. All are written by one job that sorts by value and order."""
    spark, parts = df.sparkSession, f"{folder}/.parts"
    df.orderBy(by, *order).select("value", by).write.mode("overwrite").partitionBy(by).text(parts, compression="gzip" if gzip else "none")
    system, names = _files(spark, parts)
    out = []
    for entry in names:
        if entry.startswith(f"{by}="):
            value = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(entry[len(by) + 1 :])
            out.append(name(value))
            merge_parts(spark, f"{parts}/{entry}", f"{folder}/{out[-1]}", header, gzip)
    system.delete(spark._jvm.org.apache.hadoop.fs.Path(parts), True)
    return out


def write_calls(calls: DataFrame, folder: str, basename: str, comprehensive: bool = False, merge_non_cpg: bool = False, header: str = "", gzip: bool = False, order: tuple[str, ...] = ("id", "pos")) -> list[str]:
    """Call rows (id, strand, chr, pos, ctx, methylated, call) as split files, whose names it returns: one for each context
    and strand, or fewer by mode; of those without a call there is none. Lines: read, sign, chromosome, position, letter."""
    rows = routed(calls, comprehensive, merge_non_cpg).withColumn("value", _line("id", F.when(F.col("methylated"), "+").otherwise("-"), "chr", "pos", "call"))
    return _split_files(rows, folder, "route", list(order), lambda route: f"{route}_{basename}.txt{'.gz' * gzip}", header, gzip)


def write_read_calls(calls: DataFrame, path: str, header: str = "", gzip: bool = False, order: tuple[str, ...] = ("id", "pos")) -> None:
    """Calls of all contexts with their read's ends as one file of eight columns: (id, methylated, chr, pos, call, read_start,
    read_end, orient)."""
    _one_file(calls.orderBy(*order), path, "id", F.when(F.col("methylated"), "+").otherwise("-"), "chr", "pos", "call", "read_start", "read_end", "orient", gzip=gzip, header=header)


def write_report(report: DataFrame, folder: str, stem: str, cx: bool = False, nome: bool = False, by_chromosome: bool = False, gzip: bool = False) -> list[str]:
    """A cytosine report as one file or one for each chromosome, whose names it returns: chromosome, position, strand,
    counts, context, 3-mer and any further columns."""
    end = f"{'.NOMe' * nome}.{'CX' if cx else 'CpG'}_report.txt{'.gz' * gzip}"
    columns = ["chr", "pos", "strand", "m", "u", "context", "tri", *(c for c in ("tetra", "penta", "hexa") if c in report.columns)]
    if by_chromosome:
        return _split_files(report.withColumn("value", _line(*columns)), folder, "chr", ["pos"], lambda c: f"{stem}.chr{c}{end}", "", gzip)
    _one_file(report.orderBy(F.col("chr").cast("binary"), "pos"), f"{folder}/{stem}{end}", *columns, gzip=gzip)
    return [f"{stem}{end}"]


def write_buckets(records: DataFrame, buckets: DataFrame, folder: str, chromosomes: list[tuple[str, int]], program: str = "") -> list[str]:
    """SAM files of the reads (qname, ord, ...) of each bucket of alignments.consistency() rows (id, bucket) but the
    discarded and skipped ones."""
    rows = records.join(buckets.where("bucket not in ('discarded', 'skipped')").select(F.col("id").alias("qname"), "bucket"), "qname").withColumn("value", _sam_line())
    return _split_files(rows, folder, "bucket", ["ord"], lambda b: f"{b}.sam", sam_header(chromosomes, program), False)
