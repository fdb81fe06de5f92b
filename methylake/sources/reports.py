"""Text reports: read into a row for each file, joined into a summary of samples, and written from small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methylake.functions.expr import fixed_text, percent
from methylake.operators.genome import WORDS, composition
from methylake.sources.text import numbered

# The beginnings of report lines, as the reports have them, and the count that each gives.
SINGLE_LINES = {
    "total_reads": "Sequences analysed in total:", "unaligned": "Sequences with no alignments under any condition:", "ambiguous": "Sequences did not map uniquely:",
    "no_sequence": "Sequences which were discarded because genomic sequence could not be extracted:", "aligned": "Number of alignments with a unique best hit from the different alignments:",
}
PAIRED_LINES = {
    "total_reads": "Sequence pairs analysed in total:", "unaligned": "Sequence pairs with no alignments under any condition:", "ambiguous": "Sequence pairs did not map uniquely:",
    "no_sequence": "Sequence pairs which were discarded because genomic sequence could not be extracted:", "aligned": "Number of paired-end alignments with a unique best hit:",
}
TOTAL_CS = "Total number of C's analysed:"
METHYLATED = {f"meth_{c.lower()}": f"Total methylated C's in {c} context:" for c in ("CpG", "CHG", "CHH")}
UNMETHYLATED = {f"unmeth_{c.lower()}": f"Total unmethylated C's in {c} context:" for c in ("CpG", "CHG", "CHH")}
CONVERTED = {f"unmeth_{c.lower()}": f"Total C to T conversions in {c} context:" for c in ("CpG", "CHG", "CHH")}
DUPLICATES = {"duplicates": "Total number duplicated alignments removed:", "unique": "Total count of deduplicated leftover sequences:"}
DEDUP_TOTAL = "Total number of alignments analysed in "
# The columns of the summary, and their heads.
SUMMARY = {
    "sample": "File", "total_reads": "Total Reads", "aligned": "Aligned Reads", "unaligned": "Unaligned Reads", "ambiguous": "Ambiguously Aligned Reads", "no_sequence": "No Genomic Sequence",
    "duplicates": "Duplicate Reads (removed)", "unique": "Unique Reads (remaining)", "total_c": "Total Cs", "meth_cpg": "Methylated CpGs", "unmeth_cpg": "Unmethylated CpGs",
    "meth_chg": "Methylated chgs", "unmeth_chg": "Unmethylated chgs", "meth_chh": "Methylated CHHs", "unmeth_chh": "Unmethylated CHHs",
}


def _counts(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(file, ...) with the number that the last line of each pattern gives, as text; null without such a line."""
    found = {n: F.nullif(F.regexp_extract("value", p, 1), F.lit("")) for n, p in patterns.items()}
    return rows.groupBy("file").agg(*(F.max_by(c, F.when(c.isNotNull(), F.col("ord"))).alias(n) for n, c in found.items()))


def _starts(lines: dict[str, str], whole: bool) -> dict[str, str]:
    return {n: rf"^\Q{label}\E[ \t\n\x0B\f\r]+([0-9]+)" + "$" * whole for n, label in lines.items()}


def alignment_reports(spark: SparkSession, path: str | list[str], paired: bool = False) -> DataFrame:
    """(file, total_reads, unaligned, ambiguous, no_sequence, aligned, total_c, meth_..., unmeth_...) of alignment reports."""
    lines = PAIRED_LINES if paired else SINGLE_LINES
    return _counts(numbered(spark, path), _starts(lines | {"total_c": TOTAL_CS}, True) | _starts(METHYLATED | UNMETHYLATED, False))


def dedup_reports(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, aligned, duplicates, unique) of deduplication reports."""
    return _counts(numbered(spark, path), {"aligned": rf"^\Q{DEDUP_TOTAL}\E.+:[ \t]+([0-9]+)$"} | _starts(DUPLICATES, False))


def splitting_reports(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, total_c, meth_..., unmeth_...) of methylation extraction reports."""
    return _counts(numbered(spark, path), _starts({"total_c": TOTAL_CS}, True) | _starts(METHYLATED | CONVERTED, False))


def sample_summary(alignment: DataFrame, dedup: DataFrame, splitting: DataFrame) -> DataFrame:
    """The columns of SUMMARY for each sample of alignment; all have a column sample. What a deduplication report or a
    splitting report says goes before what the alignment report says; what none says is empty."""
    out = alignment.alias("a").join(dedup.alias("d"), "sample", "left").join(splitting.alias("s"), "sample", "left")
    sources = {"a": alignment, "d": dedup, "s": splitting}

    def column(name):
        found = [F.col(f"{k}.{name}") for k in ("s", "d", "a") if name in sources[k].columns]
        return F.coalesce(*found, F.lit("")).alias(name)

    return out.select("sample", *(column(n) for n in SUMMARY if n != "sample"))


def summary_text(summary: DataFrame) -> str:
    """The summary as text, a line for each sample, by name."""
    rows = summary.select(*SUMMARY).collect()
    return "".join("\t".join(r) + "\n" for r in [tuple(SUMMARY.values()), *sorted(map(tuple, rows))])


def plotted(summary: DataFrame) -> DataFrame:
    """(sample, context, pct) of the samples that plots show: those with calls in all contexts."""
    share = {c: percent(F.col(f"meth_{c}").try_cast("long"), F.col(f"unmeth_{c}").try_cast("long")) for c in ("cpg", "chg", "chh")}
    out = summary.select("sample", *(v.alias(c) for c, v in share.items())).dropna(subset=list(share))
    return out.select("sample", F.inline(F.array(*(F.struct(F.lit(c).alias("context"), F.col(c).alias("pct")) for c in share))))


def merge_counts(reports: DataFrame, *key: str) -> DataFrame:
    """Count columns of reports of parts of a sample, summed by key."""
    return reports.groupBy(*key).agg(*(F.sum(F.col(c).cast("long")).alias(c) for c in reports.columns if c not in (*key, "file")))


# -- texts from small tables ----------------------------------------------------------------------------------


def mbias_text(table: DataFrame, paired: bool = False) -> str:
    """An M-bias table (read, ctx, position, m, u, pct), dense in position, as text."""
    rows = table.select("read", "ctx", "position", "m", "u", fixed_text(F.col("pct"), 2).alias("p")).orderBy("read", "position").collect()
    out = []
    for read in (1, 2) if paired else (1,):
        for ctx in ("CpG", "CHG", "CHH"):
            head = f"{ctx} context (R{read})\n================" if paired else f"{ctx} context\n==========="
            out += [head, "position\tcount methylated\tcount unmethylated\t% methylation\tcoverage"]
            out += [f"{r.position}\t{r.m}\t{r.u}\t{r.p or ''}\t{r.m + r.u}" for r in rows if (r.read, r.ctx) == (read, ctx)] + [""]
    return "".join(line + "\n" for line in out)


def composition_text(report: DataFrame, head: str) -> str:
    """genome.composition_report() rows, 20 of them, as text behind a head line; a word or a total that the genome or the
    sample lacks is an error."""
    rows = {r.word: r for r in report.select("word", "count_sample", "count_genomic", *(fixed_text(F.col(c), 2).alias(c) for c in ("pct_sample", "pct_genomic")), F.col("coverage")).collect()}
    out = [head]
    for word in WORDS:
        r = rows[word]
        if r.pct_sample is None or r.pct_genomic is None or not r.count_genomic:
            raise ZeroDivisionError(f"no count of {word}")
        out.append(f"{word}\t{r.count_sample or ''}\t{r.pct_sample}\t{r.count_genomic}\t{r.pct_genomic}\t{r.coverage:.3f}")
    return "".join(line + "\n" for line in out)


def cached_composition(genome: DataFrame, path: str) -> DataFrame:
    """(word, n) of a genome, from the folder at path if it is there, else counted and written there, words in the order of
    their bytes."""
    spark = genome.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        rows = composition(genome).coalesce(1).sortWithinPartitions(F.col("word").cast("binary"))  # 20 rows
        rows.select(F.concat_ws("\t", "word", "n").alias("value")).write.text(path)
    return spark.read.csv(path, sep="\t", schema="word string, n long")


def dedup_text(label: str, total: int, removed: int, positions: int, umi: bool = False) -> str:
    """The deduplication report of alignments.duplicate_counts()."""
    share = lambda n: f"{n / total * 100:.2f}" if total else "0.00"
    return (
        f"\nTotal number of alignments analysed in {label}{' (UMI mode)' if umi else ''}:\t{total}\nTotal number duplicated alignments removed:\t{removed} ({share(removed)}%)\n"
        f"Duplicated alignments were found at:\t{positions} different position(s)\n\nTotal count of deduplicated leftover sequences: {total - removed} ({share(total - removed)}% of total)\n\n"
    )


def consistency_text(buckets: dict[str, int], paired: bool = False, lower: int = 10, upper: int = 90, least: int = 5, chh: bool = False, rule: str = "-" * 49) -> str:
    """The report of numbers of reads by bucket of alignments.consistency(); skipped reads don't count."""
    n = {b: buckets.get(b, 0) for b in ("all_meth", "all_unmeth", "mixed_meth", "discarded")}
    total = sum(n.values())
    share = lambda b: f"{n[b]} ({f'{n[b] / total * 100:.2f}' if total else 'N/A'}%)"
    return (
        f"Total {'paired' if paired else 'single'}-end records     -\t{total}\n{rule}\nAll methylated    [ >= {upper}% ] -\t{share('all_meth')}\nAll unmethylated  [ <= {lower}% ] -\t{share('all_unmeth')}\n"
        f"Mixed methylation [ {lower}-{upper}% ] -\t{share('mixed_meth')}\nToo few {'CHH' if chh else 'CpG'}s   [min-count {least}] -\t{share('discarded')}\n"
    )


def splitting_share(context: str, m: int, u: int) -> str:
    """A splitting report's line on one context."""
    if m + u == 0:
        return f"Can't determine percentage of methylated Cs in {context} context if value was 0"
    return f"C methylated in {context} context:\t{m * 100 / (m + u):.1f}%"
