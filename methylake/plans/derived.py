"""Domain tables derived from the driver's tables, in Spark and, word for word the same, in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASES = "ACGTACGTCGCGATTAACGTACCGTA"
_CALLS = "ZzXxHhUu..ZzXxHhz..hxH.zhZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letters():
    return F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chr, seq): the letters of each document as bases."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chr"), F.translate(letters(), _ABC, _BASES).alias("seq")).repartition("chr")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, meth, chr, pos, call, status): a call for each line item; some signs don't fit their letter."""
    up = F.col("l_discount") >= 0.05
    letter = F.element_at(F.array(F.lit("z"), F.lit("x"), F.lit("h")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    sign = F.when(up != (F.col("l_quantity") == 7), "+").otherwise("-")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("read_id"), sign.alias("meth"), F.col("l_suppkey").cast("string").alias("chr"), ((F.col("l_partkey") * 31 + F.col("l_linenumber")) % 4000 + 1).cast("long").alias("pos"),
        F.when(up, F.upper(letter)).otherwise(letter).alias("call"), F.col("l_linestatus").alias("status"),
    )


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, chr, start, xm, xr, xg, cigar): the letters of each document as a call string, with three CIGAR shapes."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.translate(letters(), _ABC, _CALLS).alias("xm")).where("length(xm) > 0").repartition("doc_id")
    n, i = F.length("xm"), F.col("doc_id")
    cigar = F.when((n < 40) | (i % 3 == 0), F.concat(n.cast("string"), F.lit("M")))
    cigar = cigar.when(i % 3 == 1, F.concat((n - 20).cast("string"), F.lit("M2D20M"))).otherwise(F.concat(F.lit("10S"), (n - 25).cast("string"), F.lit("M5I10M")))
    return d.select(i.alias("id"), (i % 7).cast("string").alias("chr"), (i * 10 + 1).alias("start"), "xm", F.when(i % 4 < 2, "CT").otherwise("GA").alias("xr"), F.when(i % 2 == 0, "CT").otherwise("GA").alias("xg"), cigar.alias("cigar"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_ord, ord, id, qname, chr, start, cigar, xr, xg, umi, flag, inst, as_i, xs_i, ...): a record for each event."""
    e = F.col("event_id")
    pick = lambda n, *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (n + 1).cast("int"))
    umi = pick(e % 4, "ACGT", "TTGA", "ACG+TTA", "TTA+ACG")
    # whole numbers throughout: products pass 2**53 above event 3.4 million, where a division as doubles may round up
    score = (F.expr("event_id * 2654435761 div 65536") % 4 * -6).cast("int")
    xs = F.when(e % 5 == 0, score).when(e % 5 == 1, score - 6)
    return table(spark, sf_dir, "events").select(
        F.lit(0).alias("file_ord"), e.alias("ord"), e.alias("id"), F.concat(F.lit("r "), e.cast("string"), F.lit(":"), umi).alias("qname"), (e % 3).cast("string").alias("chr"), (F.col("user_id") % 500 + 1).alias("start"),
        pick(e % 3, "50M", "20M2D30M", "5S45M").alias("cigar"), F.when(F.floor(e / 4) % 4 < 2, "CT").otherwise("GA").alias("xr"), F.when(F.floor(e / 4) % 2 == 0, "CT").otherwise("GA").alias("xg"), umi.alias("umi"),
        pick(e % 5, 0, 16, 4, 256, 2048).cast("int").alias("flag"), F.floor(e / 4).cast("long").alias("read_id"), (e % 4).cast("int").alias("inst"), (F.col("user_id") % 5).cast("long").alias("pos"), score.alias("as_i"), xs.cast("int").alias("xs_i"),
    )


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, chr, pos, cigar, inst, seq, qual, n, xr, xg): a read of 50 bases on the derived genome for each event, three
    CIGAR shapes; n is the chromosome's length."""
    e = F.col("event_id")
    text = F.concat(*(F.md5(F.concat(F.lit(k), e.cast("string")).cast("binary")) for k in "ab"))
    cigar = F.element_at(F.array(*(F.lit(x) for x in ("50M", "20M2D30M", "5S45M"))), (e % 3 + 1).cast("int"))
    inst = (F.floor(e / 3) % 4).cast("int")
    rows = table(spark, sf_dir, "events").select(
        e.alias("read_id"), (e * 7 % 200).cast("string").alias("chr"), (e * 31 % 300 + 1).alias("pos"), cigar.alias("cigar"), inst.alias("inst"), F.left(F.translate(text, "0123456789abcdef", "ACGT" * 4), F.lit(50)).alias("seq"),
        F.repeat(F.lit("I"), F.lit(50)).alias("qual"), F.lit("CT").alias("xr"), F.when(inst < 2, "CT").otherwise("GA").alias("xg"),
    )
    return rows.join(genome(spark, sf_dir).select("chr", F.length("seq").alias("n")), "chr").where(F.col("pos") <= F.col("n"))


SQL = {
    "placed": """pl AS (SELECT event_id AS read_id, CAST(event_id * 7 % 200 AS VARCHAR) AS chr, event_id * 31 % 300 + 1 AS pos, event_id % 3 AS shape, CAST((event_id // 3) % 4 AS INT) AS inst,
      left(translate(md5('a' || event_id) || md5('b' || event_id), '0123456789abcdef', 'ACGTACGTACGTACGT'), 50) AS seq FROM events),
      w0 AS (SELECT pl.*, g.seq AS gs, length(g.seq) AS n, CASE shape WHEN 0 THEN 50 WHEN 1 THEN 52 ELSE 45 END AS span, inst IN (1, 3) AS before, inst IN (1, 2) AS minus FROM pl JOIN genome g USING (chr) WHERE pos <= length(g.seq)),
      w1 AS (SELECT *, CASE shape WHEN 0 THEN substr(gs, pos, 50) WHEN 1 THEN substr(gs, pos, 20) || substr(gs, pos + 22, 30) ELSE 'XXXXX' || substr(gs, pos, 45) END AS core, CASE WHEN before THEN pos > 2 ELSE n >= pos + span + 1 END AS room FROM w0),
      w2 AS (SELECT *, CASE WHEN before THEN substr(gs, pos - 2, 2) || core ELSE core || substr(gs, pos + span, 2) END AS whole FROM w1),
      win AS (SELECT *, CASE WHEN NOT room THEN CASE WHEN before THEN '' ELSE core END WHEN minus THEN translate(reverse(whole), 'ACGT', 'TGCA') ELSE whole END AS win FROM w2)""",
    "genome": f"genome AS (SELECT CAST(doc_id AS VARCHAR) AS chr, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{_ABC}', '{_BASES}') AS seq FROM documents)",
    "calls": """calls AS (SELECT l_orderkey AS read_id, CASE WHEN (l_discount >= 0.05) <> (l_quantity = 7) THEN '+' ELSE '-' END AS meth, CAST(l_suppkey AS VARCHAR) AS chr,
      (l_partkey * 31 + l_linenumber) % 4000 + 1 AS pos, CASE WHEN l_discount >= 0.05 THEN upper(substr('zxh', CAST(l_linenumber % 3 + 1 AS INT), 1)) ELSE substr('zxh', CAST(l_linenumber % 3 + 1 AS INT), 1) END AS call, l_linestatus AS status FROM lineitem)""",
    "aln": f"""aln0 AS (SELECT doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{_ABC}', '{_CALLS}') AS xm FROM documents),
      aln AS (SELECT doc_id AS id, CAST(doc_id % 7 AS VARCHAR) AS chr, doc_id * 10 + 1 AS start, xm, length(xm) AS n, CASE WHEN doc_id % 4 < 2 THEN 'CT' ELSE 'GA' END AS xr, CASE WHEN doc_id % 2 = 0 THEN 'CT' ELSE 'GA' END AS xg,
      CASE WHEN length(xm) < 40 THEN 0 ELSE doc_id % 3 END AS shape, CASE doc_id % 4 WHEN 0 THEN 'OT' WHEN 1 THEN 'OB' WHEN 2 THEN 'CTOT' ELSE 'CTOB' END AS strand FROM aln0 WHERE length(xm) > 0)""",
    "reads": """reads0 AS (SELECT *, list_extract(['ACGT', 'TTGA', 'ACG+TTA', 'TTA+ACG'], CAST(event_id % 4 + 1 AS INT)) AS umi, CAST((event_id * 2654435761 // 65536) % 4 * -6 AS INT) AS as_i FROM events),
      reads AS (SELECT event_id AS ord, event_id AS id, 'r ' || event_id || ':' || umi AS qname, CAST(event_id % 3 AS VARCHAR) AS chr, user_id % 500 + 1 AS start, umi,
      list_extract([50, 52, 45], CAST(event_id % 3 + 1 AS INT)) AS span, CASE WHEN (event_id // 4) % 4 < 2 THEN 'CT' ELSE 'GA' END AS xr, CASE WHEN (event_id // 4) % 2 = 0 THEN 'CT' ELSE 'GA' END AS xg,
      CASE (event_id // 4) % 4 WHEN 0 THEN 'OT' WHEN 1 THEN 'OB' WHEN 2 THEN 'CTOT' ELSE 'CTOB' END AS strand, list_extract([0, 16, 4, 256, 2048], CAST(event_id % 5 + 1 AS INT)) AS flag,
      event_id // 4 AS read_id, CAST(event_id % 4 AS INT) AS inst, user_id % 5 AS pos, as_i, CASE WHEN event_id % 5 = 0 THEN as_i WHEN event_id % 5 = 1 THEN as_i - 6 END AS xs_i FROM reads0)""",
}
