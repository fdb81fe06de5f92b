"""Operator 2, URL filters: a trie over reversed host labels, then path segments, with the longest entry winning.

The trie of up to MAX_RULES entries and MAX_BYTES bytes is broadcast, and nothing is shuffled. A longer list stays a table
of the same keys (host, path up to its last /, rest): each distinct url meets it under its host and the hosts above,
and under its path's folders, in two equi-joins; the second is by rests of the lengths that a folder's entries have.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methylake.llm.common import map_batches, split_join, written

#: Entries, and bytes of their hosts and paths, of a trie that goes to every executor; longer lists are joined.
MAX_RULES, MAX_BYTES = 200_000, 16 << 20

_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


@dataclass
class _Node:
    """A node of the host part or of the path part. labels: children. paths: the path trie of this host.
    verdicts: (rule length, blocks, rule) of the entry for what is left of the path in this segment; lengths: those
    of the verdicts' keys, longest first."""

    labels: dict[str, _Node] = field(default_factory=dict)
    paths: _Node | None = None
    verdicts: dict[str, tuple[int, bool, str]] = field(default_factory=dict)
    lengths: tuple[int, ...] = ()


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first :// up to / ? # or the end, A-Z lower-cased; path from there up to
    ? # or the end. Both are empty for a null url or one without ://."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    return (rest, "") if slash < 0 else (rest[:slash], rest[slash:])


def build_trie(rules: list[tuple[str, str, str]]) -> _Node:
    """rules: (host, path, verdict), verdict allow or block. The rule's name is host + path."""
    root, ends = _Node(), {}
    for host, path, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        node, host = root, host.translate(_LOWER)
        for label in reversed(host.split(".")):
            node = node.labels.setdefault(label, _Node())
        node.paths = node.paths or _Node()
        node = node.paths
        *whole, rest = path.split("/")
        for segment in whole:
            node = node.labels.setdefault(segment, _Node())
        entry = (len(host) + len(path), verdict == "block", host + path)
        node.verdicts[rest] = max(entry, node.verdicts.get(rest, entry))
        ends[id(node)] = node
    for node in ends.values():
        node.lengths = tuple(sorted({len(rest) for rest in node.verdicts}, reverse=True))
    return root


def longest(root: _Node, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest entry that fits; of equally long ones a block, then the first by name."""
    best: tuple[int, bool, str] | None = None
    node, segments = root, None
    for label in reversed(host.split(".")) if host else ():
        node = node.labels.get(label)
        if node is None:
            break
        if node.paths is not None:
            segments = path.split("/") if segments is None else segments
            at = node.paths
            for i, segment in enumerate(segments):
                # the longest rest of a node is its longest entry
                now = next((v for n in at.lengths if n <= len(segment) and (v := at.verdicts.get(segment[:n]))), None)
                if now and (best is None or now[:2] > best[:2] or (now[:2] == best[:2] and now[2] < best[2])):
                    best = now
                at = at.labels.get(segment) if i < len(segments) - 1 else None
                if at is None:
                    break
    return best and (best[2], "block" if best[1] else "allow")


def _joined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, blocks) of the distinct (host, path) that an entry of rules (host, path, verdict) fits."""
    known = F.when(F.col("verdict").isin("allow", "block"), F.col("verdict") == "block").otherwise(F.raise_error(F.concat(F.lit("verdict "), "verdict")).cast("boolean"))
    host = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rest = F.regexp_extract("path", "[^/]*$", 0)
    entries = rules.select(host.alias("at"), F.regexp_replace("path", "[^/]*$", "").alias("folder"), rest.alias("rest"), (F.length("host") + F.length("path")).alias("size"), known.alias("blocks"), F.concat(host, "path").alias("rule"))
    entries = written(entries.groupBy("at", "folder", "rest").agg(F.max("size").alias("size"), F.max("blocks").alias("blocks"), F.min("rule").alias("rule")), "url-entries")
    lengths = entries.groupBy("at", "folder").agg(F.collect_set(F.length("rest")).alias("lengths"))
    # no url is looked at deeper than the deepest entry
    most = lambda c, by: F.coalesce(F.max(F.size(F.split(c, by, -1))), F.lit(1))
    hosts, deepest = entries.agg(most("at", "\\."), most("folder", "/") - 1).first()

    labels, segments = F.split("host", "\\.", -1), F.split("path", "/", -1)
    above = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - hosts + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    depth = F.least(F.size(segments) - 1, F.lit(deepest))
    folders = F.transform(F.sequence(F.lit(0), depth), lambda i: F.struct(F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(segments, F.lit(1), i), "/"), F.lit("/"))).alias("folder"), F.get(segments, i).alias("segment")))
    keys = urls.where("host <> ''").select("host", "path", F.explode(above).alias("at"), folders.alias("f")).select("host", "path", "at", F.inline("f"))
    near = split_join(keys, lengths, ["at", "folder"]).withColumn("n", F.explode("lengths")).where(F.length("segment") >= F.col("n"))
    near = near.select("host", "path", "at", "folder", F.expr("left(segment, n)").alias("rest"))
    fits = split_join(near, entries, ["at", "folder", "rest"])
    # the largest struct: longest, a block before an allow, then the first by name, which max_by can't order downwards
    top = fits.groupBy("host", "path").agg(F.max(F.struct("size", "blocks")).alias("top"))
    return fits.join(top, ["host", "path"]).where((F.col("size") == F.col("top.size")) & (F.col("blocks") == F.col("top.blocks"))).groupBy("host", "path").agg(F.min("rule").alias("rule"), F.first("blocks").alias("blocks"))


def url_filter(df: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of df.

    rules: (host, path, verdict) rows, a list or a table with columns of these names. A rule fits its host and all
    subdomains when the url's path starts with the rule's path. The longest rule that fits decides; of equally long
    ones a block does. rule is its host and path, null where none fits; the verdict is then default. A null url, an
    empty one or one without :// has an empty host and path and gets the default. Repeated rows give repeated results, a
    null id stays null, an empty table gives an empty one; very long urls are judged whole and other columns are not
    read. Nothing is shuffled with up to MAX_RULES rules of MAX_BYTES; more, which only a table should hold, are joined.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    if isinstance(rules, DataFrame):
        rules = rules.select("host", "path", "verdict")
        n, size = rules.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0))).first()
        large = n > MAX_RULES or size > MAX_BYTES
        if not large:
            rules = [tuple(r) for r in rules.collect()]
    else:
        large = len(rules) > MAX_RULES or sum(len(h.encode()) + len(p.encode()) for h, p, _ in rules) > MAX_BYTES
        if large:
            rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    trie = spark.sparkContext.broadcast(None if large else build_trie(rules))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        root, out = trie.value, ([], [], [], [])
        for url in batch.column(1).to_pylist():
            host, path = split_url(url)
            host = host.translate(_LOWER)
            rule, verdict = (root and longest(root, host, path)) or (None, default)
            for column, value in zip(out, (host, path, rule, verdict), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in out)], [id_col, "host", "path", "rule", "verdict"])

    judged = map_batches(rows, judge, f"`{id_col}` long, host string, path string, rule string, verdict string")
    if not large:
        return judged
    urls = written(judged.select(F.col(f"`{id_col}`").alias("id"), "host", "path"), "urls")
    distinct = urls.select("host", "path").distinct()
    decided = written(_joined(distinct, rules).withColumn("verdict", F.when(F.col("blocks"), "block").otherwise("allow")), "url-verdicts")
    decided = distinct.join(decided, ["host", "path"], "left").select("host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    return split_join(urls, decided, ["host", "path"]).select(F.col("id").alias(id_col), "host", "path", "rule", "verdict")
