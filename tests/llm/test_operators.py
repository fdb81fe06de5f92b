"""The training-data operators on small hard tables, against brute force, the public libraries or exact round trips."""

import base64
import collections
import hashlib
import io
import random
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from methylake.llm import common, decontaminate, gif, graph, minhash, pieces_fst, quality, queries, rans, sharding, token_counts, token_files, url_filters, warc

SCHEMA = "doc_id long, text string, shard int, size string, id string"  # with clashing extra columns


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def hard_rows():
    base = words(120, 1)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "Two words"), (7, "two  WORDS"), (8, base), (9, base.replace("w1 ", "changed ")), (10, base + " tail"), (10, base + " tail")]
    rows += [(11, words(30_000, 2)), (12, "x" * 50_000), (None, "no id é 日本 <|endoftext|>"), (13, "<|startoftext|> it's 'S ²."), (14, "a\x00b\x1c\x85c"), (15, words(90, 3)), (16, "tiny")]
    return [(i, t, 7, "s", "z") for i, t in rows]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(r[0], r[1] or "") for r in hard_rows()]


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def any_script(n):
    """Texts of many scripts, of characters that change in lower case or NFC, and of special tokens."""
    r, out = random.Random(3), []
    alphabets = ["ab c", "’“—…é ß", "привет мир Ёж", " 日本語テキスト。", "مرحبا بالعالم ", "🙂👍🏽👨\u200d👩\u200d👧 ", "e\u0301\u2009\u200b\u3000\n\t", "It's we'll ٣٤५ Ⅷ½", "İıſẞΣς ﬁ Ǆǅ K"]
    for i in range(n):
        letters = "".join(r.sample(alphabets, r.randrange(1, 4)))
        x = "".join(r.choice(letters) for _ in range(r.randrange(30)))
        if i % 3 == 0:
            x += r.choice(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " <|endoftext|> it’s"]) + "".join(r.choice(letters) for _ in range(5))
        out.append(x)
    return out


@pytest.mark.parametrize(("head", "held"), [(1 << 17, 1 << 18), (40, 50), (0, 1)])
def test_token_counts(spark, hard, empty, head, held, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "HEAD", head)
    monkeypatch.setattr(token_counts, "HELD", held)
    path = queries.tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    scripts = [(500 + i, x) for i, x in enumerate(any_script(300))]
    want = [(i, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 1024) for i, x in texts() + scripts]
    df = hard.withColumn("n", F.lit(1)).withColumn("piece", F.lit("clash"))
    more = spark.createDataFrame([(i, x, 7, "s", "z") for i, x in scripts], SCHEMA).withColumn("n", F.lit(1)).withColumn("piece", F.lit("clash"))
    same(token_counts.token_counts(df.union(more), path).collect(), want)
    assert token_counts.token_counts(empty, path).count() == 0


def test_pre_tokens_are_counted_once(spark, hard):
    path = queries.tokenizer("byte_bpe_50k.json")
    rows = token_counts.pre_token_table(hard.select(F.col("doc_id").alias("id"), "text"), path).collect()
    want = sum((token_counts.frequencies(x, path) for _, x in texts()), collections.Counter())
    assert {r.piece: r.freq for r in rows} == dict(want) and len(rows) == len(want)


def test_url_filter(spark, monkeypatch):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("a.b", "/x", "allow"), ("b", "/x/y", "block"), ("b", "/xz", "block")]
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.ORG/en/12?q#f", "http://example.org/es", "http://example.org/es/", "http://org", "http://org/", "http://xorg/", "http://a.b/x/y", "http://a.b/xz", "http://org?x/y", "http://u@b:80/x", "http://org/" + "p/" * 20000]
    df = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(urls)] + [(0, None, "clash", 1)], "page_id long, url string, host string, rule int")

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        rest = re.match(r"[^?#]*", rest)[0]
        host, slash, path = rest.partition("/")
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path
        fit = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, key=lambda f: (f[0], f[1], [-ord(c) for c in f[2]]), default=None)
        return host, path, best and best[2], best[3] if best else "allow"

    same(url_filters.url_filter(df, rules).collect(), [(i, *brute(u)) for i, u in [*enumerate(urls), (0, None)]])
    r = random.Random(2)
    part = lambda: "".join(r.choice("ab/") for _ in range(r.randrange(5)))
    rules[:] += [(r.choice(("org", "a.org", "B", "a.b", "x.a.b")), r.choice(("/", "")) + part(), r.choice(("allow", "block"))) for _ in range(120)]
    rules[:] = {(h.lower(), p): (h, p, v) for h, p, v in sorted(rules)}.values()
    brutal = [(h.lower(), p, v) for h, p, v in rules]
    many = [f"http://{r.choice(('org', 'a.org', 'y.x.a.b', 'B', 'ab', 'www.B'))}{r.choice(('/', ''))}{part()}{part()}" for _ in range(300)]
    rules, listed = brutal, list(rules)
    more = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(many)] + [(9999, many[0], "clash", 1)] * 700, "page_id long, url string, host string, rule int")
    want = [(i, *brute(u)) for i, u in enumerate(many)] + [(9999, *brute(many[0]))] * 700
    same(url_filters.url_filter(more, listed).collect(), want)
    monkeypatch.setattr(url_filters, "MAX_RULES", 10)
    table = spark.createDataFrame(listed, "host string, path string, verdict string")
    same(url_filters.url_filter(more, table).collect(), want)
    same(url_filters.url_filter(df, listed).collect(), [(i, *brute(u)) for i, u in [*enumerate(urls), (0, None)]])
    monkeypatch.undo()
    same(url_filters.url_filter(more, table).collect(), want)
    assert url_filters.url_filter(df.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        url_filters.build_trie([("h", "/", "maybe")])


def minimax(sizes, n):
    """Smallest largest sum of n contiguous runs, by dynamic programming."""
    ends = [0, *np.cumsum(sizes).tolist()]
    best = [0, *[float("inf")] * len(sizes)]
    for _ in range(n):
        best = [min([best[i]] + [max(best[j], ends[i] - ends[j]) for j in range(i)]) for i in range(len(ends))]
    return best[-1]


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_sharding(spark, hard, empty, shards):
    many = spark.createDataFrame([(100 + i, words(i % 37, i % 53), 7, "s", "z") for i in range(150)], SCHEMA)
    rows = sharding.shard_documents(hard.union(many), shards).collect()
    source = texts() + [(100 + i, words(i % 37, i % 53)) for i in range(150)]
    same([(r.doc_id, r.size, r.text_crc32) for r in rows], [(i, len(x.encode()) + 1, zlib.crc32(x.encode())) for i, x in source])
    of, load, slots = collections.defaultdict(set), collections.Counter(), collections.defaultdict(list)
    by_id = {i: x for i, x in source}
    for r in rows:
        of[by_id[r.doc_id]].add(r.shard)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = collections.Counter()
    for _, x in source:
        groups[hashlib.sha256(x.encode()).hexdigest()] += len(x.encode()) + 1
    assert max(load.values()) == minimax([groups[k] for k in sorted(groups)], shards)
    assert sharding.shard_documents(empty, shards).count() == 0


def shingle_set(x, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", x.encode().lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(rows, k, percent):
    sets = [(i, shingle_set(x, k)) for i, x in rows]
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t) and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [(i, len(s), None if i is None else find(i), None if i is None else find(i) == i) for i, s in sets]


def one_document_per_id(rows):
    """brute_components' rows where those that repeat an id join the components of all its texts."""
    root, merged = {}, True
    for i, _, c, _ in rows:
        root.setdefault(c, c)
    while merged:
        merged = False
        for i, _, c, _ in rows:
            for j, _, e, _ in rows:
                if i is not None and i == j and root[c] != root[e]:
                    low, high = sorted((root[c], root[e]))
                    root = {x: low if y == high else y for x, y in root.items()}
                    merged = True
    return [(i, n, c and root[c], c and root[c] == i) for i, n, c, _ in rows]


@pytest.mark.parametrize(("k", "percent", "block", "most"), [(3, 85, 256, 1_000_000), (5, 80, 4, 1_000_000), (3, 85, 3, 0)])
def test_near_duplicates(spark, hard, empty, k, percent, block, most, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", block)
    monkeypatch.setattr(minhash, "BROADCAST_MEMBERS", most)
    near = []
    for g in range(6):
        w = words(150, 50 + g).split()
        for c in range(8):
            v = w.copy()
            for e in range(c):
                v[(17 * e + 3 * c) % len(v)] = f"e{g}{c}{e}"
            near.append((1000 + 100 * g + c, " ".join(v)))
    extra = spark.createDataFrame([(i, x, 7, "s", "z") for i, x in near], SCHEMA)
    copies = [(5000 + i, near[0][1]) for i in range(40)] + [(None, near[3][1])] * 30 + [(1001, near[9][1])]
    extra = extra.union(spark.createDataFrame([(i, x, 7, "s", "z") for i, x in copies], SCHEMA))
    df = hard.union(extra).withColumnsRenamed({"shard": "n", "size": "component_id"})
    got = minhash.near_duplicates(df, k, percent).collect()
    same(got, one_document_per_id(brute_components(texts() + near + copies, k, percent)))
    assert minhash.near_duplicates(empty, k, percent).count() == 0


def test_keep_one(hard):
    kept = minhash.keep_one(hard, 3, 85)
    assert kept.columns == hard.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i))
    want = {i for i, _, _, keep in brute_components(texts(), 3, 85) if keep}
    assert ids == [*sorted(want), None]
    odd = hard.withColumnsRenamed({"shard": "_first", "size": "kept", "id": "row"})
    again = odd.union(odd.where("doc_id = 11")).union(odd.where("doc_id is null"))
    rows = minhash.keep_one(again, 3, 85)
    assert rows.columns == odd.columns and rows.schema == odd.schema
    assert sorted((r.doc_id for r in rows.collect()), key=lambda i: (i is None, i)) == [*sorted(want), None, None]
    assert minhash.keep_one(odd.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 100), (7, 7), (None, 3)] + [(200, 201 + i) for i in range(30)]
    got = dict(graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 100: 50, **{200 + i: 200 for i in range(31)}}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_contracted_in_tasks(spark):
    r = random.Random(5)
    edges = [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(320)]
    want = {}
    for a, b in edges:
        if a != b:
            both = want.get(a, {a}) | want.get(b, {b})
            want.update(dict.fromkeys(both, both))
    want = {i: min(both) for i, both in want.items()}
    table = spark.createDataFrame(edges, "a long, b long").repartition(3)
    spark.sparkContext.setJobGroup("components", "")
    assert dict(graph.connected_components(table).collect()) == want
    # what one task can contract takes no rounds: each has some ten jobs, planned and held by the driver
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 14
    spark.sparkContext.setJobGroup("", "")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:  # and what is spread over tasks takes them
        assert dict(graph.connected_components(table).collect()) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tied = dict(zip(*(x.tolist() for x in graph.forest(*np.array([e for e in edges if e[0] != e[1]]).T)), strict=True))
    assert tied == {i: c for i, c in want.items() if i != c}
    assert [len(x) for x in graph.forest(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


def test_decontamination(spark, hard, empty):
    items = [(1, "The quick brown fox jumps over the lazy dog near the river bank today."), (2, None), (3, ""), (4, "only four words here"), (5, words(40, 9))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(50, words(80, 20) + " the QUICK brown fox, jumps over the lazy dog near the river bank today! " + words(50, 21)), (51, "the quick brown fox slept"), (52, "so Only four; words HERE too"), (53, words(40, 9)), (54, "w " + words(40, 9).replace(" ", "\n")), (55, words(400, 10))]
    df = hard.union(spark.createDataFrame([(i, x, 7, "s", "z") for i, x in docs], SCHEMA))
    found = decontaminate.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(50, 1), (52, 4), (53, 5), (54, 5)}
    assert all(r.similarity == 1 for r in found)
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert kept.count() == df.count() - 4
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(hard, bench.limit(0)).count() == 0


def brute_contaminated(docs, items, k=5, least=0.8):
    """(doc_id, item_id, similarity, first_word, n_words), by comparing every window with every item."""
    split = lambda t: re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode().lower())
    out = []
    for i, text in docs:
        doc = split(text)
        for j, passage in items:
            item = split(passage)
            n, width = min(len(item), len(doc)), min(k, len(item))
            bags = lambda ws: collections.Counter(tuple(ws[a : a + width]) for a in range(len(ws) - width + 1))  # noqa: B023, E731
            size = lambda bag: sum(c * sum(map(len, s)) for s, c in bag.items())
            want = bags(item)
            if not bags(doc) & want:
                continue  # similarity 0 everywhere
            found = [(size(bag & want) / size(bag | want), -a) for a in range(len(doc) - n + 1) if n and (bag := bags(doc[a : a + n]))]
            if found and max(found)[0] >= least:
                out.append((i, j, max(found)[0], -max(found)[1], n))
    return out


def test_decontamination_of_short_documents(spark):
    item, other = words(59, 30).split(), words(59, 31).split()
    bench = [(1, " ".join(item)), (2, "four words and no more"), (3, "just three words"), (4, words(20, 32))]
    docs = [(n, " ".join(item[:n])) for n in range(1, 60)] + [(100 + n, " ".join(item[n:])) for n in range(1, 59)]
    docs += [(200 + n, " ".join(item[:n] + other[n : n + 1] + item[n + 1 : 58])) for n in range(58)]
    docs += [(300, " ".join(other[:58])), (301, "just three"), (302, "four words and no"), (303, "words"), (304, ""), (305, words(19, 32)), (306, words(12, 32))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(bench, "item_id long, text string")
    want = brute_contaminated(docs, bench)
    assert (58, 1) in {w[:2] for w in want} and (30, 1) not in {w[:2] for w in want} and (305, 4) in {w[:2] for w in want}
    same(decontaminate.contaminated(df, items).collect(), want)
    same(decontaminate.decontaminate(df, items).select("doc_id").collect(), [(i,) for i, _ in docs if i not in {w[0] for w in want}])


def altered(passage, changes, seed):
    """passage with so many of its words replaced, dropped or doubled."""
    r, out = random.Random(seed), passage.split()
    for _ in range(changes):
        at, kind = r.randrange(len(out)), r.randrange(3)
        out[at : at + 1] = [["changed"], [], [out[at]] * 2][kind]
    return " ".join(out)


@pytest.mark.parametrize("parts", [1, 5])
def test_decontamination_of_altered_passages(spark, parts, monkeypatch):
    if parts > 1:
        monkeypatch.setattr(decontaminate, "MAX_ITEMS", 4)
        monkeypatch.setattr(decontaminate, "RUN", 7)
    bench = [(n, words(n, 40 + n, 4000)) for n in (6, 9, 14, 25, 40, 59, 80, 120, 200)]
    docs = [(i, words(i % 40, 500 + i, 4000) + " " + altered(bench[i % 9][1], i // 9 % 8, i) + " " + words(i % 31, 900 + i, 4000)) for i in range(720)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(bench, "item_id long, text string")
    want = brute_contaminated(docs, bench, least=0.7)
    assert sum(0.7 <= w[2] < 0.8 for w in want) > 20 and sum(0.8 <= w[2] < 1 for w in want) > 100
    got = decontaminate.contaminated(df, items, least=0.7).collect()
    same(got, want)
    least = [w for w in want if w[2] >= 0.8]
    same(decontaminate.contaminated(df, items).collect(), least)
    same(decontaminate.decontaminate(df, items).select("doc_id").collect(), [(i,) for i, _ in docs if i not in {w[0] for w in least}])


def test_hamming_index_is_complete_and_filters():
    rng = np.random.default_rng(3)
    radius = decontaminate.radius_for(0.8)
    prints = rng.integers(0, 256, (200, 32), dtype=np.uint8)
    probes = prints[rng.integers(0, 200, 1000)] ^ np.packbits(rng.random((1000, 256)) < rng.uniform(0, 0.4, (1000, 1)), axis=1)
    index = decontaminate.HammingIndex(prints, radius)
    got = set(zip(*(x.tolist() for x in index(probes)), strict=True))
    apart = np.bitwise_count(probes[:, None] ^ prints[None]).sum(axis=2)
    assert got == {(q, p) for q, p in zip(*(x.tolist() for x in np.nonzero(apart <= radius)), strict=True)}
    assert 200 < len(got) < 1000
    assert len(index.candidates(rng.integers(0, 256, (2000, 32), dtype=np.uint8))[0]) < 0.005 * 2000 * 200


def test_fingerprints_lose_little_at_the_threshold():
    r, lost, near = random.Random(8), 0, 0
    for case in range(1500):
        item = words(r.choice((12, 20, 40, 80, 200)), case, 5000)
        text = altered(item, 1 + len(item.split()) // 45 + case % 3, case)
        w = brute_contaminated([(0, text)], [(1, item)])
        if w and w[0][2] < 0.9:
            near += 1
            b = decontaminate.Benchmark([(1, item)], 5, 0.8)
            lost += [x[1][:2] for x in decontaminate._scan(b, pa.array([text]))] != [w[0][1:3]]
    assert near > 150 and lost <= near // 100


def test_decontamination_of_long_repetitive_texts():
    import tracemalloc

    item = "again and again the same five words " * 400
    for text in (item * 60, "and again " * 60_000 + item):
        b = decontaminate.Benchmark([(1, item), (2, words(30, 3))], 5, 0.8)
        tracemalloc.start()
        found = decontaminate._scan(b, pa.array([text]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert [(i, x[0], x[1]) for i, x in found] == [(0, 1, 1.0)] and peak < 200 << 20


@pytest.mark.parametrize(("least", "few"), [(0, 500_000), (4, 500_000), (0, 0)])
def test_warc(spark, least, few, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_REPEATS", few)
    rows = [(3, "http://a/\r\nX: y", "same"), (1, None, "same"), (2, "u", ""), (4, "u", None), (5, "u", "<p>é" * 30000), (None, "u", "same"), (6, "u", "other"), (6, "u", "other"), (7, "u", "abc"), (8, "u", "abc")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")
    got = warc.warc_round_trip(df, least=least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        ids = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        revisit = len(raw) >= least and i != min(ids)
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", min(ids) if revisit else None))
    same(got, want)
    assert warc.warc_round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_ranges(zip64):
    w = warc.ArchiveWriter()
    for i in range(50):
        raw = b"payload %d" % i * (i + 1)
        w.add(i, warc.build_record(i, "http://x/", raw, warc.digest(raw), None, "2024-01-01T00:00:00Z"))
    data = w.close(zip64)
    at = lambda n, o: data[o : o + n]
    assert [r.payload for r in warc.read_archive(len(data), at)] == [b"payload %d" % i * (i + 1) for i in range(50)]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None
        assert warc.ZipRanges(len(data), at).read(warc.INDEX, 3, 20) == z.read(warc.INDEX)[3:23]
    broken = bytearray(warc.build_record(1, "u", b"abc", warc.digest(b"abc"), None, "d"))
    broken[-6] ^= 1
    with pytest.raises(ValueError):
        warc.parse_record(bytes(broken))


@pytest.mark.parametrize("file_ids", [50, 1 << 21])
def test_token_files(hard, empty, file_ids, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "FILE_IDS", file_ids)
    path = queries.tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = sorted(texts(), key=lambda r: (r[0] is not None, r[0]))
    start, want = 0, []
    for i, x in rows:
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    same(token_files.token_file_round_trip(hard, path).collect(), want)
    assert token_files.token_file_round_trip(empty, path).count() == 0


def test_patterns_match_the_library():
    from tokenizers import Tokenizer

    around = ("{0}", "{0}hmad", "a{0}b", "1{0}2", " {0} ", ".{0}!", "it'{0}", "{0}'s", "{0}'S", "{0}{0}", "\n{0}")
    rows = [x.format(chr(c)) for c in range(0x250) for x in around] + any_script(3000)
    path = queries.tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in rows]
    assert [x for x, a, b in zip(rows, token_files.encode_texts(rows, path), want, strict=True) if a != b] == []
    path = queries.tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    count = lambda x: sum(n * token_counts.count_pieces(p, path) for p, n in token_counts.frequencies(x, path).items())
    assert [x for x in rows if count(x) != len(t.encode(x, add_special_tokens=False).ids)] == []


@pytest.mark.parametrize("n", [0, 1, 63, 65, 70_000, 140_000])
def test_rans(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(0, 49_000).astype(np.uint32)
    data = rans.encode_file(ids, [5, None], np.array([n, 0]))
    got = rans.decode_file(data)
    assert (got[0] == ids).all() and got[1] == [5, None] and got[2].tolist() == [n, 0]
    asked = []

    def at(size, offset):
        asked.append(size)
        return data[offset : offset + size]

    f = rans.File(at)
    assert (f.document(0) == ids).all() and len(f.document(1)) == 0
    if n > rans.BLOCK:
        del asked[:]
        assert (f.block(1) == ids[rans.BLOCK : 2 * rans.BLOCK]).all()
        assert asked == [4 * int(f.table[1, 2])] and asked[0] < len(data) // 2 + 1000
    if n > 1000:
        broken = bytearray(data)
        broken[-9] ^= 4
        with pytest.raises(ValueError):
            rans.decode_file(bytes(broken))


def test_sentencepiece(hard, empty):
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = [(i, sp.encode(x)) for i, x in texts()]
    encoded = pieces_fst.encode_pieces(hard, path)
    same(encoded.collect(), want)
    same(pieces_fst.decode_pieces(encoded, path).collect(), [(i, sp.decode(ids)) for i, ids in want])
    got = pieces_fst.piece_round_trip(hard, path).select("doc_id", "n_pieces", "ids_crc32", "text_crc32").collect()
    same(got, [(i, len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()), zlib.crc32(sp.decode(ids).encode())) for i, ids in want])
    assert pieces_fst.piece_round_trip(empty, path).count() == 0
    with_ids = pieces_fst.with_pieces(hard, path)
    assert with_ids.columns == [*hard.columns, "ids"]
    clash = pieces_fst.with_pieces(hard.withColumn("IDS", F.lit(3)), path)
    assert clash.columns == [*hard.columns, "ids"] and clash.count() == hard.count()
    assert with_ids.where("text is null").count() == 1


def test_sentencepiece_random_strings():
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(5)
    for alphabet in ("ab ", "the and in er", "  .,;:()[]{}=_-01²é日\n\t", "qxzjkвгд"):
        xs = ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(400)]
        got = [np.frombuffer(b, "<i4").tolist() for b in pieces_fst.encode_texts(xs, path)]
        assert got == [sp.encode(x) for x in xs]


def made_model(kind, fallback, rule, squeeze, prefix, seed):
    """A model that nobody trained: pieces of random letters with random scores, with a rule's map of characters."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as model

    m = model.ModelProto()
    if rule:
        m.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    del m.pieces[:]
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = kind, fallback
    m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.escape_whitespaces = squeeze, prefix, True
    r = random.Random(seed)
    rows = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{b:02X}>", 0, 6) for b in range(256)] * fallback
    letters = [*"▁abcdeklé日.1"]
    own = dict.fromkeys(letters + ["".join(r.choice(letters[1:]) for _ in range(r.randrange(2, 6))) for _ in range(150)] + ["▁" + "".join(r.choice(letters[1:]) for _ in range(r.randrange(1, 5))) for _ in range(80)])
    scores = [*range(len(own))]
    r.shuffle(scores)
    rows += [(p, -s, 1) for p, s in zip(own, scores, strict=True)]
    for piece, score, form in rows:
        m.pieces.add(piece=piece, score=score, type=form)
    return m.SerializeToString()


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize(("fallback", "rule", "squeeze", "prefix"), [(True, "", False, True), (False, "nmt_nfkc", True, True), (True, "nfkc_cf", True, False), (False, "nmt_nfkc_cf", False, True)])
def test_machines_of_made_models(kind, fallback, rule, squeeze, prefix):
    import sentencepiece

    proto = made_model(kind, fallback, rule, squeeze, prefix, 7)
    sp, own = sentencepiece.SentencePieceProcessor(model_proto=proto), pieces_fst.Pieces(proto=proto)
    r = random.Random(5)
    xs = ["".join(r.choice("  aabcdekléÉ日.1xﬁ①Ａ\u3000\t") for _ in range(r.randrange(40))) for _ in range(600)] + any_script(300)
    for x in xs:
        ids = np.frombuffer(b"".join(own.encode_segment(s) for s in own.segments(x)), "<i4").tolist()
        assert ids == sp.encode(x), x
        assert own.decode(ids) == sp.decode(ids), x
    if kind == 1:  # the path's weight is the least of all segmentations
        for x in xs[:200]:
            s, low = own.normalise(x)[:9], {0: 0.0}
            for at in range(len(s)):
                arcs = [(p, -w) for p, w in own.scores.items() if s.startswith(p, at)]
                for p, w in arcs + [(s[at], own.lost)] * (s[at] not in own.scores):
                    low[at + len(p)] = min(low.get(at + len(p), 1e9), low[at] + w)
            assert sum(own.lost if p < 0 else own.weight[p] for p, _ in own.shortest(s)) == pytest.approx(low[len(s)])


def test_gif_round_trip(hard, empty):
    got = gif.media_digest(gif.to_media(hard)).collect()
    want = []
    for i, x in texts():
        raw = x.encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        media = gif.store(padded)
        want.append((i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]), len(media), hashlib.sha256(media).hexdigest()))
    same([tuple(r)[:7] for r in got], want)
    assert gif.media_digest(gif.to_media(empty)).count() == 0
    frames = gif.media_frames(gif.to_media(hard)).where("doc_id = 12").orderBy("frame").collect()
    assert [r.height for r in frames] == [64, 23] and [r.start_cs for r in frames] == [0, 10]
    assert sum(sum(r.histogram) for r in frames) == 576 * (64 + 64)


def plain_gif_samples(data):
    """All frames' samples of a GIF with a global palette of 256 colours, read bit by bit and code by code."""
    at, out = 13 + 768, []
    while data[at] != 0x3B:
        if data[at] == 0x21:
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
            continue
        assert data[at] == 0x2C and data[at + 9] == 0
        size, at, stream = data[at + 10], at + 11, b""
        while data[at]:
            stream += data[at + 1 : at + 1 + data[at]]
            at += data[at] + 1
        at += 1
        place, width, table, last, samples = 0, size + 1, {}, None, bytearray()
        while True:
            code = sum((stream[(place + i) // 8] >> (place + i) % 8 & 1) << i for i in range(width))
            place += width
            if code == 1 << size:
                width, last, table = size + 1, None, {i: bytes([i]) for i in range(1 << size)}
                free = (1 << size) + 2
                continue
            if code == (1 << size) + 1:
                break
            entry = table[code] if code in table else last + last[:1]
            samples += entry
            if last is not None and free < 4096:
                table[free] = last + entry[:1]
                free += 1
            if free == 1 << width and width < 12:
                width += 1
            last = entry
        out.append(bytes(samples))
    return out


def test_gif_against_a_plain_decoder():
    r = random.Random(4)
    for n, letters in ((0, 256), (10, 3), (5000, 2), (60_000, 256), (90_000, 5)):
        payload = gif.padded(bytes(r.randrange(letters) for _ in range(n)))
        media = gif.store(payload)
        assert b"".join(plain_gif_samples(media)) == payload
        assert b"".join(f.samples.tobytes() for f in gif.read_frames(media)) == payload
    cut = media[: 13 + 768 + 8 + 10 + 1] + gif._blocks(gif.lzw_encode(payload[:4000])[:100]) + b";"
    with pytest.raises(ValueError):
        list(gif.read_frames(cut))


def test_gif_digest_of_hard_rows(spark):
    rows = [(1, 5, None, 3), (None, None, gif.store(gif.padded(b"abc")), 3), (2, 0, b"GIF89a" + bytes(7) + b";", 3)]
    df = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary, frames int")
    got = {r.doc_id: r for r in gif.media_digest(df).collect()}
    assert got[1].payload_bytes is None and got[2].payload_bytes == 0 and got[2].frames == []
    assert [(f.start_cs, f.delay_cs, f.width, f.height, sum(f.pixels)) for f in got[None].frames] == [(0, 10, 576, 1, 576)]


def test_gif_rules():
    def image(x, y, w, h, samples, control=None, palette=b"", flags=0):
        return (b"\x21\xf9\x04" + control + b"\0" if control else b"") + b"\x2c" + np.array([x, y, w, h], "<u2").tobytes() + bytes([flags]) + palette + b"\x02" + gif._blocks(gif.lzw_encode(bytes(samples), 2))

    red, own = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9]), bytes([1, 2, 3] * 4)
    head = b"GIF89a" + np.array([2, 2], "<u2").tobytes() + bytes([0x81, 0, 0]) + red
    data = head + image(0, 0, 2, 2, [0, 1, 2, 3]) + image(0, 0, 2, 1, [1, 1], bytes([2 << 2 | 1, 5, 0, 1])) + image(1, 1, 1, 1, [0], bytes([3 << 2, 7, 0, 0]), own, 0x81) + image(0, 0, 1, 1, [2]) + b"\x3b"
    frames = list(gif.read_frames(data))
    assert [f.delay for f in frames] == [0, 5, 7, 0]
    assert frames[1].screen[0].tolist() == [[255, 0, 0, 255], [0, 255, 0, 255]]  # all transparent
    assert frames[2].screen.tolist() == [[[0, 0, 0, 0], [0, 0, 0, 0]], [[0, 0, 255, 255], [1, 2, 3, 255]]]  # after disposal to background
    assert frames[3].screen[1].tolist() == [[0, 0, 255, 255], [9, 9, 9, 255]]  # after disposal to previous
    rows = image(0, 0, 1, 9, [0, 0, 1, 1, 2, 2, 2, 2, 3], flags=0x40)
    tall = b"GIF89a" + np.array([1, 9], "<u2").tobytes() + bytes([0x81, 0, 0]) + red + rows + b"\x3b"
    assert next(gif.read_frames(tall)).samples.ravel().tolist() == [0, 2, 1, 2, 1, 2, 2, 3, 0]


def test_gif_feature_is_of_the_rendered_frames(spark, hard):
    for r in gif.media_digest(gif.to_media(hard)).collect():
        raw = (dict(texts())[r.doc_id]).encode()
        grey = np.bincount(np.frombuffer(raw + b"\xff" * (r.payload_bytes - len(raw)), np.uint8) >> 5, minlength=8)
        frames = -(-r.payload_bytes // (576 * 64))
        assert r.feature == f"frames={frames};cs={10 * frames};grey={','.join(map(str, grey))}"
    media = gif.store(b"\x00" * 500 + b"\x41" * 76)
    other = [bytes(x for v in range(256) for x in c(v)) for c in (lambda v: (255 - v,) * 3, lambda v: (255, 255, 255), lambda v: (v, 0, 0))]
    at = media.index(b"\x21\xf9") + 3
    clear = media[:at] + bytes([media[at] | 1]) + media[at + 1 : at + 3] + b"\x41" + media[at + 4 :]
    rows = [(0, media), *((n + 1, media[:13] + p + media[13 + 768 :]) for n, p in enumerate(other)), (4, clear)]
    got = gif.media_digest(spark.createDataFrame([(i, 576, m) for i, m in rows], "doc_id long, n_bytes long, media binary")).collect()
    want = {0: {0: 500, 2: 76}, 1: {7: 500, 5: 76}, 2: {7: 576}, 3: {0: 576}, 4: {0: 500}}
    same([(r.doc_id, r.feature.split("grey=")[1]) for r in got], [(i, ",".join(str(w.get(b, 0)) for b in range(8))) for i, w in want.items()])


def test_quality(spark, hard, empty):
    r = random.Random(1)
    good = [(i, words(60 + i % 50, i)) for i in range(2000, 2400)]
    bad = [(i, " ".join(w + r.choice(["###", "$$$", "%%%"]) for w in words(60, i).split())) for i in range(3000, 3100)]
    docs = spark.createDataFrame([(i, x, 7, "s", "z") for i, x in good + bad], SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.quality_scores(docs, model).collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    held = [x for x in got if x.held_out]
    assert held and all(x.predicted == (x.doc_id < 3000) for x in held)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in quality.quality_scores(hard, model).collect())
    assert quality.quality_scores(hard, model).count() == hard.count()
    assert quality.quality_scores(empty, model).count() == 0
    assert {x.score for x in quality.quality_scores(hard, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    kept = quality.keep_quality(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(good)
    flipped = labels.selectExpr("doc_id", f"if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) as quality", "toxic")
    assert (quality.train(docs, flipped).rows == model.rows).all()


def test_scores_do_not_hang_on_batches():
    model = quality.fit(["a b c", "### ###"], [1, 0])
    xs = [x for _, x in texts()]
    assert model.score(pa.array(xs)).tolist() == [model.score(pa.array([x]))[0] for x in xs]


def test_quality_gives_its_memory_back(spark):
    def resident():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(x) for x in re.findall(r"\nPss_Anon:\s+(\d+)", f.read())) / 1024

    rows = [(i, words(1000, i, 5000)) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    del rows
    common.give_back()
    before = resident()
    model = quality.train(docs, labels)
    assert model.rows.any() and resident() - before < 20


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*docs.columns, "ids"]
    rows = {r.doc_id: r for r in out.collect()}
    source = {r.doc_id: r.text for r in docs.collect()}
    assert rows and all(source[i] == r.text for i, r in rows.items())
    sets = {i: shingle_set(r.text, 5) for i, r in rows.items()}
    ids = sorted(sets)
    assert not [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not [i for i, r in rows.items() if any(x in r.text for x in items)]


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    import sentencepiece

    sf = "/root/testdata/sf0.001"
    tables = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels", "benchmark")}
    source = sorted(tables["documents"].collect(), key=lambda r: r.doc_id)
    items = [(r.item_id, r.text) for r in tables["benchmark"].collect()]
    model = quality.train(tables["documents"], tables["labels"])
    good = [r for r in source if model.score(pa.array([r.text]))[0] >= 0.5]
    place = list(tables["documents"].columns).index("text")
    made = [altered(r.text, n, n) for n, r in enumerate(good[:24])]
    made += [altered(x, n % 6, n) for n, (_, x) in enumerate(items[:12])] + [x.rsplit(" ", 1)[0] for _, x in items[:12]]
    made += [good[n].text + " " + altered(x, n % 6, n) for n, (_, x) in enumerate(items[:12])]
    first = max(r.doc_id for r in source) + 1
    rows = [tuple(r) for r in source] + [(first + n, *tuple(source[0])[1:place], t, *tuple(source[0])[place + 1 :]) for n, t in enumerate(made)]
    tables["documents"] = spark.createDataFrame(rows, tables["documents"].schema)
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")

    model = quality.train(tables["documents"], tables["labels"])
    kept = [r for r in rows if model.score(pa.array([r[place]]))[0] >= 0.5]
    sets = {r[0]: shingle_set(r[place], 5) for r in kept}
    root = {i: i for i in sets}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if x == high else x for i, x in root.items()}
    distinct = [r for r in kept if root[r[0]] == r[0]]
    dirty = {w[0] for w in brute_contaminated([(r[0], r[place]) for r in distinct], items)}
    assert len(kept) < len(rows) and len(distinct) < len(kept) and dirty
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    want = [(*r[:place], sp.decode(sp.encode(r[place])), *r[place + 1 :], sp.encode(r[place])) for r in distinct if r[0] not in dirty]
    same(corpus_pipeline.run(spark, str(tmp_path)).collect(), want)


def test_pipeline_of_hard_rows(spark, tmp_path, empty):
    import corpus_pipeline

    items = [(1, words(40, 9)), (2, None), (3, "")]
    rows = hard_rows() + [(60, "so " + words(40, 9), 7, "s", "z"), (61, words(40, 9), 7, "s", "z"), (None, words(40, 9), 7, "s", "z"), (None, None, 7, "s", "z")]
    odd = {"shard": "IDS", "size": "_first", "id": "kept"}
    spark.createDataFrame(rows, SCHEMA).withColumnsRenamed(odd).repartition(4).write.parquet(f"{tmp_path}/a/documents.parquet")
    empty.withColumnsRenamed(odd).write.parquet(f"{tmp_path}/b/documents.parquet")
    for d in "ab":
        spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{d}/labels.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/{d}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/a")
    assert out.columns == ["doc_id", "text", "_first", "kept", "ids"]
    docs = [(r[0], r[1] or "") for r in rows]
    # without labels every text is as likely good as bad and stays
    first = {i for i, _, _, keep in brute_components(docs, 5, 80) if keep}
    dirty = {t for _, t in docs if brute_contaminated([(0, t)], items)}
    want = [(i, t) for i, t in dict((i, t) for i, t in docs if i in first).items() if t not in dirty] + [(None, t) for i, t in docs if i is None and t not in dirty]
    assert dirty and sorted(((r.doc_id, r.text or "") for r in out.collect()), key=str) == sorted(want, key=str)
    assert all((r.text is None) <= (r.ids == []) for r in out.collect())
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
