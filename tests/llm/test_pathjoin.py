import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabflow.llm import pathjoin
from tabflow.llm.components import connected
from tabflow.llm.pathjoin import near_duplicates, runs_for

FOLDER = "/root/testdata/sf0.01"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """class, links between different sets, copies; all pairs that share a shingle."""
    sets, where = {}, {}
    for k, t in rows:
        sets.setdefault(shingles(t), []).append(k)
    own = list(sets)
    for i, s in enumerate(own):
        for x in s:
            where.setdefault(x, []).append(i)
    links = [set() for _ in own]
    for i, s in enumerate(own):
        common = {}
        for x in s:
            for j in where[x]:
                common[j] = common.get(j, 0) + 1
        links[i] = {j for j, c in common.items() if j != i and 5 * c >= 4 * (len(s) + len(own[j]) - c)}
    root = list(range(len(own)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, others in enumerate(links):
        for j in others:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    classes = {}
    for i, s in enumerate(own):
        if s:
            classes.setdefault(find(i), []).extend(k for k in sets[s] if k is not None)
    out = []
    for i, s in enumerate(own):
        out += [(k, min(classes[find(i)], default=None) if s else k, len(links[i]), len(sets[s]) if s else 1) for k in sets[s]]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in df.collect()), key=str)


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert result(near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def noisy(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def crowd():
    """A large group of near copies, pairs around the threshold, texts that share a long passage, short and odd texts."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    base = [word() for _ in range(260)]
    rows = [noisy(rng, base, rng.randrange(1, 7)) for _ in range(160)]
    for n in (6, 9, 20, 60, 300, 900):
        for _ in range(12):
            b = [word() for _ in range(n)]
            rows += [" ".join(b), noisy(rng, b, max(1, n // 50)), noisy(rng, b, max(1, n // 40))]
    passage = " ".join(word() for _ in range(60))
    rows += [f"{passage} {' '.join(word() for _ in range(rng.randrange(20, 200)))}" for _ in range(150)]
    return [*enumerate(rows), (None, rows[0]), (None, None), (9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "one"), (9005, "one two three four"), (9006, "one  two\nthree four"),
            (9006, "one  two\nthree four"), (9007, "x " * 5000), (9008, "x " * 6000), (9007, rows[1]), (None, "only null key here"), (9009, " ".join(map(str, range(40_000))))]


def test_crowd_equals_brute_force(spark, crowd, monkeypatch):
    # Small limits: every way through the operator is taken.
    monkeypatch.setattr(pathjoin, "BUCKET", 24)
    monkeypatch.setattr(pathjoin, "BLOCK_SETS", 40)
    docs = spark.createDataFrame(crowd, "doc_id long, text string").selectExpr("*", "1 as sid", "2 as key")
    assert result(near_duplicates(docs)) == brute(crowd)


def test_links_do_not_grow_with_buckets_or_blocks(spark, crowd, monkeypatch):
    monkeypatch.setattr(pathjoin, "BUCKET", 24)
    monkeypatch.setattr(pathjoin, "BLOCK_SETS", 20)
    found = []

    def seen(links):
        found.append((links.distinct().count(), links.select("a").union(links.select("b")).distinct().count()))
        return connected(links)

    monkeypatch.setattr(pathjoin, "connected", seen)
    docs = spark.createDataFrame(crowd, "doc_id long, text string")
    near_duplicates(docs)
    # One link for each set, and a few between those that sets hang on; one for each bucket or block a set was met in would be many more.
    assert len(found) == 2
    assert all(links <= 2.5 * sets for links, sets in found)


def test_thinned_links_connect_the_same_sets(spark):
    rng = np.random.default_rng(3)
    links = spark.createDataFrame([tuple(map(int, x)) for x in rng.integers(0, 300, (250, 2))] + [(7, 7), (900, 900), (5, 1), (5, 2)], "a long, b long")
    thin = pathjoin._thinned(links)
    assert {tuple(r) for r in connected(thin).collect()} == {tuple(r) for r in connected(links).collect()}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).count() == 0


def test_runs():
    assert runs_for(0.999, 0.8) <= 8 < runs_for(0.999999, 0.7)


def test_components(spark):
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(60)] + [(1000, int(i)) for i in range(200, 420)] + [tuple(map(int, x)) for x in rng.integers(2000, 2400, (300, 2))] + [(None, 5), (7, 7)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in chain:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    links = spark.createDataFrame(chain, "a long, b long")
    assert {r.node: r.root for r in connected(links).collect()} == {i: find(i) for i in root}
    assert connected(links.limit(0)).count() == 0


def test_near_copies_leave_large_buckets(spark):
    """Rows that go deeper don't grow with a group of near copies."""
    from tabflow.llm import pathjoin as P

    def left(n):
        rng = random.Random(5)
        base = [f"w{i}" for i in range(120)]
        rows = []
        for i in range(n):
            w = list(base)
            w[rng.randrange(120)] = f"x{i}"
            rows.append((i, " ".join(w)))
        rows += [(n + i, " ".join(f"y{i}z{j}" for j in range(60))) for i in range(300)]
        docs = spark.createDataFrame(rows, "key long, text string").withColumn("mark", F.lit(1).cast("long"))
        sets = P._sketches(docs, 5).withColumn("node", F.lit(1).cast("long"))
        links, rest = P._led(sets)
        kept = rest.join(sets.select("key", "sid"), "sid")
        assert kept.filter(f"key >= {n}").count() == 300
        return kept.filter(f"key < {n}").count(), links.count()

    few, many = left(300), left(1500)
    assert few[0] <= 30 and many[0] <= 30
    assert few[0] + few[1] == 300 and many[0] + many[1] == 1500


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    """Texts that share most of their words stay in large buckets without near copies; pairs among them are found all the same."""
    monkeypatch.setattr(pathjoin, "BUCKET", 4)
    monkeypatch.setattr(pathjoin, "LEADERS", 1)
    rng = random.Random(3)
    base, rows = [f"b{i}" for i in range(200)], []
    for f in range(90):
        own, at = list(base), rng.randrange(0, 100)
        own[at : at + 95] = [f"f{f}w{i}" for i in range(95)]
        rows += [" ".join(own), noisy(rng, own, 2)]
    rows = list(enumerate(rows))
    want = brute(rows)
    assert sum(n for _, _, n, _ in want) == 180
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_what_resembles_a_set_behind_a_leader_is_linked(spark, monkeypatch):
    """A set far enough from a leader to stay, and so near to one that left that they may be similar, is linked to the leader, too."""
    monkeypatch.setattr(pathjoin, "LEADERS", 1)
    tokens = np.arange(1, 2000, dtype=np.uint32) * np.uint32(7)
    sets = [(i, list(map(int, tokens[a : a + 64]))) for i, a in ((1, 0), (2, 8), (3, 18), (4, 500))]
    rows = [(1, sid, 64, bytes(np.array(x, "<u4").tobytes())) for sid, x in sets]
    df = spark.createDataFrame(rows, "node long, sid long, size int, sketch binary")
    links, left = pathjoin._led(df)
    (leader,) = {b for r in links.collect() for b in r.leaders} | {b for r in left.collect() for b in r.leaders} or {4}
    linked = {r.a for r in links.collect()} | {r.sid for r in left.collect() if r.leaders}
    assert linked | {leader} >= ({1, 2, 3} if leader != 4 else {4})
