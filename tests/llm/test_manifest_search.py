"""Ranked search, fingerprints and the manifest against plain loops."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ticklake.llm.lexical import Segment, ranked, term_counts
from ticklake.llm.merkle import Tree, height, leaf, manifest
from ticklake.llm.simhash import embedded, fingerprint, forest, links, near_prints, neighbours, parts

from . import edge

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- ranked search ---


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute_ranks(docs, items, top):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n = [sum(c.values()) for _, c in counts]
    documents, length = sum(x > 0 for x in n), sum(n)
    df = Counter(t for _, c in counts for t in c)
    by_item = {}
    for i, t in items:
        by_item.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in by_item.items():
        rows = []
        for (d, c), k in zip(counts, n):
            s = 0
            for t in ts:
                if c[t]:
                    w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                    s += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * k * documents // length)))
            if s > 0:
                rows.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(rows)[:top])]
    return sorted(out, key=str)


def got_ranks(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_terms():
    assert term_counts("A_b9 É-x\x7fX".encode()) == Counter({b"a": 1, b"b9": 1, "É".encode(): 1, b"x": 2})
    assert term_counts(None) == term_counts(b" \n-") == Counter()
    long = b"Word,other " * 300_000  # over several slices
    assert term_counts(long) == Counter({b"word": 300_000, b"other": 300_000})


@pytest.mark.parametrize("block_bytes,segment", [(4 << 20, 4_000_000), (300, 40)])
def test_ranked_against_loops(spark, block_bytes, segment):
    """Random texts with ties, and the awkward rows; several blocks of items and segments of postings."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    docs = [(int(i), " ".join(rng.choice(words, int(rng.integers(1, 30)), p=np.arange(60, 0, -1) / 1830))) for i in range(200)]
    docs += [r[:2] for r in edge.rows()] + [(500, "w3 w4"), (400, "w3 w4"), (400, "w3 w4")]
    items = [(k, " ".join(rng.choice(words, 9)) + " w0 W0") for k in range(12)] + [(3, "w59 extra"), (20, None), (21, " -"), (None, "w1 w2"), (22, "nowhere")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumns({c: F.lit(1) for c in ("n", "terms", "times", "rank", "score", "item_id")})
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("term", "t", "doc_id")})
    assert got_ranks(ranked(df, q, top=7, block_bytes=block_bytes, segment=segment)) == brute_ranks(docs, items, 7)


def test_ranked_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert ranked(edge.docs(spark), none).count() == 0
    assert ranked(edge.empty(spark), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_accumulators_stop():
    """A rare term decides: documents that hold frequent ones only get no accumulator, and the survivors' scores are exact."""
    n = np.full(100, 3)
    doc = np.concatenate(([7, 8], np.arange(100)))
    term = np.concatenate(([0, 0], np.ones(100, int)))
    order = np.argsort(doc, kind="stable")
    weight = np.array([9000, 100])
    s = Segment(n, np.bincount(doc, minlength=100), term[order], np.ones(102, int), weight, 100, 300)
    docs, score, made = s.search(np.array([0, 1]), 2, 0)
    assert docs.tolist() == [7, 8] and made == 2
    one = 1_000_000_000 // (1000 + 20 * (50 + 50 * 3 * 100 // 300))
    assert score.tolist() == [9100 * one] * 2
    assert s.search(np.array([0, 1]), 3, 0)[2] == 100  # the third place is open
    assert s.search(np.array([1]), 3, 10**12)[2] == 0  # others have better ones


# --- fingerprints ---


def brute_print(text, k=3):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if x]
    if not w:
        return 0
    k = min(k, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, distance):
    """Smallest id that each row reaches; ``prints`` are (id, print)."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= distance:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(prints))]


def test_fingerprints(spark):
    for _, text, *_ in edge.rows():
        assert fingerprint(None if text is None else text.encode()) == brute_print(text)
    df = spark.createDataFrame([("b c d",)], "s string").select(F.xxhash64("s").alias("h"))
    assert df.first().h % (1 << 64) == fingerprint(b"B\tc  d")


def test_embedding():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 64, 2000, np.uint64)
    for flips in range(5):
        y = x.copy()
        for _ in range(flips):
            y ^= np.uint64(1) << rng.integers(0, 64, len(y), np.uint64)
        u, v = embedded(x), embedded(y)
        bound = sum(np.abs(np.bitwise_count(u >> np.uint64(2 * j) & np.uint64(3)).astype(int) - np.bitwise_count(v >> np.uint64(2 * j) & np.uint64(3))) for j in range(32))
        assert (np.bitwise_count(u ^ v) == bound).all() and (bound <= np.bitwise_count(x ^ y)).all()
        if flips <= 3:
            assert np.any([np.bitwise_count((u ^ v) & m) <= 1 for m in parts(3)], axis=0).all()
    place, cells = neighbours(embedded(x[:50]) & parts(3)[0], parts(3)[0])
    assert set(np.bitwise_count((embedded(x[:50]) & parts(3)[0])[place] ^ cells)) == {1}
    a, b = forest(np.array([1, 2, 9, 8]), np.array([2, 3, 8, 9]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(2, 1), (3, 1), (9, 8)]


@pytest.mark.parametrize("distance,members", [(3, 512), (3, 8), (1, 512), (5, 16)])
def test_links_against_all_pairs(spark, distance, members):
    """A dense ball, chains and lone prints; small blocks part the cells."""
    rng = np.random.default_rng(distance)

    def flipped(x, k):
        for b in rng.choice(64, k, replace=False):
            x ^= 1 << int(b)
        return x

    centre, prints = int(rng.integers(1 << 62)), [0, (1 << 64) - 1, 1, 7, 15, 31]
    prints += [flipped(centre, int(rng.integers(0, 8))) for _ in range(150)]
    for _ in range(30):
        x = int(rng.integers(1 << 62))
        prints += [x, y := flipped(x, distance), flipped(y, distance), flipped(x, distance + 1)]
    prints = sorted(set(prints))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    want = brute_components(list(enumerate(prints)), distance)
    at = {p: i for i, p in enumerate(prints)}
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    rows = links(df, distance, members=members).collect()
    for a, b in rows:
        x, y = sorted((find(at[a % (1 << 64)]), find(at[b % (1 << 64)])))
        root[y] = x
    assert [find(i) for i in range(len(prints))] == want


def test_near_prints_rows(spark):
    rows = [r[:2] for r in edge.rows()] + [(20, None), (21, edge.BASE + " more"), (21, edge.BASE + " more")]
    extra = {c: F.lit(1) for c in ("print", "fingerprint", "component_id", "cell", "part", "node", "a", "b")}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns(extra)
    got = near_prints(df).collect()
    prints = [(i, brute_print(t)) for i, t in rows]
    want = Counter((i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints, 3)))
    assert Counter(tuple(r) for r in got) == want
    assert near_prints(edge.empty(spark)).count() == 0
    assert [tuple(r) for r in near_prints(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()] == [(None, f"{brute_print('a b'):016x}", None)]


# --- manifest ---


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grow(nodes):
    """Root, and for each node the (before, after) text level by level."""
    paths, at, now = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(now) > 1:
        runs = [now[i : i + 16] for i in range(0, len(now), 16)]
        for k, i in enumerate(at):
            run = runs[i // 16]
            paths[k].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        at, now = [i // 16 for i in at], [H("".join(r)) for r in runs]
    return now[0], paths


def brute_manifest(rows, tampered):
    """``rows`` are (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, brute_leaf(r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: grow([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    root, above = grow([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, above):
        for (_, _, h, r), path in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1]):
            f = brute_leaf((*r[:4], r[4].translate(LOWER))) if tampered(r) and r[4] is not None else h
            for b, a in path + up:
                f = H(b + f + a)
            out.append((r[0], h, trees[s][0], root, H("".join(b + a for b, a in path + up)), f, f == root))
    return Counter(out)


def is_tampered(r):
    return r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0


def made(df, **kw):
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    t = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf({"text": low}))
    return Counter(tuple(r) for r in manifest(df, tampered=t, **kw).collect())


def test_tree():
    for n in (1, 2, 15, 16, 17, 256, 257, 300, 4096):
        nodes = [H(str(i)) for i in range(n)]
        tree, levels = Tree(), height(n)
        for x in nodes:
            tree.append(x)
        root, paths = grow(nodes)
        assert tree.finish(levels) == root
        assert [list(tree.path(i, levels)) for i in range(n)] == paths


@pytest.mark.parametrize("span", [3, 1])
def test_manifest_against_loops(spark, span):
    """Block roots go up as further appends: with blocks of 16 the trees have several stages."""
    rows = [(i, s, "en", len(t), t) for k, (s, n) in enumerate((("a", 700), ("B", 17), ("é", 16), ("", 1), (None, 3))) for i in range(k, 5 * n, 5) for t in [f"Text {i}"]]
    rows += [(r[0], r[3], r[2], r[4], r[1]) for r in edge.rows()] + [(1, f"z{i}", None, None, "X") for i in range(20)]
    names = ("digest", "node", "tree", "pos", "n", "root", "leaf", "path", "bad", "name")
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4).withColumns({c: F.lit(1) for c in names})
    assert made(df, span=span) == brute_manifest(rows, is_tampered)


def test_manifest_small(spark):
    assert not made(edge.empty(spark))
    one = [(2**62 + 1, None, None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(one, "doc_id long, source string, lang string, n_chars long, text string")
    assert made(df) == brute_manifest(one, is_tampered)
