"""Near copies of five-word shingles at 0.8 against exact Jaccard similarities of all pairs."""

import random

import numpy as np
from llm.conftest import KINDS, prose, texts_of
from llm.test_simhash import components

from loomql.llm import near_copies as nc
from loomql.llm import op1_simhash as op


def shingles(text, width=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute(rows, similarity=0.8):
    """The components, as sets of row numbers, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= similarity:
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    return list(groups.values())


def kept_of(rows):
    """Least doc_id (null last) of each component."""
    return sorted((min((rows[k][0] for k in g), key=lambda i: (i is None, i or 0)) for g in brute(rows)), key=repr)


def edited(rng, groups=12, copies=6, n=150, most=8):
    rows = []
    for g in range(groups):
        words = prose(rng, n).split()
        for k in range(copies):
            copy = list(words)
            for _ in range(rng.randint(0, most)):
                copy[rng.randrange(len(copy))] = f"w{rng.random()}"
            rows.append((g * 100 + k, " ".join(copy)))
    return rows


def test_least_row_of_each_component_stays(spark, docs):
    rows = texts_of(docs)
    kept = op.representatives(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert ids == kept_of(rows)
    by_id = dict(rows)
    assert jaccard(shingles(by_id[6]), shingles(by_id[145])) >= 0.8 and 145 not in ids


def test_edited_copies(spark):
    rows = edited(random.Random(2))
    groups = brute(rows)
    assert 12 < len(groups) < len(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((r["doc_id"] for r in op.representatives(df).collect()), key=repr) == kept_of(rows)


def test_blocks_change_nothing(spark):
    rows = edited(random.Random(4), groups=3, copies=25, n=120, most=5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marked = nc.cut(nc.marks(df))
    expected = sorted(len(g) for g in brute(rows))
    sizes = marked.groupBy("fp").count()
    for blocks in ((4096, 1024), (7, 4)):
        named = nc.classes(marked, 0.8, *blocks).join(sizes, "fp")
        assert sorted(r["n"] for r in named.groupBy("root").agg({"count": "sum"}).toDF("root", "n").collect()) == expected


def test_awkward_rows(spark, odd, empty):
    rows = texts_of(odd)
    kept = op.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == kept_of(rows)
    assert op.representatives(empty).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3, KINDS)
    assert op.representatives(nulls).count() == 1


def test_budget_and_chains():
    assert nc.budget(1.0) == 0 and nc.budget(0.8) == 39 and nc.budget(0.6) == 59
    rng, far, apart = random.Random(6), 0, 0
    for _ in range(200):  # pairs at a similarity of 0.8: 44 of 400 hashes are replaced
        h = [rng.getrandbits(64) for _ in range(444)]
        a, b = (nc.sketch(np.unique(np.array(x, dtype=np.uint64))) for x in (h[:400], h[44:]))
        far += int(np.bitwise_count(a[:4] ^ b[:4]).sum(dtype=int)) > nc.budget(0.6)
        apart += not np.any(a[4:] == b[4:])
    assert far <= 1 and apart <= 1


def test_spanning_trees_reach_what_links_reach():
    rng = np.random.default_rng(1)
    near = rng.random((60, 60)) < 0.02
    near |= near.T
    trees = nc._spanning(60, lambda one, rest: near[one][rest])
    a, b = (np.concatenate(x) for x in zip(*trees))
    u, v = np.nonzero(near & ~np.eye(60, dtype=bool))
    whole, tree = nc.forest(u, v), nc.forest(a, b)
    assert sorted(zip(*map(np.ndarray.tolist, whole))) == sorted(zip(*map(np.ndarray.tolist, tree)))
    assert len(a) == len(whole[0])


def ring_nodes(rng, n=300, centres=20):
    """Distinct rings of 1024 bits, many of them a few to 200 bits from another."""
    found = set()
    while len(found) < n:
        x = rng.getrandbits(nc.RING) if len(found) < centres else rng.choice(sorted(found))
        for k in rng.sample(range(nc.RING), rng.choice([1, 20, 63, 120, 160, 200])):
            x ^= 1 << k
        found.add(x)
    return sorted(found)


def meet(x, y):
    """The law in plain Python: from some start the first bits are equal, and the chains of 64 and 128 bits lie within their share of the budget."""
    for start in range(0, nc.RING, nc.SEGMENT):
        d = x ^ y
        d = (d >> start | d << nc.RING - start) & (1 << nc.RING) - 1
        if d & (1 << nc.KEY) - 1 == 0 and all((d & (1 << n) - 1).bit_count() <= nc.budget(0.6, n) for n in nc.CHAIN_BITS):
            return True
    return False


def test_candidates_are_found_by_pigeonring_chains_of_fingerprints(spark):
    """No other column than the SimHash's words is needed, and the links are those of comparing all pairs, in blocks too."""
    fps = ring_nodes(random.Random(8))
    words = [[(x >> 64 * k) & (1 << 64) - 1 for k in range(nc.RING // 64)] for x in fps]
    signed = [[w - (1 << 64) if w >> 63 else w for w in row] for row in words]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(signed)], ", ".join(f"{c} long" for c in ["fp", *nc._RING]))
    every = [(a, b) for a in range(len(fps)) for b in range(a) if meet(fps[a], fps[b])]
    near = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() < nc.STARTS]
    assert near and set(near) < set(every)
    for block in (nc.BLOCK, 3):
        got = [(r["u"], r["v"]) for r in nc.loose_links(df, 0.6, block).collect()]
        assert components(range(len(fps)), got) == components(range(len(fps)), every)


def test_trees_and_pairs_give_the_same_components(monkeypatch):
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 63, (40, 2), dtype=np.uint64)[rng.integers(0, 40, 400)] ^ (np.uint64(1) << rng.integers(0, 63, (400, 2), dtype=np.uint64))
    group = np.sort(rng.integers(0, 5, 400))
    bits = tuple(nc.budget(0.6, n) for n in nc.CHAIN_BITS)
    found = []
    for lags, held in ((1024, 1 << 20), (1024, 50), (10, 1 << 20)):
        monkeypatch.setattr(nc, "LAGS", lags)
        monkeypatch.setattr(nc, "HELD_LINKS", held)
        a, b = nc.group_links(group, words, bits)
        assert (group[a] == group[b]).all()
        found.append(components(range(400), zip(a.tolist(), b.tolist())))
    assert found[0] == found[1] == found[2] and 5 < len(found[0]) < 400
