"""SimHash against brute force over all pairs."""

import random

import numpy as np
import xxhash
from llm.conftest import KINDS, prose, rows_of, texts_of

from loomql.llm import near_copies
from loomql.llm import op1_simhash as op


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """(doc_id, fingerprint, component id) by comparing all pairs."""
    marks = [(i, slow_fingerprint(t)) for i, t in rows]
    root = list(range(len(marks)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(marks)):
        for b in range(a):
            if (marks[a][1] ^ marks[b][1]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(marks):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, f"{f:016x}", least.get(find(k))) for k, (i, f) in enumerate(marks)), key=repr)


def test_equals_brute_force(spark, docs):
    assert rows_of(op.near_duplicates(docs)) == brute(texts_of(docs))


def test_near_copies_are_linked(spark):
    rng = random.Random(1)
    rows = []
    for g in range(6):
        words = prose(rng, 400).split()
        for k in range(8):
            copy = list(words)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = f"w{rng.random()}"
            rows.append((g * 100 + k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(op.near_duplicates(df))
    assert got == brute(rows) and len({c for _, _, c in got}) < len(rows)


def test_awkward_rows(spark, odd, empty):
    assert rows_of(op.near_duplicates(odd)) == brute(texts_of(odd))
    assert op.near_duplicates(empty).count() == 0


def random_links(rng, n=400, centres=25):
    fps = set()
    while len(fps) < n:
        x = rng.getrandbits(64) if len(fps) < centres else rng.choice(sorted(fps))
        for _ in range(rng.randint(0, 3)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    return sorted(fps)


def components(nodes, edges):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        root[find(u)] = find(v)
    groups = {}
    for x in nodes:
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


def test_links_with_any_key_width_and_blocks(spark):
    fps = random_links(random.Random(3))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    every = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    expected = components(signed, every)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for block in (4096, 3):  # the second cuts every key into many blocks
        got = [(r["u"], r["v"]) for r in op.links(df, block).collect()]
        assert components(signed, got) == expected
    for r in (0, 5, 16):
        rows = [tuple(x) for x in op._keyed(df, r).collect()]
        by_key = {}
        for key, fp, base in rows:
            by_key.setdefault(key, []).append((key >> 40 & 3, fp & (1 << 64) - 1, base))
        met = set()
        for group in by_key.values():
            for start, fp, base in group:
                if base:
                    turn = lambda x, s=start: ((x << 16 * s) | (x >> 64 - 16 * s)) & (1 << 64) - 1 if s else x
                    met |= {frozenset((turn(fp), turn(o))) for _, o, _ in group}
        assert all(frozenset(x & (1 << 64) - 1 for x in pair) in met for pair in every)


def test_forest_keeps_components():
    rng = np.random.default_rng(0)
    u, v = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    a, b = near_copies.forest(u, v)
    nodes = sorted({*u.tolist(), *v.tolist()})
    assert components(nodes, zip(u.tolist(), v.tolist())) == components(nodes, zip(a.tolist(), b.tolist()))
    assert len(a) == len(nodes) - len(components(nodes, zip(u.tolist(), v.tolist())))


def test_schema_of_input(spark):
    df = spark.createDataFrame([(1, "a b c d", "en", "s", 7)], KINDS)
    assert op.near_duplicates(df).columns == ["doc_id", "fingerprint", "component_id"]
