"""Near copies by similarity: texts whose sets of word shingles have a Jaccard similarity of at least 0.8, or another bound.

A budget of 3 of 64 bits, as ``op1_simhash`` searches it, is far narrower than that: two texts of similarity 0.8 differ in about
15 % of their bits, and chains of so distant fingerprints of 64 bits aren't selective.  So the fingerprint is wider, and the search has three steps:

1. a text's distinct shingles give a SimHash of ``RING`` bits, read as a ring of 64 segments of ``SEGMENT`` bits.  Candidates are found by pigeonring chains:
   two texts meet under a start segment, of which the first ``KEY`` bits must be equal, and the chains of ``CHAIN_BITS`` bits from that start must lie within their share of
   a loose budget (that of a similarity less by ``SLACK``).  Fingerprints that differ in fewer bits than there are segments always meet (the ring's chains
   of 1, 2, 3, ... segments then differ by at most 0, 1, 2, ... bits from some start); beyond that any of 64 starts may do, and of pairs at 0.8
   all but a few in 10,000 of the shortest texts have one;
2. a spanning forest of the links under each key gives components, in which near copies can be;
3. within a component, pairs within a looser budget of the first ``BITS`` bits are compared by the exact Jaccard similarity of their shingles' hashes (32 bits).

Texts of one fingerprint are one node.  A key or component that more than a block of nodes share is cut into blocks, and all pairs of blocks are compared in different
tasks.  Of the links in a large block only a spanning tree is searched: a node is compared with those that no node before has reached.

Cost: a node has one row a start, of 128 bits of its ring; under a key there are n / 2 ** ``KEY`` of n nodes, so comparisons grow as n * n / 32, some nanoseconds each.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and are one node; a text with fewer words than a
shingle is one shingle; a very long text is read whole, its hashes in blocks; repeated rows are one node; an empty table gives none; other
columns of the input are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomql.llm.batches import bound_batches, release, runs
from loomql.operators.components import connected_components
from loomql.plans.scratch import cut, small_side

SEED = 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SHINGLE, SIMILARITY, SLACK, EXACT_SLACK = 5, 0.8, 0.2, 0.4
RING, SEGMENT, KEY, BITS = 1024, 16, 10, 256
STARTS = RING // SEGMENT
CHAIN_BITS = (64, 128)
BLOCK, EXACT_BLOCK = 32768, 1024
#: Groups of at most so many rows are compared pair by pair, larger ones by spanning trees; links held before they are made a forest.
LAGS, HELD_LINKS = 1024, 1 << 20
_RING = [f"f{k}" for k in range(RING // 64)]
_FP = _RING[: BITS // 64]
_CHAIN = [f"w{k}" for k in range(CHAIN_BITS[-1] // 64)]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of a text's shingles of ``width`` words in order, repeats included; the whole sequence if it has fewer words."""
    words = (text or "").encode().translate(LOWER).split()
    if len(words) <= width:
        shingles, n = ([b" ".join(words)] if words else []), min(1, len(words))
    else:
        shingles, n = map(b" ".join, zip(*[words[k:] for k in range(width)])), len(words) - width + 1
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n)


def budget(similarity: float, bits: int = BITS) -> int:
    """Bits of ``bits`` in which fingerprints of two texts of this Jaccard similarity are expected to differ."""
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ring(h: np.ndarray) -> np.ndarray:
    """The fingerprint of distinct hashes: the ring's bits in unsigned 64-bit words."""
    ones = np.zeros(RING, dtype=np.int64)
    for at in range(0, len(h), 1 << 9):
        part = _mixed(h[at : at + (1 << 9), None] + _STEP * np.arange(len(_RING), dtype=np.uint64))
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8")


def rings(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``ring`` for each set of hashes."""
    return np.stack([ring(h) for h in sets]) if sets else np.empty((0, len(_RING)), dtype=np.uint64)


def starts(fp: np.ndarray) -> np.ndarray:
    """The keys of each ring (a row), one a start: the start's number and the first bits of its segment."""
    segments = np.ascontiguousarray(fp).view("<u2").astype(np.int64)
    return (np.arange(STARTS, dtype=np.int64) << KEY) | (segments & ((1 << KEY) - 1))


def chains(fp: np.ndarray) -> np.ndarray:
    """The two words that follow each start of each ring, the start's segment included: rows, starts, words."""
    segments = np.ascontiguousarray(fp).view("<u2")
    around = (np.arange(STARTS)[:, None] + np.arange(CHAIN_BITS[-1] // SEGMENT)) % STARTS
    return np.ascontiguousarray(segments[:, around]).view("<u8")


def sketch(h: np.ndarray) -> np.ndarray:
    """The first ``BITS`` bits' words, then the starts' keys, of distinct sorted hashes, as one row of unsigned 64-bit integers."""
    fp = ring(h)[None, :]
    return np.concatenate([fp[0, : len(_FP)], starts(fp)[0].astype(np.uint64)])


def nodes_of(fp: np.ndarray) -> np.ndarray:
    """One signed long for each fingerprint (a row)."""
    node = np.zeros(len(fp), dtype=np.uint64)
    for k in range(fp.shape[1]):
        node = _mixed(node * _STEP + fp[:, k])
    return node.view(np.int64)


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The distinct hashes of each text's shingles, sorted."""
    return [np.unique(shingle_hashes(t, width)) for t in texts]


def text_nodes(texts: list[str], width: int = SHINGLE) -> np.ndarray:
    """The node of each text."""
    return nodes_of(rings(shingle_sets(texts, width)))


def marks(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, f0.., shingles, rid) for every row of ``docs``: its node, fingerprint, hashes, and a number of its own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part, texts in runs(batch, 1):
                sets = shingle_sets(texts, width)
                rows = rings(sets)
                columns = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in rows.T]
                short = pa.array([np.unique(h.astype("<u4")).tobytes() for h in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes_of(rows)), *columns, short], ["doc_id", "fp", *_RING, "shingles"])

    bound_batches(docs.sparkSession)
    schema = ", ".join(f"{c} long" for c in ["doc_id", "fp", *_RING]) + ", shingles binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, schema).withColumn("rid", F.monotonically_increasing_id())


def nodes(marked: DataFrame) -> DataFrame:
    """One row a node: fp, f0.., ``least_id`` and ``least_rid``."""
    least = [F.min(c).alias(c) for c in _RING]
    return marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.min("rid").alias("least_rid"), *least)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least node) with the same components as the links u-v."""
    names, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(names))
    return names[other], names[label[other]]


def _close(fp: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1, dtype=np.int64) <= bits


def _spanning(n: int, reach: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning trees of ``n`` rows; ``reach`` tells which of some rows are linked to one row."""
    rest, found = np.arange(n), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            hit = reach(one, rest)
            if not hit.any():
                continue
            new, rest = rest[hit], rest[~hit]
            found.append((np.full(len(new), one), new))
            queue += new.tolist()
    return found


def _chained(words: np.ndarray, a: np.ndarray, b: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """Which pairs of rows lie within each chain's budget, the shorter chain first."""
    hit = np.flatnonzero(np.bitwise_count(words[a, 0] ^ words[b, 0]) <= bits[0])
    near = np.zeros(max(len(a), len(b)), dtype=bool)
    x, y = (r if len(r) == 1 else r[hit] for r in (a, b))
    near[hit] = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64) <= bits[1]
    return near


def group_links(group: np.ndarray, words: np.ndarray, bits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal ``group`` (rows sorted by it), enough for their components."""
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    length = np.diff(edges)
    none = np.empty(0, dtype=np.int64)
    out, held = [(none, none)], 0
    rows = np.flatnonzero(np.repeat(length <= LAGS, length))
    left, lag = np.repeat(edges[1:], length)[rows], 1
    while len(rows):
        keep = rows + lag < left
        rows, left = rows[keep], left[keep]
        hit = rows[_chained(words, rows, rows + lag, bits)]
        out.append((hit, hit + lag))
        held += len(hit)
        if held > HELD_LINKS:
            out = [forest(np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out]))]
            held = 0
        lag += 1
    for k in np.flatnonzero(length > LAGS):
        at = edges[k]
        out += [(a + at, b + at) for a, b in _spanning(int(length[k]), lambda one, rest: _chained(words, at + rest, at + np.array([one]), bits))]
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _link_batches(bits: tuple[int, ...]):
    """Spanning edges of the links under each key; rows arrive sorted by (key, pair)."""

    def links_of(rows: np.ndarray) -> pa.RecordBatch:
        new = np.r_[False, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
        a, b = group_links(np.cumsum(new), rows[:, 3:].view(np.uint64), bits)
        u, v = forest(rows[a, 2], rows[b, 2])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
            if sum(map(len, waiting)) < 100_000:
                continue
            rows = np.concatenate(waiting)
            at = int(np.argmax((rows[:, :2] == rows[-1, :2]).all(axis=1)))  # the last group may go on in the next batch
            if at:
                yield links_of(rows[:at])
            waiting = [rows[at:].copy()]
        if waiting:
            yield links_of(np.concatenate(waiting))

    return work


def _cut_up(rows: DataFrame, block: int, sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` (key, fp, others) with a column ``pair``: a key of more than ``block`` rows is cut into blocks, and a row comes once for each pair of blocks with its own.

    ``sizes`` has (key, n) rows, whose n add up to the key's rows.
    """
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")) if sizes is None else sizes.groupBy("key").agg(F.sum("n").alias("n"))
    hot = cut(sizes.where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("parts")))
    if hot.isEmpty():
        return rows.withColumn("pair", F.lit(0).cast("long"))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("long")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1), lambda j: F.least(mine, j) * 1_000_000_000 + F.greatest(mine, j))
    every = F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(pairs)
    return rows.join(small_side(hot), "key", "left").select(*rows.columns, F.explode(every).alias("pair"))


def _dealt(rows: DataFrame, *others: str) -> DataFrame:
    return rows.select("key", "pair", "fp", *others).repartition("key", "pair").sortWithinPartitions("key", "pair")


def _ring_of(batch: pa.RecordBatch) -> np.ndarray:
    """The rings of a batch of (fp, f0..)."""
    return np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1).view(np.uint64)


def _start_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            fp = _ring_of(part)
            words = chains(fp).reshape(-1, len(_CHAIN)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(starts(fp).ravel()), pa.array(np.repeat(part.column(0).to_numpy(), STARTS)), *map(pa.array, np.ascontiguousarray(words.T))], ["key", "fp", *_CHAIN])


def _size_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(STARTS << KEY, dtype=np.int64)
    for batch in batches:
        if batch.num_rows:
            n += np.bincount(starts(_ring_of(batch)).ravel(), minlength=len(n))
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["key", "n"])


def loose_links(of: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """(u, v): edges whose components are those of all pairs of ``nodes`` that meet under a start and lie within the chains' budgets."""
    of = of.select("fp", *_RING)
    rows = of.mapInArrow(_start_batches, ", ".join(f"{c} long" for c in ["key", "fp", *_CHAIN]))
    sizes = of.mapInArrow(_size_batches, "key long, n long")
    bits = tuple(budget(similarity, n) for n in CHAIN_BITS)
    return _dealt(_cut_up(rows, block, sizes), *_CHAIN).mapInArrow(_link_batches(bits), "u long, v long").distinct()


def _same(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity; two empty ones have."""
    low, high = sorted((len(a), len(b)))
    if low < similarity * high:
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common >= similarity * (low + high - common)


def _check_batches(similarity: float, bits: int):
    """Spanning trees of the exact links in each (key, pair); rows arrive sorted by it."""

    def links_of(rows: list[tuple[int, bytes]], fp: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        marked, sets = np.stack(fp).view(np.uint64), [np.frombuffer(x, dtype="<u4") for _, x in rows]

        def reach(one: int, rest: np.ndarray) -> np.ndarray:
            hit = _close(marked, rest, np.array([one]), bits)
            hit[hit] = [_same(sets[one], sets[k], similarity) for k in rest[hit].tolist()]
            return hit

        name = np.array([node for node, _ in rows], dtype=np.int64)
        trees = _spanning(len(rows), reach)
        none = np.empty(0, dtype=np.int64)
        return np.concatenate([none, *(name[a] for a, _ in trees)]), np.concatenate([none, *(name[b] for _, b in trees)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fp, at = [], [], None
        for batch in batches:
            out = []
            table = np.stack([c.to_numpy() for c in batch.columns[:-1]], axis=1) if batch.num_rows else ()
            for row, shingles in zip(table, batch.column(batch.num_columns - 1).to_pylist()):
                key = (int(row[0]), int(row[1]))
                if key != at and group:
                    out.append(links_of(group, fp))
                    group, fp = [], []
                at = key
                group.append((int(row[2]), shingles))
                fp.append(row[3:])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["u", "v"])
        if group:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in links_of(group, fp)], ["u", "v"])

    return work


def classes(marked: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, exact_block: int = EXACT_BLOCK) -> DataFrame:
    """(fp, least_id, root) for every node of stored ``marks``: ``root`` names the component of links of at least ``similarity``."""
    of = cut(nodes(marked))
    loose, looser = (max(0.0, similarity - slack) for slack in (SLACK, EXACT_SLACK))
    near = connected_components(loose_links(of, loose, block)).select(F.col("node").alias("fp"), F.col("root").alias("key"))
    rows = cut(_cut_up(of.join(near, "fp").select("key", "fp", "least_rid"), exact_block))
    side = small_side(rows)
    whole = marked.select("rid", *_FP, "shingles").join(side if side is not rows else rows.hint("shuffle_hash"), F.col("rid") == F.col("least_rid"))
    exact = _dealt(whole, *_FP, "shingles").mapInArrow(_check_batches(similarity, budget(looser)), "u long, v long")
    roots = connected_components(exact).withColumnRenamed("node", "fp")
    return of.select("fp", "least_id").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
