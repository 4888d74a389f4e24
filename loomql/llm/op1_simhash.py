"""SimHash near duplicates: fingerprints, pigeonring candidate search, components.

Two 64-bit fingerprints are linked when they differ in at most 3 bits.  The fingerprint
is read as a ring of four 16-bit segments.  If the four segment differences add up to 3
or less, some start segment exists from which every chain of 1, 2, 3, 4 consecutive
segments differs by at most 0, 1, 2, 3 bits (the proportional budgets 3/4 per segment).
The search therefore

1. keys every distinct fingerprint by its start segment plus the first ``r`` bits of the
   next one, and also by those keys with one set bit of the ``r`` cleared, so that a chain
   of length two within its budget always meets under one key.  ``r`` follows from the
   number of distinct fingerprints, so that a key is expected to hold few of them; it
   changes cost, never the result;
2. inside a key, prunes by the longer chains before the whole Hamming distance;
3. hands on only a spanning forest of the links of each batch, so a group of thousands of
   near copies costs edges in proportion to its members, not to its pairs.

A key that holds more than ``BLOCK`` fingerprints is cut into blocks and all pairs of
blocks are compared in different tasks.

This is the law of ``near_duplicates``.  ``representatives``, which the pipeline calls, links texts by shingles of five words and a similarity of 0.8
(``near_copies``): the same search by pigeonring chains, on a ring of 1,024 bits with a budget wide enough for that, and an exact check.

A fingerprint that many rows share is joined to its component by broadcast: at most ``HOT`` fingerprints can hold more than
that part of the rows each.  Texts themselves are shuffled once, and only where rows are chosen (``representatives``).

Defined cases: a null text counts as empty; a text without words has fingerprint zero and
is linked like any other; a very long text is read whole, its hashes in blocks; null doc_ids are never the smallest, so a
component of null ids has a null id; repeated rows are returned as often as they occur; an empty table gives none; other
columns of the input are ignored by ``near_duplicates`` and kept by ``representatives``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomql.llm import near_copies
from loomql.llm.batches import bound_batches, release, runs
from loomql.operators.components import connected_components
from loomql.plans.scratch import cut, small_side

SHINGLE = 3
SEGMENT = 16
SEGMENTS = 4
BLOCK = 4096
HOT = 1000


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of one text (XXH64 of 3-word shingles, majority per bit)."""
    hashes = near_copies.shingle_hashes(text, SHINGLE)
    n = len(hashes)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _values(texts: list[str]) -> np.ndarray:
    return np.fromiter(map(fingerprint, texts), dtype=np.uint64, count=len(texts)).view(np.int64)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for part, texts in runs(batch, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_values(texts))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed long."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _near(x: np.ndarray) -> np.ndarray:
    """The chain test on xor values whose start segment is the lowest: budgets 0, 1, 2, then 3 in all."""
    chain = (x & np.uint64(0xFFFF)) == 0
    chain &= np.bitwise_count(x & np.uint64(0xFFFFFFFF)) <= 1
    chain &= np.bitwise_count(x & np.uint64(0xFFFFFFFFFFFF)) <= 2
    chain[chain] = np.bitwise_count(x[chain]) <= 3
    return chain


def _unrotate(fp: np.ndarray, start: np.ndarray) -> np.ndarray:
    by = (start * SEGMENT).astype(np.uint64)
    return np.where(by == 0, fp, (fp << by) | (fp >> ((np.uint64(64) - by) & np.uint64(63))))


def _group_links(key: np.ndarray, fp: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal key (rows sorted by it), as two arrays of rotated fingerprints and starts."""
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    length = np.diff(edges)
    out_a, out_b = [], []
    short = np.repeat(length <= 64, length)
    rows = np.flatnonzero(short)
    left = np.repeat(edges[1:], length)[rows]
    lag = 1
    while len(rows):
        keep = rows + lag < left
        rows, left = rows[keep], left[keep]
        a, b = rows, rows + lag
        pair = base[a] | base[b]
        a, b = a[pair], b[pair]
        hit = _near(fp[a] ^ fp[b])
        out_a.append(a[hit])
        out_b.append(b[hit])
        lag += 1
    for k in np.flatnonzero(length > 64):
        span = np.arange(edges[k], edges[k + 1])
        bases = span[base[span]]
        for at in range(0, len(span), 256):
            part = span[at : at + 256]
            i, j = np.nonzero(_near(fp[part][:, None] ^ fp[bases][None, :]))
            out_a.append(part[i])
            out_b.append(bases[j])
    a, b = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (out_a, out_b))
    return a.astype(np.int64), b.astype(np.int64)


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges of the links under each key; rows arrive sorted by (key, block)."""
    held: list[tuple[np.ndarray, ...]] = []
    n_held = 0

    def links(part: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        key, block, fp, base = part
        start = (key >> 40) & 3
        group = np.unique(np.stack([key, block]), axis=1, return_inverse=True)[1].ravel()
        a, b = _group_links(group, fp, base)
        real = _unrotate(fp, start).view(np.int64)
        u, v = real[a], real[b]
        u, v = near_copies.forest(u[u != v], v[u != v])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy(zero_copy_only=False)))
        n_held += batch.num_rows
        if n_held < 200_000:
            continue
        whole = tuple(np.concatenate(x) for x in zip(*held))
        last = (whole[0] == whole[0][-1]) & (whole[1] == whole[1][-1])
        cut_at = int(np.argmax(last))  # the last group may go on in the next batch
        if cut_at:
            yield links(tuple(x[:cut_at] for x in whole))
        held = [tuple(x[cut_at:] for x in whole)]
        n_held = len(held[0][0])
    if n_held:
        yield links(tuple(np.concatenate(x) for x in zip(*held)))


def _keyed(nodes: DataFrame, r: int) -> DataFrame:
    """Rows (key, fp rotated to its start segment, base) of the length-two chains."""
    fp = F.col("fp")
    entries: list[Column] = []
    for i in range(SEGMENTS):
        turned = fp if i == 0 else F.shiftleft(fp, 64 - SEGMENT * i).bitwiseOR(F.shiftrightunsigned(fp, SEGMENT * i))
        seg = turned.bitwiseAND(F.lit(0xFFFF))
        ahead = F.shiftrightunsigned(turned, SEGMENT).bitwiseAND(F.lit((1 << r) - 1))
        key = F.lit(i << 40).bitwiseOR(F.shiftleft(seg, 20)).bitwiseOR(ahead)
        entries.append(F.struct(key.alias("key"), turned.alias("fp"), F.lit(True).alias("base")))
        for bit in range(r):
            has = ahead.bitwiseAND(F.lit(1 << bit)) != 0
            entries.append(F.when(has, F.struct(key.bitwiseXOR(F.lit(1 << bit)).alias("key"), turned.alias("fp"), F.lit(False).alias("base"))))
    return nodes.select(F.explode(F.array(*entries)).alias("e")).where("e is not null").select("e.key", "e.fp", "e.base")


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(u, v): edges whose components are those of all pairs of distinct ``fp`` within 3 bits."""
    n = nodes.count()
    r = min(SEGMENT, max(0, n.bit_length() - SEGMENT + 3))
    rows = _keyed(nodes, r)
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    hot = cut(sizes.select("key", F.ceil(F.col("n") / block).cast("int").alias("parts")))
    if hot.isEmpty():
        rows = rows.withColumn("pair", F.lit(0).cast("long"))
    else:
        mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("long")
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1), lambda j: F.least(mine, j) * 1_000_000_000 + F.greatest(mine, j))
        rows = rows.join(hot, "key", "left").select("key", "fp", "base", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(pairs)).alias("pair"))
    dealt = rows.select("key", "pair", "fp", "base").repartition("key", "pair").sortWithinPartitions("key", "pair")
    return dealt.mapInArrow(_link_batches, "u long, v long").distinct()


def _classes(nodes: DataFrame) -> DataFrame:
    """``nodes`` (one row a distinct ``fp``) with the ``root`` of its component."""
    roots = connected_components(links(nodes.select("fp")))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text)."""
    marks = cut(fingerprints(docs))
    named = _classes(cut(marks.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n"))))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = cut(named.join(least, "root").select("fp", "component_id", "n"))
    most = (classes.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = F.broadcast(classes.where(F.col("n") > most))  # fewer than HOT rows
    if hot.isEmpty():
        found = marks.join(classes, "fp")
    else:
        rest = marks.join(hot.select("fp"), "fp", "left_anti").join(classes.where(F.col("n") <= most), "fp")
        found = marks.join(hot, "fp").unionByName(rest)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, words: int = near_copies.SHINGLE, similarity: float = near_copies.SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: the one of least doc_id, null last.

    Links are those of ``near_copies``: shingles of ``words`` words, of which two texts share at least ``similarity``.  Chosen rows are found by their doc_id; only those whose doc_id is null or occurs twice are found by their fingerprint as well.
    """
    marks = cut(near_copies.marks(docs, words))
    order = F.struct(F.col("least_id").isNull().alias("none"), F.col("least_id"), F.col("fp"))
    chosen = cut(near_copies.classes(marks, similarity).groupBy("root").agg(F.min(order).alias("c")).select("c.fp", "c.least_id"))
    repeated = cut(marks.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    unclear = not repeated.isEmpty() or not chosen.where("least_id is null").isEmpty()
    clear = chosen.where("least_id is not null").select("least_id")
    if unclear:
        clear = clear.join(repeated, F.col("least_id") == F.col("doc_id"), "left_anti")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    side = small_side(clear)
    # beyond the size of a broadcast the ids are hashed, so that the texts needn't be sorted
    kept = rows.join(side if side is not clear else clear.hint("shuffle_hash"), F.col("id") == F.col("least_id"), "left_semi").select("row")
    if unclear:

        @F.pandas_udf("long")
        def fp_of(texts: pd.Series) -> pd.Series:
            return pd.Series(near_copies.text_nodes([t or "" for t in texts], words))

        nulls = rows.where("id is null")
        twice = rows.join(small_side(repeated), F.col("id") == F.col("doc_id"), "left_semi").unionByName(nulls)
        marked = twice.withColumn("f", fp_of(F.col("row.text").cast("string")))
        found = marked.join(small_side(chosen), (F.col("f") == F.col("fp")) & F.col("id").eqNullSafe(F.col("least_id")))
        kept = kept.unionByName(found.select("row", "fp").dropDuplicates(["fp"]).select("row"))
    return kept.select("row.*")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
