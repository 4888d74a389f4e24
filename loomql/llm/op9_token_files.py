"""Token ids as Parquet list columns, written in document order and read back.

Layout: one row per document with ``doc_id``, ``part`` (the file's number), ``local_start``
(ids before it in the file), ``n_tokens`` and ``ids`` (list of 32-bit ids, the end id last).  Files
follow ascending doc_id.  The ids are dictionary encoded (a vocabulary's ids fit a 1 MB dictionary
page, so an id takes as many bits as the file's own vocabulary needs), the metadata columns are
delta encoded, row groups are ``ROW_GROUP`` bytes and pages ``PAGE`` bytes with a page index, so a
reader can fetch metadata alone, or the pages of one document.

Cost: documents are dealt by ranges of (doc_id, hash of the text) as text, which is smaller than ids,
and encoded where they are written; Python looks up each different word of a batch once, Arrow puts the ids together.
A global running total needs only one number per file.  ``read_metadata`` reads the delta-encoded
columns alone, ``read_ids`` the pages of a range of documents.

Defined cases: a null text is an empty one and has the end id alone; a very long text, with or without spaces, is encoded whole; null doc_ids come first;
rows of equal doc_id are ordered by a hash of their text and repeated rows all stay; an empty table
gives none; other columns of the input are ignored whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomql.llm.batches import bound_batches, held, slices
from loomql.plans.scratch import new_folder

END_ID = 2
ROW_GROUP = 16 << 20
PAGE = 256 << 10
#: Bounds of a worker's memory of words: their number, and the characters of one (longer ones aren't kept).
CACHE_WORDS, LONGEST_KEPT = 1_200_000, 48
#: Bytes of text that are encoded at once: the more, the fewer of their words are different ones.
RUN = 4 << 20
_FILE = "doc_id long, part int, local_start long, n_tokens int, ids array<int>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ChunkEncoder:
    """Encodes with the ``tokenizers`` library, remembering the ids of space-led words.

    The byte-level pre-tokeniser always breaks before a single space that stands between two
    characters other than white space, and between a letter and a full stop or comma.  So the
    ids of a text are those of its parts at such places, and a part's ids can be remembered.  A
    text with other white space around a space goes to the library whole.  The memory is
    bounded by ``CACHE_WORDS``: a worker that has filled half of it starts the half anew and
    keeps the last one, from which words that are met again return.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.leads = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)  # ids that begin with a space
        self.leads[[i for piece, i in self.tokenizer.get_vocab().items() if piece.startswith("\u0120")]] = True
        self.words: dict[str, bytes] = {}
        self.last: dict[str, bytes] = {}
        self.fresh: list[str] = []

    def _library(self, texts: list[str]) -> list[bytes]:
        many = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in many(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of " " + word for words that have no space in them and no white space at either end.

        The library gets them in long runs; as only a word's first token holds a space, the runs are cut there.
        """
        runs = ["".join([" " + w for w in words[at : at + 512]]) for at in range(0, len(words), 512)]
        raw = b"".join(self._library(runs))
        cuts = np.flatnonzero(self.leads[np.frombuffer(raw, dtype="<u4")]) * 4
        cuts = [*cuts.tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, words: list[str]) -> None:
        """Puts words into the memory, but for those that no memory can hold."""
        plain, rest = [], []
        for w in words:
            (plain if w.isalpha() else rest).append(w)
        odd = {w for w in rest if not w or w[0].isspace() or w[-1].isspace()}
        split, known = {}, self.words
        self.fresh = words
        for w in rest:
            core = w.rstrip(".,")
            if core != w and core and core[-1].isalpha() and w not in odd:
                split[w] = core
            elif w not in odd:
                plain.append(w)
        plain += set(split.values()).difference(known).difference(plain)
        known.update(zip(plain, self._words(plain)))
        ends = list({w[len(core) :] for w, core in split.items()})
        end_ids = dict(zip(ends, self._library(ends)))
        known.update({w: known[core] + end_ids[w[len(core) :]] for w, core in split.items()})

    def encode_column(self, texts: pa.Array, end: bytes = b"") -> tuple[pa.Array, np.ndarray]:
        """The ids of a column's texts (null: empty) in a row, with the ids ``end`` after each text, and how many each text has.

        Arrow cuts the texts into words, numbers the different ones and puts the ids of all together, so Python sees each different word once.
        """
        if len(self.words) > CACHE_WORDS // 2:
            self.words, self.last = {}, self.words
        self.fresh = []
        n, get = len(texts), self.words.get
        parts = pc.split_pattern(pc.fill_null(texts, ""), " ")
        starts = parts.offsets.to_numpy().astype(np.int64)
        n_parts, starts = np.diff(starts), starts[:-1] - starts[0]
        coded = parts.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        head = np.zeros(len(at), dtype=bool)
        head[starts] = True
        led = np.zeros(len(words), dtype=bool)  # words that follow a space somewhere
        led[at[~head]] = True
        found = list(map(get, words))
        gaps = [j for j, x in enumerate(found) if x is None and led[j]]
        if gaps and self.last:
            back = {words[j]: x for j in gaps if (x := self.last.get(words[j])) is not None}
            self.words.update(back)
            for j in gaps:
                found[j] = back.get(words[j])
            gaps = [j for j in gaps if found[j] is None]
        if gaps:
            self._learn([words[j] for j in gaps])
        odd = np.zeros(len(words), dtype=bool)
        for j in gaps:
            found[j] = get(words[j])
            odd[j] = found[j] is None
        # texts with other white space around a space, or before the first one, go to the library whole
        heads = [words[j] for j in at[starts].tolist()]
        single = (n_parts == 1) | np.array([not w or w[-1].isspace() for w in heads], dtype=bool)
        single[np.searchsorted(starts, np.flatnonzero(odd[at] & ~head), side="right") - 1] = True
        alone = np.flatnonzero(single)
        for i, text in zip(alone.tolist(), texts.take(pa.array(alone)).to_pylist()):
            heads[i] = text or ""
        for w in self.fresh:
            if len(w) > LONGEST_KEPT:
                self.words.pop(w, None)
        # a text's slots: its head (or all of it), its other words, its end
        pool = pa.array([*found, *self._library(heads), end], pa.large_binary())
        kept = head | ~np.repeat(single, n_parts)
        at[starts] = len(words) + np.arange(n)
        ends = np.cumsum(np.where(single, 1, n_parts) + 1)
        slots, inner = np.full(int(ends[-1]) if n else 0, len(words) + n), np.ones(int(ends[-1]) if n else 0, dtype=bool)
        inner[ends - 1] = False
        slots[inner] = at[kept]
        _, bounds, ids = pool.take(pa.array(slots)).buffers()
        bounds = np.frombuffer(bounds, dtype=np.int64, count=len(slots) + 1)[np.r_[0, ends]] // 4 if n else np.zeros(1, np.int64)
        return pa.Array.from_buffers(pa.int32(), int(bounds[-1]), [None, ids]), np.diff(bounds)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, n = self.encode_column(pa.array(texts, pa.string()))
        ids, ends = ids.to_numpy().astype("<i4", copy=False), np.cumsum(n)
        return [ids[b - k : b].tobytes() for b, k in zip(ends.tolist(), n.tolist())]


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder for a tokenizer file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return held(("tokenizers", path), lambda: ChunkEncoder(path))


def _encode_batches(path: str, end_id: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, end = TaskContext.get().partitionId(), 0, np.array([end_id], dtype="<u4").tobytes()
        code = encoder(path)
        for batch in batches:
            for piece in slices(batch, 1, RUN):
                ids, n = code.encode_column(piece.column(1), end)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), ids)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(done + ends - n), pa.array(n.astype(np.int32)), lists], ["doc_id", "part", "local_start", "n_tokens", "ids"])
                done += int(ends[-1])

    return work


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Write the ids of every text to Parquet files in ``folder``, in ascending doc_id order."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    coded = dealt.mapInArrow(_encode_batches(tokenizer or default_tokenizer(), end_id), _FILE)
    options = {
        "compression": "zstd", "parquet.block.size": str(ROW_GROUP), "parquet.page.size": str(PAGE), "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true", "parquet.dictionary.page.size": str(1 << 20),
    }
    coded.write.options(**options).parquet(folder)


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        raw, at = memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B"), ids.offsets.to_numpy()
        sums = [zlib.crc32(raw[4 * int(a) : 4 * int(b)]) for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def read_token_digests(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of token files, from the ids as they are stored."""
    files = spark.read.schema(_FILE).parquet(folder)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = files.select("doc_id", "part", "local_start", "ids").mapInArrow(_digest_batches, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(offsets, "part").select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def read_metadata(spark, folder: str) -> DataFrame:
    """(doc_id, part, local_start, n_tokens) of token files; the ids' pages aren't read."""
    return spark.read.schema(_FILE).parquet(folder).select("doc_id", "part", "local_start", "n_tokens")


def read_ids(spark, folder: str, first: int, last: int) -> DataFrame:
    """(doc_id, ids) of the documents from ``first`` to ``last``: files and row groups are chosen by their statistics, pages by their index."""
    return spark.read.schema(_FILE).parquet(folder).where(F.col("doc_id").between(first, last)).select("doc_id", "ids")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_token_digests(spark, folder)
