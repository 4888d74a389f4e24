"""SentencePiece encoding and decoding as a shortest path through a weighted transducer.

``loomql.llm.transducer`` compiles a model file and finds least paths.  A text is normalised whole and cut
before every space that follows another character, where no piece can reach across; the paths of such words
are found together, as arrays, and a worker remembers those of short words in at most ``CACHE_BYTES``, whatever the texts
hold: of two generations of words the older goes when the younger is full.  Batches are small (``batches.bound_batches``) and a text is held by itself, so memory follows the longest text.

Defined cases: a null text is an empty one and has no ids; an empty text has no ids; a very long text, with or
without spaces, is encoded whole; repeated rows all stay; an empty table gives none; other columns of the input are
ignored whatever their names.  Decoding gives the text back except that U+2581 itself comes back as a space; null ids are
decoded as none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomql.llm.batches import bound_batches, held, runs
from loomql.llm.transducer import SPACE, Transducer

CACHE_BYTES = 40 << 20
LONGEST_KEPT, WORD_BYTES = 40, 190
_WORD = re.compile(" *[^ ]+| +")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Encoder:
    """A transducer with a bounded memory of words' ids."""

    def __init__(self, model: str | bytes):
        self.machine = Transducer(model)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0  # estimated bytes of the younger generation

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [_WORD.findall(self.machine.normalise(t)) for t in texts]
        wanted = set(chain.from_iterable(cut)).difference(self.young)
        if wanted:
            found = {w: self.old[w] for w in wanted if w in self.old}
            new = [w for w in wanted if w not in found]
            found.update(zip(new, (x.tobytes() for x in self.machine.shortest_paths(new)[0])))
            short = {w: x for w, x in found.items() if len(w) <= LONGEST_KEPT}
            self.young.update(short)
            self.held += sum(map(len, short.values())) + WORD_BYTES * len(short)
            known = self.young if len(short) == len(found) else {**self.young, **found}
        else:
            known = self.young
        if self.held > CACHE_BYTES // 2:
            self.old, self.young, self.held = self.young, {}, 0
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def decode(self, ids: list[int]) -> str:
        return self.machine.decode(ids)


def encoder(model: str) -> Encoder:
    """This worker's encoder for a model file."""
    return held(("sentencepiece", model), lambda: Encoder(model))


def _piece_batches(path: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            for part, texts in runs(batch, 1):
                ids = code.encode(texts)
                lists = [np.frombuffer(x, dtype="<u4") for x in ids]
                back = [code.decode(x.tolist()).encode() for x in lists]
                offsets = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists).astype(np.int32)))
                same = [b == t.replace(SPACE, " ").encode() for b, t in zip(back, texts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), column, pa.array([len(x) for x in lists], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([zlib.crc32(b) for b in back], pa.int64()), pa.array(same)],
                    ["doc_id", "ids", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip"],
                )

    return work


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, n_pieces, ids_crc32, decoded_crc32, round_trip) for every row of ``docs``.

    ``ids`` are the piece ids; the crc32 values are unsigned, of the ids as little-endian unsigned 32-bit
    integers and of the UTF-8 text decoded from them; ``round_trip`` tells whether that text is the input.
    """
    bound_batches(docs.sparkSession)
    schema = "doc_id long, ids array<int>, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_piece_batches(model or default_model()), schema)


def _text_batches(path: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = pa.array([code.decode(x or []) for x in part.column(1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts], ["doc_id", "text"])

    return work


def decode_documents(coded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) for every row of ``coded`` (doc_id, ids): the text that the piece ids stand for."""
    bound_batches(coded.sparkSession)
    rows = coded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return rows.mapInArrow(_text_batches(model or default_model()), "doc_id long, text string")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
