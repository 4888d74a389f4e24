"""Token files against the public library, and their layout."""

import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from llm.conftest import texts_of

from loomql.llm import op9_token_files as op


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op.default_tokenizer())
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def le(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_remembered_words_give_the_library_s_ids(library, docs, monkeypatch):
    rng = random.Random(7)
    parts = [" ", "  ", "\n", ".", ",", "a", "bc", "É", "1", "'s", "'", "!", "\x85", "ß", "😀", "日本", "́", "　", "\x1c", "\t"]
    texts = [t for _, t in texts_of(docs)] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    texts += ["", " ", "a  b", " lead", "trail ", "<|endoftext|> a", "it's 't don't"]
    monkeypatch.setattr(op, "CACHE_WORDS", 2000)
    code = op.ChunkEncoder(op.default_tokenizer())
    got = [x for at in range(0, len(texts), 50) for x in code.encode(texts[at : at + 50])]
    assert got == [le(x) for x in library(texts)]


def test_query(spark, docs, small, library):
    rows = {r["doc_id"]: tuple(r[1:]) for r in op.op9_token_files(spark, small).collect()}
    expected, at = {}, 0
    texts = sorted(texts_of(docs))
    for (i, _), ids in zip(texts, library([t for _, t in texts])):
        ids = [*ids, op.END_ID]
        expected[i] = (at, len(ids), zlib.crc32(le(ids)))
        at += len(ids)
    assert rows == expected


def test_layout(spark, docs, tmp_path):
    op.write_token_files(docs, str(tmp_path / "t"))
    files = sorted(Path(tmp_path / "t").glob("*.parquet"))
    last = None
    for file in files:
        meta = pq.ParquetFile(file)
        ids = meta.read(["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids) and (last is None or not ids or ids[0] > last)
        last = ids[-1] if ids else last
        for g in range(meta.metadata.num_row_groups):
            columns = {meta.metadata.row_group(g).column(c).path_in_schema: meta.metadata.row_group(g).column(c) for c in range(meta.metadata.num_columns)}
            (tokens,) = [c for p, c in columns.items() if p.startswith("ids")]
            assert any("DICTIONARY" in e for e in tokens.encodings) and tokens.compression == "ZSTD" and tokens.has_offset_index
            assert "DELTA_BINARY_PACKED" in columns["local_start"].encodings


def test_awkward_rows(spark, odd, empty, tmp_path, library):
    op.write_token_files(odd, str(tmp_path / "odd"))
    rows = op.read_token_digests(spark, str(tmp_path / "odd")).orderBy("start").collect()
    ids = [(*x, op.END_ID) for x in library([t or "" for _, t in texts_of(odd)])]
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((repr(i), len(x), zlib.crc32(le(x))) for (i, _), x in zip(texts_of(odd), ids))
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in rows]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    op.write_token_files(empty, str(tmp_path / "empty"))
    assert op.read_token_digests(spark, str(tmp_path / "empty")).count() == 0


def test_selective_reads(spark, docs, tmp_path):
    """A range of documents is read by pages, metadata without the ids' columns."""
    import pyarrow.parquet as pq

    folder = str(tmp_path / "files")
    many = docs.select("doc_id", "text").unionByName(docs.select((docs.doc_id + 1000).alias("doc_id"), "text")).unionByName(docs.select((docs.doc_id + 2000).alias("doc_id"), "text"))
    op.write_token_files(many, folder)
    every = {r["doc_id"]: r["ids"] for r in spark.read.parquet(folder).collect()}
    some = op.read_ids(spark, folder, 1010, 1019)
    assert {r["doc_id"]: r["ids"] for r in some.collect()} == {i: x for i, x in every.items() if 1010 <= i <= 1019}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,1010)" in plan and "ReadSchema: struct<doc_id:bigint,ids:array<int>>" in plan
    meta = op.read_metadata(spark, folder)
    assert "ids" not in meta._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert {r["doc_id"]: r["n_tokens"] for r in meta.collect()} == {i: len(x) for i, x in every.items()}
    file = max(tmp_path.glob("files/*.parquet"), key=lambda f: f.stat().st_size)
    group = pq.ParquetFile(file).metadata.row_group(0)
    columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
    assert all(c.has_column_index and c.has_offset_index for n, c in columns.items() if not n.startswith("ids")) and columns["doc_id"].statistics.has_min_max
    assert sum(c.total_compressed_size for n, c in columns.items() if not n.startswith("ids")) < 0.1 * sum(c.total_compressed_size for c in columns.values())


def test_long_texts_without_spaces(spark, library):
    texts = ["x" * 100_000, "日本語" * 20_000, "word " * 50_000]
    coder = op.ChunkEncoder(op.default_tokenizer())
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in coder.encode(texts)] == library(texts)
    assert max(map(len, coder.words), default=0) <= op.LONGEST_KEPT


def test_known_words_are_looked_up_once(library):
    """A new word in a text doesn't make the text's other words be looked up again."""

    class Counting(dict):
        calls = 0

        def get(self, *a):
            Counting.calls += 1
            return dict.get(self, *a)

    known = "the of and to in is it lowly river stone".split() * 100
    code = op.ChunkEncoder(op.default_tokenizer())
    code.encode([" ".join(known)])
    code.words = Counting(code.words)
    texts = [" ".join([*known, "wholly-new,", "words", *known]), " ".join(known)]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in code.encode(texts)] == library(texts)
    assert Counting.calls <= sum(len(t.split()) for t in texts) + 10


def test_a_column_s_different_words_are_looked_up_once(library):
    """Lookups grow with the different words of a column, not with its words."""

    class Counting(dict):
        calls = 0

        def get(self, *a):
            Counting.calls += 1
            return dict.get(self, *a)

    words = "the of and to in is it lowly river stone 1998, l'eau".split()
    texts = [" ".join([*words, f"new{i % 3}", *words] * 20) for i in range(100)]
    code = op.ChunkEncoder(op.default_tokenizer())
    code.words = Counting()
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in code.encode(texts)] == library(texts)
    assert Counting.calls <= 2 * (len(words) + 3)


def test_columns_with_nulls_and_offsets(library):
    """A slice of a column, with nulls: the end id follows each text."""
    import pyarrow as pa

    texts = ["cut off", "a river", None, "", " lead", "one", "a  b", "tail ", "x\u00a0 y z", "a river, a stone.", "cut off"]
    for kind in (pa.string(), pa.large_string()):
        ids, n = op.ChunkEncoder(op.default_tokenizer()).encode_column(pa.array(texts, kind)[1:-1], (2).to_bytes(4, "little"))
        expected = [[*x, op.END_ID] for x in library([t or "" for t in texts[1:-1]])]
        assert n.tolist() == list(map(len, expected)) and ids.to_pylist() == sum(expected, [])
    ids, n = op.ChunkEncoder(op.default_tokenizer()).encode_column(pa.array([], pa.string()))
    assert len(ids) == len(n) == 0


def test_frequent_words_outlive_a_full_memory(library, monkeypatch):
    """A memory that is full forgets words that weren't met lately; the others aren't encoded again."""
    monkeypatch.setattr(op, "CACHE_WORDS", 100)
    code, seen = op.ChunkEncoder(op.default_tokenizer()), []
    inner = code._words
    code._words = lambda words: seen.extend(words) or inner(words)
    for i in range(40):
        texts = [" ".join(["the", "river", *(f"w{i}x{j}" for j in range(20)), "stone"])]
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in code.encode(texts)] == library(texts)
        assert len(code.words) + len(code.last) <= 100 + 2 * 22
    assert seen.count("river") == seen.count("stone") == 1
