"""The transducer against the public library and against all paths."""

import random

import numpy as np
import pytest
import sentencepiece
from llm.conftest import texts_of
from sentencepiece import sentencepiece_model_pb2 as pb

from loomql.llm import op4_sentencepiece as op


@pytest.fixture(scope="module")
def machine():
    return op.encoder(op.default_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=op.default_model())


AWKWARD = ["", " ", "  ", "a  b", "a \n b", " lead", "trail ", "x\n", "\n", "\t a", "▁a ▁ b▁", "a▁ b", "<s> </s> <0x41>", "ﷺ ½ 日本 😀", "a" * 200, "    x     y", "\x00\x01", "é"]


def test_equals_the_library(machine, library, docs):
    rng = random.Random(4)
    parts = [" ", "  ", "\n", ".", ",", "a", "bc", "É", "1", "'s", "!", "▁", "ß", "😀", "the", "ing", "tion", "http"]
    texts = [t for _, t in texts_of(docs)] + AWKWARD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    got = [np.frombuffer(x, dtype="<u4").tolist() for x in machine.encode(texts)]
    assert got == library.encode(texts)
    assert [machine.decode(x) for x in got] == [library.decode(x) for x in got]


def test_path_is_the_least_of_all(machine):
    """With the merge constraint one segmentation is accepted, the one the merges yield; without it the path weighs as little as any."""
    m = machine.machine
    number = {s: k for k, s in enumerate(m.symbols)}

    def all_paths(text):
        if not text:
            yield []
        for k in range(1, len(text) + 1):
            if (q := number.get(text[:k])) is not None:
                for rest in all_paths(text[k:]):
                    yield [q, *rest]

    rng = random.Random(6)
    texts = [" " + "".join(rng.choice("theringoz") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    ids, weights = m.shortest_paths(texts)
    for text, found, w in zip(texts, ids, weights):
        ok = [p for p in all_paths(text) if m.follows(np.array(p[:-1], np.int64), np.array(p[1:], np.int64)).all()]
        assert len(ok) == 1 and m.id_of[ok[0]].tolist() == found.tolist() and w == pytest.approx(m.weight[ok[0]].sum())
        assert [m.symbols[q] for q in ok[0]] == m.merged(text)[0]
    m.constrained = False
    try:
        for text, w in zip(texts, m.shortest_paths(texts)[1]):
            assert w == pytest.approx(min(m.weight[p].sum() for p in all_paths(text)))
    finally:
        m.constrained = True


def test_remembered_words_change_nothing(library, monkeypatch):
    monkeypatch.setattr(op, "CACHE_BYTES", 2000)
    machine = op.Encoder(op.default_model())
    texts = ["one two three four five six", "two seven  eight", "one", "nine ten two", "x" * 100] * 3
    assert [np.frombuffer(x, dtype="<u4").tolist() for t in texts for x in machine.encode([t])] == library.encode(texts)
    assert machine.held <= 2000 and len(machine.old) < 12 and not any(len(w) > op.LONGEST_KEPT for w in {**machine.young, **machine.old})


def test_long_texts_without_spaces(machine, library):
    rng = random.Random(8)
    texts = ["x" * 20_000, "".join(rng.choice("abcdefghij") for _ in range(20_000)), "日本語" * 5000, "word " * 20_000, "a\n" * 5000]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in machine.encode(texts)] == library.encode(texts)


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("strip", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
def test_normalisers(rule, strip, prefix, docs):
    """Models with character maps, white-space removal and without a dummy prefix: the public model with another normaliser."""
    proto = pb.ModelProto()
    with open(op.default_model(), "rb") as file:
        proto.ParseFromString(file.read())
    made = pb.ModelProto()
    made.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = made.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.add_dummy_prefix = strip, prefix
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    machine = op.Encoder(proto.SerializeToString())
    texts = [*AWKWARD, "①②　ｆｕｌｌ ｗｉｄｔｈ", "e\u0301 A\u030a ﬁn", "ÀÉ straße ΑΒΓ", "\u200b \u00a0 x", "가각", *[t for _, t in texts_of(docs)][:6]]
    got = [np.frombuffer(x, dtype="<u4").tolist() for x in machine.encode(texts)]
    assert got == library.encode(texts)
    assert [machine.decode(x) for x in got] == [library.decode(x) for x in got]


def test_query_and_awkward_rows(spark, odd, empty, library):
    rows = op.encode_documents(odd).collect()
    by = sorted((repr(r["doc_id"]), r["ids"]) for r in rows)
    assert by == sorted((repr(i), library.encode(t or "")) for i, t in texts_of(odd))
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in rows)
    assert op.encode_documents(empty).count() == 0


def test_query_returns_ids_and_they_decode(spark, odd, empty, docs, small, library):
    rows = {r["doc_id"]: r for r in op.op4_sentencepiece(spark, small).collect()}
    assert {i: r["ids"] for i, r in rows.items()} == {i: library.encode(t) for i, t in texts_of(docs)}
    for df in (docs, odd):
        back = op.decode_documents(op.encode_documents(df))
        assert back.columns == ["doc_id", "text"]
        assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=repr) == sorted(((i, (t or "").replace("▁", " ")) for i, t in texts_of(df)), key=repr)
    ids = [([],), (None,), ([3 + 0xC3],), (library.encode("a b"),)]
    got = op.decode_documents(spark.createDataFrame([(k, *x) for k, x in enumerate(ids)], "doc_id long, ids array<int>")).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [library.decode(x or []) for x, in ids]
    assert op.decode_documents(op.encode_documents(empty)).count() == 0
