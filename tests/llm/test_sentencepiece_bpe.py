"""Ids and decoded texts against the sentencepiece library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from corpusloom.llm import sentencepiece_bpe as spb


SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)
TEXTS = ["", " ", "   a  b ", "\n\n\t\r\x00", "▁a▁ ▁", "日本語テキスト と é", "\U0001f642\U0010ffff�", "<s></s><unk><0x0A>", "x" * 3000, " " * 500, "it's 3.14, isn't_it?", "ab" * 40_000]


def same(bpe, text):
    ids = np.frombuffer(bpe.encode(text), "<u4").tolist()
    expected = LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert ids == expected
    assert bpe.decode(ids).decode() == LIBRARY.decode(expected)


@pytest.fixture(scope="module")
def bpe():
    return spb.PieceBpe(PATH)


def test_odd_texts(bpe):
    for text in TEXTS:
        same(bpe, text)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(bpe, text):
    same(bpe, text)


def test_texts_of_pieces(bpe):
    rng = random.Random(3)
    for _ in range(1500):
        same(bpe, "".join(LIBRARY.id_to_piece(rng.randint(259, 31999)) for _ in range(rng.randint(1, 12))).replace("▁", " "))
        same(bpe, "".join(rng.choice("etain .,'\n") for _ in range(rng.randint(1, 200))))


def test_any_ids(bpe):
    rng = random.Random(4)
    for _ in range(2000):
        ids = [rng.choice([rng.randint(0, 31999), rng.randint(3, 258), rng.randint(0, 2), 29871]) for _ in range(rng.randint(0, 9))]
        assert bpe.decode(ids).decode() == LIBRARY.decode(ids)


def test_each_prefix_ends_in_its_own_last_token(bpe):
    text = "▁The▁unbelievable▁antidisestablishmentarians'▁ééxç"
    last = bpe.table.last_tokens(text)
    for end in range(1, len(text) + 1):
        piece = bpe.table.text_of.get(last[end]) or chr(-1 - last[end])
        assert bpe.table.encoded(text[:end])[-1:] == ([last[end]] if last[end] >= 0 else [bpe.table.byte_ids[piece.encode()[-1]]])
        assert text[:end].endswith(piece)


def test_other_vocabularies():
    """Against the joins themselves: pieces that are no token of their own text, equal scores, marks inside pieces."""
    rng = random.Random(5)
    for round_ in range(60):
        letters = "ab▁." if round_ % 2 else "abc"
        pieces = {p: (i, float(rng.randint(-6, 0))) for i, p in enumerate({"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(14)} | set(letters))}
        table = spb.PrefixTable(pieces, list(range(1000, 1256)))
        for _ in range(60):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 24)))
            s = list(text)
            while True:
                best = max(((pieces[s[k] + s[k + 1]][1], -k) for k in range(len(s) - 1) if s[k] + s[k + 1] in pieces), default=None)
                if best is None:
                    break
                s[-best[1] : 2 - best[1]] = [s[-best[1]] + s[1 - best[1]]]
            assert [i for part in table.parts(text) for i in table.encoded(part)] == [pieces[x][0] for x in s]


def test_bounded_tables(bpe):
    small = spb.PrefixTable(bpe.table.pieces, bpe.table.byte_ids, limit=3)
    words = [f"▁word{k}" for k in range(50)]
    assert [small[w] for w in words] == [bpe.table[w] for w in words]
    assert len(small) == 3


def test_documents(spark):
    rows = [(k, TEXTS[k % len(TEXTS)]) for k in range(40)] + [(None, "x"), (7, None), (7, None)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, ids int, n_tokens string")
    got = spb.encode_documents(docs, PATH)
    expected = sorted(((i, np.asarray(LIBRARY.encode(t or "", add_bos=True, add_eos=True), "<u4").tobytes()) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, bytes(r.ids)) for r in got.collect()), key=repr) == expected
    assert sorted(map(tuple, spb.decode_documents(got, PATH).collect()), key=repr) == sorted(((i, LIBRARY.decode(LIBRARY.encode(t or ""))) for i, t in rows), key=repr)
    assert spb.encode_documents(docs.limit(0), PATH).collect() == []


def test_query(spark):
    from corpusloom.llm.queries import op13_sentencepiece

    def digests(text):
        ids = LIBRARY.encode(text, add_bos=True, add_eos=True)
        return len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = op13_sentencepiece(spark, SF).collect()
    assert len(got) == len(texts)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(texts[r.doc_id]) for r in got)
