import random

import numpy as np
import public_tokenizers
import pytest
import zlib
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakescribe.llm.token_counts import token_counts
from lakescribe.llm.token_files import decode_ranks, encode_ranks, read_token_files, token_files, write_token_files
from lakescribe.llm.tokens import encoder
from tests.oracle import session

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
HARD = [None, "", " ", "  a", "a  b ", "a \n b", "<|endoftext|> x<|endoftext|>y", "it's 't 's  're", "a" * 30_000, "x " * 20_000, "é è　 z", "\x85 a \x85b", "a​b c", "1 2 3,4 ,", "same", "same"]


@pytest.fixture(scope="module")
def docs():
    spark = session()
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(HARD)], "doc_id long, text string, _id string, n_tokens int")


def test_pieces_give_the_librarys_ids():
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "'s", "1", "é", ".", "\t", "<|endoftext|>", "\xa0", "漢", "\x1c", "​", "THE", "_", "<|", "²", "word", ",", ".", "!?", "é", "\r", '"']
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    whole = Tokenizer.from_file(VOCABULARY).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder(VOCABULARY).encode(texts)] == [e.ids for e in whole]


def test_special_strings_of_other_vocabularies(tmp_path):
    from tokenizers import AddedToken

    library = Tokenizer.from_file(VOCABULARY)
    library.add_special_tokens([AddedToken("[SEP]", special=True), AddedToken("zq", special=True)])
    library.save(f"{tmp_path}/t.json")
    texts = ["hello a [SEP] b", "x[SEP]y azqb zq. zq [SEP", "[SEP][SEP]  zq", "word, word. Word! it's \n\nnew.\nline a_b __ x-y"] * 3
    got = [np.frombuffer(x, encoder(f"{tmp_path}/t.json").dtype).tolist() for x in encoder(f"{tmp_path}/t.json").encode(texts)]
    assert encoder(f"{tmp_path}/t.json").safe and got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_counts(docs):
    want = [len(Tokenizer.from_file(VOCABULARY).encode(t or "", add_special_tokens=False).ids) for t in HARD]
    got = sorted(token_counts(docs, VOCABULARY).collect())
    assert [(r.doc_id, r.n_tokens, r.over_limit) for r in got] == [(i, n, n > 1024) for i, n in enumerate(want)]
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in HARD]
    assert token_counts(docs.limit(0), VOCABULARY).count() == 0
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = sorted(token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).collect())
    assert [r.n_tokens for r in got] == [len(pieces.encode(t or "")) for t in HARD]


def test_coding_round_trip():
    ranks = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7] + list(range(1000)), dtype=np.uint32)
    for n in (0, 1, 3, 4, 5, len(ranks)):
        control, data = encode_ranks(ranks[:n])
        assert len(control) == -(-n // 4)
        assert decode_ranks(control, data, n).tolist() == ranks[:n].tolist()


def test_files(docs, tmp_path):
    library = Tokenizer.from_file(VOCABULARY)
    start, want = 0, []
    for i, t in enumerate(HARD):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files(docs.repartition(5), VOCABULARY).collect()
    assert sorted(map(tuple, got)) == want
    path = f"file://{tmp_path}/t"
    write_token_files(docs, path, VOCABULARY)
    back = {r.doc_id: r.ids for r in read_token_files(docs.sparkSession, path, with_ids=True).collect()}
    assert back[5] == library.encode(HARD[5], add_special_tokens=False).ids
    assert back[0] == []


def test_files_edges(docs):
    assert token_files(docs.limit(0), VOCABULARY).count() == 0
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id") % 5))
    got = sorted(token_files(odd, VOCABULARY).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in odd.select("doc_id").collect()), key=lambda x: (x is not None, x or 0))


def test_full_table_stays_as_it_is_and_words_give_the_librarys_ids(monkeypatch):
    from lakescribe.llm import tokens

    class Kept(dict):
        def pop(self, *a):
            raise AssertionError("a piece was put into the full table and taken out again")

    monkeypatch.setattr(tokens, "KEPT_PIECES", 50)
    e = tokens.PieceEncoder(VOCABULARY)
    e.kept = Kept()
    rng = random.Random(2)
    letters = [chr(c) for c in range(0xC0, 0x180)] + list("abcXYZ")
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 45))) + rng.choice(["", "", ",", "...", "<|", "\nNd"])
    for extra in ([], ["x <|endoftext|>y <| z"]):
        texts = [" ".join(word() for _ in range(60)) for _ in range(20)] + extra
        whole = Tokenizer.from_file(VOCABULARY).encode_batch(texts, add_special_tokens=False)
        assert [np.frombuffer(x, "<u2").tolist() for x in e.encode(texts)] == [x.ids for x in whole]
    assert len(e.kept) == 50 and all(len(p) <= tokens.KEPT_LENGTH for p in e.kept)


def test_arrays_are_cut_in_arrow_and_a_piece_is_met_once():
    import pyarrow as pa

    from lakescribe.llm import tokens

    class Kept(dict):
        met = []

        def get(self, piece, *a):
            self.met.append(piece)
            return dict.get(self, piece, *a)

    library = Tokenizer.from_file(VOCABULARY)
    e = tokens.PieceEncoder(VOCABULARY)
    texts = ["the end.\nThe  end", "the end.\nThe end", "\nThe end\n\n\nThe end\n's 's\n1 <|x\n<|endoftext|>\nend", "the \n end", "", "The", "\n", "a\r\n b\x85", "end.\n\n\n\n\nend \u2028 x"]
    texts += ["\n".join(["le garçon a été là."] * n) for n in range(1, 6)] + ["a" + "\n" * n + "b" for n in range(12)] + ["Āſ ŀx,\nÀß!!\nÝ." * n for n in range(4)]
    for some in (texts, texts[4:5], texts[1:2], texts[3:4], texts[:0], texts[::-1], texts):
        coded = e.encode_array(pa.array(["x", *some], pa.string())[1:], b"\2\0")
        want = [[*x.ids, 2] for x in library.encode_batch(some, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u2").tolist() for x in coded.to_pylist()] == want
        assert e.ids(coded).tolist() == [i for ids in want for i in ids]
    e.kept = Kept(e.kept)
    e.encode_array(pa.array(["the end.\nThe end of the end.\nThe end"] * 100, pa.string()))
    assert sorted(e.kept.met) == sorted(["the", "end.", "\nThe", "end", "of"])
