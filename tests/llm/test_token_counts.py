import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tablework.llm import token_counts as X
from tablework.llm.pieces import Table

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def transducer():
    return X.Transducer(X.Vocabulary.load(PATH))


def check(transducer, lib, texts):
    got = transducer.count(texts)
    want = [len(lib.encode(t)) for t in texts]
    assert [(t[:50], int(g), w) for t, g, w in zip(texts, got, want) if g != w] == []


def test_odd_texts(transducer, lib):
    check(transducer, lib, ["a  b", " a", "a ", "", "\n\n", "a\tb", "▁x", "　x", "é é", "ﬁ", "<s>hi</s>", "<0x41>",
                            "<unk>", "   ", "日本語テキスト 中文", "🙂🙂 ok", "\x00a", "a\r\nb", " " * 77, "a" + " " * 77])


def test_random_texts(transducer, lib):
    rng = random.Random(4)
    bits = ["the", "ing", " ", "  ", "a", "é", "re", "tion", "x", "\n", "12", "un", "able", " def", "(", "    ", "return",
            "日", "в", "ы", "=", "--", "é"]
    check(transducer, lib, ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(2000)])


def test_long_stretches_are_composed_from_chunks(transducer, lib, monkeypatch):
    rng = random.Random(6)
    texts = ["x" * 5000, "ab" * 3000, "the" * 4000, "=" * 6000, "".join(rng.choice("etaoinsh") for _ in range(20000)), " " * 9000]
    check(transducer, lib, texts)
    # a warm-up shorter than the machine's memory makes states disagree: chunks are run again
    monkeypatch.setattr(X, "WARM", 20)
    monkeypatch.setattr(X, "CHUNK", 40)
    transducer.counts.clear()
    check(transducer, lib, texts)


def test_table_grows():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 60, 50_000))
    t = Table(keys[:10], keys[:10] % 7)
    t.add(keys[10:], keys[10:] % 7)
    assert (t.find(keys) == keys % 7).all() and (t.find(keys + (1 << 61)) == -1).all()


def test_query_shape(spark, lib):
    rows = [(1, "hello wörld"), (2, None), (3, ""), (None, "x"), (1, "hello wörld"), (4, "word " * 5000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_tokens string")
    out = X.token_counts(df, PATH)
    assert out.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    want = [(i, len((t or "").encode()), len(lib.encode(t or "")), len(lib.encode(t or "")) > 4096) for i, t in rows]
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    assert X.token_counts(df.where("false"), PATH).count() == 0
