import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablecraft.llm import bpe, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as file:
    CODEC = bpe.Codec(file.read())

TEXTS = [
    None,
    "",
    " ",
    "  a  b\n\n\tc ",
    "It's we'll they'd I'M don't",
    "<|endoftext|>",
    "a<|endoftext|> b<|endoftext|><|endoftext|>c <|endoftex|>",
    "élève naïve über straße 東京 العربية 👩‍👩‍👧   x​",
    "1234567890 ¾ ٣ ½ $$$ ### hello###world",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 20,
    "word another, line\nnext " * 9000,
    "x" * 70_000,
    "\x00\x01\x7f\r\n\x0b\x0c",
]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("text", TEXTS)
def test_ids_and_text_as_the_library(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    assert CODEC.encode(text or "") == ids
    assert CODEC.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert CODEC.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODEC.decode(CODEC.encode(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=12))
def test_any_ids(ids):
    assert CODEC.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t.'é$1<|endoftext|>", max_size=80), st.integers(1, 9))
def test_parts_add_up(text, size):
    parts = list(tokens.pieces(text, size))
    assert "".join(parts) == text
    count = lambda t: len(LIBRARY.encode(t, add_special_tokens=False))
    assert sum(map(count, parts)) == count(text)


def test_queries_on_odd_rows(spark, rows):
    data = [(i, t, "x", 7) for i, t in enumerate(TEXTS)] + [(None, "same", "x", 7), (3, "same", "x", 7), (3, "same", "x", 7)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_tokens string, ids int").repartition(3)
    expected = []
    for doc, text, *_ in data:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        expected.append((doc, text or "", ids))
    assert rows(bpe.round_trip(docs)) == sorted(
        ((d, len(i), digest(",".join(map(str, i))), digest(t)) for d, t, i in expected), key=repr
    )
    assert rows(tokens.token_counts(docs)) == sorted(
        ((d, len(t.encode()), len(i), len(i) > 512) for d, t, i in expected), key=repr
    )
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(none).count() == 0 and tokens.token_counts(none).count() == 0


def test_columns_of_ids(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    encode, decode = bpe.encode_column(spark), bpe.decode_column(spark)
    back = docs.select("text", decode(encode("text")).alias("back")).collect()
    assert all((r.text or "") == r.back for r in back)


def test_sentencepiece_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    found = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, path=path).collect()}
    assert found == {i: len(model.encode(t or "")) for i, t in enumerate(TEXTS)}
