import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm.tokens import encoder, safe_parts

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
HARD = [
    "", " ", "\n", "  a", "a  ", "a \n b", "a\n\n b  \t c ", "x1 22 3a", "don't we'll 'tis", "<|endoftext|> a<|endoftext|>b", "<|startoftext|>",
    "Ünïcode ÀÉÎ ß straße œuvre Œ", "日本語 テキスト", "é é", "İstanbul ΣΑΣ", "a×b÷c", "\x00\x01 \x1c\x1d a\x85b c d", "…—“q”", "🙂🙂 ok", "..!! ?? a,b;c", "\r\n\x0b\x0c x",
    "a" * 3000, "word " * 20000, "x\n" * 50,
]


@pytest.mark.parametrize("name", FILES)
def test_as_the_library(name):
    lib, own = Tokenizer.from_file(public_tokenizers.path(name)), encoder(public_tokenizers.path(name))
    texts = HARD + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    column = pa.array([*texts, None])
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)] + [[]]
    got = []
    for a, b, flat, off in own.ids(column):
        got += [flat[off[i] : off[i + 1]].tolist() for i in range(b - a)]
    assert got == want
    assert own.counts(column).tolist() == [len(x) for x in want]


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(alphabet=" \n\tabZÉéß1.,'<|×x\x1c ", max_size=20), max_size=5))
def test_any_mixture(name, texts):
    lib, own = Tokenizer.from_file(public_tokenizers.path(name)), encoder(public_tokenizers.path(name))
    assert own.counts(pa.array(texts, pa.string())).tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("name", FILES)
def test_parts_of_long_texts(name):
    own = encoder(public_tokenizers.path(name))
    text = "日本 word, it's  fine day \n" * 300
    parts = safe_parts(text, 100)
    assert "".join(parts) == text and len(parts) > 10
    assert np.concatenate([np.array(own.lib.encode(p, add_special_tokens=False).ids) for p in parts]).tolist() == own.lib.encode(text, add_special_tokens=False).ids
