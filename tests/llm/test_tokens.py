from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import tokens as K

pytestmark = pytest.mark.skipif(not (Path(K.TOKENIZERS) / "byte_bpe_50k.json").exists(), reason="vocabulary files are not here")


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(Path(K.TOKENIZERS) / "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


TEXTS = ["Hello world, it's 2024!", "<|endoftext|> typed", "我把钥匙留在这里了。", "नमस्ते दुनिया", "👩‍👩‍👧 🇵🇹", "  spaces \n\n\t tabs  ", "a" * 5000, "Größe" * 300, "\x00\x01 é́"]


def test_exact(spark, public):
    rows = [(k, t, "q") for k, t in enumerate(TEXTS * 3)] + [(100, None, "q"), (101, "", "q"), (102, "common common", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in K.found(df).collect()}
    for k, t, _ in rows:
        assert got[k] == public.encode(t or "", add_special_tokens=False).ids
    assert K.found(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoder_against_the_public_library(public, text):
    text = text.encode("utf-8", "ignore").decode()
    e = K.Encoder(K.load_ranks(), K.word_pattern(), K.Transducer.compile({b" the": [262]}))
    assert e.encode([text])[0] == public.encode(text, add_special_tokens=False).ids


def test_transducer_is_minimal_and_mapped(tmp_path):
    words = {w.encode(): [k, k + 1] for k, w in enumerate(["walking", "talking", "walked", "talked", "walk", "talk", "", "ä"])}
    t = K.Transducer.compile(words)
    # walk- and talk- share one tail: two first letters, a-l-k, then -ing and -ed together.
    assert len(t.final) <= 14
    (tmp_path / "x").write_bytes(t.to_bytes())
    m = K.Transducer.mapped(str(tmp_path / "x"))
    keys = [*words, b"wal", b"walkings", b"zzz"]
    numbers = m.numbers(keys)
    for w, n in zip(keys, numbers):
        assert (n >= 0) == (w in words)
        if n >= 0:
            assert m.ids[m.starts[n] : m.starts[n + 1]].tolist() == words[w]
    assert K.Transducer.compile({}).numbers([b"a"]).tolist() == [-1]
