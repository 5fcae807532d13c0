import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.conftest import EDGE
from tokenizers import Tokenizer

from corpusloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, "rb") as f:
    VOCABULARY = bpe.Vocabulary(f.read())
WORDS = ["the", "and", "straße", "x", "thing", "things", "sing", "123", "naïve"]
LEXICON = bpe.Transducer(bpe.Transducer.compile({w.encode(): VOCABULARY.merge(w) for w in WORDS}))


def _expected(texts):
    return [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_encodes_like_the_library(texts):
    codec = bpe.Codec(VOCABULARY, LEXICON)
    ids, n = codec.encode(texts)
    assert ids.tolist() == sum(_expected(texts), []) and n.tolist() == list(map(len, _expected(texts)))


def test_control_strings_long_words_and_sigma():
    texts = ["a<|endoftext|>b <|startoftext|>", "x" * 300, "ΑΣ Σ. İstanbul ﬁ", "it's I'LL <|endoftext", ""]
    for lexicon in (None, LEXICON, bpe.Transducer(bpe.Transducer.compile({}))):
        ids, _ = bpe.Codec(VOCABULARY, lexicon).encode(texts)
        assert ids.tolist() == sum(_expected(texts), [])


def test_long_words_merge_in_linear_steps():
    """A megabyte without a space, of repeated and of random letters, within seconds and as the library does."""
    import random
    import time

    rng = random.Random(2)
    words = ["ab" * (1 << 19), "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 20))]
    for word in words:
        began = time.time()
        got = VOCABULARY.merge(word)
        assert time.time() - began < 60 and got == _expected([word])[0]


@settings(max_examples=100, deadline=None)
@given(st.text("abcetinhor", min_size=1, max_size=120))
def test_merges_like_the_library(word):
    assert VOCABULARY.merge(word) == _expected([word])[0]


def test_transducer_shares_suffixes_and_finds_only_its_words():
    import numpy as np

    for w in WORDS:
        row = np.frombuffer(w.encode(), np.uint8).reshape(1, -1)
        at = LEXICON.lookup(row)[0]
        assert LEXICON.ids(at).tolist() == VOCABULARY.merge(w)
    assert LEXICON.lookup(np.frombuffer(b"thin", np.uint8).reshape(1, -1))[0] == -1
    assert len(LEXICON.accept) < sum(len(w.encode()) for w in WORDS)


def test_full_memo_is_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 3)
    codec = bpe.Codec(VOCABULARY, LEXICON)
    for t in ("one two three four five", "six one two seven", "eight the one"):
        assert codec.encode([t])[0].tolist() == _expected([t])[0]


def test_decodes_lists_like_the_library():
    lists = pa.array([[320, 321], None, [], [49407, 5], [99999, 1, -4]], pa.list_(pa.int32()))
    want = [LIBRARY.decode(x or [], skip_special_tokens=False) for x in ([320, 321], None, [], [49407, 5])]
    assert VOCABULARY.decode_lists(lists).to_pylist() == want + [VOCABULARY.decode([1])]
    assert VOCABULARY.decode_lists(lists.slice(3, 1)).to_pylist() == want[3:]


def test_round_trip_in_spark(spark, make):
    v = bpe.load_vocabulary(spark)
    rows = bpe.decode(bpe.encode(make(EDGE), v, lexicon_words=4), v).select("row.text", "ids", "decoded").collect()
    for r in rows:
        ids = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == LIBRARY.decode(ids, skip_special_tokens=False)
