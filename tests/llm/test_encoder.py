import random

import pytest


@pytest.fixture
def encoder():
    from sparkfacts.llm import token_output

    return token_output.Encoder(token_output.default_tokenizer())


def test_words_met_often_go_to_the_library_once(encoder, monkeypatch):
    """A full cache drops what was not met lately, not all it holds, and never what is too long to keep."""
    from sparkfacts.llm import token_output

    sent, words = [], type(encoder)._words
    monkeypatch.setattr(token_output, "CACHED_WORDS", 40)
    monkeypatch.setattr(type(encoder), "_words", lambda self, new: sent.extend(new) or words(self, new))
    for i in range(30):
        text = " ".join(["often", "café,", *(f"only{i}x{j}" for j in range(15)), "z" * 100_000 if i % 3 == 0 else "often"])
        assert encoder.ids(text) == encoder._whole(text), i
        assert len(encoder.size) == len(encoder.vocabulary) <= 60 and len(encoder.held) < 20_000 + 60 * 50
    assert sent.count(b"often") == 1 and sent.count(b"caf\xc3\xa9") + sent.count(b"caf\xc3\xa9,") == 1


def test_same_ids_as_the_library(encoder):
    """Several texts at once, of letters, signs, special tokens, odd white space and bytes beside them."""
    rng = random.Random(3)
    bits = ["Word", "it's", "a-b", "x=1", "(y)", "é", "É.", "e\u0301!", "u\u0308", "straße", "<|endoftext|>", "a<|endoftext|>b-c", "<|x", "\x1c", "\x85", "\xa0", "\u3000", "\0", "7th", "3.14", "雷,李", "'", "--", "Σας", "İx", "\U0001f600!"]
    texts = ["", " ", "\n", *("".join(rng.choice(bits) + rng.choice(["", " ", "\t", "  ", "\x0b\r\n"]) for _ in range(rng.randint(1, 30))) for _ in range(400))]
    assert encoder.many([t.encode() for t in texts]) == [encoder._whole(t) for t in texts]
