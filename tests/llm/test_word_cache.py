"""op2's word table: one for bare words and those between symbols, with the tokenizer's own ids."""

import random

import numpy as np
from tokenizers import Tokenizer

from millrace.llm import packing

PATH = packing.default_vocabulary()


def test_ids_are_the_tokenizers_while_values_go(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 40)
    monkeypatch.setattr(packing, "SYMBOLS", 3)
    rng = random.Random(11)
    letters = ["a", "the", "tion", "É", "ß", "ÿ", "Þ", "ñ", "É", "µ", "ﬁ", "ſ", "ª", "'", "x1", "中", "Q"]
    symbols = ["", ".", "!!", "***", "<|", "|>", "<|endoftext|>", "'", "'s", "&&&", "…", "«", "\x1c", "\x1f", "_", "\\", "~`"]
    word = lambda: rng.choice(symbols) + "".join(rng.choice(letters) for _ in range(rng.randrange(4))) + rng.choice(symbols) + rng.choice(["", "", "b", "Z."])
    tk, cache = Tokenizer.from_file(PATH), packing.WordCache(PATH)
    for _ in range(600):
        text = " ".join(word() for _ in range(8))
        assert cache.encode(text) == np.array(tk.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
        assert len(cache) <= 40 and len(cache.old) <= 40 and len(cache.symbols) <= 3


def test_each_plain_word_is_kept_and_tokenized_once():
    cache = packing.WordCache(PATH)
    rng = random.Random(5)
    words = sorted({"".join(rng.choice(["th", "an", "er", "on", "ing", "e"]) for _ in range(5)) for _ in range(500)})
    called = []
    own = cache.tokenize
    cache.tokenize = lambda s: (called.append(s), own(s))[1]
    for form in ("{}", "{}.", "{}***", "({})"):
        cache.encode(" ".join(form.format(w) for w in words))
    assert sorted(called) == sorted([*words, ".", "***", "(", ")"])
    # a word's ids stand in no second table
    assert len(cache) == 4 * len(words) and len(cache.symbols) == 4
