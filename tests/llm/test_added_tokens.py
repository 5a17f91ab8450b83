"""Ids equal those of tokenizers under its default settings, also where a text has an added token."""

import json
from pathlib import Path

import numpy as np
import pytest

from tidemark.llm import packing

TOKEN = "<|endoftext|>"


@pytest.fixture(scope="module")
def both():
    import public_tokenizers
    from tokenizers import Tokenizer

    file = packing.tokenizer_file()
    return packing.Ids(json.loads(Path(file).read_text()), public_tokenizers.PATTERN), Tokenizer.from_file(file)


@pytest.mark.parametrize("text", [
    TOKEN, f"a {TOKEN} b", f"a{TOKEN}b", f" {TOKEN}  {TOKEN}\n y", f"one two{TOKEN}{TOKEN} three  four ", f"é 中文 {TOKEN}😀", "<|endoftext", f"<{TOKEN}>", "no token here", "",
])
def test_ids_equal_the_library_s(both, text):
    ids, library = both
    assert np.frombuffer(ids.of(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_random_texts_with_the_token(both):
    ids, library = both
    rng = np.random.default_rng(7)
    parts = [TOKEN, " ", "  ", "\n", "a", "Word", "é", "中", "😀", "1", "'s", "<|", "|>", "endoftext", "\t", ".", "\u00a0"]
    for _ in range(3000):
        text = "".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(1, 14)))
        assert np.frombuffer(ids.of(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
