"""What a worker remembers of words and their pieces."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidegauge.llm import tokens

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


class Counted:
    """A model that counts the words it is asked for."""

    def __init__(self, model):
        self.model, self.calls = model, 0

    def tokenize(self, text):
        self.calls += 1
        return self.model.tokenize(text)


def test_a_word_and_its_pieces_are_remembered_once():
    encoder = tokens.WordEncoder(TOKENIZER)
    encoder._model = counted = Counted(encoder._model)
    letters = "etaoinshrdlu"
    words = ["".join(letters[n // 12**k % 12] for k in range(5)) for n in range(240_000)]
    text = " ".join(words)
    first = encoder.encode(text)
    assert counted.calls == len(set(words)) <= tokens.CACHE_WORDS
    # All fit, so nothing is encoded again, with signs beside it neither.
    assert encoder.encode(text) == first and counted.calls == len(set(words))
    assert encoder.encode(f"{words[-1]}.") and counted.calls <= len(set(words)) + 1


def test_remembered_words_give_the_ids_of_the_whole_text():
    whole, encoder = Tokenizer.from_file(TOKENIZER), tokens.WordEncoder(TOKENIZER)
    texts = ["It's the's 's s' ''s don't. Don't, 12x3 x12 ...", "'s . x s ' '' the", "Äpfel, äpfel. ǅ ǅ Ж x Ж.", "a\x85b\xa0c d\x85b", "", " ."]
    for text in texts * 2:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
