"""What an encoder of packing holds once its first texts are compared."""

import numpy as np
import public_tokenizers

from millrace.llm import packing


def test_the_second_library_is_held_only_while_texts_are_compared():
    enc = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    assert enc.tokenizer is None
    text = "One  text, with 12 numbers\n\nand ünïcode 日本."
    ids = enc.reference(text)
    assert enc.encode(text) == ids and enc.tokenizer is not None
    enc.compared()
    assert enc.tokenizer is None and enc.encode(text) == ids
    # and where it is needed again, it is there
    assert enc.reference(text) == ids and len(np.frombuffer(ids, "<u4")) > 5


def test_an_encoder_without_ranks_keeps_it(monkeypatch):
    monkeypatch.setattr(packing, "_ranks", lambda path: (None, []))
    enc = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    assert enc.encode("a b") and enc.tokenizer is not None
    enc.compared()
    assert enc.tokenizer is not None
