"""Words are encoded without the pattern and without being kept twice; the ids are tiktoken's."""

import itertools

import public_tokenizers
import tiktoken

from millrace.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_words_with_and_without_a_last_character_are_encoded_as_by_tiktoken():
    tokens = bpe.load_ranks(RANKS)
    t = bpe.Tokenizer(tokens, public_tokenizers.PATTERN)
    want = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks={x: i for i, x in enumerate(tokens)}, special_tokens={})
    words = ["a", "Zebra", "tiontiones", "étioneuxç", "ªº", "Ɏɐ", "ßẞ", "日本", "x²", "i̇", "ab1", "don't", "'s", "s'", "", "zqxjkv" * 400]
    ends = ["", *(chr(c) for c in range(0x21, 0x7F)), "\n", "\x1c", " ", " ", "…", "''"]
    for word, end in itertools.product(words, ends):
        text = f"of {word}{end} {word}{end} 's"
        n, ids, decoded = t.result(text)
        assert [int(x) for x in ids.split()] == want.encode_ordinary(text), text
        assert n == len(ids.split()) and decoded == text.encode()
    assert t.result("") == (0, "", b"")


def test_a_word_is_kept_as_a_chunk_only():
    t = bpe.Tokenizer(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    t.result("The houses, über wörter tiontiones.")
    assert not {" houses", " über", " wörter", " tiontiones"} & set(t.pieces)


def test_known_neighbours_are_dropped_when_they_are_too_many(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    merges = bpe.Merges(bpe.load_ranks(RANKS))
    words = [w.encode() for w in ("tiontiones", "anstkeitä", "emedhsher", "zqxjkvzqxjkv", "thththshnd")]
    first = [merges.encode(w) for w in words]
    assert [merges.encode(w) for w in words] == first and 0 < sum(map(len, merges.fits)) == merges.known <= 20
