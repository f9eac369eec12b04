"""Long unbroken runs: ids of the library, in time that grows with the length."""

import base64
import random
import time

import public_tokenizers
import pytest
import tiktoken

from millrace.llm import bpe

RNG = random.Random(1)
RUNS = {
    "ab": lambda n: "ab" * (n // 2),
    "letters": lambda n: "".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)),
    "base64": lambda n: base64.b64encode(RNG.randbytes(3 * n // 4)).decode(),
    "acgt": lambda n: "".join(RNG.choice("acgt") for _ in range(n)),
    "punctuation": lambda n: "".join(RNG.choice("!=-_*#") for _ in range(n)),
    "one": lambda n: "=" * n,
    "spaces": lambda n: " " * n,
    "han": lambda n: "".join(chr(RNG.randrange(0x4E00, 0x9FA5)) for _ in range(n // 3)),
}


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))


@pytest.fixture(scope="module")
def library(merges):
    return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks={t: i for i, t in enumerate(merges.tokens)}, special_tokens={})


@pytest.mark.parametrize("kind", sorted(RUNS))
def test_ids_of_long_runs(merges, library, kind):
    for n in (1, 127, 128, 129, 511, 512, 513, 640, 5000, 100_000):
        text = RUNS[kind](n + 2)
        assert merges.encode(text.encode()) == library.encode_ordinary(text)


@pytest.mark.parametrize("kind", ["ab", "letters", "acgt", "spaces"])
def test_time_grows_with_the_length(merges, kind):
    def least(n):
        text, took = RUNS[kind](n).encode(), []
        for _ in range(3):
            start = time.process_time()
            merges.encode(text)
            took.append(time.process_time() - start)
        return min(took)

    merges.encode(RUNS[kind](10_000).encode())
    assert least(400_000) < 6 * max(least(100_000), 0.01)
