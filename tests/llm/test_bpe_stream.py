"""The transducer fed in blocks: same ids, flat memory."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from fleetscope.llm import bpe, queries
from tests.llm.test_text_operators import tricky


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(queries.tokenizer_path())


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 18])
def test_blocks_give_the_same_ids(encoder, block):
    for text in [*tricky(3, 150), "  \n ", "a" * 500 + " " + "b" * 500, " x" * 400]:
        data = text.encode()
        assert b"".join(encoder.transduce(memoryview(data), block)) == encoder.encode(data)


def test_memory_does_not_grow_with_the_text(encoder):
    """A hundred times the text, the same peak beside it."""
    words = "the quick brown fox jumps over 12 lazy dogs, it's said\n".encode()
    rnd = random.Random(1)
    peaks = []
    for size in (1 << 20, 100 << 20):
        text = memoryview(bytes(words * (size // len(words))))
        digest, count, dec = hashlib.sha256(), 0, bpe.Decoder(encoder)
        tracemalloc.start()
        for ids in encoder.transduce(text):
            numbers = np.frombuffer(ids, "<u4")
            count += len(numbers)
            if rnd.random() < 0.02:  # the decoder is slow under the tracer; its state is the same for any block
                digest.update(dec.feed(numbers.tolist()).encode())
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert count > size // 8
    assert peaks[1] < 1.5 * peaks[0] + (1 << 20) and peaks[1] < 64 << 20


def test_cache_is_dropped_with_its_generations():
    """An executor keeps its workers, and they their encoders: what they remember stays small beside the executor's memory."""
    enc = bpe.encoder_of(queries.tokenizer_path())
    words = [b"w%d" % i for i in range(250_000)]
    enc.encode(b" ".join(words))
    assert len(enc.young) + len(enc.old) <= 200_000
    assert enc.encode(words[0]) == enc.encode(b" " + words[0]) and len(enc.encode(b" ".join(words[:2]))) > 0
