"""Token counts (operator 8): huge documents in overlapping chunks, spliced where both encodings are proven equal.

A text of more than ``chunk`` characters is cut into pieces that overlap. Each
piece is encoded alone with the offsets of its words. A border inside the
overlap is a proven common one if a word of both encodings starts there and
the character before it is white space: no word, merge or special string goes
over white space, so what stands left of it can't change what stands right.
The left piece counts up to that border, the right one from it. Where an
overlap holds no such border it is doubled, up to the rest of the text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, encoder_of

CHUNK, OVERLAP = 1 << 15, 1 << 9
SPACE = frozenset(" \t\n\x0b\x0c\r")


def offsets(enc: Encoder, text: str, base: int) -> list[tuple[int, int]]:
    """(start in the whole text, tokens) of each stretch between white space."""
    out, at = [], 0
    for word in text.encode().split():
        piece = word.decode()
        at = text.index(piece, at)
        out.append((base + at, len(enc.cached(word)) // 4))
        at += len(piece)
    return out


def common_border(text: str, left: list[tuple[int, int]], right: list[tuple[int, int]], start: int, end: int) -> int | None:
    """The first proven border in [start, end): both encodings begin a word there, after white space."""
    begins = {s for s, _ in right}
    for s, _ in left:
        if start < s < end and s in begins and text[s - 1] in SPACE:
            return s
    return None


def count_spliced(enc: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, from overlapping pieces."""
    total, start, border = 0, 0, 0
    end = min(len(text), chunk)
    left = offsets(enc, text[:end], 0)
    while end < len(text):
        wide = overlap
        while True:
            start = max(border, end - wide)
            stop = min(len(text), start + max(chunk, 2 * wide))
            right = offsets(enc, text[start:stop], start)
            cut = common_border(text, left, right, start, end)
            if cut is not None or start <= border:
                break
            wide *= 2
        if cut is None:  # no white space since the last border: the piece itself has to grow
            end = min(len(text), end + max(chunk, end - border))
            left = offsets(enc, text[border:end], border)
            continue
        total += sum(n for s, n in left if border <= s < cut)
        border, end, left = cut, stop, right
    return total + sum(n for s, n in left if s >= border)


def token_counts(df: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row. NULL and empty texts count 0; ids may be NULL or repeat.

    Other columns are ignored. Rows are independent, so nothing is shuffled.
    """
    def run(batches):
        enc = encoder_of(path)
        for batch in batches:
            sizes, counts = [], []
            for value in batch.column(1):
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                sizes.append(len(data))
                counts.append(len(enc.encode(data)) // 4 if len(data) <= chunk else count_spliced(enc, data.decode(), chunk, overlap))
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), n, pa.array([c > limit for c in counts], pa.bool_())],
                ["id", "n_bytes", "n_tokens", "over_limit"])

    out = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id long, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
