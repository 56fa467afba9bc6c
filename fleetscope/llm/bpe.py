"""BPE encoding and decoding (operator 3) as a bounded-lookahead streaming transducer.

The encoder reads a merge list and computes how far a change at the end of a
text can reach back into its tokens (``sufficient_lookahead``). A text goes in
block by block, cut at white space, and ids come out as they become stable. A run of
symbols longer than that is encoded through a window: tokens that end before
the reach of what is still unread are stable and leave the window, the rest
starts again from the last stable border. Memory is the window and a bounded
cache of short words, whatever the length of the text. The decoder is a state
machine that takes ids and gives text as soon as its bytes are complete.

Results are those of the ``tokenizers`` library for BPE files with an NFC and
lower-case normaliser, a splitting pattern and byte-level symbols.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, short_batches

#: Longest stretch without white space that is cached, in bytes, and cached stretches per generation.
CACHED_BYTES, CACHED_WORDS = 64, 100_000
#: Bytes of text that go in at a time, and ids that the decoder takes at a time.
BLOCK, DECODE_BLOCK = 1 << 18, 1 << 16
#: The rank of a pair that no merge has.
NONE = 1 << 60


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next free code point from 256 on."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols after a token border that can still move it; a border further than that from the unread text stays.

    Two runs of the merges, one over a text and one over the text with more
    behind it, differ from some border on. A merge (u, v) moves that border to
    the left by |u| only where v stands right of it in one run and not in the
    other; what stands there was made by an earlier merge (u', v') at the same
    border, so v begins with u'. The bound is the longest such chain, taken
    over rising ranks. It needs each token to have one merge that makes it and
    parts that are made before it; other lists are refused.
    """
    made: set[str] = set()
    reach: dict[str, int] = {}
    for left, right in merges:
        for part in (left, right):
            if len(part.removesuffix("</w>")) > 1 and part not in made:
                raise ValueError(f"merge list uses {part!r} before it is made")
        if left + right in made:
            raise ValueError(f"two merges make {left + right!r}")
        made.add(left + right)
    longest = 0
    for left, right in reversed(merges):
        far = len(left) + reach.get(left, 0)
        longest = max(longest, far)
        for i in range(1, len(right) + 1):
            if reach.get(right[:i], 0) < far:
                reach[right[:i]] = far
    return longest


class Encoder:
    """Tokens of whole texts or streams, from a tokenizer file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE":
            raise ValueError("not a BPE file")
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.rank = {(self.ids[a], self.ids[b]): i for i, (a, b) in enumerate(pairs)}
        self.made = [self.ids[a + b] for a, b in pairs]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = [""] * (1 + max([*self.ids.values(), *self.specials.values()]))
        for text, i in [*self.ids.items(), *self.specials.items()]:
            self.token[i] = text
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.symbols = byte_symbols()
        self.inner = [self.ids[c] for c in self.symbols]
        self.final = [self.ids[c + self.suffix] for c in self.symbols]
        self.length = [len(t.removesuffix(self.suffix)) for t in self.token]
        self.lookahead = sufficient_lookahead(pairs)
        self.window = self.lookahead + 2 * max(map(len, self.ids))
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.angled = all("<" in t for t in self.specials)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def merge(self, parts: list[int]) -> list[int]:
        """The merges in order of rank, leftmost first, until none applies. Works on the list it is given."""
        rank, made = self.rank.get, self.made
        ranks = [rank(p, NONE) for p in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = new = made[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((new, parts[i + 1]), NONE)
            if i:
                ranks[i - 1] = rank((parts[i - 1], new), NONE)
        return parts

    def stream(self, parts: Iterable[int]) -> Iterator[int]:
        """Tokens of one word from its symbols, each as soon as the symbols behind it can't change it."""
        held: list[int] = []
        for part in parts:
            held.append(part)
            if len(held) >= 2 * self.window:
                used = 0
                for t in self.merge(held[:]):
                    if used + self.length[t] > len(held) - self.lookahead:
                        break
                    used += self.length[t]
                    yield t
                del held[:used]
        yield from self.merge(held)

    def word(self, word: str) -> Iterable[int]:
        data = word.encode()
        if len(data) <= self.window:
            return self.merge([*map(self.inner.__getitem__, data[:-1]), self.final[data[-1]]])
        return self.stream((self.inner if i < len(data) - 1 else self.final)[b] for i, b in enumerate(data))

    def plain(self, text: str) -> list[str]:
        """Words of a text after normalising."""
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # no context rule for the final sigma
        return self.words.findall(text)

    def stretch(self, text: str) -> Iterator[int]:
        """Ids of a stretch of text, special strings as their own ids."""
        at = 0
        for m in self.marks.finditer(text) if "<" in text or not self.angled else ():
            for word in self.plain(text[at:m.start()]):
                yield from self.word(word)
            yield self.specials[m[0]]
            at = m.end()
        for word in self.plain(text[at:] if at else text):
            yield from self.word(word)

    def cached(self, data: bytes) -> bytes:
        """Little-endian ids of a stretch without ASCII white space."""
        found = self.young.get(data)
        if found is None:
            found = self.old.get(data)
            if found is None:
                found = np.array(array("I", self.stretch(data.decode())), "<u4").tobytes()
                if len(data) > CACHED_BYTES:
                    return found
            if len(self.young) >= CACHED_WORDS:
                self.young, self.old = {}, self.young
            self.young[data] = found
        return found

    def encode(self, data: bytes) -> bytes:
        """Little-endian 32-bit ids of a whole UTF-8 text. White space ends every word and every special string."""
        young = self.young.get
        return b"".join([young(w) or self.cached(w) for w in data.split()])

    def transduce(self, data: bytes | memoryview, block: int = BLOCK) -> Iterator[bytes]:
        """The same ids, as they become stable: a block of text goes in, cut at its last white space, and its ids come out.

        Beyond the text, one block and its ids are held. A stretch without white
        space that is longer than a block goes in whole; inside it, words leave
        through the lookahead's window.
        """
        at, size = 0, len(data)
        while at < size:
            piece = bytes(data[at:at + block])
            if at + block < size:
                cut = max(piece.rfind(bytes([s])) for s in SPACES)
                while cut < 0:
                    more = bytes(data[at + len(piece):at + 2 * len(piece)])
                    found = [i for s in SPACES if (i := more.find(bytes([s]))) >= 0]
                    cut = len(piece) + min(found) if found else (-1 if at + len(piece) + len(more) < size else len(piece) + len(more))
                    piece += more
                piece = piece[:cut]
            at += max(len(piece), 1)
            ids = self.encode(piece)
            if ids:
                yield ids


class Decoder:
    """Ids to text, a block at a time; ``feed`` gives what is complete, ``end`` what is left.

    With a byte-level decoder the state is the open UTF-8 sequence; without a
    decoder tokens are words and the state is whether one was written.
    """

    def __init__(self, encoder: Encoder):
        self.token, self.byte_level, self.begun = encoder.token, encoder.byte_level, False
        self.codec = codecs.getincrementaldecoder("utf-8")("replace")
        self.of = {c: b for b, c in enumerate(encoder.symbols)}

    def feed(self, ids: Iterable[int]) -> str:
        if self.byte_level:
            return self.codec.decode(bytes(self.of[c] for i in ids for c in self.token[i]))
        text = " ".join(map(self.token.__getitem__, ids))
        if self.begun and text:
            text = " " + text
        self.begun = self.begun or bool(text)
        return text

    def end(self) -> str:
        return self.codec.decode(b"", True) if self.byte_level else ""


@lru_cache(maxsize=4)
def encoder_of(path: str) -> Encoder:
    """One encoder for each process and file."""
    return Encoder(path)


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """One row for each input row: id, number of tokens, digests of ids and of the decoded text.

    ``texts`` adds ``ids`` and ``decoded``. NULL and empty texts have no ids and
    decode to an empty text. Ids may be NULL or repeat: rows stay apart. Other
    columns are ignored. An empty table gives no rows. A text of any length
    goes through in blocks: beside it, a task holds one block and its ids (all
    ids and the decoded text only with ``texts``). Rows are independent: no
    shuffle, and a lost task is simply run again.
    """
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if texts else "")

    def run(batches):
        enc = encoder_of(path)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for value in batch.column(1):
                data = memoryview(value.as_buffer()) if value.is_valid else b""
                count, encoded, digest, dec, kept, out = 0, hashlib.sha256(), hashlib.sha256(), Decoder(enc), [], []
                for ids in enc.transduce(data):
                    numbers = np.frombuffer(ids, "<u4")
                    count += len(numbers)
                    encoded.update(ids)
                    for at in range(0, len(numbers), DECODE_BLOCK):
                        piece = dec.feed(numbers[at:at + DECODE_BLOCK].tolist())
                        digest.update(piece.encode())
                        if texts:
                            out.append(piece)
                    if texts:
                        kept.append(numbers.astype(np.int32))
                last = dec.end()
                digest.update(last.encode())
                whole = np.concatenate(kept) if kept else np.zeros(0, np.int32)
                for col, v in zip(cols, (count, encoded.hexdigest(), digest.hexdigest(), whole, "".join(out) + last)):
                    col.append(v)
            arrays = [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if texts:
                arrays += [pa.array(cols[3], pa.list_(pa.int32())), pa.array(cols[4], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    out = short_batches(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
