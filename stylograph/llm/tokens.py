"""Problem 6: encoding with a public tokenizer's rank file, and decoding.

Defined results: a null and an empty text both give an empty list, never null; blank texts are encoded as they
are; special tokens are never produced, their strings are ordinary text; ids outside the rank file decode to
nothing. Texts of any length are encoded whole: a long one is split where the pre-splitting pattern always
splits, before white space that follows something else, so the ids are those of the unsplit text. A long run of white space is
one piece to that pattern, but for its last character if more follows, and is merged as such without the pattern.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the published pattern of the byte_bpe_50k vocabulary, which splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The rank file is broadcast; a larger one is refused.
MOST_RANK_BYTES = 64 << 20
PIECE_CHARS = 1 << 16

#: White space of Unicode, as the pattern means it.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SAFE = re.compile(f"(?<=[^{_WS}])(?=[{_WS}])")
_BLANK_RUN = re.compile(f"[{_WS}]{{{PIECE_CHARS},}}")
_encoders: dict[int, object] = {}


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Pieces of `text` of `size` characters or more, cut only before white space that follows other text."""
    start = 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def parts_of(text: str, run: re.Pattern = _BLANK_RUN) -> Iterator[tuple[str, bool]]:
    """The text in parts, those of white space only (marked true) from its long runs."""
    start = 0
    for found in run.finditer(text):
        end = found.end() - (found.end() < len(text))  # the last character goes with what follows
        yield text[start : found.start()], False
        yield text[found.start() : end], True
        start = end
    yield text[start:], False


def build_encoder(data: bytes):
    """A tiktoken encoding of the content of a rank file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}
    return tiktoken.Encoding("local_ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_text(encoder, text: str | None) -> list[int]:
    if not text:
        return []
    if len(text) <= PIECE_CHARS:
        return encoder.encode_ordinary(text)
    ids: list[int] = []
    for part, blank in parts_of(text):
        if blank:
            ids += encoder._encode_single_piece(part)
        elif part:
            for piece in safe_pieces(part):
                ids += encoder.encode_ordinary(piece)
    return ids


class Tokenizer:
    """Column functions of one rank file; its bytes (of a checked size) are broadcast once."""

    def __init__(self, spark: SparkSession, rank_file: str = RANK_FILE):
        with open(rank_file, "rb") as f:
            data = f.read(MOST_RANK_BYTES + 1)
        if len(data) > MOST_RANK_BYTES:
            raise ValueError(f"{rank_file} is larger than {MOST_RANK_BYTES} bytes")
        shared = spark.sparkContext.broadcast(data)

        def encoder():
            key = hash(shared.value)
            if key not in _encoders:
                _encoders[key] = build_encoder(shared.value)
            return _encoders[key]

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            enc, ids, ends = encoder(), [], [0]
            for text in texts.to_pylist():
                ids += encode_text(enc, text)
                ends.append(len(ids))
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))

        @F.arrow_udf("bigint")
        def count(texts: pa.Array) -> pa.Array:
            enc = encoder()
            return pa.array([len(encode_text(enc, text)) for text in texts.to_pylist()], pa.int64())

        @F.arrow_udf("binary")
        def decode(ids: pa.Array) -> pa.Array:
            enc = encoder()
            most = enc.max_token_value
            return pa.array([b"".join(enc.decode_single_token_bytes(i) for i in x or [] if i is not None and 0 <= i <= most) for x in ids.to_pylist()], pa.binary())

        # as if not deterministic: else a filter on the number would make the optimizer count twice
        self._encode, self._count, self._decode = encode, count.asNondeterministic(), decode

    def ids(self, text: Column | str) -> Column:
        """The ids of a text column."""
        return self._encode(text)

    def n_tokens(self, text: Column | str) -> Column:
        """The number of ids of a text column."""
        return self._count(text)

    def bytes_of(self, ids: Column | str) -> Column:
        """The raw bytes of a column of ids, without any decoding to characters."""
        return self._decode(ids)
