"""Byte-level BPE encoding and decoding with the tokenizers library.

Ids travel as binary columns of little-endian unsigned 32-bit integers; ``unpacked`` turns
them into arrays.  A text is cut at spaces that are followed by other characters: no
match of the split pattern crosses such a place, so every chunk is encoded once per
worker and looked up afterwards.  The lookup table has a bounded size.

Edge cases: a null text is the empty text and has no ids; other columns of the input are
not read, so their names cannot clash; equal rows give equal rows; an empty table gives
an empty table; a text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from marketloom.llm.batches import TAILS, Memo, is_word, split_batches, texts_of, word_and_tail

#: Chunks kept by a worker, and the longest chunk that is kept.
MEMO_CHUNKS = 1_200_000
MEMO_LENGTH = 48
#: A space before white space or the end belongs to a longer match: such texts are cut with care.
_RISKY = ("  ", " \n", " \t", " \r", " \v", " \f")
_RARE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CUT = re.compile(r"(?= \S)")


@lru_cache
def byte_characters() -> tuple[str, ...]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable bytes of Latin-1 stand for themselves; the others take, in order, the
    characters from 256 on.
    """
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return tuple(chr(b) if b in own else chr(next(rest)) for b in range(256))


def _byte_level(text: str) -> str:
    """A text as the characters that stand for its bytes."""
    return text.encode().decode("latin-1").translate(_BYTES)


def rank_tokens(path: str) -> list[bytes]:
    """The tokens of a rank file by their id."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[int(rank)] = base64.b64decode(token)
    return [ranks[i] for i in range(len(ranks))]


def tokenizer_from_ranks(path: str, pattern: str) -> Tokenizer:
    """A byte-level tokenizer that merges by the ranks of a file.

    Ranks allow every pair of tokens whose concatenation is a token, so each such pair
    becomes a merge, in the order of the rank of what it makes.
    """
    chars = byte_characters()
    tokens = ["".join(chars[b] for b in t) for t in rank_tokens(path)]
    vocab = {t: i for i, t in enumerate(tokens)}
    merges = [(t[:k], t[k:]) for t in tokens for k in range(1, len(t)) if t[:k] in vocab and t[k:] in vocab]
    out = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return out


def tokenizer_from_json(path: str) -> Tokenizer:
    """A tokenizer file; the strings of its special tokens count as ordinary text."""
    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


_BYTES = dict(enumerate(byte_characters()))


class ChunkEncoder:
    """Encodes texts chunk by chunk, each distinct chunk once."""

    def __init__(self, tokenizer: Tokenizer, limit: int = MEMO_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = tokenizer
        # where a word is one match and a mark behind it another, words go to the model without splitting, and without the mark
        matches = lambda t: [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(f" wörd{t} a")]
        plain = all(matches(t) == [_byte_level(" wörd"), t, _byte_level(" a")] for t in TAILS)
        self.tails = dict(zip(TAILS, self._ids(list(TAILS)))) if plain else {}
        self.model = tokenizer.model
        self.memo = Memo(self._learned, limit, MEMO_LENGTH)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_behind_space(self, chunks: list[str]) -> list[bytes]:
        if not self.tails:
            return self._ids([" " + c for c in chunks])
        tokenize, words = self.model.tokenize, list(map(is_word, chunks))
        others = iter(self._ids([" " + c for c, word in zip(chunks, words) if not word]))
        return [array("I", [t.id for t in tokenize(_byte_level(" " + c))]).tobytes() if word else next(others) for c, word in zip(chunks, words)]

    def _learned(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks behind a space."""
        bare = [c[:-1] if self.tails and word_and_tail(c) else c for c in chunks]
        known = self.memo.young
        some = list({c for c in bare if c not in known})
        known.update(zip(some, self._ids_behind_space(some)))
        out = [known[c] for c in bare]
        for c in some:
            if len(c) > MEMO_LENGTH:
                del known[c]
        return [ids if c is whole else ids + self.tails[whole[-1]] for whole, c, ids in zip(chunks, bare, out)]

    @staticmethod
    def cut(text: str) -> list[str]:
        """The chunks of a text, all but the first without the space before them."""
        if any(pair in text for pair in _RISKY) or text.endswith(" ") or _RARE_SPACE.search(text):
            first, *rest = _CUT.split(text)
            return [first, *[c[1:] for c in rest]]
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        chunks = [self.cut(t) for t in texts]
        starts = self._ids([c.pop(0) for c in chunks])
        return [a + b"".join(found) for a, found in zip(starts, self.memo.rows(chunks))]


@lru_cache
def rank_encoder(path: str, pattern: str) -> ChunkEncoder:
    return ChunkEncoder(tokenizer_from_ranks(path, pattern))


@lru_cache
def json_encoder(path: str, limit: int = MEMO_CHUNKS) -> ChunkEncoder:
    return ChunkEncoder(tokenizer_from_json(path), limit)


@lru_cache
def _token_bytes(path: str) -> list[bytes]:
    return rank_tokens(path)


def _encode_batches(batches: Iterable[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder = rank_encoder(path, pattern)
    for part in split_batches(batches, "text"):
        ids = encoder.encode(texts_of(part.column(1)))
        yield pa.record_batch([part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"])


def _decode_batches(batches: Iterable[pa.RecordBatch], path: str, keep: bool) -> Iterator[pa.RecordBatch]:
    table = _token_bytes(path)
    for part in split_batches(batches, "ids"):
        ids = part.column(part.schema.get_field_index("ids"))
        raw = [b"".join(map(table.__getitem__, np.frombuffer(i or b"", "<u4").tolist())) for i in ids.to_pylist()]
        kept = part.columns if keep else [part.column(0)]
        names = part.schema.names if keep else ["id"]
        yield pa.record_batch([*kept, pa.array(raw, pa.binary())], [*names, "bytes"])


def _id_field(df: DataFrame, id_col: str) -> StructField:
    return StructField(id_col, df.schema[id_col].dataType)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, ``n_tokens`` and the packed ``ids``."""
    schema = StructType([_id_field(df, id_col), StructField("n_tokens", LongType()), StructField("ids", BinaryType())])
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _renamed(_encode_batches(it, path, pattern), id_col), schema)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``df``: its id and the ``bytes`` its packed ids stand for.

    Bytes, not text: ids cut inside a character decode to a part of it.  ``text`` makes
    text of them.
    """
    schema = StructType([_id_field(df, id_col), StructField("bytes", BinaryType())])
    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(lambda it: _renamed(_decode_batches(it, path, False), id_col), schema)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` of its ids in one pass over the batches."""
    schema = StructType([_id_field(df, id_col), StructField("n_tokens", LongType()), StructField("ids", BinaryType()), StructField("bytes", BinaryType())])
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _renamed(_decode_batches(_encode_batches(it, path, pattern), path, True), id_col), schema)


def _renamed(batches: Iterable[pa.RecordBatch], id_col: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch(b.columns, [id_col, *b.schema.names[1:]])


def unpacked(ids: str | Column) -> Column:
    """Packed ids as an array of longs, in Spark."""
    c = F.col(ids) if isinstance(ids, str) else ids
    hexed = F.hex(c)
    at = lambda i: F.substring(hexed, i, F.lit(2))
    n = (F.length(c) / 4).cast("int")
    word = lambda k: F.conv(F.concat(at(k * 8 + 7), at(k * 8 + 5), at(k * 8 + 3), at(k * 8 + 1)), 16, 10).cast("long")
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), word))


def text(raw: str | Column) -> Column:
    """Decoded bytes as text; what is not UTF-8, such as half a character, becomes U+FFFD."""
    return F.make_valid_utf8((F.col(raw) if isinstance(raw, str) else raw).cast("string"))


def _offset_batches(batches: Iterable[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    tokenizer = rank_encoder(path, pattern).tokenizer
    kind = pa.list_(pa.struct([("token_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
    for part in split_batches(batches, "text"):
        found = tokenizer.encode_batch(texts_of(part.column(1)), add_special_tokens=False)
        rows = [[{"token_id": i, "start": a, "end": b} for i, (a, b) in zip(e.ids, e.offsets)] for e in found]
        yield pa.record_batch([part.column(0), pa.array(rows, kind)], ["id", "tokens"])


def encode_with_offsets(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: its id and ``tokens``, an array of id, first character and end.

    Tokens that share a character all name the whole character.
    """
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, tokens array<struct<token_id: bigint, start: bigint, end: bigint>>"
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _renamed(_offset_batches(it, path, pattern), id_col), schema)
