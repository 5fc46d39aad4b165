"""SentencePiece encoding and decoding for models of merge type, through a table of prefixes.

In a merge model every prefix of a text has one last token: the end of the prefix's own
encoding.  The table holds it for each prefix, from left to right.  An Aho-Corasick automaton
yields the tokens that end at a place; a token is the last one if it starts where the text does,
or if it is compatible with the last token of the prefix before it, that is, if merging the two
tokens' characters gives these two again.  Exactly one candidate passes, because a sequence is
the encoding of its text if and only if each adjacent pair is.  Ids are then recovered from the
end backwards.  Merges go by score, the leftmost first among equals, as in the library.

Characters without a token stand alone: they become byte tokens where the model has them, else
the unknown token.  Where no token crosses from another character to a space mark, a text is cut
there and each distinct piece is encoded once per worker; the table of pieces has a bounded size.

Edge cases: a null text is the empty text and has no ids; equal rows give equal rows; null ids
stay; other columns are not read; an empty table gives an empty table; a text of any length is
encoded whole.  Models that normalise characters, split off symbols by hand or are not of merge
type are refused.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from marketloom.llm.batches import TAILS, Memo, split_batches, texts_of, word_and_tail

SPACE = "▁"
#: Pieces, and tested pairs, kept by a worker; the longest piece that is kept.
MEMO_PIECES, MEMO_PAIRS, MEMO_LENGTH = 400_000, 500_000, 48


class Model:
    """The tokens of a model file: strings, scores of merges, and what each id decodes to."""

    def __init__(self, path: str):
        proto = model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec, kinds = proto.normalizer_spec, model_pb2.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != model_pb2.TrainerSpec.BPE or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model is not of merge type with space marks in front")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("the model normalises texts")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("the model has symbols of its own")
        self.dummy_prefix = spec.add_dummy_prefix
        self.ids: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        self.decoded: list[bytes] = []
        self.unknown = 0
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.NORMAL:
                self.ids[p.piece] = i
                self.decoded.append(p.piece.replace(SPACE, " ").encode())
            elif p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value] = i
                self.decoded.append(bytes([value]))
            elif p.type == kinds.UNKNOWN:
                self.unknown = i
                self.decoded.append(proto.trainer_spec.unk_surface.encode())
            else:
                self.decoded.append(b"")
        self.merges = {t: proto.pieces[i].score for t, i in self.ids.items()}
        self.with_mark = {i for t, i in self.ids.items() if t.startswith(SPACE)}
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.ids)

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text by merging: the best score first, the leftmost among equals."""
        parts, none = list(text), float("-inf")
        score = self.merges.get
        offers = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while offers and (best := max(offers)) > none:
            k = offers.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del offers[k]
            if k:
                offers[k - 1] = score(parts[k - 1] + parts[k], none)
            if k < len(offers):
                offers[k] = score(parts[k] + parts[k + 1], none)
        return parts


class Pairs(dict):
    """Whether two tokens may stand side by side, tested when first asked for; (left << bits | right) is the key."""

    def __init__(self, model: Model, strings: dict[int, str], bits: int):
        super().__init__()
        self.model, self.strings, self.bits = model, strings, bits

    def __missing__(self, key: int) -> bool:
        a, b = self.strings[key >> self.bits], self.strings[key & (1 << self.bits) - 1]
        fits = self[key] = self.model.merged(a + b) == [a, b]
        return fits


class Encoder:
    """Encodes and decodes with one model; keeps tables of bounded size."""

    def __init__(self, path: str, pieces: int = MEMO_PIECES, pairs: int = MEMO_PAIRS):
        self.model, self.max_pairs = Model(path), pairs
        # a token travels as (id << size_bits | length)
        self.size_bits = max(map(len, self.model.ids)).bit_length()
        self.bits = self.size_bits + len(self.model.decoded).bit_length()
        self.automaton = ahocorasick.Automaton()
        strings = {}
        for t, i in self.model.ids.items():
            if len(t) == 1 or self.model.merged(t) == [t]:  # other tokens are never made
                strings[i << self.size_bits | len(t)] = t
                self.automaton.add_word(t, i << self.size_bits | len(t))
        self.automaton.make_automaton()
        self.pairs = Pairs(self.model, strings, self.bits)
        # marks that no token has behind a letter: a word is looked up without them
        after_letters = {b for t in self.model.ids for a, b in zip(t, t[1:]) if a.isalpha()}
        self.tails = dict(zip(marks := sorted(TAILS - after_letters), self._encoded(marks)))
        self.memo = Memo(self._learned, pieces, MEMO_LENGTH)
        self.byteless = {i for i, d in enumerate(self.model.decoded) if not d}

    def last_tokens(self, text: str) -> list[int]:
        """For each character the last token of the prefix it ends; -1 where a character has none."""
        last = [-1] * (len(text) + 1)  # the entry before the first is the last one
        pairs, bits, mask = self.pairs, self.bits, (1 << self.size_bits) - 1
        if len(pairs) > self.max_pairs:
            pairs.clear()
        for end, token in self.automaton.iter(text):
            if last[end] < 0:
                previous = last[end - (token & mask)]
                if previous < 0 or pairs[previous << bits | token]:
                    last[end] = token
        return last

    def _loose(self, character: str) -> list[int]:
        """Ids of a character without a token, the last first."""
        table = self.model.byte_ids
        return [table[b] for b in reversed(character.encode())] if table else [self.model.unknown]

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece through one table for all: what stands between them has no token, so prefixes start anew there."""
        gap = next(c for c in "\n\0\ufdd0" if c not in self.model.ids)
        text = gap.join(pieces)
        last, out, at = self.last_tokens(text), [], 0
        shift, mask = self.size_bits, (1 << self.size_bits) - 1
        for p in pieces:
            ids, end = [], at + len(p) - 1
            while end >= at:
                token = last[end]
                if token < 0:
                    ids += self._loose(text[end])
                    end -= 1
                else:
                    ids.append(token >> shift)
                    end -= token & mask
            ids.reverse()
            out.append(array("i", ids).tobytes())
            at += len(p) + 1
        return out

    def cut(self, text: str) -> list[str]:
        """A text in pieces that no token crosses, without the mark that each starts with (models that put one in front)."""
        if not text:
            return []
        if self.model.cuts and self.model.dummy_prefix:
            if "  " not in text and SPACE not in text and not text.startswith(" "):
                return text.split(" ")
            return [p[1:] for p in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
        return [text.replace(" ", SPACE)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit integers."""
        return [b"".join(found) for found in self.memo.rows([self.cut(t) for t in texts])]

    def _learned(self, cut: list[str]) -> list[bytes]:
        """Ids of pieces behind the mark that each starts with."""
        front = SPACE if self.model.dummy_prefix else ""
        bare = [c[:-1] if c[-1:] in self.tails and word_and_tail(c) else c for c in cut]
        known = self.memo.young
        some = list({c for c in bare if c not in known})
        known.update(zip(some, self._encoded([front + c for c in some])))
        out = [known[c] for c in bare]
        for c in some:
            if len(c) > MEMO_LENGTH:
                del known[c]
        return [ids if c is whole else ids + self.tails[whole[-1]] for whole, c, ids in zip(cut, bare, out)]

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text that the ids stand for; each byte that is part of no character becomes U+FFFD."""
        table, parts = self.model.decoded, []
        if self.byteless.isdisjoint(ids):
            parts.append(b"".join(map(table.__getitem__, ids)))
        else:  # a control token parts the bytes on its sides
            for known, run in groupby(ids, lambda i: i not in self.byteless):
                parts += [b"".join(map(table.__getitem__, run))] if known else []
        first = next((i for i in ids if table[i]), None)
        if self.model.dummy_prefix and first in self.model.with_mark:
            parts[0] = parts[0][1:]
        try:
            return "".join([p.decode() for p in parts]).encode()
        except UnicodeDecodeError:
            return "".join([p.decode(errors=_EACH_BYTE) for p in parts]).encode()


_EACH_BYTE = "each byte"
codecs.register_error(_EACH_BYTE, lambda e: ("�", e.start + 1))


@lru_cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def library(path: str) -> sentencepiece.SentencePieceProcessor:
    """The library's own processor, for comparison."""
    return sentencepiece.SentencePieceProcessor(model_file=path)


def _encode_batches(batches: Iterable[pa.RecordBatch], path: str, decode: bool) -> Iterator[pa.RecordBatch]:
    coder = encoder(path)
    for part in split_batches(batches, "text"):
        packed = coder.encode(texts_of(part.column(1)))
        ends = np.r_[0, np.cumsum([len(p) // 4 for p in packed])].astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
        columns = [part.column(0), ids]
        if decode:
            columns.append(pa.array([coder.decode(np.frombuffer(p, np.int32).tolist()).decode() for p in packed], pa.string()))
        yield pa.record_batch(columns, ["id", "ids", "decoded"][:len(columns)])


def _decode_batches(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder = encoder(path)
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array([coder.decode(i or []).decode() for i in b.column(1).to_pylist()], pa.string())], ["id", "decoded"])


def _rows(df: DataFrame, id_col: str, col: str, kind: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(col).cast(kind).alias("text" if kind == "string" else "ids"))


def _named(df: DataFrame, id_col: str) -> DataFrame:
    return df.withColumnRenamed("id", id_col)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the token ``ids`` of every row of ``df``."""
    kind = df.schema[id_col].dataType.simpleString()
    return _named(_rows(df, id_col, text_col, "string").mapInArrow(lambda it: _encode_batches(it, path, False), f"id {kind}, ids array<int>"), id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id and the ``decoded`` text of every row of ``df``; null ids are none."""
    kind = df.schema[id_col].dataType.simpleString()
    return _named(_rows(df, id_col, ids_col, "array<int>").mapInArrow(lambda it: _decode_batches(it, path), f"id {kind}, decoded string"), id_col)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass over the batches."""
    kind = df.schema[id_col].dataType.simpleString()
    return _named(_rows(df, id_col, text_col, "string").mapInArrow(lambda it: _encode_batches(it, path, True), f"id {kind}, ids array<int>, decoded string"), id_col)
