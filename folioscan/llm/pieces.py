"""SentencePiece encoding and decoding, for BPE models with byte fallback.

The encoder fills a table with the last token of every prefix's encoding. A prefix has one encoding, so
it has one last token: of the pieces that end there, which an automaton over the vocabulary tells, it is the
one whose neighbour, the last token of the prefix before it, stays apart from it when both are merged
from their characters. A character that no such piece covers is unknown, a token by itself. The ids are
recovered backwards from the whole text's entry; an unknown character becomes its UTF-8 bytes.

That test of two tokens is enough: merges happen by score, then from the left, so of a sequence of tokens
all of whose neighbours stay apart, no edge is ever merged across, as that merge would also come first in the
two tokens alone. Where no piece has a blank after another character, a text falls apart before its blanks; the
table is then filled word by word, and a worker remembers the ids of frequent words.

Defined results: a null text encodes and decodes as the empty one, to no ids and no characters. A blank and
U+2581 are the same character to such a model, so both decode as a blank. A text of any length takes time and
table space in proportion to it. Ids outside the vocabulary are an error, null ids decode as none. Lone
surrogates, which UTF-8 cannot hold, become ``?``. Other columns stay, and an output replaces a column of its name.
Models with another type, a normaliser or pieces of users' own are refused.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import send
from .common import SLICE_BYTES, slices

BLANK = "▁"
#: The table's entry of the empty prefix, and of those not reached yet; unknown characters are above it, below 0.
START, IDS = -(1 << 22), 1 << 22
#: Words, and pairs of tokens, that a worker remembers before it starts afresh.
WORDS, PAIRS = 400_000, 1_000_000
NORMAL, UNK, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in a model file


class Model:
    """A vocabulary: pieces by id, their scores, what is a byte, and how texts begin and decode."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as files

        proto = files.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds, rules = [p.type for p in proto.pieces], proto.normalizer_spec
        plain = rules.name == "identity" and not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.escape_whitespaces
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or proto.trainer_spec.treat_whitespace_as_suffix or not plain or set(kinds) - {NORMAL, UNK, CONTROL, BYTE}:
            raise ValueError(f"{path} is no plain BPE model with byte fallback")
        self.prefix = BLANK if rules.add_dummy_prefix else ""
        self.pieces = [p.piece for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.ids = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.byte = {k: int(p.piece[3:5], 16) for k, p in enumerate(proto.pieces) if p.type == BYTE}
        self.shown = [proto.trainer_spec.unk_surface if k == UNK else "" if k == CONTROL else p for k, p in zip(kinds, self.pieces)]


def pattern(pieces) -> str:
    """What finds the parts of a text between edges that no piece lies across, as far as the vocabulary has them.

    White space that is in no piece is an edge on both sides, and so is the front of blanks that only begin
    pieces. If no piece mixes letters with other characters, but for blanks before them, their runs are parts.
    """
    letters = "[A-Za-zÀ-ÖØ-öø-ɏ]"
    edges = "".join(c for c in "\n\r\t" if not any(c in p for p in pieces))
    alone = f"[{edges}]|" if edges else ""
    if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces):
        return f"{alone}[^{edges}]+" if edges else ".+"
    body = f"[^{edges}{BLANK}]"
    if any(re.search(f"{letters}(?!{letters}).|(?!{letters})[^{BLANK}]{letters}", p, re.S) for p in pieces):
        return f"{alone}{BLANK}+{body}*|{body}+"
    other = f"(?:(?!{letters}){body})"
    return f"{alone}{BLANK}*{letters}+|{BLANK}+{other}*|{other}+"


class Codec:
    """Encodes and decodes with one model; remembers the ids of frequent words."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.size = model, list(map(len, model.pieces))
        self.automaton = ahocorasick.Automaton()
        for piece, k in model.ids.items():
            self.automaton.add_word(piece, k)
        self.automaton.make_automaton()
        self.byte_ids = np.zeros(256, np.int32)
        for k, b in model.byte.items():
            self.byte_ids[b] = k
        self.is_byte = np.zeros(len(model.pieces), bool)
        self.is_byte[list(model.byte)] = True
        self.text = [p.replace(BLANK, " ") for p in model.shown]
        self.apart: dict[int, bool] = {}
        self.split = re.compile(pattern(model.ids), re.S).findall
        codec = self

        class Words(dict):
            def __missing__(self, word: str) -> tuple[int, ...]:
                ids = codec.table(word)
                if len(word) <= 64:
                    if len(self) >= WORDS:
                        self.clear()
                    self[word] = ids
                return ids

        self.words = Words()

    def merged(self, span: str) -> list[str]:
        """A short span's merges from single characters: the best score first, then the leftmost."""
        parts, score, none = list(span), self.model.score, float("-inf")
        while len(parts) > 1:
            each = [score.get(a + b, none) for a, b in zip(parts, parts[1:])]
            best = max(each)
            if best == none:
                break
            at = each.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: int, token: int) -> bool:
        """Whether ``token`` stays apart from what is before it: a token, an unknown character (``~code``), or nothing (``START``)."""
        if len(self.apart) >= PAIRS:
            self.apart.clear()
        first = [] if before == START else [self.model.pieces[before] if before >= 0 else chr(~before)]
        both = [*first, self.model.pieces[token]]
        ok = self.apart[before * IDS + token] = self.merged("".join(both)) == both
        return ok

    def last_tokens(self, text: str) -> list[int] | array:
        """The last token of every prefix, by its length; ``~code`` for an unknown character by itself."""
        last = [START] * (len(text) + 1) if len(text) < 1000 else array("i", [START]) * (len(text) + 1)
        size, apart, fits, at = self.size, self.apart, self.fits, 0
        for end, token in self.automaton.iter(text):
            if end >= at:  # the first piece that ends here; what ended before and fitted nothing is unknown
                while at <= end:
                    if last[at] == START and at:
                        last[at] = ~ord(text[at - 1])
                    at += 1
            elif last[at] != START:
                continue
            before = last[at - size[token]]
            ok = apart.get(before * IDS + token)
            if ok or ok is None and fits(before, token):
                last[at] = token
        while at <= len(text):
            if last[at] == START and at:
                last[at] = ~ord(text[at - 1])
            at += 1
        return last

    def table(self, text: str) -> tuple[int, ...]:
        last, at, ids = self.last_tokens(text), len(text), array("i")
        while at:
            token = last[at]
            if token >= 0:
                ids.append(token)
                at -= self.size[token]
            else:
                ids.extend(self.byte_ids[list(reversed(text[at - 1].encode("utf-8", "replace")))].tolist())
                at -= 1
        return tuple(reversed(ids))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        words = self.split(self.model.prefix + text.replace(" ", BLANK))
        return np.fromiter(chain.from_iterable(map(self.words.__getitem__, words)), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The pieces' text, less the blank that every text begins with; bytes that are no UTF-8 are each U+FFFD."""
        edges = np.flatnonzero(np.diff(self.is_byte[ids].astype(np.int8), prepend=-1, append=-1))
        out, opening = [], bool(self.model.prefix)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if self.is_byte[ids[a]]:
                out.append(utf8(bytes(map(self.model.byte.__getitem__, ids[a:b].tolist()))))
                opening = False
                continue
            run = ids[a:b].tolist()
            while opening and run:  # until something is shown, or a blank taken off
                first = self.model.shown[run.pop(0)]
                opening = not first
                out.append(first.removeprefix(BLANK).replace(BLANK, " "))
            out.extend(map(self.text.__getitem__, run))
        return "".join(out)


def utf8(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            out += [data[at : at + e.start].decode(), "�"]
            at += e.start + 1
    return "".join(out)


@lru_cache(2)
def codec(name: str) -> Codec:
    """One codec for a Python worker, from the model file that Spark has sent to its node."""
    return Codec(Model(SparkFiles.get(name)))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``, the token ids of ``text`` by the model file at ``path``, without begin or end ids."""
    name = send(docs, path)

    @F.arrow_udf("array<int>")
    def encoded(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(name)
        for batch in parts:
            for part in slices(batch):
                each = [c.encode(x) for x in part.to_pylist()]
                flat = np.concatenate([np.zeros(0, np.int32), *each])
                yield pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]), pa.int32()), pa.array(flat, pa.int32()))

    return docs.withColumn(ids, encoded(F.col(text)))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the text that ``ids`` stand for."""
    name = send(docs, path)

    @F.arrow_udf("string")
    def decoded(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(name)
        for batch in parts:
            made, size = [], 0
            for x in batch:
                made.append(c.decode(x.values.drop_null().to_numpy(zero_copy_only=False)) if x.is_valid else "")
                size += len(made[-1]) + 16
                if size > SLICE_BYTES:
                    yield pa.array(made, pa.string())
                    made, size = [], 0
            yield pa.array(made, pa.string())

    return docs.withColumn(out, decoded(F.col(ids)))
