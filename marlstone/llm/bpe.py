"""Byte-level BPE encoding and decoding with forced boundaries.

A pair of bytes that stands next to each other inside no token of the vocabulary can never be joined by a merge, so a
cut between the two is certain: the fragments between such cuts are encoded independently and their ids concatenated.
The tokenizer's own first split (added tokens, then its pattern) is made before that. Whole pieces, from a space that
follows a visible character to the next, recur often; their ids and bytes are kept in two bounded tables per worker: when the younger is
full it becomes the elder, and pieces found in the elder move on, so pieces that recur stay.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from .common import release

VOCABULARY = "byte_bpe_50k.json"
#: A space after a character that is white space by no definition: the pattern always starts a new match there.
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85]) ")
#: A space that may belong to a run of white space.
_RUN = re.compile(r"[\s\x1c-\x1f\x85] ")
#: Pieces whose characters are letters, digits and marks by any version of Unicode: the pattern's matches are found here.
_PLAIN = re.compile("[ -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^ {_LETTERS}0-9]+| +(?![^ ])| +")
#: Pieces kept in a table, and the longest that is, so that a table's bytes are bounded too.
_CACHED, _LONGEST = 250_000, 64
_coders: dict[str, Coder] = {}


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else extra))
        extra += b not in shown
    return out


class Coder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        chars = byte_characters()
        self.shown = {c: "".join(chars[b] for b in chr(c).encode()) for c in [32, *range(0xC0, 0x100)]}
        self.split, self.model = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        # joined[a, b]: some token holds the characters of bytes a and b side by side.
        self.joined = np.zeros((256, 256), bool)
        for token in self.bytes_of.values():
            t = np.frombuffer(token, np.uint8)
            self.joined[t[:-1], t[1:]] = True
        self.certain = {chars[a]: {chars[b] for b in np.flatnonzero(~self.joined[a])} for a in range(256)}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces: dict[str, tuple[str, int, bytes]] = {}  # by what follows the piece's space
        self.elder: dict[str, tuple[str, int, bytes]] = {}

    def clear(self) -> None:
        self.pieces, self.elder = {}, {}

    def fragments(self, word: str) -> list[str]:
        """A word, in byte characters, cut at the certain boundaries."""
        certain = self.certain
        cuts = [i for i, (a, b) in enumerate(zip(word, word[1:], strict=False), 1) if b in certain[a]]
        if not cuts:
            return [word]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def words(self, piece: str) -> list[str]:
        """The pattern's matches in a piece, in byte characters."""
        if not _PLAIN.fullmatch(piece):
            return [word for word, _ in self.split(piece)]
        found = _SPLIT.findall(piece)
        return [w.translate(self.shown) for w in found]

    def encode_piece(self, piece: str) -> list[int]:
        return [t.id for word in self.words(piece) for f in self.fragments(word) for t in self.model.tokenize(f)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def describe(self, piece: str) -> tuple[str, int, bytes]:
        """Ids as decimals joined by commas, their number, and the bytes they decode to."""
        ids = self.encode_piece(piece)
        return ",".join(map(str, ids)), len(ids), b"".join(map(self.bytes_of.__getitem__, ids))

    def after_space(self, rest: str) -> tuple[str, int, bytes]:
        """Of a piece of one space and rest."""
        if len(self.pieces) > _CACHED:
            self.elder, self.pieces = self.pieces, {}
        out = self.elder.get(rest) or self.describe(" " + rest)
        if len(rest) <= _LONGEST:
            self.pieces[rest] = out
        return out

    def coded(self, text: str) -> list[tuple[str, int, bytes]]:
        """Of each piece of a text, in order."""
        out: list[tuple[str, int, bytes]] = []
        for k, part in enumerate(self.at_added.split(text) if self.at_added and self.at_added.search(text) else [text]):
            if k % 2:
                out.append((str(self.added[part]), 1, part.encode()))
                continue
            first, *rest = _CUT.split(part) if _RUN.search(part) else part.split(" ")
            if first:
                out.append(self.describe(first))
            try:
                out += list(map(self.pieces.__getitem__, rest))
            except KeyError:
                out += [self.pieces.get(p) or self.after_space(p) for p in rest]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, n, _ in self.coded(text) if n for i in ids.split(",")]


def coder(name: str = VOCABULARY) -> Coder:
    if name not in _coders:
        _coders[name] = Coder(public_tokenizers.path(name))
    return _coders[name]


def encode_decode(docs: DataFrame, vocabulary: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded.

    Null text counts as empty, which has no ids. Very long texts are gone through piece by piece and kept whole in one task. An empty table gives an empty result. Repeated rows and null doc_ids keep their rows; other columns are not read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(vocabulary)
        gc.disable()  # the tables hold no cycles, and going through them again and again takes time
        try:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                    parts, numbers, shown = zip(*code.coded(text.as_py() or ""), strict=True) if text.as_py() else ((), (), ())
                    ids = ",".join(parts)
                    decoded = b"".join(shown).decode("utf-8", "replace")
                    rows.append((doc_id, sum(numbers), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()) + ((list(map(int, ids.split(","))) if ids else []), decoded) * with_ids)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
        finally:  # the worker goes on to other tasks
            code.clear()
            gc.enable()
            release()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
