"""Exact token ids of whole texts, each distinct safe piece encoded once.

A text is split where the tokenizer itself always splits, so the ids of the
text are the ids of its pieces in order:

* ``word``: the pre-tokenizer removes white space, so the words between ASCII
  white space are independent;
* ``byte``: byte-level BPE without a normalizer; a new pre-token starts at a
  single space between two other characters (the space goes with the right);
* ``piece``: sentencepiece with a dummy prefix and no vocabulary entry with a
  space mark after another character; a single space between two characters
  equals the dummy prefix of the right-hand piece;
* ``whole``: anything else is not split.

Natural text repeats its words, so a worker keeps a bounded table of the pieces it
has encoded; only new pieces go to the library, in batches of equal bytes.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa

TABLE_PIECES = 600_000  # entries of a worker's table (about 120 MB); beyond, it starts anew
BATCH_BYTES = 256  # bytes a string given to the library (short ones are encoded fastest, a word at a time is slower)
SLICE_BYTES = 1 << 21  # text bytes worked on at once
MARK = b"\x01"  # stands between words in a library call; words holding it are encoded alone

_BYTE_CUT = re.compile(r"(?<=\S)(?= \S)")
_PIECE_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")

# How byte-level BPE shows a byte: printable Latin-1 characters as themselves, the others from U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = {b: chr(b) for b in _PLAIN} | {b: chr(0x100 + i) for i, b in enumerate(x for x in range(256) if x not in _PLAIN)}


class _Codes(dict):
    """Piece -> code; a new piece gets the next code and is put on the list."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, piece):
        code = self[piece] = len(self)
        self.new.append(piece)
        return code


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
            self.encode = lambda texts: [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
            self.kind = _json_kind(json.loads(self.library.to_str()))
        else:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: self.library.encode(texts, num_threads=1)
            names = (self.library.id_to_piece(i) for i in range(self.library.get_piece_size()))
            split = all("▁" not in n.lstrip("▁") for n in names)
            self.kind = "piece" if split and _has_dummy_prefix(self.library) else "whole"
        mark = self.encode([MARK.decode()])[0] if self.kind == "word" else []
        self.mark = mark[0] if len(mark) == 1 else None
        # the pre-tokenizer parts letters from a point or comma, and the normalizer folds case
        self.folds = self.kind == "word" and '"Lowercase"' in self.library.to_str()
        self.ends = {ord(c): np.asarray(self.encode([c])[0], np.uint32) for c in ".,"} if self.folds else {}
        self.clear()

    def clear(self) -> None:
        self.codes = _Codes()
        self.length = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def pieces(self, text: bytes) -> list[bytes]:
        if self.kind == "word":
            return text.split()
        if not text:
            return []
        if self.kind == "whole":
            return [text]
        cut = _BYTE_CUT if self.kind == "byte" else _PIECE_CUT
        return [p.encode() for p in cut.split(text.decode())]

    def coded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the pieces of all texts, and the first piece of each text (texts + 1)."""
        if len(self.codes) > TABLE_PIECES:
            self.clear()
        code, parts, first = self.codes.__getitem__, [], np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            pieces = self.pieces(text)
            parts.append(np.fromiter(map(code, pieces), np.int64, len(pieces)))
            first[i + 1] = first[i] + len(pieces)
        self._learn()
        return np.concatenate(parts) if parts else np.zeros(0, np.int64), first

    def _learn(self) -> None:
        """Ids of the new pieces: from the library, or, for a word that differs from
        another only in A-Z or a last point or comma, from that word's."""
        known, new = len(self.length), self.codes.new
        if not new:
            return
        derived: list[tuple[int, int, np.ndarray]] = []
        if self.folds:
            plain = []
            for i, p in enumerate(new[: len(new)]):
                end = self.ends.get(p[-1])
                if end is None and p.islower():  # no A-Z
                    plain.append(known + i)
                    continue
                stem = (p if end is None else p[:-1]).lower()
                if stem != p and stem and stem.decode().isalpha():
                    derived.append((known + i, self.codes[stem], end))
                else:
                    plain.append(known + i)
            plain += range(known + len(derived) + len(plain), len(self.codes))
            new = self.codes.new
        else:
            plain = list(range(known, known + len(new)))
        self.codes.new = []
        ids = self._encode([new[i - known] for i in plain])
        size = np.array([len(x) for x in ids], np.int64)
        self.length, self.start = (np.concatenate([x, np.zeros(len(new), np.int64)]) for x in (self.length, self.start))
        self.length[plain], self.start[plain] = size, len(self.flat) + np.cumsum(size) - size
        flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))])
        more, at = [], len(flat)
        for code, stem, end in derived:
            start, n = self.start[stem], self.length[stem]
            if end is not None:
                more.append(flat[start : start + n])
                more.append(end)
                start, n, at = at, n + len(end), at + n + len(end)
            self.start[code], self.length[code] = start, n
        self.flat = np.concatenate([flat, *more])

    def _letters(self, piece: bytes) -> list[int] | None:
        """Ids of a lower-case word of letters straight from the library's model: its
        normalizer leaves such a word as it is and its pre-tokenizer makes it one token."""
        if piece.isalpha() and piece.islower():  # a-z only
            return [t.id for t in self.library.model.tokenize(piece.decode())]
        word = piece.decode()
        if not word.isalpha() or word.lower() != word or not is_normalized("NFC", word):
            return None
        return [t.id for t in self.library.model.tokenize(word if word.isascii() else "".join([_SHOWN[b] for b in piece]))]

    def _encode(self, pieces: list[bytes]) -> list[list[int]]:
        if not self.folds:
            return [x.tolist() for x in self._encode_any(pieces)]
        ids = [self._letters(p) for p in pieces]
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(rest, self._encode_any([pieces[i] for i in rest])):
            ids[i] = x.tolist()
        return ids

    def _encode_any(self, pieces: list[bytes]) -> list[np.ndarray]:
        if self.mark is None:
            return [np.asarray(x, np.uint32) for group in _groups(pieces, 1) for x in self.encode([p.decode() for p in group])]
        ids: list = [None] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if MARK not in p]
        for i, p in enumerate(pieces):
            if MARK in p:
                ids[i] = np.asarray(self.encode([p.decode()])[0], np.uint32)
        joint = b" " + MARK + b" "  # the mark is a token of its own and ends the word before it
        rows = self.encode([joint.join(group).decode() for group in _groups([pieces[i] for i in plain], len(joint))])
        at = 0
        for row in rows:
            row = np.asarray(row, np.uint32)
            cuts = [-1, *np.flatnonzero(row == self.mark).tolist(), len(row)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                ids[plain[at]] = row[a + 1 : b]
                at += 1
        return ids

    def counts(self, texts: list[bytes]) -> np.ndarray:
        codes, first = self.coded(texts)
        total = np.concatenate([[0], np.cumsum(self.length[codes])])
        return total[first[1:]] - total[first[:-1]]

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        codes, first = self.coded(texts)
        size = self.length[codes]
        stop = np.cumsum(size)
        flat = self.flat[np.repeat(self.start[codes] - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)]
        total = np.concatenate([[0], stop])
        return np.split(flat, total[first[1:-1]]) if len(texts) else []


def _groups(pieces: list[bytes], joint: int):
    group, held = [], 0
    for p in pieces:
        group.append(p)
        held += len(p) + joint
        if held >= BATCH_BYTES:
            yield group
            group, held = [], 0
    if group:
        yield group


def _json_kind(spec: dict) -> str:
    steps = spec.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    normal = (spec.get("normalizer") or {}).get("normalizers", [])
    if steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") \
            and "\\s" in str(steps[0].get("pattern")) and all(n["type"] in ("NFC", "Replace", "Lowercase") for n in normal):
        return "word"
    if [s.get("type") for s in steps] == ["ByteLevel"] and steps[0].get("use_regex", True) \
            and not steps[0].get("add_prefix_space") and not spec.get("normalizer"):
        return "byte"
    return "whole"


def _has_dummy_prefix(library) -> bool:
    return library.encode("a", out_type=str)[0].startswith("▁")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a vocabulary file (workers are reused between tasks)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(column, limit: int = SLICE_BYTES):
    """(first row, texts as bytes) of a string column in runs of about ``limit`` bytes; null is empty."""
    held, size, first = [], 0, 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        for x in chunk.cast(pa.large_binary()):
            held.append(x.as_py() or b"")
            size += len(held[-1])
            if size >= limit:
                yield first, held
                first, held, size = first + len(held), [], 0
    if held:
        yield first, held
