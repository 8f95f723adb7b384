"""Token ids of whole texts from a public tokenizer file, with repeated pieces encoded once."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np

#: A text may be cut before a space that follows a character other than white space: there a
#: byte-level pre-tokenizer always starts a new token, so the pieces' ids are the text's ids.
PIECE = re.compile(r"(?<=\S)(?= )")
#: White space before a space: only then do cuts before every space differ from ``PIECE``.
CLOSE = re.compile(r"\s ")
PAIRS = [chr(c) + " " for c in (*range(9, 14), *range(28, 33))]
#: A run of letters and then one of these characters are tokens of their own, so they encode apart.
TAIL = ".,;:!?|%$&#*\""
#: Letters below this one have been letters in every version of Unicode.
LATIN_END = "\u0250"
#: Printable bytes stand for themselves in the vocabulary, the others follow from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + n) for n, b in enumerate(sorted({*range(256)} - {*PRINTABLE}))}


def blocks_of(text: str | None, size: int = 500_000) -> Iterator[str]:
    """Consecutive blocks of ``text`` of about ``size`` characters that encode independently."""
    at, end = 0, len(text or "")
    while at < end:
        cut = PIECE.search(text, at + size) if at + size < end else None
        to = cut.start() if cut else end
        yield text[at:to]
        at = to


def pieces_of(text: str) -> tuple[str, list[str]]:
    """Pieces of ``text`` that a byte-level tokenizer encodes independently of each other: the
    first, and the later ones without the space each of them starts with."""
    if text.isascii():
        plain = not any(pair in text for pair in PAIRS)
    else:
        plain = not CLOSE.search(text)
    first, *rest = text.split(" ") if plain else PIECE.split(text)
    return first, rest if plain else [p[1:] for p in rest]


class _Known:
    """Values by piece, the first ``most`` met. After as many misses again it starts afresh."""

    def __init__(self, most: int, longest: int):
        self.most, self.longest, self.missed = most, longest, 0
        self.values: dict[str, bytes] = {}

    def add(self, fresh: dict[str, bytes]) -> None:
        if len(self.values) < self.most:
            self.values.update((p, v) for p, v in fresh.items() if len(p) <= self.longest)
            return
        self.missed += len(fresh)
        if self.missed > self.most:
            self.values, self.missed = {}, 0


class Encoder:
    """Encodes texts with a ``tokenizers`` file of a byte-level BPE; one for each Python worker.

    Pieces met before are looked up: at most ``max_pieces`` of at most ``max_length`` characters.
    Ids are those of the library's own call with ``add_special_tokens=False``: the text of an added
    token, where it occurs, is that token. Null is empty text.
    """

    _by_path: dict[str, Encoder] = {}

    def __init__(self, path: str, max_pieces: int = 1_000_000, max_length: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        plain = isinstance(self.tokenizer.model, models.BPE) and self.tokenizer.normalizer is None
        self.byte_level = plain and isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel)
        # The tokenizer takes its added tokens out of a text before anything else. A cut before a space
        # does not touch those without white space; with others a text is encoded whole.
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.cuts = not any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added)
        self.byte_level &= not any(t.content.rstrip(TAIL).isalpha() or set(t.content) <= set(TAIL) for t in added)
        self.known, self.known_spans = _Known(max_pieces, max_length), _Known(max_pieces, max_length)
        self.tails: dict[str, bytes] = {}
        self.tail_spans: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    @classmethod
    def release(cls) -> None:
        """Forget the pieces met: for a worker that goes on with other work."""
        cls._by_path.clear()

    def ids(self, text: str | None) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit numbers."""
        out = []
        for block in blocks_of(text) if self.cuts else [text or ""]:
            first, rest = pieces_of(block) if self.cuts else (block, [])
            out.append(self._ids_of(first))
            out.extend(self._looked_up(rest, self.known, self._encode))
        return b"".join(out)

    def spans(self, text: str | None) -> np.ndarray:
        """One row for each token of ``text``: its first character and the one after its last.

        A token that holds only some bytes of a character spans the whole character.
        """
        parts, at = [np.zeros((0, 2), np.int64)], 0
        for block in blocks_of(text) if self.cuts else [text or ""]:
            first, rest = pieces_of(block) if self.cuts else (block, [])
            found = [self._spans_of(first), *self._looked_up(rest, self.known_spans, self._encode_spans)]
            starts = at + np.cumsum([0, len(first), *[len(p) + 1 for p in rest]])
            inside = np.frombuffer(b"".join(found), "<i4").reshape(-1, 2)
            parts.append(inside + np.repeat(starts[:-1], [len(x) // 8 for x in found])[:, None])
            at = int(starts[-1])
        return np.concatenate(parts)

    def _looked_up(self, pieces: list[str], known: _Known, encode) -> list[bytes]:
        values = list(map(known.values.get, pieces))
        if None in values:
            fresh = encode({p for p, v in zip(pieces, values) if v is None})
            values = [fresh[p] if v is None else v for p, v in zip(pieces, values)]
            known.add(fresh)
        return values

    def _ids_of(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def _spans_of(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).offsets, "<i4").tobytes()

    def _encode(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of each piece and its space."""
        out, known, tokenize = {}, self.known.values, self.tokenizer.model.tokenize
        for p in pieces:
            core = p.rstrip(TAIL)
            if not (self.byte_level and core.isalpha() and max(core) < LATIN_END):
                out[p] = self._ids_of(" " + p)
                continue
            ids = known.get(core) if len(core) < len(p) else None
            if ids is None:
                tokens = tokenize("".join(map(BYTES.get, (" " + core).encode())))
                ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
            if len(core) < len(p):
                tail = p[len(core) :]
                if tail not in self.tails:
                    self.tails[tail] = self._ids_of(tail)
                ids += self.tails[tail]
            out[p] = ids
        if len(self.tails) > 10_000:
            self.tails = {}
        return out

    def _encode_spans(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """First and last-plus-one character of the tokens of each piece and its space."""
        out, tokenize = {}, self.tokenizer.model.tokenize
        for p in pieces:
            core = p.rstrip(TAIL)
            if not (self.byte_level and core.isalpha() and max(core) < LATIN_END):
                out[p] = self._spans_of(" " + p)
                continue
            # A token's text has one character for each of its bytes.
            shown, at, spans = " " + core, 0, []
            holder = None if core.isascii() else [i for i, c in enumerate(shown) for _ in c.encode()]
            for token in tokenize("".join(map(BYTES.get, shown.encode()))):
                end = at + len(token.value)
                spans += (at, end) if holder is None else (holder[at], holder[end - 1] + 1)
                at = end
            if len(core) < len(p):
                tail = np.frombuffer(self._tail_spans(p[len(core) :]), "<i4") + len(shown)
                spans += tail.tolist()
            out[p] = struct.pack(f"<{len(spans)}i", *spans)
        return out

    def _tail_spans(self, tail: str) -> bytes:
        if tail not in self.tail_spans:
            if len(self.tail_spans) > 10_000:
                self.tail_spans = {}
            self.tail_spans[tail] = self._spans_of(tail)
        return self.tail_spans[tail]
