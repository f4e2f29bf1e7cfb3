"""Public tokenizers behind one vectorised interface, loaded once per Python worker."""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterable

import numpy as np

#: Where the vocabulary files lie; every operator takes another folder as a parameter.
TOKENIZER_DIR = "/opt/tokenizers"

#: Fixed value: the public pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts above this many characters are encoded in pieces.
LONG_TEXT = 1 << 16

#: A safe cut: before one plain space between two visible characters. No match of PATTERN holds a
#: visible character followed by a space, so the pieces' ids are the ids of the whole.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


class RankTokenizer:
    """A byte-level BPE given as a file of base64 pieces and ranks."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _one(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=())

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if len(text) <= LONG_TEXT:
            return self._one(text)
        return np.concatenate([self._one(piece) for piece in split_safely(text, LONG_TEXT)])

    def ids(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        return [self.encode(t) for t in texts]

    def counts(self, texts: Iterable[str | None]) -> np.ndarray:
        return np.fromiter((len(self.encode(t)) for t in texts), np.int64)

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """The bytes behind the ids; a token may hold part of a character, so bytes are joined before decoding."""
        return self.encoding.decode_bytes([int(i) for i in ids])


class PieceTokenizer:
    """A sentencepiece model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        return [np.asarray(x, np.uint32) for x in self.model.encode([t or "" for t in texts], num_threads=1)]

    def counts(self, texts: Iterable[str | None]) -> np.ndarray:
        return np.fromiter(map(len, self.model.encode([t or "" for t in texts], num_threads=1)), np.int64)


class JsonTokenizer:
    """A tokenizer described by a JSON file; special strings in a text are ordinary text."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True

    def ids(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        return [np.asarray(x.ids, np.uint32) for x in self.model.encode_batch([t or "" for t in texts], add_special_tokens=False)]

    def counts(self, texts: Iterable[str | None]) -> np.ndarray:
        return np.fromiter(map(len, self.ids(texts)), np.int64)


def split_safely(text: str, size: int) -> list[str]:
    """Pieces of about ``size`` characters whose encodings join to that of the whole.

    Without a safe place within a piece, the piece grows up to the next one, so runs without blanks stay whole.
    """
    pieces, at = [], 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size - 1)
        if not cut:
            break
        pieces.append(text[at : cut.start()])
        at = cut.start()
    return [*pieces, text[at:]]


@functools.lru_cache(maxsize=8)
def load(name: str, folder: str = TOKENIZER_DIR) -> RankTokenizer | PieceTokenizer | JsonTokenizer:
    """The tokenizer of that name in a folder of vocabulary files, kept for the life of the process."""
    for suffix, kind in ((".tiktoken", RankTokenizer), (".model", PieceTokenizer), (".json", JsonTokenizer)):
        path = os.path.join(folder, name + suffix)
        if os.path.exists(path):
            return kind(path)
    raise FileNotFoundError(f"no vocabulary file for tokenizer {name!r} in {folder}")


class _Counts(dict):
    """Token counts of units under several tokenizers, packed into one whole number; filled as units turn up."""

    #: Units kept at most in each of two generations: a full table becomes the older one, from which units that turn up again
    #: are taken over. So memory is bounded whatever the vocabulary, and frequent units stay.
    LIMIT = 200_000

    def __init__(self, tokens: list, first: bool) -> None:
        super().__init__()
        self.older: dict[str, int] = {}
        self.encoders = [(t.model.encode if isinstance(t, PieceTokenizer) else t.encoding.encode_ordinary, "" if first or isinstance(t, PieceTokenizer) else " ", 40 * i) for i, t in enumerate(tokens)]

    def __missing__(self, unit: str) -> int:
        if len(self) >= self.LIMIT:
            self.older = dict(self)
            self.clear()
        packed = self.older.get(unit)
        if packed is None:
            packed = 0
            for encode, lead, shift in self.encoders:
                packed |= len(encode(lead + unit)) << shift
        self[unit] = packed
        return packed


class UnitCounter:
    """Exact token counts by adding up counts of units, each encoded once.

    A unit ends before a plain space between two visible characters. Byte-level tokenizers never
    merge across such a place (see ``split_safely``), nor do piece models none of whose pieces has a
    blank after a visible sign; their blank before the first unit is the one that they add
    themselves. Other tokenizers count whole texts.
    """

    def __init__(self, names: list[str], folder: str = TOKENIZER_DIR) -> None:
        loaded = [load(n, folder) for n in names]
        self.by_unit = [i for i, t in enumerate(loaded) if _adds_up(t)]
        self.whole = [i for i in range(len(loaded)) if i not in self.by_unit]
        self.loaded = loaded
        parts = [loaded[i] for i in self.by_unit]
        self.rest, self.first = _Counts(parts, False), _Counts(parts, True)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """An array of texts by tokenizers."""
        out = np.zeros((len(texts), len(self.loaded)), np.int64)
        low = (1 << 40) - 1
        again = []
        if self.by_unit:
            for row, text in enumerate(texts):
                if text:
                    units = _SAFE.split(text)
                    packed = self.first[units[0]] + sum(map(self.rest.__getitem__, units[1:]))
                    for i, column in enumerate(self.by_unit):
                        out[row, column] = packed >> (40 * i) & low
                    if "\u2581" in text:  # piece models take this sign for a blank
                        again.append(row)
        for row in again:
            out[row] = [t.counts([texts[row]])[0] for t in self.loaded]
        for column in self.whole:
            out[:, column] = self.loaded[column].counts(texts)
        return out


def _adds_up(tokenizer: object) -> bool:
    if isinstance(tokenizer, RankTokenizer):
        return True
    if isinstance(tokenizer, PieceTokenizer):
        m = tokenizer.model
        return not any("\u2581" in m.id_to_piece(i).lstrip("\u2581") for i in range(m.get_piece_size()))
    return False
