"""Exact token ids of whole texts with a public tokenizer file, memoised by word.

``encode`` gives what ``tokenizers.Tokenizer.encode(text,
add_special_tokens=False)`` gives.  The tokenizer drops white space and never
joins across it, so a text's ids are those of its blank-separated chunks in
turn; chunks repeat, so each distinct one is encoded once per worker and kept in
a memo of bounded size (what was not used lately goes: only speed depends on it).
Chunks with characters outside a plainly safe set (other white space, combining
marks, letters whose lower case differs between libraries) or with the beginning
of a special token go to the library as they are.
"""

from __future__ import annotations

import os
import re

import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed by the tokenizer file: its pre-tokeniser's pattern.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Any character outside the set for which lower-casing and splitting here are sure to equal the library's.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ſ]")
_BLANKS = re.compile("[ \t\n\r\f\v]+")
MEMO = 200_000


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in own}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + n)
            n += 1
    return out


class WordTokenizer:
    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        self.path = path or default_path()
        self.library = Tokenizer.from_file(self.path)
        self.model = self.library.model
        self._letters = _byte_letters()
        self._bytes = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def letters(self, word: str) -> str:
        """A word in the byte-level alphabet, as the merges see it."""
        return word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self._letters)

    def piece(self, piece: str) -> bytes:
        """Ids of one pre-token, or of a chunk that ``chunk`` keeps."""
        ids = self._new.get(piece)
        if ids is None:
            ids = self._old.get(piece)
            if ids is None:
                ids = b"".join([self._bytes[t.id] for t in self.model.tokenize(self.letters(piece))])
            self._keep(piece, ids)
        return ids

    def _keep(self, key: str, ids: bytes) -> None:
        if len(self._new) >= MEMO:  # what was not used since the last turn goes
            self._old, self._new = self._new, {}
        self._new[key] = ids

    def chunk(self, chunk: str) -> bytes:
        if _OTHER.search(chunk) or "<|" in chunk:
            return b"".join([self._bytes[i] for i in self.library.encode(chunk, add_special_tokens=False).ids])
        if chunk.isalpha():
            return self.piece(chunk)
        ids = self._old.get(chunk)
        if ids is None and chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            ids = self.piece(chunk[:-1]) + self.piece(chunk[-1])
        elif ids is None:
            found = PIECES.findall(chunk)
            ids = self.piece(found[0]) if found == [chunk] else b"".join(map(self.piece, found))
        self._keep(chunk, ids)
        return ids

    def chunks(self, text: str) -> list[str]:
        """Blank-separated chunks whose ids, one after the other, are the text's."""
        if (not text.isascii() or not text.isprintable()) and _OTHER.search(text) or "<|" in text:
            return [c if _OTHER.search(c) or "<|" in c else c.lower() for c in _BLANKS.split(text) if c]
        return text.lower().split()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return b"".join(self.ids(self.chunks(text)))

    def ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk."""
        out = list(map(self._new.get, chunks))
        at = -1
        try:
            while True:
                at = out.index(None, at + 1)
                out[at] = self.chunk(chunks[at])
        except ValueError:
            return out


_HELD: dict[str, WordTokenizer] = {}


def tokenizer(path: str | None = None) -> WordTokenizer:
    """This worker's tokenizer (with its memo) for a file."""
    path = path or default_path()
    if path not in _HELD:
        _HELD[path] = WordTokenizer(path)
    return _HELD[path]
