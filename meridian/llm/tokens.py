"""Whole texts to token ids by a public tokenizer, through a bounded cache of pieces.

A BPE tokenizer splits a text before it merges, so a text may be cut wherever the split always falls,
each distinct piece encoded once by the library, and the ids joined. Where a tokenizer's split is not one
of the two known here, whole texts go to the library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from meridian.llm.common import kept

#: Pieces kept in a worker; beyond it the older half goes. Longer pieces, which seldom come again, are not kept, so
#: that a cache takes a few hundred bytes a piece at most.
CACHE_PIECES, PIECE_BYTES = 800_000, 64
#: Marks, a byte each, of pieces seen once; they are cleared when half are set.
SEEN_MARKS = 1 << 22

_ODD = re.compile(r"[ \n](?:\s|$)")
_CUT = re.compile(r"(?=[ \n]\S)")
#: A run of letters for which lower case and composition are beyond doubt, and ASCII marks other than the apostrophe.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)\Z")


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_CHARS = _byte_chars()
_BLANK = _BYTE_CHARS[ord(" ")]


class _Pieces(dict):
    """piece -> its ids as bytes; a missing one is encoded. Two generations bound the memory.

    Once the first generation is full, a piece is kept from the second time it is met (or marked alike), as more than
    half of all pieces come once and would push out those that come again. What is kept has no bearing on the ids.
    """

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit // 2, {}
        self.seen, self.marked = bytearray(SEEN_MARKS), 0

    def __missing__(self, piece):
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
            if len(piece) > PIECE_BYTES:
                return ids
            at = hash(piece) % SEEN_MARKS
            if self.old and not self.seen[at]:
                if self.marked >= SEEN_MARKS // 2:
                    self.seen, self.marked = bytearray(SEEN_MARKS), 0
                self.seen[at] = 1
                self.marked += 1
                return ids
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class TextEncoder:
    """encode(text) gives the ids as little-endian bytes of `dtype`, special strings being ordinary text."""

    def __init__(self, path: str, cache: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge = self.tokenizer.model.tokenize
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.vocab <= 0x10000 else np.dtype("<u4")
        self.pieces = _Pieces(self._piece, cache)
        self.kind = self._split(path)
        self.of_id = [np.array([i], self.dtype).tobytes() for i in range(self.vocab)]
        self.encode = {"words": self._by_words, "spaces": self._by_spaces, "": self._ids}[self.kind]

    @staticmethod
    def _split(path: str) -> str:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal, pre, model = spec.get("normalizer"), spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        if model.get("type") != "BPE":
            return ""
        if normal is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "spaces"
        steps = [x.get("type") for x in (normal or {}).get("normalizers", [])]
        first = (pre.get("pretokenizers") or [{}])[0]
        if steps == ["NFC", "Replace", "Lowercase"] and first.get("behavior") == "Removed" and first.get("invert") and "[^\\s\\p{L}\\p{N}]+" in str((first.get("pattern") or {}).get("Regex")):
            return "words"
        return ""

    def _ids(self, text: str) -> bytes:
        """What the library gives for a text."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _run(self, run: str) -> bytes:
        """Ids of one split by the library's merges, from its bytes' printable signs."""
        return b"".join([self.of_id[t.id] for t in self.merge(run)])

    @staticmethod
    def _mapped(run: str) -> str:
        return run.encode().decode("latin-1").translate(_BYTE_CHARS)

    def _word(self, piece: bytes) -> bytes:
        """A piece without white space: a plain word with or without marks after it is two splits at most."""
        if piece.isalpha():
            return self._run(piece.lower().decode())
        if m := _PLAIN.match(word := piece.decode()):
            if m[2]:
                return self.pieces[m[1].encode()] + self.pieces[m[2].encode()]
            return self._run(self._mapped(word.lower()))
        return self._ids(word)

    def _blank_word(self, piece: bytes) -> bytes:
        """The same for a blank and a piece; one that starts with a newline stands for itself, as does a bare str."""
        if piece.isalpha():
            return self._run(_BLANK + piece.decode())
        word = piece.decode()
        if word[:1] == "\n":
            return self.pieces["\n"] + self.pieces[word[1:]]
        if m := _PLAIN.match(word):
            return self.pieces[m[1].encode()] + self.pieces[m[2]] if m[2] else self._run(_BLANK + self._mapped(word))
        return self._ids(" " + word)

    def _piece(self, piece: bytes | str) -> bytes:
        if isinstance(piece, str):
            return self._ids(piece)
        return self._word(piece) if self.kind == "words" else self._blank_word(piece)

    def _by_words(self, text: str) -> bytes:
        """White space belongs to no token and stops every rule, so ASCII white space is a cut."""
        return b"".join(map(self.pieces.__getitem__, text.encode().split()))

    def _by_spaces(self, text: str) -> bytes:
        """A blank or newline before a character that is no white space always starts a new split."""
        if _ODD.search(text):
            return b"".join(map(self.pieces.__getitem__, _CUT.split(text)))
        first, *rest = text.encode().replace(b"\n", b" \n").split(b" ")
        return b"".join([self._ids(first.decode()), *map(self.pieces.__getitem__, rest)])

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text), dtype=self.dtype)


def encoder(path: str, cache: int = CACHE_PIECES) -> TextEncoder:
    """The encoder of a file, kept in the worker process while its tasks are of operators that encode by it."""
    return kept(("encoder", path, cache), lambda: TextEncoder(path, cache))


def public_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
