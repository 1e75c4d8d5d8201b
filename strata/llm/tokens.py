"""Fast exact encoding with a public tokenizer file of the tokenizers library.

A space that something else than white space follows always begins a new
pre-token, both for byte-level and for word-end vocabularies, so a text falls
into chunks (a space and what follows up to the next one) whose ids don't depend
on each other. Chunks recur, and so do the pre-tokens in them: the ids of both
are remembered, in bounded tables, and only new pre-tokens go through the
library's merge model. Ids are those of the library's own ``encode`` of the whole
text without special tokens around it: texts that hold the string of an added
token, and files of other kinds, go through the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import regex

#: Chunks and pre-tokens remembered by one Python worker at most, each: the first that it meets, which are the frequent ones.
REMEMBERED = 300_000
REMEMBERED_CHARS = 40

#: The pattern that byte-level pre-tokenizers use.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ODD = re.compile(r" \s|^\s|\s$")


def _byte_table() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = _byte_table()
#: Marks that the patterns keep together behind a word.
_MARKS = ".,!?;:|#$%&*()-"


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.model = self.tokenizer.model
        self.by_chunk: dict[str, bytes] = {}
        self.by_word: dict[str, bytes] = {}
        self.by_piece: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pattern, self.normalizer = self._pieces_of(spec)
        self.spaces = self.normalizer is None  # a word's space is part of it

    def _pieces_of(self, spec: dict):
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        if spec["model"]["type"] != "BPE" or spec["model"].get("continuing_subword_prefix"):
            return None, None
        if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and norm is None:
            return regex.compile(BYTE_LEVEL_PATTERN), None
        steps = pre.get("pretokenizers", [])
        if [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["invert"] and steps[0]["behavior"] == "Removed" and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]:
            kinds = [n["type"] for n in (norm or {}).get("normalizers", [])]
            return regex.compile(steps[0]["pattern"]["Regex"]), (self.tokenizer.normalizer if norm else None, kinds == ["NFC", "Replace", "Lowercase"])
        return None, None

    def chunks(self, text: str) -> list[str]:
        """The text cut before each space that something else than white space follows."""
        first, *rest = text.split(" ")
        if not _ODD.search(text):
            return [first, *[" " + p for p in rest]]
        out = [first] if first else []
        tail = ""
        for p in rest:
            if p and not p[0].isspace():
                if tail:
                    out[-1:] = [(out[-1] if out else "") + tail]
                    tail = ""
                out.append(" " + p)
            else:
                tail += " " + p
        if tail:
            out[-1:] = [(out[-1] if out else "") + tail]
        return out

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token."""
        got = self.by_piece.get(piece)
        if got is None:
            mapped = piece.encode("utf-8", "replace").decode("latin-1").translate(_BYTES)
            got = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])
            if len(piece) <= REMEMBERED_CHARS and len(self.by_piece) < REMEMBERED:
                self.by_piece[piece] = got
        return got

    def _ids(self, chunk: str) -> bytes:
        """Ids of a chunk that isn't remembered."""
        text = chunk
        if self.normalizer is not None:
            normalizer, plain = self.normalizer
            text = chunk.lower() if plain and chunk.isascii() else normalizer.normalize_str(chunk) if normalizer else chunk
        core = text.rstrip(_MARKS)
        if core[1:].isalpha() and (core[0] == " " or core[0].isalpha()):  # one word, and marks behind it: what the pattern would find
            out = [self._piece(core if self.spaces else core.lstrip(" "))]
            if len(core) < len(text):
                out.append(self._piece(text[len(core) :]))
        else:
            out = list(map(self._piece, self.pattern.findall(text)))
        return out[0] if len(out) == 1 else b"".join(out)

    def _chunk(self, chunk: str) -> bytes:
        got = self.by_chunk.get(chunk)
        if got is None:
            got = self._ids(chunk)
            if len(chunk) <= REMEMBERED_CHARS and len(self.by_chunk) < REMEMBERED:
                self.by_chunk[chunk] = got
        return got

    def _word(self, word: str) -> bytes:
        """Ids of the chunk of a space and ``word``, remembered without the space, so that a split text needs no new strings."""
        got = self.by_word.get(word)
        if got is None:
            got = self._ids(" " + word)
            if len(word) < REMEMBERED_CHARS and len(self.by_word) < REMEMBERED:
                self.by_word[word] = got
        return got

    def encode_one(self, text: str | None) -> bytes:
        """Ids of a text (None: empty) as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.pattern is None or self.added is not None and self.added.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        words = text.split(" ")
        found = list(map(self.by_word.get, words))
        found[0] = self._chunk(words[0])
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    word = words[i]
                    if not word or word[0].isspace():  # never remembered as a word: spaces that chunks don't begin with
                        return b"".join(map(self._chunk, self.chunks(text)))
                    found[i] = self._word(word)
        return b"".join(found)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self.encode_one(t) for t in texts]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The encoder of this Python worker for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    """Path of one of the installed public vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path(name)
