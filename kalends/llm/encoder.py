"""Exact token ids of whole texts, with repeated words encoded once.

A split before a blank is proven safe for both public vocabularies: their
pre-tokenizers never join across it, so the ids of a text are the ids of its
blank-separated words in a row. Words are counted with Arrow's dictionary
encoding and only words not met before go through the tokenizers library.
Texts in which a split isn't proven (special-token strings, blanks next to
white space where that matters) are encoded whole by the library, and so are
all texts if a vocabulary's normalizer, pre-tokenizer or special tokens aren't
those that this was proven for.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Words kept at most; the store is emptied beyond it, which bounds memory.
MAX_WORDS = 400_000
#: Likewise of the pieces that words are made of, which outlast the words.
MAX_PIECES = 700_000
#: Words of these characters alone take the quick way; others go through the whole library.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7fßà-öø-ÿÀ-ÖØ-Þ]*")
#: What the splits were proven for, as a vocabulary file states it; fixed values.
PROVEN = {
    "byte": {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}},
    "word": {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    },
}
WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
BYTE_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_alphabet() -> dict[int, str]:
    """Byte to the printable character that byte-level vocabularies use for it."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in printable}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def packed(ids: Iterable[int]) -> bytes:
    return array("I", ids).tobytes()


class WordStore:
    """Ids of words, each worked out once; texts are gathered from them."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.counts = array("I"), array("q"), array("q")

    def word(self, word: str) -> bytes:
        """A word's ids as unsigned 32-bit integers."""
        raise NotImplementedError

    def _lookup(self, words: list[str]) -> np.ndarray:
        known = self.known
        for word in words:
            if word not in known:
                ids = self.word(word)
                known[word] = len(self.starts)
                self.starts.append(len(self.ids))
                self.counts.append(len(ids) // 4)
                self.ids.frombytes(ids)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def gather(self, parts: pa.ListArray, counts_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row as uint32, number of ids of each text), a text being a list of words."""
        if len(self.known) > MAX_WORDS:
            self.clear()
        offsets = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        at = self._lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy(zero_copy_only=False)]
        counts = np.frombuffer(self.counts, np.int64)[at]
        ends = np.concatenate([[0], counts.cumsum()])
        total = ends[offsets[1:] - offsets[0]] - ends[offsets[:-1] - offsets[0]]
        if counts_only or not len(at):
            return np.empty(0, np.uint32), total
        first = np.frombuffer(self.starts, np.int64)[at] - ends[:-1]
        where = np.repeat(first, counts)
        where += np.arange(len(where))
        return np.frombuffer(self.ids, np.uint32)[where] if len(self.ids) else np.empty(0, np.uint32), total


class Encoder(WordStore):
    """Ids as tokenizers gives them, add_special_tokens=False."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.library = Tokenizer.from_str(text)
        self.model = self.library.model
        spec = json.loads(text)
        self.by_words = spec["model"].get("end_of_word_suffix") == "</w>"
        model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>" if self.by_words else None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
        as_proven = all(spec["model"].get(k) == v for k, v in model.items()) and all(spec.get(k) == v for k, v in PROVEN["word" if self.by_words else "byte"].items())
        self.proven = as_proven and all(t["content"].startswith("<|") for t in spec.get("added_tokens", [])) and not spec.get("truncation") and not spec.get("padding")
        self.alphabet = byte_alphabet()
        self.blank = self.alphabet[32]
        self.pieces: dict[str, bytes] = {}
        super().__init__()

    def clear(self) -> None:
        super().clear()
        if len(self.pieces) > MAX_PIECES:
            self.pieces.clear()

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            if piece.isascii() and piece.isprintable():  # of these the blank alone has another character
                mapped = piece.replace(" ", self.blank)
            else:
                mapped = piece.encode().decode("latin-1").translate(self.alphabet)
            got = self.pieces[piece] = packed(t.id for t in self.model.tokenize(mapped))
        return got

    def word(self, word: str) -> bytes:
        end = word[-1:] if word[-1:] in (".", ",") else ""
        core = word[:-1] if end else word
        if core.isascii() and (core if self.by_words else core.removeprefix(" ")).isalpha():  # most words: letters, and a mark after them
            own = self._piece(core.lower() if self.by_words else core)
            return own + self._piece(end) if end else own
        if not PLAIN.fullmatch(word):
            return packed(self.library.encode(word, add_special_tokens=False).ids)
        if self.by_words:
            parts = WORD_PIECES.findall(word.lower())
        else:
            parts = BYTE_PIECES.findall(word)
        return b"".join(map(self._piece, parts))

    def encode(self, texts: pa.Array, counts_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row as uint32, number of ids of each text)."""
        n = len(texts)
        if n == 0:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if not self.proven:
            each = [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        unsafe = pc.match_substring(texts, "<|")
        if not self.by_words:
            unsafe = pc.or_(unsafe, pc.match_substring(texts, "\x00"))
            unsafe = pc.or_(unsafe, pc.match_substring_regex(texts, r" ([\s\pZ\x{85}\x0b\x1c-\x1f]|$)"))
        odd = np.flatnonzero(unsafe.to_numpy(zero_copy_only=False))
        if len(odd):
            plain = np.flatnonzero(~unsafe.to_numpy(zero_copy_only=False))
            ids, counts = self.encode(texts.take(pa.array(plain)), counts_only)
            each: list = [None] * n
            total = np.zeros(n, np.int64)
            total[plain] = counts
            for k in odd:
                own = np.array(self.library.encode(texts[int(k)].as_py(), add_special_tokens=False).ids, np.uint32)
                each[k], total[k] = own, len(own)
            if counts_only:
                return np.empty(0, np.uint32), total
            ends = counts.cumsum()
            for k, end, c in zip(plain, ends, counts, strict=True):
                each[k] = ids[end - c : end]
            return np.concatenate(each), total
        if not self.by_words:  # all words but a text's first have their blank
            texts = pc.replace_substring(texts, " ", "\x00 ")
        parts = pc.split_pattern(texts, " " if self.by_words else "\x00")
        return self.gather(parts, counts_only)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker process's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def public(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
