"""Token ids of whole documents, with a memo of words over the tokenizers library.

``word_bpe_49k.json`` never lets a token span white space: its splitter drops white
space and its normaliser maps characters one by one.  So the ids of a text are the
ids of its words, one after the other, and a word that was met before needs no second
run of the merge rules.  A word of letters with closing punctuation is looked up by its
lower-case letters; every other new word, and texts with the separators 0x1C-0x1F, which
Python but not the tokenizer takes for white space, go to ``Tokenizer.encode`` as they are.
"""

from __future__ import annotations

import json
import os
import sys
import types
import unicodedata

import numpy as np

#: Words kept, first as they stand, then as letters alone.  A full table is emptied, so
#: each Python worker holds at most about 45 and 55 MB.
WORDS, STEMS, LONGEST = 200_000, 250_000, 48
CLOSING = ".,!?;:*#$%&\"()-"


def _byte_letters() -> dict[int, str]:
    """The usual printable stand-ins of byte-level vocabularies: printable bytes stand
    for themselves, the others follow from U+0100 on."""
    same = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(same)]
    return {b: chr(b) for b in same} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Words(dict):
    """Word to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = {b: c for b, c in _byte_letters().items()}
        self.pack = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.stems: dict[str, bytes] = {}

    @staticmethod
    def _pack(ids) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _run(self, run: str) -> bytes:
        """Ids of one run that the splitter leaves in one piece."""
        mapped = run if run.isascii() else "".join([self.letters[b] for b in run.encode()])
        pack = self.pack
        found = b"".join([pack[t.id] for t in self.model.tokenize(mapped)])
        if len(self.stems) >= STEMS:
            self.stems.clear()
        self.stems[run] = found
        return found

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(CLOSING)
        stems = self.stems
        run = stem.lower()
        ids = stems.get(run)
        if ids is None:
            # Below U+0130 lower() maps characters one by one, as the tokenizer does.
            if len(word) > LONGEST:
                return self.whole(word)
            if not stem.isalpha() or not stem.isascii() and not (max(stem) < "\u0130" and unicodedata.is_normalized("NFC", stem)):
                ids = self.whole(word)
                stem = word
            else:
                ids = self._run(run)
        if len(stem) < len(word):
            end = word[len(stem) :]
            ids += stems.get(end) or self._run(end)
        if len(self) >= WORDS:
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


class Library:
    """The same for any other vocabulary: every text goes to the library whole."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, text: str | None) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids if text else [], "<u4").tobytes()


# The normaliser and splitter that ``Words`` is written for.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def drops_spaces(path: str) -> bool:
    """Whether a vocabulary file normalises and splits as ``Words`` takes for granted."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    special = all(t.get("special") and not any(c.isspace() for c in t["content"]) and not t.get("lstrip") and not t.get("rstrip") for t in found.get("added_tokens") or [])
    return found.get("normalizer") == NORMALISER and found.get("pre_tokenizer") == SPLITTER and special and not found.get("truncation")


def encoder(path: str) -> Words | Library:
    """The memo of this Python worker, or the plain library for other vocabularies; later tasks of the worker find it filled."""
    held = sys.modules.setdefault("_graphloom_tokens", types.ModuleType("_graphloom_tokens"))
    if path not in held.__dict__:
        held.__dict__[path] = Words(path) if drops_spaces(path) else Library(path)
    return held.__dict__[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
