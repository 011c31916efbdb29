"""Exact tokenization at the speed of a dictionary.

A tokenizer that splits text before it merges gives each stretch of text that
begins where white space begins the same ids wherever it stands. So a worker
encodes each distinct stretch once, through the tokenizers library, and strings
documents together from what it keeps. What is kept is bounded; a stretch that
is met again after the bound is encoded again.
"""

from __future__ import annotations

import json
import os
import re
from array import array

from .common import worker_cache

#: Stretches that a worker keeps.
KEPT = 1_200_000

#: Letters that are one code point in either normal form, and that both the pattern's and Python's classes call letters.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Points that some regular-expression engines call white space and others do not, and the mark used for cutting.
_ODD = re.compile(r"[\x00\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁤　﻿]")
_RUN = re.compile(r"[ \t\n\r][ \t\n\r]")
_BREAK = re.compile(r"(?<=[^ \t\n\r])(?=[ \t\n\r])")
_GAP = re.compile(r"[ \t\n\r]+")
_TAIL = re.compile(r"[.,;:!?]+$")


def default_path(name: str) -> str:
    """Where the public vocabulary file ``name`` lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """The byte-level letters: printable bytes stand for themselves, the others for the points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(rest)}


class _Kept(dict):
    """Serialized ids (little-endian unsigned 32 bits) by stretch of text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.words_only = "Split" in json.dumps(spec["pre_tokenizer"])
        self.letters = _byte_letters()
        self.by_model = self.tokenizer.model.tokenize

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, text: str) -> bytes:
        tail = _TAIL.search(text)
        if tail and tail.start() and _PLAIN.match(text[tail.start() - 1]):
            ids = self[text[: tail.start()]] + self[tail.group()]
        elif text[:1] == "\n" and text[1:2] > " ":
            ids = self["\n"] + self[text[1:]]
        else:
            space = not self.words_only and text[:1] == " "
            word = text[1:] if space else text
            if _PLAIN.fullmatch(word):
                if self.words_only:
                    word = word.lower()
                raw = (" " + word if space else word).encode().decode("latin-1").translate(self.letters)
                ids = array("I", [t.id for t in self.by_model(raw)]).tobytes()
            else:
                ids = self.encode(text)
        if len(text) <= 64 and len(self) < KEPT:
            self[text] = ids
        return ids

    def serialized(self, text: str) -> bytes:
        """Ids of a whole text."""
        if self.words_only:
            # White space is dropped, and nothing is merged or composed across it.
            return b"".join(map(self.__getitem__, _GAP.split(text) if _ODD.search(text) else text.split()))
        if _ODD.search(text):
            return self.encode(text)
        if _RUN.search(text) or "\t" in text or "\r" in text:
            parts = _BREAK.split(text)
        else:
            parts = text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")
        return b"".join(map(self.__getitem__, parts))


def serializer(path: str):
    """Function from a text to its serialized ids by the tokenizer file ``path``; one per worker and file."""
    return worker_cache(f"ids:{path}", lambda: _Kept(path)).serialized
