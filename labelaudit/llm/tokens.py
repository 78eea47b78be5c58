"""Tokenizing inside tasks with a vocabulary file that is a parameter."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers

#: Text worked off at a time.
CHUNK_CHARS = 2_000_000
#: Distinct pieces a process remembers.
REMEMBERED = 800_000

DEFAULT = "byte_bpe_50k.json"
BYTE_LEVEL = "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"

#: A text that holds one of these, an added token or white space beside white space goes to the tokenizer whole.
ODD = re.compile("[\x00-\x09\x0b-\x1f\x7f-\xa0 ᠎ -‏ -  -⁯　﻿]")
#: Pieces joined into one text for the tokenizer.
JOINED = 256


def vocabulary_path(name: str = DEFAULT) -> str:
    return public_tokenizers.path(name)


@cache
def load(path: str):
    """The tokenizer at `path`, once per process, with the library's defaults: the string of an added token
    in a text is that token."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Codes(dict):
    """Numbers pieces in the order they are first seen."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        code = self[piece] = len(self)
        self.new.append(piece)
        return code


class Pieces:
    """Encodes words once: a byte-level BPE never merges across a single space or line break between
    words, so a text's ids are those of its words, each with the space before it, strung together."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        plain = tokenizer.normalizer is None and repr(tokenizer.pre_tokenizer) == BYTE_LEVEL and not any(re.search(r"\s", a) for a in added)
        newline = tokenizer.encode("\n", add_special_tokens=False).ids if plain else []
        self.newline = newline[0] if len(newline) == 1 else None
        self.forget()

    def forget(self) -> None:
        self.codes = _Codes()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def plain(self, text: str) -> bool:
        return not (
            self.newline is None
            or not text
            or text[0] in " \n"
            or text[-1] in " \n"
            or "  " in text
            or "\n\n" in text
            or " \n" in text
            or "\n " in text
            or ODD.search(text)
            or self.added.search(text)
        )

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        new, self.codes.new = self.codes.new, []
        if not new:
            return
        words = [w for w in new if w != "\n"]
        texts = ["\n".join(words[i : i + JOINED]) + "\n" for i in range(0, len(words), JOINED)]
        ids = np.concatenate([*self.whole(texts), np.zeros(0, np.uint32)])
        ends = np.flatnonzero(ids == self.newline)
        size = np.diff(ends, prepend=-1) - 1
        if "\n" in new:
            at = new.index("\n")
            lead = int(ends[at - 1]) + 1 if at else 0
            ids = np.insert(ids, lead, [self.newline, self.newline])
            size = np.insert(size, at, 1)
        start = np.cumsum(size + 1) - size - 1 + self.used
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(2 * (self.used + len(ids)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, size])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.codes) > REMEMBERED:
            self.forget()
        plain = [self.plain(t) for t in texts]
        odd = iter(self.whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        counts, codes = [], []
        for text, p in zip(texts, plain, strict=True):
            if p:
                pieces = text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
                codes += map(self.codes.__getitem__, pieces)
                counts.append(len(pieces))
        self._learn()
        codes = np.array(codes, np.int64)
        size = self.size[codes]
        ends = np.cumsum(size)
        at = np.repeat(self.start[codes] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        ids = self.flat[at]
        stops = np.concatenate([[0], ends])[np.cumsum(counts, dtype=np.int64)]
        known = iter(np.split(ids, stops[:-1])) if counts else iter(())
        return [next(known) if p else next(odd) for p in plain]


@cache
def pieces(path: str) -> Pieces:
    return Pieces(load(path))


def encode(texts: list[str | None], path: str) -> Iterator[np.ndarray]:
    """Ids of each text, null as the empty text, in order."""
    words = pieces(path)
    chunk: list[str] = []
    chars = 0
    for text in texts:
        chunk.append(text or "")
        chars += len(chunk[-1])
        if chars >= CHUNK_CHARS:
            yield from words.encode(chunk)
            chunk, chars = [], 0
    if chunk:
        yield from words.encode(chunk)
