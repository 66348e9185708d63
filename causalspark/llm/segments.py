"""Tokenizer files and a bounded memory of encoded text segments, kept for the life of a Python worker."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable

#: Where the public vocabulary files lie; every operator takes the file's path as a parameter.
TOKENIZER_DIR = "/opt/tokenizers"
BYTE_BPE = os.path.join(TOKENIZER_DIR, "byte_bpe_50k.tiktoken")
PIECE_BPE = os.path.join(TOKENIZER_DIR, "piece_bpe_32k.model")
#: Entries of one generation, and the longest segment that is remembered; together they bound the memory of a worker.
REMEMBERED, LONGEST = 500_000, 48

# Pre-token pattern of the byte-level vocabulary (a fixed value).
BYTE_BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stretches that no token of that vocabulary crosses: white space (as the pattern takes it), then other characters.
BYTE_BPE_CUT = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+").findall


class Segments(dict):
    """segment -> value by ``compute``. Two generations: what is used again survives, the rest is dropped."""

    def __init__(self, compute: Callable, size: int = REMEMBERED):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, segment):
        value = self.old.get(segment)
        if value is None:
            value = self.compute(segment)
        if len(segment) <= LONGEST:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[segment] = value
        return value


_LOADED: dict = {}


def once(key, make: Callable):
    """One object per Python worker and key."""
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]


def byte_bpe(path: str = BYTE_BPE):
    """The byte-level BPE encoding of a ranks file."""
    def load():
        import tiktoken
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding(os.path.basename(path), pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return once(("byte_bpe", path), load)
