"""Splitting of text into pre-tokens, and memos of what each distinct pre-token encodes to.

A byte-level BPE encodes each match of its pattern by itself, so that the ids of a text are the ids of its matches, one
after the other.  Corpora repeat their pre-tokens; each worker keeps what it has resolved, up to ``MEMO`` entries, and
starts the memo anew when it is full (the memo only saves time).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import chain

import regex

MEMO = 900_000
TOGETHER = 64  # texts whose new pre-tokens are resolved at once

#: Code points whose classes (letter, number, space, other) no Unicode version has changed since 5.0: the letters and
#: numbers among them, and all of them.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ŰΑ-ΡΣ-ώА-яぁ-ゖァ-ヺ一-龥가-힣", "0-9²³¹¼-¾"
_STEADY = re.compile("[^\t\n\r\x20-\x7e¡-ŰΑ-ΡΣ-ώА-я‐-‧‰-›€ぁ-ゖァ-ヺ一-龥가-힣]")
#: public_tokenizers.PATTERN over steady text, for the standard library's faster engine.  No two of its first three
#: alternatives can match at one place, so that letters may come first; no run needs to be given back.
_FAST = re.compile(rf" ?[{_L}]++| ?[{_N}]++|'(?:[stmd]|re|ve|ll)| ?[^\s{_L}{_N}]++|\s+(?!\S)|\s+").findall


def is_steady(text: str) -> bool:
    """Whether all implementations of the pattern must split ``text`` alike."""
    return _STEADY.search(text) is None


class PieceEncoder:
    """Encodes texts by pre-token.  ``resolve`` maps distinct pre-tokens to the bytes of their ids."""

    def __init__(self, pattern: str, resolve: Callable[[list[str]], Iterable[bytes]], memo: int = MEMO):
        import public_tokenizers

        self.slow = regex.compile(pattern).findall
        self.fast = _FAST if pattern == public_tokenizers.PATTERN else self.slow
        self.resolve = resolve
        self.memo: dict[str, bytes] = {}
        self.limit = memo

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(texts), TOGETHER):
            split = [self.fast(t) if is_steady(t) else self.slow(t) for t in texts[lo : lo + TOGETHER]]
            if len(self.memo) > self.limit:
                self.memo.clear()
            missing = list(set(chain.from_iterable(split)).difference(self.memo))
            if missing:
                self.memo.update(zip(missing, self.resolve(missing)))
            get = self.memo.__getitem__
            out += [b"".join(map(get, pieces)) for pieces in split]
        return out
