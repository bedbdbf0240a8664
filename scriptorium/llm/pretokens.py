"""Splitting text into pre-tokens, the pieces inside which byte-pair merges happen."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import regex

#: Fixed value: the split of the byte-level vocabularies.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_COMMON_END = 0x250  # Latin letters and punctuation: small character classes, for which the built-in engine is faster


def _members(prop: str) -> str:
    rule = regex.compile(prop)
    return "".join(re.escape(chr(c)) if c < 128 else chr(c) for c in range(_COMMON_END) if rule.match(chr(c)))


@lru_cache(maxsize=8)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that lists the matches of ``pattern`` in a text.

    For the byte-level pattern, texts of Latin characters only go through an equal pattern whose classes are spelled
    out; the members come from the same Unicode tables, so both give the same pieces.
    """
    whole = regex.compile(pattern).findall
    if pattern != BYTE_LEVEL:
        return whole
    letters, numbers, spaces = _members(r"\p{L}"), _members(r"\p{N}"), _members(r"\s")
    common = re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    ).findall
    beyond = re.compile(f"[^\x00-{chr(_COMMON_END - 1)}]").search
    return lambda text: common(text) if text.isascii() or not beyond(text) else whole(text)


def in_portions(texts: list[str], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``chars`` characters each, one row at least; a row is never cut."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
