"""Cutting texts into the words of byte-level vocabularies, and ranges of flat arrays."""

from __future__ import annotations

import re

import numpy as np
import regex

# The pattern by which byte-level vocabularies of this kind cut words (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same where every character is ASCII; blanks are those of the Unicode property.
_BLANK = r"\x20\x09-\x0D"
ASCII_PATTERN = (PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{_BLANK}A-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]")
                 .replace(r"\p{N}", "[0-9]").replace(r"\S", f"[^{_BLANK}]").replace(r"\s", f"[{_BLANK}]"))
_any, _ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall


def words(text: str) -> list[str]:
    """Every match of ``PATTERN``, which together are the whole text."""
    return _ascii(text) if text.isascii() else _any(text)


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions begin[0] .. begin[0] + size[0] - 1, begin[1] .. and so on."""
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
