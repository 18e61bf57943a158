"""Words of running text as passages are compared: layout, case and punctuation taken away."""

from __future__ import annotations

import unicodedata

import numpy as np
import regex
import xxhash

_CUE = regex.compile(r"(?m)^[> \t]*(?:\d+[ \t]*\n[> \t]*)?\d+:\d\d(?::\d\d)?[.,]\d+[ \t]*-->.*$")
_QUOTE = regex.compile(r"(?m)^[ \t]*>+ ?")
_INVISIBLE = regex.compile("[​-‏⁠﻿]")
#: A hyphen of any kind, the not-sign that stands for one in scans, or a soft hyphen, at a line end.
LINE_HYPHENS = "-‐‑¬­"
_CUT = regex.compile(rf"(?<=\p{{L}}\p{{M}}*)[{LINE_HYPHENS}][ \t]*\r?\n[ \t>]*(?=\p{{L}})")
_SOFT = regex.compile("­")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def passage_words(text: str) -> list[str]:
    """Lower-case words; caption times, quote marks and invisible characters dropped, words cut at line ends joined."""
    text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)) if not text.isascii() else text
    if "-->" in text:
        text = _CUE.sub("", text)
    if ">" in text:
        text = _QUOTE.sub("", text)
    if "\n" in text:
        text = _CUT.sub("", text)
    return _WORD.findall(_SOFT.sub("", text).lower())


def shingle_hashes(words: list[str], width: int) -> np.ndarray:
    """64-bit hash of each run of ``width`` words."""
    if len(words) < width:
        return np.empty(0, np.int64)
    digest = xxhash.xxh3_64_intdigest
    single = np.array([digest(w) for w in words], np.uint64)
    out = np.zeros(len(words) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = (out ^ single[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out.view(np.int64)
