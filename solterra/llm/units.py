"""Words of byte-level BPE: stretches of text that the pre-token pattern never crosses, so each can be encoded alone."""

from __future__ import annotations

import re
from functools import lru_cache

import public_tokenizers
import regex

#: White space other than the space and the line feed, or runs of it: such texts take the pattern itself.
_RARE = re.compile("[^\\S \n]|[\x1c-\x1f\x85᠎​﻿]")


@lru_cache(1)
def _pattern():
    return regex.compile(public_tokenizers.PATTERN)


def units(text: bytes) -> list[str]:
    """The text cut into words that join to it. A cut before a space, or around a line feed, that has no other white
    space beside it is always a cut of the pattern too; a text with other white space, or runs of it, gets the pattern's
    own matches."""
    s = text.decode()
    if "  " in s or "\n\n" in s or " \n" in s or "\n " in s or _RARE.search(s):
        return _pattern().findall(s)
    out = []
    for line in s.split("\n"):
        first, *rest = line.split(" ")
        out.append(first)
        out.extend([" " + w for w in rest])
        out.append("\n")
    out.pop()
    return [w for w in out if w] if "" in out else out
