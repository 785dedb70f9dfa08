"""Cutting texts where patterns of byte-level vocabularies always end a pre-token.

Such patterns give letters with at most one space before them as one pre-token and don't look past the end of a run of
other characters than white space. So a text can be cut before each white space that follows another character, and
each part can be handled once and remembered.
"""

from __future__ import annotations

import regex

#: Unicode's White_Space property, as ``\\s`` in tokenizer patterns has it, for a character class.
WHITE = r"\t-\r\x20\x85\xa0  -     　"
#: Marks of which any run after letters is one pre-token (the apostrophe isn't: it can open a contraction).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space before a space: there a text can't be cut at the space.
DOUBLE_WHITE = tuple(c + " " for c in map(chr, range(0x3001)) if regex.match(f"[{WHITE}]", c))
_chunks = regex.compile(f"[{WHITE}]*+[^{WHITE}]++|[{WHITE}]++").findall


def parts(text: str) -> tuple[list[str], list[str]]:
    """The parts of a text: those that are given whole, then those that stand without the space before them.

    Almost always only the first part is given whole. Where white space stands before a space, all parts are.
    """
    if any(w in text for w in DOUBLE_WHITE):
        return _chunks(text), []
    first, *rest = text.split(" ")
    return [first], rest


def letters_and_marks(part: str) -> list[str] | None:
    """The pre-tokens of a space and ``part`` if that is letters and then marks; None: ask the pattern."""
    if part.isalpha():
        return [" " + part]
    word = part.rstrip(MARKS)
    return [" " + word, part[len(word) :]] if word.isalpha() else None
