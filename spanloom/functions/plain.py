"""The text functions that scores need, on strings of Python: the same results as their columns in ``text``."""

from __future__ import annotations

import re

from .text import _SEPARATED, NUMBER

#: Fixed value: what is white space to the patterns of ``text``; Python's own class has four characters more.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES, _FIVE_WORDS = re.compile(f"[{_SPACE}]+"), re.compile(f"[{_SPACE}]*+(?:[^{_SPACE}]++[{_SPACE}]++){{4}}[^{_SPACE}]")
_STRIPPED = "".join(c for c in map(chr, range(0x3001)) if _SPACES.match(c))
_NUMBER, _JOINED, _DIGIT = re.compile(NUMBER.removeprefix("(?U)")), re.compile(_SEPARATED.removeprefix("(?U)")), re.compile(r"\d")
_THINKING, _LEAD = re.compile(r"(?s)<think>.*?</think>"), re.compile(rf"(?i)\A[{_SPACE}]*(here is[^\n:]*:|here's[^\n:]*:|summary:)[{_SPACE}]*")


def strip(text: str) -> str:
    return text.strip(_STRIPPED)


def squeeze(text: str) -> str:
    return _SPACES.sub(" ", text).strip(" ")


def is_claim_like(text: str) -> bool:
    return bool(_FIVE_WORDS.match(text) or _DIGIT.search(text))


def strip_artifacts(text: str) -> str:
    return strip(_LEAD.sub("", _THINKING.sub("", text)))


def numbers(text: str) -> list[str]:
    return _NUMBER.findall(text if text.isascii() else _JOINED.sub("", text))


def numeric_forms(token: str) -> set[str]:
    forms = {token, token.replace(",", "")}
    if "/" in token:
        for part in filter(None, token.split("/")):
            forms.add(part)
            if part.isdecimal():
                forms.add(part.lstrip("0") or "0")
    return forms
