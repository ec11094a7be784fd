"""English full-text search: words, stop words, stems by Porter's published algorithm, and queries.

The set of matches follows the usual web-search grammar: words are all required, "..." is a phrase, ``or`` an
alternative, a leading - excludes, and a query of stop words alone matches nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: The common English stop words.
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
_WORD = re.compile(r"[^\W_]+")
_VOWEL = "aeiou"


_LETTERS = {c: "v" if chr(c) in _VOWEL else "y" if chr(c) == "y" else "c" for c in range(ord("a"), ord("z") + 1)}


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = word.translate(_LETTERS)
    while (at := out.find("y")) >= 0:
        out = out[:at] + ("v" if at and out[at - 1] == "c" else "c") + out[at + 1 :]
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


_BY_LENGTH = {i: sorted(rules, key=lambda r: -len(r[0])) for i, rules in ((2, _STEP2), (3, _STEP3))}
_ENDS = {i: tuple(end for end, _ in rules) for i, rules in _BY_LENGTH.items()}
_LAST = sorted(_STEP4, key=len, reverse=True)
_LAST_ENDS = tuple(_LAST)


def _replace(word: str, step: int) -> str:
    if word.endswith(_ENDS[step]):
        for end, new in _BY_LENGTH[step]:
            if word.endswith(end):
                stem = word[: -len(end)]
                return stem + new if _measure(stem) > 0 else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                if "v" in _shape(base := word[: -len(end)]):
                    if base.endswith(("at", "bl", "iz")):
                        base += "e"
                    elif base[-1:] * 2 == base[-2:] and _shape(base)[-1] == "c" and base[-1] not in "lsz":
                        base = base[:-1]
                    elif _measure(base) == 1 and _short(base):
                        base += "e"
                    word = base
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, 2), 3)
    for end in _LAST if word.endswith(_LAST_ENDS) else ():
        if word.endswith(end):
            base = word[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                word = base
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def terms(text: str | None) -> list[tuple[str, int]]:
    """(stem, position from 1) of the words that are no stop words; stop words keep their positions."""
    return [(stem(w), i) for i, w in enumerate(words(text), 1) if w not in STOP]


class Vocabulary(dict):
    """Numbers of the stems of words, -1 for stop words, as they come; a worker's lies within ``most`` words between batches."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most, self.stems, self.number = most, [], {}

    def __missing__(self, word: str) -> int:
        n = -1 if word in STOP else self.number.setdefault(stem(word), len(self.stems))
        if n == len(self.stems):
            self.stems.append(stem(word))
        self[word] = n
        return n

    def postings(self, texts: list[str | None], by_text: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, position, length): each term's places, by term, text and position (or text, term and position), and each text's number of terms."""
        if len(self) > self.most:
            self.clear()
            self.stems, self.number = [], {}
        each = [np.fromiter(map(self.__getitem__, words(t)), np.int64) for t in texts]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        term = np.concatenate(each) if each else np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(each)), sizes)
        position = np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        kept = np.flatnonzero(term >= 0)
        length = np.bincount(text[kept], minlength=len(each))
        order = text[kept] * len(self.stems) + term[kept] if by_text else term[kept]
        kept = kept[np.argsort(order, kind="stable")]
        return text[kept], term[kept], position[kept], length


@dataclass(frozen=True)
class Clause:
    """A phrase (stems with their distance from its start) that must or must not occur."""

    words: tuple[tuple[str, int], ...]
    negative: bool = False


def parse(query: str) -> list[list[Clause]]:
    """Alternatives of clauses that must all hold; [] matches nothing."""
    out: list[list[Clause]] = [[]]
    for quoted, plain in re.findall(r'(-?"[^"]*"?)|([^\s"]+)', query):
        if plain.lower() == "or":
            if out[-1]:
                out.append([])
            continue
        token = quoted or plain
        negative = token.startswith("-")
        got = terms(token)
        if got:
            first = got[0][1]
            out[-1].append(Clause(tuple((w, i - first) for w, i in got), negative))
    return [a for a in out if a]
