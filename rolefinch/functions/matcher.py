"""Which of many regular expressions occur in a text, in one pass over it.

Every match of most patterns holds one of a few words: ``\\bnode\\.?js\\b`` holds "node" or nothing. An Aho-Corasick
automaton over these words reads the text once and tells which patterns can occur at all; only those are searched.
A pattern of which no word is sure is always searched, so the result is that of searching all.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd

#: Letters beyond ASCII that match an ASCII one where case is ignored.
_FOLDED = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}


def folded(text: str) -> str:
    return text.translate(_FOLDED).lower() if not text.isascii() else text.lower()


def _group_end(pattern: str, i: int) -> int:
    """Where the group or class that opens at ``i`` is closed."""
    if pattern[i] == "[":
        k = i + 1 + pattern.startswith("^", i + 1)
        k += pattern.startswith("]", k)
        while pattern[k] != "]":
            k += 1 + (pattern[k] == "\\")
        return k
    k, depth = i, 0
    while True:
        c = pattern[k]
        if c == "\\":
            k += 1
        elif c == "[":
            k = _group_end(pattern, k)
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return k
        k += 1


def _alternatives(pattern: str) -> list[str]:
    out, lo, k = [], 0, 0
    while k < len(pattern):
        if pattern[k] == "\\":
            k += 1
        elif pattern[k] in "([":
            k = _group_end(pattern, k)
        elif pattern[k] == "|":
            out.append(pattern[lo:k])
            lo = k + 1
        k += 1
    return [*out, pattern[lo:]]


def required(pattern: str, ignore_case: bool) -> list[tuple[str, bool]] | None:
    """ASCII words, each with whether its case is ignored, of which every match holds one; None if none is sure."""
    if re.search(r"\(\?[a-zA-Z]*x", pattern):
        return None
    out = []
    for alternative in _alternatives(pattern):
        whole = re.match(r"\((\?:|\?i:)?(?!\?)", alternative)
        if whole and _group_end(alternative, 0) == len(alternative) - 1:
            inner = required(alternative[whole.end() : -1], ignore_case or whole[1] == "?i:")
            if inner is None:
                return None
            out += inner
            continue
        runs, now, k = [], "", 0
        while k < len(alternative):
            c, literal = alternative[k], ""
            if c == "\\" and k + 1 < len(alternative):
                k += 1
                if alternative[k] in "bB":
                    k += 1
                    continue
                literal = alternative[k] if not alternative[k].isalnum() else ""
            elif c in "([":
                k = _group_end(alternative, k)
            elif c in "?*{":
                now = now[:-1]  # what may be missing is not sure
                k = alternative.index("}", k) if c == "{" and "}" in alternative[k:] else k
            elif c not in ".^$+":
                literal = c
            if literal and literal.isascii():
                now += literal
            else:
                runs.append(now)
                now = ""
            k += 1
        best = max([*runs, now], key=len)
        if not best:
            return None
        out.append((folded(best) if ignore_case else best, ignore_case))
    return out


class Matcher:
    def __init__(self, patterns: tuple[tuple[str, str, bool], ...]):
        """``patterns``: name, expression, whether case counts."""
        import ahocorasick

        self.names = [n for n, _, _ in patterns]
        self.found = [re.compile(p, 0 if cased else re.IGNORECASE).search for _, p, cased in patterns]
        self.always, words = [], ({}, {})
        for k, (_, p, cased) in enumerate(patterns):
            sure = required(p, not cased)
            if sure is None:
                self.always.append(k)
            for word, ignored in sure or ():
                words[ignored].setdefault(word, set()).add(k)
        self.readers = []
        for held, fold in zip(words, (str, folded)):
            if held:
                a = ahocorasick.Automaton()
                for word, which in held.items():
                    a.add_word(word, tuple(which))
                a.make_automaton()
                self.readers.append((a, fold))

    def candidates(self, text: str) -> set[int]:
        out = set(self.always)
        for a, fold in self.readers:
            for which in {x for _, x in a.iter(fold(text))}:
                out.update(which)
        return out

    def names_in(self, text: str) -> list[str]:
        return sorted(self.names[k] for k in self.candidates(text) if self.found[k](text))


@lru_cache(16)
def matcher(patterns: tuple[tuple[str, str, bool], ...]) -> Matcher:
    return Matcher(patterns)


def names_in(patterns: tuple[tuple[str, str, bool], ...]):
    """A function of a series of texts that gives the names found in each, in code-point order; null has none."""

    def of(texts: pd.Series) -> pd.Series:
        find = matcher(patterns).names_in
        return texts.map(lambda t: find(t) if isinstance(t, str) else [])

    return of
