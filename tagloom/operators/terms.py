"""Finding listed terms in the words of a text: a trie of words, walked from every word that begins a term."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

WORD = re.compile(r"\w+")
#: Key of the terms that end at a node; no word is empty.
_ENDS = ""


def cut(text: str) -> tuple[list[str], list[int], list[int]]:
    """The words of a text in lower case, and where each begins and ends (in characters)."""
    found = [m.span() for m in WORD.finditer(text)]
    return [text[a:b].lower() for a, b in found], [a for a, _ in found], [b for _, b in found]


class TermTrie:
    """Numbers of terms by their words. Terms with the same words share an end."""

    def __init__(self, terms: Iterable[tuple[Sequence[str], int]]):
        self.root: dict = {}
        for words, number in terms:
            node = self.root
            for word in words:
                node = node.setdefault(word, {})
            if words:
                node.setdefault(_ENDS, []).append(number)

    def find(self, words: Sequence[str]) -> Iterator[tuple[int, int, int]]:
        """(first word, last word, number) of every mention, also of those inside others."""
        begin, size = self.root.get, len(words)
        for first, word in enumerate(words):
            node, last = begin(word), first
            while node is not None:
                for number in node.get(_ENDS, ()):
                    yield first, last, number
                last += 1
                if last == size:
                    break
                node = node.get(words[last])


def longest(mentions: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Mentions that don't overlap: from left to right the longest one that begins at a word, of equal ones the smallest number."""
    out, free = [], 0
    for first, last, number in sorted(mentions, key=lambda m: (m[0], -m[1], m[2])):
        if first >= free:
            out.append((first, last, number))
            free = last + 1
    return out
