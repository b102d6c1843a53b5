"""Folding of typed names into comparable tokens; shared by the mapping (problem 1) and variant (problem 4) operators."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

#: Letters that Unicode does not decompose, in their plain spelling.
PLAIN_LETTERS = {"ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i", "ŧ": "t", "ħ": "h"}
#: Endings and joining words in short.
SHORT = {"3o": "trio", "4tet": "quartet", "5tet": "quintet", "bros": "brothers", "orch": "orchestra", "n": "and", "y": "and", "und": "and", "et": "and"}
#: Stands for a letter that a wrong decoding lost.
LOST = "ʘ"
#: Ways to write that a record has no single artist.
COMPILATION = re.compile(r"\A\W*(various(\W+artists?)?|var\W+artists?|artists?\W+various|v\W*a|various\W+comp\w*|compilations?|soundtracks?)\W*\Z")

_LOST = re.compile(r"�|\?(?=[^\W\d_?])|(?<=[^\W\d_])\?")
_QUOTED = re.compile(r"[\"“”«»„]([^\"“”«»„]*)[\"“”«»„]")
_TAG = re.compile(r"\s*[\(\[][^\)\]]*[\)\]]\s*\Z")
_WORD = re.compile(r"\w+")
_PLAIN = str.maketrans(PLAIN_LETTERS)


_CASED = re.compile(r"[^\W\d_]+")


def likely(text: str) -> bool:
    """Whether a misreading undone looks like a name: words of letters in one script, none with a capital after a small
    letter."""
    if any(c > "\x7f" and unicodedata.category(c)[0] not in "LM" for c in text):
        return False
    for w in _CASED.findall(text):
        scripts = {unicodedata.name(c, "?").split(" ", 1)[0] for c in w}
        if len({"CJK" if x in ("HIRAGANA", "KATAKANA") else x for x in scripts}) > 1 or (w != w.lower() and w[1:] != w[1:].lower() and w != w.upper()):
            return False
    return True


def fold(text: str) -> str:
    """Case, accents and width folded; marks stay."""
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFKD", text).casefold().translate(_PLAIN)
    return "".join(c for c in t if unicodedata.category(c) not in ("Mn", "Cf"))


def words(text: str) -> tuple[list[str], list[str]]:
    """(words, nicknames): a quoted part among others is a nickname; tags in brackets at the end and marks go; & and + are
    'and'."""
    t = fold(_LOST.sub(LOST, text))
    nick: list[str] = []
    rest = _QUOTED.sub(lambda m: nick.extend(_WORD.findall(m[1])) or " ", t)
    if not _WORD.search(rest):
        rest, nick = t, []
    while (cut := _TAG.sub("", rest)) != rest and _WORD.search(cut):
        rest = cut
    rest = rest.replace("&", " and ").replace("+", " and ").replace("_", " ")
    return _WORD.findall(rest), nick


@dataclass
class Habits:
    """What a reference list shows of its own names: words that open or end many of them."""

    openers: set[str] = field(default_factory=set)
    endings: set[str] = field(default_factory=set)

    @classmethod
    def of(cls, names: list[str], share: float = 0.006) -> Habits:
        first, last = Counter(), Counter()
        for n in names:
            w, _ = words(n)
            if len(w) > 2:
                first[w[0]] += 1
                last[w[-1]] += 1
        least = max(3, share * len(names))
        return cls({w for w, n in first.items() if n >= least}, {w for w, n in last.items() if n >= least})


def expand(word: str, endings: set[str]) -> str:
    """An abbreviated ending in full: the one ending with the same first letter that holds the word's letters in order."""
    if word in endings or len(word) < 3:
        return word
    fit = []
    for e in endings:
        if e[0] == word[0] and len(e) > len(word) + 1:
            it = iter(e)
            if all(c in it for c in word):
                fit.append(e)
    return fit[0] if len(fit) == 1 else word


def core(text: str, habits: Habits) -> tuple[list[str], bool]:
    """(words without openers, whether one was there). An opener after 'and', mistyped or not, stays; a name of openers only
    stays whole; a first word one slip off an opener is one where two other words follow."""
    w, _ = words(text)
    w = [SHORT[x] if 0 < i < len(w) - (SHORT.get(x) == "and") and x in SHORT else x for i, x in enumerate(w)]
    for i in range(1, len(w) - 1):
        if w[i + 1] in habits.openers and 1 < len(w[i]) < 5 and w[i] != "and" and typo_distance(w[i], "and") == 1:
            w[i] = "and"
    out = [x for i, x in enumerate(w) if x not in habits.openers or (i and w[i - 1] == "and")]
    if not out:
        return w, False
    if len(out) == len(w) > 2 + (w[-1] in habits.endings) and len(w[0]) > 2 and any(typo_distance(w[0], o) == 1 for o in habits.openers if abs(len(o) - len(w[0])) < 2 < len(o)):
        out = out[1:]
    if len(out) > 2:
        out[-1] = expand(out[-1], habits.endings)
    return out, len(out) < len(w)


def orders(w: list[str]) -> list[list[str]]:
    """The words as they stand, then with two neighbours swapped, then rotated."""
    out = [w]
    if 2 <= len(w) <= 6:
        for i in range(len(w) - 1):
            out.append([*w[:i], w[i + 1], w[i], *w[i + 2 :]])
        for i in range(1, len(w)):
            out.append(w[i:] + w[:i])
    seen: set[tuple[str, ...]] = set()
    return [x for x in out if not (tuple(x) in seen or seen.add(tuple(x)))]


def typo_distance(a: str, b: str, most: int = 99) -> int:
    """As ``distance``, but two neighbouring letters exchanged count once (optimal string alignment)."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    # what both begin or end with costs nothing
    i, m = 0, min(len(a), len(b))
    while i < m and a[i] == b[i]:
        i += 1
    j = 0
    while j < m - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], last[j - 2] + 1)
        # the next row comes from these two, an exchange from the first of them
        if min(row) > most and min(before) >= most:
            return most + 1
    return min(row[-1], most + 1)


def distance(a: str, b: str, most: int = 99) -> int:
    """Levenshtein distance, a true metric; ``most`` + 1 when it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return min(row[-1], most + 1)
