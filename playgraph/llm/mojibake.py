"""Garbled text from wrong character encoding (problem 6): EM over latent encoding chains per source and field."""

from __future__ import annotations

import functools
import math
import operator
import pickle
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playgraph.session import cut

#: Encodings in which UTF-8 bytes, or one another's bytes, are misread.
MULTI_BYTE = ["shift_jis", "gbk", "euc_kr"]
READ_AS = ["cp1252", "latin_1", "cp1250", "cp1251", "cp437", "mac_roman", "iso8859_2"]
OTHER_SCRIPTS = ["cp1251", "cp1253", "koi8_r", "cp866"]
WRITTEN_AS = ["cp1252", "cp1250", "cp1251", "cp1253", "mac_roman", "koi8_r", "cp866"]
#: Misreadings that lose characters: each lost character or byte as '?' or U+FFFD, or control characters dropped.
LOSSY = ["question", "question_bytes", "replacement", "replacement_bytes", "dropped"]
CLEAN = "clean"
DEPTH = 3
#: Candidates this many nats behind a value's best by the character model alone are not scored further.
BEAM, SWAP_BEAM = 18.0, 10.0

#: A word seen this often counts half by its count, half by its characters.
RARE = 3.0
USUAL = 64
#: A value all of whose records have one reading with this posterior leaves the rounds; it goes on counting as it then stands.
SETTLED = 0.999
#: Found values that are sent to every task for the last join; more of them are joined by a shuffle.
BROADCAST_VALUES = 200_000
#: Units and characters of a group, which one call judges; a single unit may have more.
GROUP_UNITS, GROUP_CHARS = 20_000, 4_000_000
#: Nats off a reading that holds what no clean text does: U+FFFD or control characters of the high range.
NEVER = re.compile("[\x80-\x9f\ufffd]")
NEVER_COST = 40.0

_LATIN = re.compile("[A-Za-z]")
_TWO_HIGH = re.compile(r"[^\x00-\x7f]{2}")
_EDGE = re.compile(r"\A(\W*)(.*?)(\W*)\Z", re.S)
_TRIM = "\"'()[]{},.;:!*/-_+&"


@functools.lru_cache(maxsize=None)
def _table(codec: str) -> dict[str, int]:
    """char -> byte, bytes the codec leaves undefined as the control character of the same number."""
    out = {}
    for b in range(128, 256):
        try:
            ch = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            ch = chr(b)
        out[ch] = b
    return out


class _Bytes(dict):
    """For str.translate: each character as the character of its byte; high ones that are no byte as a noncharacter."""

    def __missing__(self, code: int) -> int:
        return 0xFFFE if code > 127 else code


@functools.lru_cache(maxsize=None)
def _as_bytes(codec: str) -> tuple[_Bytes, _Bytes]:
    """(characters to bytes, the same with letters in upper case: lead bytes lower-cased after the misreading)."""
    table = _table(codec)
    raised = {ord(c): table.get(c.upper(), b) if len(c.upper()) == 1 else b for c, b in table.items()}
    same = {i: i for i in range(128)}
    return _Bytes(same | {ord(c): b for c, b in table.items()}), _Bytes(same | raised)


_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")
_LEADS, _CONTINUES = frozenset(range(0xC2, 0xF5)), frozenset(range(0x80, 0xC0))


@functools.lru_cache(maxsize=None)
def _pair(codec: str) -> re.Pattern[str]:
    """What every text holds of which something can be undone: a lead byte of UTF-8, as it is or raised, and one that goes on."""
    plain, raised = _as_bytes(codec)
    lead = {c for x in (plain, raised) for c, b in x.items() if b in _LEADS}
    return re.compile(f"[{''.join(re.escape(chr(c)) for c in sorted(lead))}][{''.join(re.escape(chr(c)) for c in sorted(c for c, b in plain.items() if b in _CONTINUES))}]")


_UTF8_BLANK = re.compile("[\xc2-\xdf](?:[\x80-\xbf]| (?= |\\Z))|[\xe1-\xec\xee\xef][\x80-\xbf](?:[\x80-\xbf]| (?= |\\Z))")


def _undo_utf8(text: str, codec: str, blank: bool = False) -> str | None:
    """UTF-8 bytes read as ``codec``, read rightly; sequence by sequence, so that a partly garbled text is mended where it can
    be; with ``blank`` a blank before another, or last, may stand for a non-breaking one. None when nothing can be."""
    if not blank and not _pair(codec).search(text):
        return None
    plain, raised = _as_bytes(codec)
    read = text.translate(plain)
    found = list((_UTF8_BLANK if blank else _UTF8).finditer(read))
    if not found and not blank and text == text.lower():
        up = text.translate(raised)
        # a lead byte in upper case before bytes as they are
        read = "".join(u if "\xc2" <= u <= "\xdf" and not "\x80" <= r <= "\xbf" else r for u, r in zip(up, read))
        found = list(_UTF8.finditer(read))
    if not found:
        return None
    out, at = [], 0
    for m in found:
        out.append(text[at : m.start()])
        out.append(m[0].replace(" ", "\xa0").encode("latin_1").decode("utf-8"))
        at = m.end()
    out.append(text[at:])
    fixed = "".join(out)
    return fixed if fixed != text else None


def _undo_multi(text: str, read: str, written: str) -> str | None:
    """Bytes of a multi-byte encoding read as a single-byte one, read rightly; only with letters of one or two scripts."""
    table, out = _table(read), bytearray()
    for c in text:
        b = ord(c) if c < "\x80" else table.get(c)
        if b is None:
            return None
        out.append(b)
    try:
        fixed = bytes(out).decode(written)
    except UnicodeDecodeError:
        return None
    return fixed if fixed != text and all(unicodedata.category(c)[0] in "LMN" for c in fixed if c > "\x7f") else None


@functools.lru_cache(maxsize=None)
def _swap(read: str, written: str) -> tuple[frozenset[str], dict[int, str]]:
    """(high characters whose byte is one in both encodings, what each was)."""
    out = {}
    for c, b in _table(read).items():
        try:
            out[c] = bytes([b]).decode(written)
        except UnicodeDecodeError:
            continue
    return frozenset(out), str.maketrans(out)


@functools.lru_cache(maxsize=100_000)
def _swaps(high: frozenset[str], latin: bool) -> tuple[list[dict[int, str]], list[tuple[str, int]]]:
    """(what each high character was, in the ways there are; (chain, its way)) of all misreadings of one single-byte encoding as
    another in which every high character is such a byte, and some character changes; ``latin``: none into OTHER_SCRIPTS."""
    ways: dict[tuple[str, ...], int] = {}
    chains = []
    for read in READ_AS:
        if read == "latin_1":
            continue
        for written in WRITTEN_AS:
            if written != read and not (latin and written in OTHER_SCRIPTS):
                known, change = _swap(read, written)
                if high <= known and (was := tuple(change[ord(c)] for c in high)) != tuple(high):
                    chains.append((f"{written}>{read};", ways.setdefault(was, len(ways))))
    return [dict(zip(map(ord, high), was)) for was in ways], chains


@functools.lru_cache(maxsize=100_000)
def _undone_token(token: str) -> tuple[dict[str, str], dict[str, str]]:
    """(chains that some high characters of a blank-free token allow to be undone, chains that need all of them)."""
    found: dict[str, str] = {}
    seen = {token}
    # a character of UTF-8 was two bytes at least
    level = [("", token)] if _TWO_HIGH.search(token) else []
    for _ in range(DEPTH):
        nxt = []
        for name, t in level:
            for codec in READ_AS:
                fixed = _undo_utf8(t, codec)
                if fixed is not None and fixed != token:
                    # another token of the text may need this very chain
                    found[f"{name}utf8>{codec};"] = fixed
                    if fixed not in seen:
                        seen.add(fixed)
                        if _TWO_HIGH.search(fixed):
                            nxt.append((f"{name}utf8>{codec};", fixed))
        level = nxt
    whole: dict[str, str] = {}
    # a word with Latin letters is not undone into one of two scripts unless it holds two as it stands
    latin = _LATIN.search(token) is not None and not _mixed(token)
    high = frozenset(c for c in token if c > "\x7f")
    ways, chains = _swaps(high, latin)
    fixed_as = [token.translate(was) for was in ways]
    whole.update((chain, fixed_as[i]) for chain, i in chains)
    for read in ("latin_1", "cp1252") if _TWO_HIGH.search(token) or "\x80" <= max(token) <= "\x9f" else ():
        for written in MULTI_BYTE:
            if (fixed := _undo_multi(token, read, written)) is not None:
                whole[f"{written}>{read};"] = fixed
    return found, whole


def _chain_order(chain: str) -> tuple[int, list[int]]:
    """Short chains of UTF-8 misreadings first, then by the order of the encodings."""
    return chain.count(";"), [READ_AS.index(x[5:]) for x in chain.split(";")[:-1]]


def invertible(text: str) -> dict[str, str]:
    """chain name -> text before it, of all chains up to DEPTH misreadings that can be undone. A chain of UTF-8 misreadings
    mends the tokens it can; the others must hold for every high character of the text."""
    if text.isascii():
        return {}
    tokens = text.split(" ")
    odd = [i for i, t in enumerate(tokens) if not t.isascii()]
    undone = {i: _undone_token(tokens[i]) for i in odd}
    found: dict[str, str] = {}
    seen = {text}

    def add(chain: str, part: int) -> None:
        new = list(tokens)
        for i in odd:
            fixed = undone[i][part].get(chain)
            if fixed is None and part:
                return
            new[i] = fixed if fixed is not None else tokens[i]
        if (joined := " ".join(new)) not in seen:
            seen.add(joined)
            found[chain] = joined

    for chain in sorted({c for i in odd for c in undone[i][0]}, key=_chain_order):
        add(chain, 0)
    for codec in READ_AS[:2] if " " in text else []:
        fixed = _undo_utf8(text, codec, blank=True)
        if fixed is not None and fixed not in seen:
            seen.add(fixed)
            found[f"utf8~{codec};"] = fixed
    for chain in undone[odd[0]][1]:
        add(chain, 1)
    return found


_BLANK_AFTER = re.compile(r"[^\x00-\x7f] (?: |\Z)")
#: What other tokens than those that are not ASCII may change in.
_AS_A_WHOLE = re.compile(r"[?\ufffd]|[^\x00-\x7f] (?: |\Z)")


class Beam:
    """The readings of values that are not far behind the best by characters, token by token: tokens repeat, so each is undone
    and scored once, and only the readings kept are put together."""

    def __init__(self, m: CharModel, losses: dict[str, dict[str, str]]):
        self.m, self.losses = m, losses
        self.tokens: dict[str, tuple] = {}
        self.alone: dict[str, list[tuple[str, str, bool]]] = {}

    def _weigh(self, token: str) -> tuple[str, float, int, bool]:
        """(token, log chance by characters, words of several scripts, whether it holds what no clean text does)."""
        return token, self.m.score(token + " "), int(_mixed(token)), bool(NEVER.search(token))

    def _options(self, token: str) -> tuple:
        got = self.tokens.get(token)
        if got is None:
            part, whole = _undone_token(token)
            split = lambda t: self._weigh(t) if " " not in t else (t, sum(self.m.score(x + " ") for x in t.split(" ")), mixed_words(t), bool(NEVER.search(t)))
            # many encodings give the same letters
            weighed = {t: split(t) for t in {*part.values(), *whole.values()}}
            if len(self.tokens) > 100_000:
                self.tokens, self.alone = {}, {}
            got = self.tokens[token] = (self._weigh(token), {c: weighed[t] for c, t in part.items()}, {c: weighed[t] for c, t in whole.items()})
        return got

    def readings(self, value: str) -> list[tuple[str, str, bool, bool, float]]:
        """(chain, text, readable, strong, standing cost) of the readings kept, the clean one first; strong is what was undone by
        the rules of UTF-8, or of U+FFFD."""
        tokens = value.split(" ")
        odd = [i for i, t in enumerate(tokens) if not t.isascii()]
        if len(odd) == 1 < len(tokens) and not _AS_A_WHOLE.search(value):
            # what is kept depends on the one token
            i = odd[0]
            kept = self.alone.get(tokens[i])
            if kept is None:
                kept = self.alone[tokens[i]] = self._kept(tokens[i], [tokens[i]], [0])
            a, b = " ".join([*tokens[:i], ""]), " ".join(["", *tokens[i + 1 :]])
            return [(c, a + t + b, *rest) for c, t, *rest in kept]
        return self._kept(value, tokens, odd)

    def _kept(self, value: str, tokens: list[str], odd: list[int]) -> list[tuple[str, str, bool, bool, float]]:
        opts = [self._options(tokens[i]) for i in odd]
        clean = tuple(o[0] for o in opts)
        # (chain, the odd tokens or the text, readable)
        found: list[tuple[str, tuple | str, bool]] = [(CLEAN, clean, True)]
        seen = {tuple(x[0] for x in clean)}

        def add(chain: str, parts: tuple) -> None:
            key = tuple(x[0] for x in parts)
            if key not in seen:
                seen.add(key)
                found.append((chain, parts, True))

        def add_alone(options: dict) -> None:
            for chain, x in options.items():
                if (key := (x[0],)) not in seen:
                    seen.add(key)
                    found.append((chain, (x,), True))

        if len(opts) == 1:
            add_alone(opts[0][1])
        else:
            for chain in sorted({c for o in opts for c in o[1]}, key=_chain_order):
                add(chain, tuple(o[1].get(chain, o[0]) for o in opts))
        if _BLANK_AFTER.search(value):
            found += [(c, t, True) for c, t in invertible(value).items() if c.startswith("utf8~")]
        if len(opts) == 1:
            add_alone(opts[0][2])
        for chain in opts[0][2] if len(opts) > 1 else ():
            parts = tuple(o[2].get(chain) for o in opts)
            if None not in parts:
                add(chain, parts)
        found += lossy_readings(value, self.losses)
        if len(found) == 1:
            return [(CLEAN, value, True, False, standing_cost(CLEAN, value))]
        plain = None
        scores, strong, standing = [], [], []
        for chain, parts, _ in found:
            if isinstance(parts, str):
                # as far as it differs from the clean reading
                plain = self.m.text(value) - sum(x[1] for x in clean) if plain is None else plain
                mixed, never, score = mixed_words(parts), bool(NEVER.search(parts)), self.m.text(parts) - plain
            else:
                mixed, never, score = 0, False, 0.0
                for _, x, y, z in parts:
                    score, mixed, never = score + x, mixed + y, never or z
            off = NEVER_COST * never + MIXED_COST * mixed
            scores.append(score - off)
            standing.append(off + GIVEN_UP_COST * (chain == "lost:unknown"))
            strong.append((chain.startswith("utf8>") or "replacement" in chain) and not mixed)
        top = max(scores)
        keep = [i for i, (c, _, _) in enumerate(found) if c == CLEAN or strong[i] or scores[i] > top - (BEAM if c.startswith(("utf8", "lost")) else SWAP_BEAM)]

        def text(parts: tuple | str) -> str:
            if isinstance(parts, str):
                return parts
            new = list(tokens)
            for i, x in zip(odd, parts):
                new[i] = x[0]
            return " ".join(new)

        return [(found[i][0], text(found[i][1]), found[i][2], strong[i], standing[i]) for i in keep]


#: Nats off a reading for each word of several scripts, and for giving a lost part up.
MIXED_COST, GIVEN_UP_COST = 12.0, 20.0
#: Nats off a misread single-byte encoding none of whose mended words stands elsewhere: any bytes can be undone that way.
UNBACKED_COST = 6.0


@functools.lru_cache(maxsize=None)
def _script(c: str) -> str:
    """The script of a letter (kanji and kana are one), '' for other characters and for signs counted as letters."""
    if unicodedata.category(c)[0] != "L":
        return ""
    name = unicodedata.name(c, "?").split(" ", 1)[0]
    return "" if name in ("MICRO", "FEMININE", "MASCULINE", "MODIFIER") else "CJK" if name in ("HIRAGANA", "KATAKANA") else name


@functools.lru_cache(maxsize=200_000)
def _mixed(token: str) -> bool:
    return len(set(map(_script, token)) - {""}) > 1


def mixed_words(text: str) -> int:
    """Words with letters of more than one script (kanji and kana count as one)."""
    return sum(not t.isascii() and _mixed(t) for t in text.split(" "))


def lossy_form(word: str, kind: str) -> str:
    """The word as the lossy misreading leaves it."""
    if kind == "dropped":
        return re.sub("[\x80-\x9f\xad]", "", word.encode("utf-8").decode("latin_1"))
    mark = "?" if kind.startswith("question") else "�"
    return "".join(c if c < "\x80" else mark * (len(c.encode("utf-8")) if kind.endswith("bytes") else 1) for c in word)


def _lossy_kinds(value: str) -> list[str]:
    out = []
    if "?" in value:
        out += ["question", "question_bytes"]
    if "�" in value:
        out += ["replacement", "replacement_bytes"]
    if re.search("[\xa0-\xff]", value) and not re.search("[Ā-￼]", value):
        out.append("dropped")
    return out


@functools.lru_cache(maxsize=200_000)
def char_class(c: str) -> str:
    """A class out of a bounded set: category with script for letters, single class names for what garbling leaves behind."""
    if c == " ":
        return "_"
    if c < "\x80":
        return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "?" if c == "?" else "." if c > " " else "~"
    kind = unicodedata.category(c)
    if kind[0] == "L":
        name = unicodedata.name(c, "?").split(" ", 1)[0]
        return f"{name[:4]}{kind}"
    return kind if kind != "Cn" else "Cc"


class CharModel:
    """Character bigrams over classes and characters within classes; both tables are bounded by Unicode, not by the data."""

    def __init__(self, pairs: dict[tuple[str, str], float], chars: dict[str, float]):
        self.pairs, self.chars = pairs, chars
        self.from_class: dict[str, float] = {}
        self.in_class: dict[str, float] = {}
        for (a, _), n in pairs.items():
            self.from_class[a] = self.from_class.get(a, 0) + n
        for c, n in chars.items():
            k = char_class(c)
            self.in_class[k] = self.in_class.get(k, 0) + n
        # by the class before: character -> (log chance, the table after it)
        self.memo: dict[str, dict[str, tuple[float, dict]]] = {}
        self.tokens: dict[str, float] = {}
        self.words: dict[tuple[bool, str, str, str], tuple[float, float]] = {}

    def cost(self, before: str, c: str) -> tuple[float, dict]:
        """(log chance of a character after one of class ``before``, the table of its own class)."""
        k = char_class(c)
        move = (self.pairs.get((before, k), 0) + 0.02) / (self.from_class.get(before, 0) + 1)
        pick = (self.chars.get(c, 0) + 0.02) / (self.in_class.get(k, 0) + 1)
        return math.log(move) + math.log(pick), self.memo.setdefault(k, {"": k})

    def move(self, before: str, c: str) -> float:
        """From one class to the next, whatever the character."""
        return math.log((self.pairs.get((before, char_class(c)), 0) + 0.02) / (self.from_class.get(before, 0) + 1))

    def word(self, whole: bool, a: str, core: str, b: str) -> tuple[float, float]:
        """(cost by characters alone, cost of the marks beside a known word)."""
        key = (whole, a, core, b)
        got = self.words.get(key)
        if got is None:
            marks = self.score(a) + self.score(b + " ", char_class(core[-1]) if core else "_")
            before = char_class(a[-1]) if a else "_"
            floor = marks + self.score(core, before) - 1
            got = self.words[key] = (floor, self.move("_", (a + core + b)[0]) if whole else marks + self.move(before, core[0]))
            if len(self.words) > 200_000:
                self.words = {key: got}
        return got

    def text(self, text: str) -> float:
        """By characters alone, token by token."""
        s = 0.0
        for t in text.split(" "):
            got = self.tokens.get(t)
            if got is None:
                got = self.tokens[t] = self.score(t + " ")
                if len(self.tokens) > 200_000:
                    self.tokens = {}
            s += got
        return s

    def score(self, text: str, before: str = "_") -> float:
        s, table = 0.0, self.memo.setdefault(before, {"": before})
        for c in text:
            got = table.get(c)
            if got is None:
                got = table[c] = self.cost(table[""], c)
            s += got[0]
            table = got[1]
        return s


def _hash(word: str) -> int:
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), seed=42)
    return h - (1 << 64) if h >> 63 else h


@functools.lru_cache(maxsize=200_000)
def _token_words(token: str) -> tuple[tuple[int, bool, str, str, str], ...]:
    a, core, b = _EDGE.match(token).groups()
    out = []
    if core:
        out.append((_hash(core.lower()), False, a, core, b))
    if a or b:
        out.append((_hash((token + "\n").lower()), True, a, core, b))
    return tuple(out)


def word_parts(text: str) -> list[tuple[str, tuple[tuple[int, bool, str, str, str], ...]]]:
    """(token, its words) of each token: word hash, whole token?, leading marks, core, trailing marks of its core and, where it
    has marks, of the token itself, told from a core by a line end. Words are counted in lower case."""
    return [(t, _token_words(t)) for t in text.split(" ") if t]


def own_words(strong: bool, chains, parts, p) -> dict[int, float]:
    """What a value gives to the word counts: its readings' words by posterior (``parts``: ``word_parts`` of each). Words that only
    stand in the garbled look of an undoable text don't support it."""
    out: dict[int, float] = {}
    for chain, words, q in zip(chains, parts, p):
        bare = strong and chain == CLEAN
        for _, own in words:
            for h, whole, a, core, b in own:
                if not bare or (a + core + b if whole else core).isascii():
                    out[h] = out.get(h, 0) + q
    return out


def standing_cost(chain: str, text: str) -> float:
    """Nats off a reading whatever the corpus: for what no clean text holds, words of several scripts, a part given up."""
    return NEVER_COST * bool(NEVER.search(text)) + MIXED_COST * mixed_words(text) + GIVEN_UP_COST * (chain == "lost:unknown")


def likelihood(chain: str, parts: list, standing: float, m: CharModel, known: dict[int, float], mine: dict[int, float], mass: float, done: dict[str, tuple[float, bool]]) -> float:
    """Log likelihood of a reading of ``parts`` (``word_parts``): each token by the better of word counts and characters. A rare word leans on its
    characters too: else two rare forms, one garbled from the other, would support each other alike. ``done``: tokens of this
    value that are already weighed, as its readings share most."""
    each, backed = [], False
    for token, own in parts:
        got = done.get(token)
        if got is None:
            best, stands = -1e9, False
            for h, whole, a, core, b in own:
                floor, off = m.word(whole, a, core, b)
                others = max(known.get(h, 0.0) - mine.get(h, 0.0), 1e-9)
                trust = others / (others + RARE)
                stands = stands or (others >= 0.5 and not (core.isascii() and a.isascii() and b.isascii()))
                best = max(best, floor, trust * (math.log(others / mass) + off) + (1 - trust) * floor)
            got = done[token] = best, stands
        each.append(got[0])
        backed = backed or got[1]
    alone = 0.0 if backed or chain == CLEAN or chain.startswith(("utf8", "lost")) else UNBACKED_COST
    return sum(each) - alone - standing


_ASCII_CLASSES = sorted({char_class(chr(i)) for i in range(128)})
_ASCII_CLASS = np.array([_ASCII_CLASSES.index(char_class(chr(i))) for i in range(128)])


def tally(texts, weights) -> pd.DataFrame:
    """Class pairs (t = p) and characters (t = c) of texts by weight. A long value counts as much as one of USUAL characters, or
    it would set the model by itself. ASCII texts are counted in arrays."""
    pairs: dict[tuple[str, str], float] = {}
    chars: dict[str, float] = {}
    plain, plain_w = [], []
    for t, p in zip(texts, weights):
        p = p * min(1.0, USUAL / len(t)) if t else p
        if t.isascii():
            plain.append(t)
            plain_w.append(p)
            continue
        before = "_"
        for c in t + " ":
            k = char_class(c)
            pairs[before, k] = pairs.get((before, k), 0) + p
            chars[c] = chars.get(c, 0) + p
            before = k
    if plain:
        # every text ends with a blank, the class before the next one's first character
        codes = np.frombuffer(" ".join([*plain, ""]).encode(), np.uint8)
        w = np.repeat(np.array(plain_w, float), [len(t) + 1 for t in plain])
        kind = _ASCII_CLASS[codes]
        before = np.r_[_ASCII_CLASSES.index("_"), kind[:-1]]
        n = len(_ASCII_CLASSES)
        for i, x in enumerate(np.bincount(before * n + kind, w, n * n)):
            if x:
                key = (_ASCII_CLASSES[i // n], _ASCII_CLASSES[i % n])
                pairs[key] = pairs.get(key, 0) + x
        for i, x in enumerate(np.bincount(codes, w, 128)):
            if x:
                chars[chr(i)] = chars.get(chr(i), 0) + x
    data = [("p", a, b, float(n)) for (a, b), n in pairs.items()] + [("c", a, "", float(n)) for a, n in chars.items()]
    return pd.DataFrame(data, columns=["t", "a", "b", "n"])


def lossy_readings(value: str, losses: dict[str, dict[str, str]]) -> list[tuple[str, str, bool]]:
    """(chain, text, readable) of a value that lost characters. ``losses``: by kind, what a loss left -> the word of the corpus; where there is none, a lost letter is taken for a common accented one, and the text is not readable."""
    out = []
    for kind in _lossy_kinds(value):
        words = losses.get(kind, {})
        if kind == "dropped" and not words:
            continue
        parts, full = [], True
        for t in value.split(" "):
            s = t.strip(_TRIM)
            if s and s in words:
                parts.append(t.replace(s, words[s]))
            elif kind == "dropped":
                parts.append(t)
            else:
                mark = "?" if kind.startswith("question") else "\ufffd"
                new = t.replace(mark * 2, "é") if kind.endswith("bytes") else t
                new = new.replace(mark, "é")
                full &= new == t
                parts.append(new)
        if (text := " ".join(parts)) != value:
            out.append((f"lost:{kind}", text, full))
    if NEVER.search(value):
        out.append(("lost:unknown", NEVER.sub("", value), False))
    return out


def posterior(ll: list[float], lpi: list[float]) -> list[float]:
    """Chances of the readings by their log likelihoods and the log chances of their chains."""
    each = [a + b for a, b in zip(ll, lpi)]
    top = max(each)
    each = [math.exp(x - top) for x in each]
    total = sum(each)
    return [x / total for x in each]


class Sums:
    """What units give to the counts: words, chains where they stand, and characters. ``mark``: put after the names of its rows."""

    def __init__(self, mark: str = ""):
        self.mark = mark
        self.words: dict[int, float] = {}
        self.chances: dict[tuple[int, str], float] = {}
        self.texts: dict[str, float] = {}

    def add(self, unit: tuple, parts: list, qs: list[list[float]]) -> None:
        """``parts``: ``word_parts`` of each reading; ``qs``: their posteriors at each place."""
        _, ats, n, strong, chains, texts, _, _, p = unit
        for h, x in own_words(strong, chains, parts, p).items():
            self.words[h] = self.words.get(h, 0) + n * x
        for at, q in zip(ats, qs):
            for c, x in zip(chains, q):
                self.chances[at, c] = self.chances.get((at, c), 0) + n * x
        for t, x in zip(texts, p):
            if x > 0.001:
                self.texts[t] = self.texts.get(t, 0) + n * x

    def rows(self) -> list[tuple]:
        """(what, a, b, x, s, t) of each sum."""
        got = [("word" + self.mark, h, 0, x, None, None) for h, x in self.words.items()]
        got += [("chance" + self.mark, 0, at, x, c, None) for (at, c), x in self.chances.items()]
        return got + [(t + self.mark, 0, 0, n, a, b) for t, a, b, n in tally(self.texts, self.texts.values()).itertuples(index=False)]


def packed(pid: int, open_: list[tuple], found: list[tuple], sums: Sums, gone: Sums) -> pd.DataFrame:
    """The rows a group returns: its open units in one, the words and places they need to be judged, what was found, and sums."""
    rows = [(*x, None, None) for x in [*sums.rows(), *gone.rows()]]
    rows += [("found", uid, at, x, chain, fixed, text, None) for uid, at, x, chain, fixed, text in found]
    if open_:
        rows.append(("state", 0, 0, 0.0, None, None, None, pickle.dumps(open_, 5)))
        rows += [("need", h, 0, 0.0, None, None, None, None) for h in {w[0] for u in open_ for x in u[5] for _, own in word_parts(x) for w in own}]
        rows += [("at", 0, at, 0.0, None, None, None, None) for at in {at for u in open_ for at in u[1]}]
    out = pd.DataFrame(rows, columns=["what", "a", "b", "x", "s", "t", "u", "blob"]).astype({"a": "int64", "b": "int64", "x": "float64"})
    out.insert(0, "pid", pid)
    return out


def detect(df: DataFrame, id_col: str, source_col: str, fields: list[str], rounds: int = 3, threshold: float = 0.5) -> DataFrame:
    """entry_id, field_name, value, chain, repaired, readable, posterior: every value of ``fields`` that a wrong decoding has
    changed, with the text before it where that can be had (``readable``), else null.

    Each distinct value is either clean or came out of one latent chain of misreadings; the chance of a chain is learned per
    (source, field), so many weak cases support one another. A reading's likelihood comes from word counts of the whole corpus
    (a value's own count excepted) and, for unknown words, from a character model. EM: the chances of the chains, the word
    counts and the character model are re-estimated from the posteriors ``rounds`` times, a value leaving the rounds once its
    posterior is settled; then every record is judged and repaired by the posterior. Lost characters ('?', U+FFFD, dropped
    bytes) are found by an equi-join of the corpus's own words, as each loss would leave them, with the words at hand. All work
    is on distinct values, and values with the same tokens that are not ASCII, in the same places, are judged as one unit that
    counts for each of them. Units are judged in groups (GROUP_UNITS, GROUP_CHARS); the words they need come by equi-joins, a
    word once a group; only the class and character tables (bounded by Unicode) reach the driver. Readings far behind a value's best by characters alone (BEAM, SWAP_BEAM nats) are not followed.

    Defined cases: null and empty values, and plain ASCII ones without '?', are clean; a null source is a source of its own;
    repeated rows all come out; a value of any length is judged whole; a null id gives a row with a null id; an empty table
    gives an empty result; other columns are ignored."""
    spark = df.sparkSession
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))

    def odd(c: Column) -> Column:
        """Whether a text is not plain: more bytes than characters, bytes that are no UTF-8, or a question mark."""
        return (F.octet_length(c) != F.char_length(c)) | F.contains(c, F.lit("?")) | ~F.is_valid_utf8(c)

    def stacked(rows: DataFrame, **more: Column) -> DataFrame:
        """A row a field that is not empty; at: source and field in one number."""
        each = [F.struct(F.lit(i).alias("f"), F.xxhash64(source, F.lit(i)).alias("at"), F.col(c).cast("string").alias("value")) for i, c in enumerate(fields)]
        return rows.select(*(c.alias(n) for n, c in more.items()), F.explode(F.array(*each)).alias("x")).select(*more, "x.*").where("value <> ''")

    def counted(rows: DataFrame) -> DataFrame:
        """Words of ``value``, by their hash."""
        x = rows.select(F.explode(F.split(F.lower("value"), " ")).alias("t")).select("t", F.regexp_extract("t", r"^[^\p{L}\p{N}_]*(.*?)[^\p{L}\p{N}_]*$", 1).alias("core"))
        x = x.select(F.explode(F.when(F.col("core") == F.col("t"), F.array("core")).otherwise(F.array(F.col("core"), F.concat("t", F.lit("\n"))))).alias("word")).where("trim(word) <> ''")
        return x.groupBy(F.xxhash64("word").alias("word")).agg(F.count("*").cast("double").alias("w"))

    # distinct values of a source and field: all that is counted comes from these
    kinds = cut(stacked(df).distinct().withColumn("odd", odd(F.col("value"))))
    plain = cut(kinds.where("not odd").select("f", "value").distinct())
    # ats: where a value stands, as many as sources and fields
    odd_values = kinds.where("odd").groupBy("value").agg(F.sort_array(F.collect_list("at")).alias("ats"), F.size(F.collect_set("f")).alias("fs"))
    # what can be undone in a short value are its tokens that are not ASCII, mostly; values with the same ones that stand in the
    # same places are one unit, which counts as often as it has values. Every other value is a unit as it is
    tokens, high = F.split("value", " "), lambda t: F.octet_length(t) != F.char_length(t)
    apart = (F.char_length("value") <= USUAL) & F.is_valid_utf8("value") & ~F.col("value").rlike(r"[?\x{FFFD}]|[^\x00-\x7F] ( |\z)")
    odd_values = odd_values.withColumn("apart", apart).withColumn("text", F.when(F.col("apart"), F.array_join(F.filter(tokens, high), " ")).otherwise(F.col("value")))
    plain_tokens = F.filter(tokens, lambda t: ~high(t))
    odd_values = odd_values.withColumn("rest", F.when(F.col("apart") & (F.size(plain_tokens) > 0), F.array_join(plain_tokens, " ")))
    odd_values = cut(odd_values.withColumn("uid", F.xxhash64("text", "ats")))
    n_values, n_chars = odd_values.agg(F.count("*"), F.sum(F.char_length("text"))).first()
    if not n_values:
        return spark.createDataFrame([], "entry_id long, field_name string, value string, chain string, repaired string, readable boolean, posterior double")
    slots = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = max(slots, n_values // GROUP_UNITS + 1, n_chars // GROUP_CHARS + 1)
    units = odd_values.groupBy("text", "ats").agg(F.count("*").cast("double").alias("n"))
    units = cut(units.withColumn("pid", F.pmod(F.xxhash64("text"), F.lit(groups)).cast("int")))
    # the plain tokens of a unit's values are in all its readings: they count like those of plain values
    rest = odd_values.where("rest is not null").select(F.col("rest").alias("value"))
    plain_words = cut(counted(plain.select("value").unionByName(rest)))
    # chances are shares of distinct values: else one frequent value could raise the chance of a chain by itself
    settled_n = kinds.where("not odd").groupBy("at").agg(F.count("*").cast("double").alias("s")).select("at", F.lit(CLEAN).alias("chain"), "s")

    # words as each loss would leave them; matched with the words of suspicious values
    def lost(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            words: dict[str, float] = {}
            for v, n in zip(f["text"], f["n"]):
                for t in v.split(" ") if "�" not in v else ():
                    if not t.isascii() and "?" not in t:
                        words[s] = words.get(s := t.strip(_TRIM), 0) + n
            # a question mark after a word may stand for a lost letter, but not for other lost marks
            rows = [(k, x, t, n) for t, n in words.items() if t and not t.isascii() for k in LOSSY if (x := lossy_form(t, k)) != t and not (x.endswith("?") and not t[-1].isalpha())]
            yield pd.DataFrame(rows, columns=["kind", "left", "word", "count"])

    def marred(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = {(i, k, s) for i, x in zip(f["pid"], f["text"]) for k in _lossy_kinds(x) for t in x.split(" ") if (s := t.strip(_TRIM)) and ("?" in s or not s.isascii())}
            yield pd.DataFrame(list(rows), columns=["pid", "kind", "left"])

    broken = units.select("pid", "text").mapInPandas(marred, "pid int, kind string, left string").groupBy("kind", "left").agg(F.collect_set("pid").alias("pids"))
    whole = units.select("text", "n").mapInPandas(lost, "kind string, left string, word string, count double")
    losses = whole.join(broken, ["kind", "left"]).groupBy("kind", "left", "word", "pids").agg(F.sum("count").alias("count"))
    losses = losses.groupBy("kind", "left", "pids").agg(F.max_by("word", F.struct("count", "word")).alias("word"))

    def tallied(rows: DataFrame) -> pd.DataFrame:
        """``rows``: text, p. Class pairs and characters, summed over all rows: at most as many as Unicode has."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield tally(f["text"], f["p"])

        return rows.mapInPandas(run, "t string, a string, b string, n double").groupBy("t", "a", "b").agg(F.sum("n").alias("n")).toPandas()

    def summed(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts).groupby(["t", "a", "b"], as_index=False)["n"].sum()

    def model_of(parts: list[pd.DataFrame]) -> tuple[dict, dict]:
        got = summed(parts)
        p, c = got[got["t"] == "p"], got[got["t"] == "c"]
        return dict(zip(zip(p["a"], p["b"]), p["n"])), dict(zip(c["a"], c["n"]))

    chars = tallied(plain.select(F.col("value").alias("text"), F.lit(1.0).alias("p")))
    # at first every value as it stands counts for the characters
    model = model_of([chars, tallied(odd_values.select(F.col("value").alias("text"), (0.2 * F.col("fs")).alias("p")))])
    chars = summed([chars, tallied(rest.select(F.col("value").alias("text"), F.lit(1.0).alias("p")))])

    def flat(rows: DataFrame, what: str, **more: Column) -> DataFrame:
        """Rows of several kinds in one shape, no number null (pandas would make floats of the others)."""
        none = {"pid": F.col("pid"), "what": F.lit(what), "a": F.lit(0).cast("long"), "b": F.lit(0).cast("long"), "x": F.lit(0.0)} | dict.fromkeys("stu", F.lit(None).cast("string"))
        return rows.select(*(c.alias(k) for k, c in (none | {"ats": F.lit(None).cast("array<long>"), "blob": F.lit(None).cast("binary")} | more).items()))

    def grouped(rows: DataFrame, run) -> DataFrame:
        return cut(rows.repartition(groups, "pid").groupBy("pid").applyInPandas(run, "pid int, what string, a long, b long, x double, s string, t string, u string, blob binary"))

    def first(f, *, shared=spark.sparkContext.broadcast(model)):
        """The readings within the beam, and where to start: a text that UTF-8 rules allow to be undone, or one with U+FFFD,
        most likely is garbled. A unit with one reading is clean and needs no rounds."""
        known: dict[str, dict[str, str]] = {}
        lost = f[f["what"] == "loss"]
        for kind, left, word in zip(lost["s"], lost["t"], lost["u"]):
            known.setdefault(kind, {})[left] = word
        beam, last, got = Beam(CharModel(*shared.value), known), None, ()
        sums, alone, open_ = Sums(), Sums("!"), []
        own = f[f["what"] == "unit"].sort_values("t")
        for uid, n, x, ats in zip(own["a"].tolist(), own["x"].tolist(), own["t"], own["ats"]):
            if x != last:
                last, got = x, tuple(zip(*beam.readings(x)))
            chains, texts, oks, strong, standing = got
            m, k = len(chains), sum(strong)
            if k:
                p = [0.99 / k if y else 0.01 / (m - k) for y in strong]
            else:
                p = [0.95] + [0.05 / (m - 1)] * (m - 1) if m > 1 else [1.0]
            unit = uid, ats.tolist(), n, bool(k), chains, texts, oks, standing, p
            (sums if m > 1 else alone).add(unit, list(map(word_parts, texts)), [p] * len(ats))
            if m > 1:
                open_.append(unit)
        return packed(int(f["pid"].iat[0]), open_, [], sums, alone)

    given = flat(units, "unit", a=F.xxhash64("text", "ats"), x=F.col("n"), t=F.col("text"), ats=F.col("ats"))
    state = grouped(given.unionByName(flat(losses.withColumn("pid", F.explode("pids")), "loss", s=F.col("kind"), t=F.col("left"), u=F.col("word"))), first)

    def chars_of(state: DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Of what has left the rounds, and of the rest."""
        got = state.where("what in ('p', 'c', 'p!', 'c!')").groupBy(F.col("what").alias("t"), F.col("s").alias("a"), F.col("t").alias("b")).agg(F.sum("x").alias("n")).toPandas()
        gone = got["t"].str.endswith("!")
        return got[gone].assign(t=got["t"].str[:1]), got[~gone]

    words = plain_words
    chars = summed([chars, chars_of(state)[0]])
    judged = []
    for step in range(rounds):
        of = lambda what, *c, state=state: state.where(F.col("what").isin(what)).select(*c)
        word_count, chance = [F.col("a").alias("word"), F.col("x").alias("w")], [F.col("b").alias("at"), F.col("s").alias("chain"), F.col("x").alias("s")]
        words = words.unionByName(of(["word!"], *word_count))
        settled_n = settled_n.unionByName(of(["chance!"], *chance))
        counts = words.unionByName(of(["word"], *word_count))
        # the mass of all words: one number
        mass = float(counts.agg(F.sum("w").alias("s")).first()["s"] or 1.0)
        known = of(["need"], "pid", F.col("a").alias("word")).join(counts.groupBy("word").agg(F.sum("w").alias("w")), "word")
        # the chances of chains per source and field, smoothed towards those over all
        prior = cut(settled_n.unionByName(of(["chance"], *chance)).groupBy("at", "chain").agg(F.sum("s").alias("s")))
        total = float(prior.agg(F.sum("s").alias("x")).first()["x"] or 1.0)
        over = prior.groupBy("chain").agg(F.sum("s").alias("a"))
        here = prior.groupBy("at").agg(F.sum("s").alias("t"))
        prior = prior.join(over, "chain").join(here, "at").select("at", "chain", F.log((F.col("s") + 20 * (F.col("a") + 0.1) / total) / (F.col("t") + 20)).alias("lpi"))
        prior = of(["at"], "pid", F.col("b").alias("at")).join(prior, "at")

        def judge(f, *, last=step + 1 == rounds, mass=mass, shared=spark.sparkContext.broadcast(model)):
            m, pid = CharModel(*shared.value), int(f["pid"].iat[0])
            facts = f[f["what"] == "word"]
            known = dict(zip(facts["a"].tolist(), facts["x"].tolist()))
            lpi: dict[int, dict[str, float]] = {}
            facts = f[f["what"] == "prior"]
            for at, chain, x in zip(facts["b"].tolist(), facts["s"], facts["x"].tolist()):
                lpi.setdefault(at, {})[chain] = x
            sums, gone, open_, found = Sums(), Sums("!"), [], []
            for unit in (u for x in f["blob"].dropna() for u in pickle.loads(x)):
                uid, ats, n, strong, chains, texts, oks, standing, p = unit
                split = [word_parts(t) for t in texts]
                mine = own_words(strong, chains, split, p)
                done: dict[str, tuple[float, bool]] = {}
                ll = [likelihood(c, t, x, m, known, mine, mass, done) for c, t, x in zip(chains, split, standing)]
                qs = [posterior(ll, [lpi[at][c] for c in chains]) for at in ats]
                p = [sum(q) / len(ats) for q in zip(*qs)]
                unit = uid, ats, n, strong, chains, texts, oks, standing, p
                settled = min(map(max, qs)) >= SETTLED
                if last or settled:
                    for at, q in zip(ats, qs):
                        if 1 - q[0] > threshold:
                            # the clean reading is the first; of the others the likeliest, the one named last among equals
                            i = max(range(1, len(q)), key=lambda i: (q[i], chains[i], i))
                            found.append((uid, at, 1 - q[0], chains[i], texts[i] if oks[i] else None, texts[0]))
                else:
                    open_.append(unit)
                # a place of a unit that stays open counts by the unit's mean
                if settled and not last:
                    gone.add(unit, split, qs)
                elif not last:
                    sums.add(unit, split, [p] * len(ats))
            return packed(pid, open_, found, sums, gone)

        facts = flat(known, "word", a=F.col("word"), x=F.col("w")).unionByName(flat(prior, "prior", b=F.col("at"), s=F.col("chain"), x=F.col("lpi")))
        state = grouped(facts.unionByName(flat(of(["state"], "pid", "blob"), "state", blob=F.col("blob"))), judge)
        judged.append(state.where("what = 'found'"))
        if step + 1 < rounds:
            left, going = chars_of(state)
            chars = summed([chars, left])
            model = model_of([chars, going])
    found = functools.reduce(DataFrame.unionByName, judged).select(F.col("a").alias("uid"), F.col("u").alias("text"), F.col("b").alias("at"), F.col("s").alias("chain"), F.col("t").alias("fixed"), F.col("t").isNotNull().alias("readable"), F.col("x").alias("posterior"))
    garbled = cut(odd_values.select("value", "apart", "uid", "text").join(found, ["uid", "text"]).drop("uid", "text"))
    if garbled.count() <= BROADCAST_VALUES:
        garbled = F.broadcast(garbled)
    # the tokens that are not ASCII are put back where they stood
    split, fixed = F.split("value", " "), F.split("fixed", " ")
    mended = F.array_join(F.transform(split, lambda t, i: F.when(high(t), F.get(fixed, F.size(F.filter(F.slice(split, 1, i + 1), high)) - 1)).otherwise(t)), " ")
    mended = F.when(F.col("apart") & F.col("readable"), mended).otherwise(F.col("fixed"))
    names = F.array(*[F.lit(c) for c in fields])
    # rows with plain values only are left out before fields become rows
    some = functools.reduce(operator.or_, [F.coalesce(odd(F.col(c).cast("string")), F.lit(False)) for c in fields])
    rows = stacked(df.where(some), entry_id=F.col(id_col)).where(odd(F.col("value")))
    return rows.join(garbled, ["at", "value"]).select("entry_id", F.get(names, F.col("f")).alias("field_name"), "value", "chain", mended.alias("repaired"), "readable", "posterior")
