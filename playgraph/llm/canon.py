"""Mapping free-entered values to a canonical list (problem 1): BK-trees under the Levenshtein metric."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playgraph.llm import names as nm
from playgraph.llm.mojibake import LOSSY, invertible, lossy_form
from playgraph.session import cut

#: Reference entries of one tree; a list of up to this many is broadcast, a longer one is sharded.
SHARD_ROWS = 20_000
#: Names searched at once: a tree node costs one array pass for all of them.
BATCH = 40_000
#: Names of one task, so that tasks do not grow with the input.
TASK_NAMES = 20_000
#: Letters from which on a string's forms with a letter left out would be too large.
LONG = 200
#: A string with more pairs than this is searched in the tree, which does not look at most of them.
MANY = 64
#: Pairs of strings measured at once.
PAIRS_AT_ONCE = 8192
#: Places of the table of letter pairs, by hash.
PAIRS = 256
#: Least share of a reference name that a cut-off one must have.
CUT_SHARE = 0.55


class BkTree:
    """A BK-tree searched by many queries at once. Distances are Levenshtein (insert, delete, replace), a true metric, so the
    triangle inequality prunes children exactly, and as no distance is less than the difference of lengths, there is a tree
    for each length of which only the near ones are searched: every string within a query's radius is found."""

    def __init__(self, strings: list[str]):
        self.strings = list(dict.fromkeys(s for s in strings if s))
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted({c for s in self.strings for c in s}))}
        self.index = {s: i for i, s in enumerate(self.strings)}
        self.children: list[dict[int, int]] = []
        self.roots: dict[int, int] = {}
        for i, s in enumerate(self.strings):
            self.children.append({})
            at = self.roots.setdefault(len(s), i)
            while at != i:
                d = nm.distance(s, self.strings[at])
                nxt = self.children[at].get(d)
                if nxt is None:
                    self.children[at][d] = i
                    break
                at = nxt

    def _codes(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(q) for q in queries], np.int64)
        codes = np.zeros((int(size.max(initial=0)), len(queries)), np.int32)  # unknown letters are 0, in no string
        for j, q in enumerate(queries):
            codes[: len(q), j] = [self.alphabet.get(c, 0) for c in q]
        return codes, size

    def _distances(self, s: str, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """From one string to many queries: the bit-parallel recurrence of Myers and Hyyro, one query an array cell."""
        m = len(s)
        if m > 62:
            back = {i: c for c, i in self.alphabet.items()}
            return np.array([nm.distance(s, "".join(back.get(int(c), "\0") for c in codes[:n, j])) for j, n in enumerate(size)], np.int64)
        eq = np.zeros(len(self.alphabet) + 1, np.uint64)
        for i, c in enumerate(s):
            eq[self.alphabet[c]] |= np.uint64(1 << i)
        one, top = np.uint64(1), np.uint64(m - 1)
        n = len(size)
        pv, mv = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(n, np.uint64)
        score = np.full(n, m, np.int64)
        out = score.copy()
        for j in range(int(size.max(initial=0))):
            e = eq[codes[j]]
            xv = e | mv
            xh = (((e & pv) + pv) ^ pv) | e
            ph, mh = mv | ~(xh | pv), pv & xh
            score = score + ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64)
            ph, mh = (ph << one) | one, mh << one
            pv, mv = mh | ~(xv | ph), ph & xv
            out = np.where(size == j + 1, score, out)
        return out

    def measure(self, queries: list[str], qi: np.ndarray, si: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``search``, for pairs of a query and a string that are already at hand: one pair an array cell. Of the table of
        Levenshtein only the cells within the radius of the diagonal are filled, as no others are on a way that short."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = np.array([len(q) for q in queries], np.int64)
        # pairs of like length and radius together
        order = np.lexsort((radius[qi], n[qi]))
        for a in range(0, len(order), PAIRS_AT_ONCE):
            q, s = qi[order[a : a + PAIRS_AT_ONCE]], si[order[a : a + PAIRS_AT_ONCE]]
            asked, at = np.unique(q, return_inverse=True)
            held, to = np.unique(s, return_inverse=True)
            (x, nx), (y, ny) = self._codes([queries[i] for i in asked]), self._codes([self.strings[i] for i in held])
            x, nx, y, ny = x[:, at], nx[at], y[:, to], ny[to]
            r = int(radius[q].max())
            far = np.full(len(q), len(x) + len(y) + 1, np.int32)
            # row[k] is the distance of the first j letters of the query and the first j + k - r of the string
            row = [far if k < r else np.full(len(q), k - r, np.int32) for k in range(2 * r + 1)]
            d = np.full(len(q), r + 1, np.int32)
            for j in range(1, len(x) + 1):
                new: list[np.ndarray] = []
                for k in range(2 * r + 1):
                    i = j + k - r
                    if i < 0 or i > len(y):
                        new.append(far)
                        continue
                    cell = far if i == 0 else row[k] + (x[j - 1] != y[i - 1])
                    if k < 2 * r:
                        cell = np.minimum(cell, row[k + 1] + 1)
                    new.append(np.minimum(cell, new[k - 1] + 1) if k else cell)
                row = new
                if len(ends := np.flatnonzero(nx == j)):
                    d[ends] = np.stack(row)[np.clip(ny[ends] - j + r, 0, 2 * r), ends]
            hit = (d <= radius[q]) & (np.abs(nx - ny) <= radius[q])
            found.append((q[hit], s[hit], d[hit].astype(np.int64)))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none, none)

    def search(self, queries: list[str], radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, string number, distance) of every string within its query's radius."""
        if not queries or not self.strings:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, size = self._codes(queries)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        near = ((n, root, np.flatnonzero(np.abs(size - n) <= radius)) for n, root in self.roots.items())
        stack = [(root, idx) for _, root, idx in near if len(idx)]
        while stack:
            at, idx = stack.pop()
            d = self._distances(self.strings[at], codes[:, idx], size[idx])
            hit = d <= radius[idx]
            found.append((idx[hit], np.full(int(hit.sum()), at), d[hit]))
            for k, child in self.children[at].items():
                sub = idx[np.abs(d - k) <= radius[idx]]
                if len(sub):
                    stack.append((child, sub))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none, none)


def left_out(s: str) -> set[str]:
    """``s`` and its forms with one letter left out."""
    return {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}


def hashes_left_out(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, whose) of the forms of all strings with up to one letter left out, but for those longer than LONG."""
    forms = [{hash(f) for f in left_out(s)} if len(s) <= LONG else () for s in strings]
    n = [len(f) for f in forms]
    h = np.fromiter((x for f in forms for x in f), np.int64, sum(n))
    order = np.argsort(h)
    return h[order], np.repeat(np.arange(len(strings)), n)[order]


def pair_counts(strings: list[str]) -> np.ndarray:
    """How often each pair of neighbouring letters stands in each string, pairs by their place in a hashed table."""
    out = np.zeros((len(strings), PAIRS), np.float32)
    at = [(i, (ord(x) * 31 + ord(y)) % PAIRS) for i, s in enumerate(strings) for x, y in zip(s, s[1:])]
    if at:
        i, j = np.array(at).T
        np.add.at(out, (i, j), 1)
    return out


def letter_counts(strings: list[str]) -> np.ndarray:
    """How often each letter stands in each string, letters by their place in a table of 32."""
    out = np.zeros((len(strings), 32), np.int32)
    at = [(i, ord(x) % 32) for i, s in enumerate(strings) for x in s]
    if at:
        i, j = np.array(at).T
        np.add.at(out, (i, j), 1)
    return out


def undone(text: str) -> list[str]:
    """What the misreadings that can be undone make of a name. UTF-8 proves itself; as any bytes can be undone as another
    encoding, other readings count only if they look like a name: letters of one script, no capital after a small letter."""
    if text.isascii():
        return []
    return list(dict.fromkeys(t for chain, t in invertible(text).items() if chain.startswith("utf8") or nm.likely(t)))


class Matcher:
    """The reference entries of one shard in three trees: full names, names with a word cut to 1 to 3 letters, and cut-off names."""

    def __init__(self, entries: list[tuple[int, str]], habits: nm.Habits):
        self.habits = habits
        self.names = dict(entries)
        self.compilation = sorted(i for i, n in entries if nm.COMPILATION.match(nm.fold(n)))
        self.core = {i: nm.core(n, habits) for i, n in entries}
        # names as a lossy misreading leaves them
        self.lost = {f: i for i, n in reversed(entries) for k in LOSSY if (f := lossy_form(n, k)) != n}
        self.trees: dict[str, BkTree] = {}
        self.short: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.pairs: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.owners: dict[str, list[list[int]]] = {}
        forms: dict[str, dict[str, list[int]]] = {"full": {}, "initial": {}, "cut": {}}
        for i, (w, _) in self.core.items():
            full = "".join(w)
            forms["full"].setdefault(full, []).append(i)
            for k, x in enumerate(w):
                if len(w) > 1 and len(x) > 1 and x != "and" and x not in habits.endings:
                    for n in range(1, min(4, len(x) - 1)):
                        forms["initial"].setdefault("".join([*w[:k], x[:n], *w[k + 1 :]]), []).append(i)
            for n in range(max(5, int(np.ceil(CUT_SHARE * len(full)))), len(full)):
                forms["cut"].setdefault(full[:n], []).append(i)
        for kind, f in forms.items():
            self.trees[kind] = BkTree(list(f))
            self.owners[kind] = [f[s] for s in self.trees[kind].strings]

    @staticmethod
    def radius(kind: str, n: int) -> int:
        if kind == "full":
            return 0 if n < 4 else 1 if n < 7 else 2 if n < 10 else 3 if n < 13 else 4
        return 0 if n < 7 else 1

    def _plausible(self, w: list[str], ref: list[str], d: int) -> bool:
        """The exact check after the tree: a distance of 4 must come from exchanged letters, and no single word is another
        one: a word may lose up to two fifths, or keep three first letters."""
        if d > 3 and nm.typo_distance("".join(w), "".join(ref)) - sum(x.count(nm.LOST) for x in w) > 3:
            return False
        if len(w) != len(ref):
            return True
        for a, b in zip(w, ref):
            most = max(1, int(0.4 * max(len(a), len(b)))) + a.count(nm.LOST)
            if nm.distance(a, b, most) > most and not (a[:3] == b[:3] and min(len(a), len(b)) >= 3):
                return False
        return True

    def _forms(self, text: str, cost: float) -> list[tuple[str, str, float, list[str], bool, int, int]]:
        """(kind, joined words, cost, words, opener?, radius, order number) of every form in which a name is searched."""
        w, opened = nm.core(text, self.habits)
        if not w:
            return []
        sizes = [len(x) for x in w if x.isalpha() or nm.LOST in x]
        least = min(sizes) if sizes else 9
        kinds = ["full"] if least > 3 or len(w) == 1 else ["initial"] if least == 1 else ["full", "initial"]
        out = []
        for k, o in enumerate(nm.orders(w)):
            joined = "".join(o)
            lost = min(joined.count(nm.LOST), 5)
            for kind in kinds:
                r = self.radius(kind, len(joined)) if least == 1 or kind == "full" else 0
                r = min(r, 1) if cost else min(r, 2) if k else r
                out.append((kind, joined, cost + 0.4 * bool(k) - 0.9 * lost + (1.0 if kind == "initial" else 0.0), o, opened, r + lost, k))
        return out

    def _one_off_pairs(self, kind: str, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the asked string, number of the tree's string) of those that share a form with up to one letter left out:
        strings within one edit do, so nothing is lost. Forms are told by their hash, as a pair too many does no harm. Strings
        of LONG letters and more are told by their lengths alone."""
        if kind not in self.short:
            # made where it is used: hashes of strings hold within a process
            held = self.trees[kind].strings
            self.short[kind] = (*hashes_left_out(held), np.array([len(s) if len(s) >= LONG else -9 for s in held]))
        known, of, sizes = self.short[kind]
        asked, q = hashes_left_out(strings)
        lo, hi = np.searchsorted(known, asked, "left"), np.searchsorted(known, asked, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found = [np.stack([np.repeat(q, n), of[at]])]
        for i, s in enumerate(strings):
            if len(s) >= LONG - 1:
                near = np.flatnonzero(np.abs(sizes - len(s)) <= 1)
                found.append(np.stack([np.full(len(near), i), near]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pairs[0], pairs[1]

    def _one_off(self, kind: str, strings: list[str]) -> np.ndarray:
        """Whether a string is in any pair of ``_one_off_pairs``."""
        return np.bincount(self._one_off_pairs(kind, strings)[0], minlength=len(strings)) > 0

    def _near_pairs(self, kind: str, strings: list[str], radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the asked string, number of the tree's string) of those with enough pairs of neighbouring letters, and
        letters, in common. An edit takes at most two of the longer string's pairs away, the product of two pair counts is never
        less than the pairs in common, and an edit changes two letter counts by one at most, so neither bound loses anything."""
        if kind not in self.pairs:
            held = self.trees[kind].strings
            self.pairs[kind] = (pair_counts(held), np.array([len(s) for s in held]), letter_counts(held))
        ref, size, letters = self.pairs[kind]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for a in range(0, len(strings), 1024):
            part, r = strings[a : a + 1024], radius[a : a + 1024]
            n = np.array([len(s) for s in part])
            need = np.maximum(n[:, None], size[None, :]) - 1 - 2 * r[:, None]
            q, k = np.nonzero((pair_counts(part) @ ref.T >= need) & (np.abs(n[:, None] - size[None, :]) <= r[:, None]))
            own = letter_counts(part)
            for b in range(0, len(q), 65536):
                x, y = q[b : b + 65536], k[b : b + 65536]
                near = np.abs(own[x] - letters[y]).sum(axis=1) <= 2 * r[x]
                found.append((a + x[near], y[near]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _near(self, kind: str, strings: list[str], radius: np.ndarray) -> np.ndarray:
        """Whether a string is in any pair of ``_near_pairs``."""
        return np.bincount(self._near_pairs(kind, strings, radius)[0], minlength=len(strings)) > 0

    def _search(self, asks: list[tuple], best: dict[int, dict[int, float]]) -> None:
        """asks: (name number, kind, joined, cost, words, opener?, radius). Equal strings are found directly, the others among
        the pairs that the bounds leave or in the tree; a string asked by many is searched once."""
        for kind, tree in self.trees.items():
            ask = [a for a in asks if a[1] == kind]
            keys = list(dict.fromkeys((a[2], a[6]) for a in ask if a[6]))
            hits: dict[tuple[str, int], list[tuple[int, int]]] = {}
            if keys and len(tree.strings):
                # bounds that lose nothing leave few pairs, which are measured; strings with many are left to the tree
                for one in (True, False):
                    asked = [k for k in keys if (k[1] == 1) == one]
                    strings, radius = [k[0] for k in asked], np.array([k[1] for k in asked], np.int64)
                    qi, si = self._one_off_pairs(kind, strings) if one else self._near_pairs(kind, strings, radius)
                    many = np.bincount(qi, minlength=len(asked)) > MANY
                    few, rest = ~many[qi], np.flatnonzero(many)
                    q, s, x = tree.search([strings[i] for i in rest], radius[rest])
                    for a, s, x in zip(*(np.concatenate(v).tolist() for v in zip((rest[q], s, x), tree.measure(strings, qi[few], si[few], radius)))):
                        hits.setdefault(asked[a], []).append((s, x))
            for q, _, joined, cost, w, opened, r in ask:
                found = hits.get((joined, r), []) if r else []
                if (s := tree.index.get(joined)) is not None and (s, 0) not in found:
                    found = [*found, (s, 0)]
                for s, x in found:
                    for i in self.owners[kind][s]:
                        ref, ref_opened = self.core[i]
                        if kind == "full" and x and not self._plausible(w, ref, x):
                            continue
                        score = x + cost + 0.2 * (opened != ref_opened)
                        mine = best.setdefault(q, {})
                        mine[i] = min(score, mine.get(i, 1e9))

    def match(self, typed: list[str]) -> pd.DataFrame:
        """name, entry, score, tie: the best entry of each name that has any.

        Cheap searches first; a name goes on only while a dearer search could still find a better entry: equal forms in any
        order, the same of the misreadings undone, one edit in the order typed, the full radius of all, then cut-off names."""
        best: dict[int, dict[int, float]] = {}
        forms = {}
        for q, name in enumerate(typed):
            if self.compilation and nm.COMPILATION.match(nm.fold(name)):
                best.setdefault(q, {})[self.compilation[0]] = 0.0
            if (i := self.lost.get(name.strip())) is not None:
                best.setdefault(q, {})[i] = 0.1
            forms[q] = self._forms(name, 0.0)
        readings = {q: [f] for q, f in forms.items()}

        def left(most: float) -> list[int]:
            return [q for q in forms if min(best.get(q, {-1: 1e9}).values()) > most]

        self._search([(q, *f[:5], 0) for q in left(0.0) for f in forms[q]], best)
        asks = []
        for q in left(0.3):
            for text in undone(typed[q]):
                if self.compilation and nm.COMPILATION.match(nm.fold(text)):
                    best.setdefault(q, {})[self.compilation[0]] = 0.3
                if (i := self.lost.get(text.strip())) is not None:
                    best.setdefault(q, {})[i] = 0.4
                readings[q].append(self._forms(text, 0.3))
                asks += [(q, *f[:5], 0) for f in readings[q][-1]]
        self._search(asks, best)
        self._search([(q, *f[:5], 1) for q in left(0.6) for f in forms[q] if f[0] == "full" and f[6] == 0 and f[5] >= 1 and nm.LOST not in f[1]], best)
        # a form is asked in its full radius as long as an edit more than those already looked for could still win or tie
        asks = []
        for q in left(0.1):
            worst = min(best.get(q, {-1: 1e9}).values())
            for n, reading in enumerate(readings[q]):
                for f in reading:
                    done = f[0] == "full" and f[6] == n == 0 and f[5] >= 1 and nm.LOST not in f[1]
                    if f[5] > done and worst >= 1 + done + f[2]:
                        asks.append((q, *f[:5], f[5]))
        self._search(asks, best)
        asks = []
        for q in left(1.5):
            for n, reading in enumerate(readings[q]):
                for _, joined, _, w, opened, _, k in reading:
                    if k == 0 and len(joined) >= 5:
                        asks.append((q, "cut", joined, 1.5 + 0.3 * bool(n), w, opened, self.radius("cut", len(joined) - 4)))
                        break
        self._search(asks, best)
        rows = []
        for q, by in best.items():
            least = min(by.values())
            near = [i for i, s in by.items() if s < least + 1e-6]
            tie = {i: nm.distance(nm.fold(typed[q]), nm.fold(self.names[i]), 30) if len(near) > 1 else 0 for i in near}
            i = min(near, key=lambda i: (tie[i], i))
            rows.append((typed[q], i, float(least), tie[i]))
        return pd.DataFrame(rows, columns=["name", "entry", "score", "tie"]).astype({"entry": "int64", "score": "float64", "tie": "int64"})


def list_habits(ref: DataFrame, n: int, share: float = 0.006) -> nm.Habits:
    """nm.Habits.of over all ``n`` names in column ``ref``, first and last words counted in the cluster."""

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            w = [x for x in (nm.words(s)[0] for s in f["ref"]) if len(x) > 2]
            yield pd.DataFrame([("first", x[0]) for x in w] + [("last", x[-1]) for x in w], columns=["place", "word"])

    often = ref.select("ref").mapInPandas(ends, "place string, word string").groupBy("place", "word").count().where(F.col("count") >= max(3, share * n))
    common = often.collect()  # at most 2 / share rows
    return nm.Habits({r["word"] for r in common if r["place"] == "first"}, {r["word"] for r in common if r["place"] == "last"})


def map_to_list(typed: DataFrame, name_col: str, reference: DataFrame, ref_id: str, ref_name: str) -> DataFrame:
    """name, entry, score: one row per distinct non-blank value of ``name_col``; ``entry`` is the id of the reference entry
    meant, -1 if none is, and ``score`` its edit distance plus the costs of other differences.

    Names are folded (case, accents, marks, tags, nicknames in quotes, openers such as the list's own 'The'), their words put
    in the orders people use, undoable misreadings of encodings undone, and the results searched in BK-trees over the
    reference names, the names with a word as initial and the cut-off names. The trees return every entry within the radius
    (1 to 3 by length); an exact check by words follows; the least score wins, then the least distance of the unfolded names,
    then the smaller id. Lists of up to SHARD_ROWS entries are broadcast, longer ones are sharded by id, every distinct name
    meets every shard, and the shards' winners merge.

    Defined cases: null and blank names have no row; a null id or blank name in the reference is left out; of equal reference
    names the smaller id wins; an empty reference maps everything to -1; names of any length are taken whole; further columns
    are ignored. Repeated names are searched once."""
    spark = typed.sparkSession
    distinct = typed.select(F.col(name_col).cast("string").alias("name")).where(r"name rlike '\\S'").distinct()
    ref = reference.select(F.col(ref_id).cast("long").alias("entry"), F.col(ref_name).cast("string").alias("ref")).where(r"entry is not null and ref rlike '\\S'")
    n_ref = ref.count()
    schema = "name string, entry long, score double, tie long"
    if n_ref == 0:
        return distinct.select("name", F.lit(-1).cast("long").alias("entry"), F.lit(None).cast("double").alias("score"))
    habits = list_habits(ref, n_ref)
    distinct = cut(distinct)
    parts = max(spark.sparkContext.defaultParallelism, -(-distinct.count() // TASK_NAMES))
    if n_ref <= SHARD_ROWS:
        entries = sorted((r["entry"], r["ref"]) for r in ref.collect())
        # the trees are built once and sent; a worker unpacks them once
        shared = spark.sparkContext.broadcast(Matcher(entries, habits))

        def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m, held = shared.value, []
            for f in frames:
                held += f["name"].tolist()
                if len(held) >= BATCH:
                    yield m.match(held)
                    held = []
            if held:
                yield m.match(held)

        found = distinct.repartition(parts, "name").mapInPandas(search, schema)
    else:
        shards = -(-n_ref // SHARD_ROWS)
        salts = max(1, parts // shards)
        left = distinct.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(salts)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        right = ref.withColumn("shard", F.pmod(F.xxhash64("entry"), F.lit(shards)).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

        def shard(key: tuple, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            m = Matcher(sorted(zip(r["entry"], r["ref"])), habits)
            outs = [m.match(q["name"].iloc[a : a + BATCH].tolist()) for a in range(0, len(q), BATCH)]
            return pd.concat(outs) if outs else m.match([])

        found = left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInPandas(shard, schema)
    w = Window.partitionBy("name").orderBy("score", "tie", "entry")
    won = found.withColumn("r", F.row_number().over(w)).where("r = 1").select("name", "entry", "score")
    return cut(distinct.join(won, "name", "left").withColumn("entry", F.coalesce("entry", F.lit(-1).cast("long"))))
