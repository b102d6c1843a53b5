"""Visually identical text with different characters (problem 10): script-aware repair to one consistent form."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playgraph.session import cut

#: Candidate forms that are sent to every task as a set; more of them meet the corpus by a shuffled join.
BROADCAST_FORMS = 200_000

#: Letters that look alike in Latin, Cyrillic, Greek and Armenian type; the first of each group is Latin.
LOOK_ALIKES = (
    "AАΑ BВΒ CСϹ EЕΕ FϜ GԌ HНΗ IІΙӀ JЈͿ KКΚ MМΜ NΝ OОΟՕ PРΡ QԚ SЅՏ TТΤ UՍ VѴ WԜ XХΧ YҮΥ ZΖ "
    "aаɑ cсϲ dԁ eе gɡց hһհ iіι jјϳ kк lӏ nո oоοօ pрρ qԛզ rг sѕ uսυ vѵν wԝ xх yуүγ"
).split()
#: Ligatures and the ellipsis, drawn as the letters or points they stand for.
JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "…": "..."}
#: Marks without a look of their own, besides all of category Cf.
UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍᠎︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️"

_PLAIN = re.compile(r"[\x20-\x7e\n\t]*\Z")
_TOKEN = re.compile(r"(?:[^\W\d_][̀-ͯ]*)+")


@functools.lru_cache(maxsize=None)
def script(ch: str) -> str:
    """LATIN, CYRILLIC, GREEK, ARMENIAN or '' for anything else."""
    name = unicodedata.name(ch, "").split(" ", 1)[0]
    return name if name in ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN") else ""


@functools.lru_cache(maxsize=1)
def _swaps() -> dict[tuple[str, str], str]:
    """(letter, script wanted) -> the letter of that script that looks the same."""
    out: dict[tuple[str, str], str] = {}
    for group in LOOK_ALIKES:
        for a in group:
            for b in group:
                if a != b and script(a) != script(b):
                    out.setdefault((a, script(b)), b)
    return out


@functools.lru_cache(maxsize=65536)
def _seen(ch: str) -> str:
    if ch in JOINED:
        return JOINED[ch]
    kind = unicodedata.category(ch)
    if kind == "Cf" or ch in UNSEEN:
        return ""
    if kind == "Zs":
        return " "
    if unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>")):
        return unicodedata.normalize("NFKC", ch)
    return ch


def base_form(text: str) -> str:
    """Composed form without invisible characters: full-width letters, ligatures and blanks in their plain form. Superscripts,
    other letters, digits, accents and case stay apart. A text of blanks only becomes empty."""
    if _PLAIN.match(text):
        return text if text.strip() else ""
    t = unicodedata.normalize("NFC", "".join(map(_seen, text)))
    return t if t.strip() else ""


def token_repairs(token: str, home: str) -> list[str]:
    """Forms of one token with look-alikes replaced, most wanted first. A token of several scripts goes to its dominant script
    (then the text's, then the others it holds); one of a single script foreign to its text ``home``, to that."""
    letters = [script(c) for c in unicodedata.normalize("NFD", token)]
    held = {s: letters.count(s) for s in letters if s}
    if not held or set(held) == {home}:
        return []
    if len(held) == 1:
        wanted = [home]
    else:
        wanted = sorted(held, key=lambda s: (-held[s], s != home, s))
    out = []
    for to in wanted:
        form = [c if s in ("", to) else _swaps().get((c, to), "") for c, s in zip(unicodedata.normalize("NFD", token), letters)]
        if all(form) and (form := unicodedata.normalize("NFC", "".join(form))) != token:
            out.append(form)
    return out


def _home(text: str) -> str:
    counts: dict[str, int] = {}
    for c in text:
        if (s := script(c)) :
            counts[s] = counts.get(s, 0) + 1
    return max(sorted(counts), key=counts.get) if counts else ""


def _suspects(base: str) -> list[tuple[str, int, str]]:
    """(token, order of preference, repaired form) of the tokens of a text that could be repaired."""
    if _PLAIN.match(base):
        return []
    home, out = None, []
    for token in set(_TOKEN.findall(base)):
        if token.isascii():
            continue
        if home is None:
            home = _home(base)
        out += [(token, k, form) for k, form in enumerate(token_repairs(token, home))]
    return out


def consistent_form(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, form: every row with the one form that all texts alike to the eye share.

    First the base form. Then, in tokens of mixed script (or of one script foreign to the text around them), look-alike
    letters are replaced by those of the dominant script, but only when the result stands in the corpus vocabulary: the
    tokens of all base forms. Only the candidate forms are looked up in it, so the vocabulary is never gathered: up to
    BROADCAST_FORMS candidates (counted first) meet the tokens where these are, more of them by a shuffled equi-join.

    Defined cases: a null text has a null form; empty and blank texts have the form ''; repeated rows each have their form;
    texts of any length are handled whole; columns besides the two are ignored."""
    spark = df.sparkSession

    def base(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            b = f["text"].map(lambda t: base_form(t) if isinstance(t, str) else None)
            sus = b.map(lambda t: [{"token": x, "k": k, "form": y} for x, k, y in _suspects(t)] if isinstance(t, str) else [])
            yield pd.DataFrame({"id": f["id"], "text": f["text"], "base": b, "sus": sus})

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    based = cut(rows.mapInPandas(base, f"id {kind}, text string, base string, sus array<struct<token string, k int, form string>>"))
    wanted = based.where("size(sus) > 0").select(F.explode("sus").alias("s")).select("s.token", "s.k", "s.form").distinct()
    wanted = cut(wanted)
    if wanted.isEmpty():
        return based.select("id", "text", F.col("base").alias("form"))
    words = based.where("base is not null").select(F.explode(F.regexp_extract_all("base", F.lit(r"((?:\p{L}[̀-ͯ]*)+)"), F.lit(1))).alias("form"))
    forms = wanted.select("form").distinct()
    known = words.join(F.broadcast(forms) if wanted.count() <= BROADCAST_FORMS else forms, "form", "left_semi").distinct()
    repairs = cut(wanted.join(known, "form").groupBy("token").agg(F.min_by("form", "k").alias("to")))
    # only texts with suspects meet the repairs, one row a suspect token; a text's own repairs are few
    per = based.where("size(sus) > 0").select("id", "base", F.explode(F.array_distinct(F.transform("sus", lambda s: s["token"]))).alias("token"))
    chosen = per.join(repairs, "token").groupBy("id", "base").agg(F.map_from_entries(F.collect_set(F.struct("token", "to"))).alias("map"))

    def repair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            maps = [dict(m) for m in f["map"]]
            yield pd.DataFrame({"id": f["id"], "base": f["base"], "form": [_TOKEN.sub(lambda m, r=r: r.get(m[0], m[0]), b) for b, r in zip(f["base"], maps)]})

    fixed = chosen.mapInPandas(repair, f"id {kind}, base string, form string").select(F.col("id").alias("fid"), F.col("base").alias("fbase"), "form")
    mended = based.where("size(sus) > 0").join(fixed, F.col("id").eqNullSafe(F.col("fid")) & (F.col("base") == F.col("fbase")), "left")
    return based.where("size(sus) = 0").select("id", "text", F.col("base").alias("form")).unionByName(mended.select("id", "text", F.coalesce("form", "base").alias("form")))


def alike_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose texts look the same but aren't equal character for character.

    Classes of equal texts are paired, then expanded to their members, so exact copies are not compared with one another; the
    keys are 128-bit hashes of form and text. Null texts pair with nothing, nor do empty and blank ones: they show no text that
    could look like another."""
    form = consistent_form(df, id_col, text_col).where("form <> '' and id is not null")
    key = lambda c: F.concat_ws("-", F.xxhash64(c), F.xxhash64(F.concat(F.lit("#"), F.col(c))), F.length(c))
    d = cut(form.select("id", key("form").alias("form"), key("text").alias("txt")))
    classes = d.select("form", "txt").distinct()
    many = classes.groupBy("form").agg(F.count("*").alias("c")).where("c > 1").select("form")
    classes = classes.join(many, "form", "left_semi")
    members = d.join(many, "form", "left_semi")
    pairs = classes.join(classes.select("form", F.col("txt").alias("txt2")), "form").where("txt < txt2")
    a = pairs.join(members.select("form", "txt", F.col("id").alias("x")), ["form", "txt"])
    b = a.join(members.select("form", F.col("txt").alias("txt2"), F.col("id").alias("y")), ["form", "txt2"])
    return b.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a < id_b").distinct()
