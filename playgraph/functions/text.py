"""Text functions. Whatever Spark's expressions can say stays in the JVM; the rest are Arrow-batched UDFs."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Separators at which a joint name splits.
NAME_SEPARATORS = r", | / |/| \+ "
#: Ways to write that a release has no single artist.
COMPILATION_PATTERN = r"(?i)^\s*(various(\s+artists?)?|v\s*/\s*a|v\.\s*a\.?|va|soundtracks?|compilations?)\b"
#: Suffixes in the order they are tried.
SUFFIXES = ["ies", "ing", "ed", "es", "ce", "cy", "ly", "s", "y", "t", "e"]
#: Words that need no grounding.
ALLOWED_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "been", "by", "for", "from", "has", "have", "in", "into", "is", "it", "its", "of", "on", "or", "that",
    "the", "their", "these", "this", "those", "to", "was", "were", "with", "across", "alongside", "also", "appear", "appears", "both", "common",
    "djs", "frequently", "neighbor", "neighbors", "next", "occasionally", "often", "pair", "pairs", "place", "places", "play", "plays", "share",
    "shared", "shares", "show", "shows", "tag", "together", "transition", "transitions", "uncommon", "library", "flowsheet", "flowsheets", "between",
    "though", "while",
]
#: Placeholders that stand for no name.
PLACEHOLDERS = ["unknown", "various", "various artists", "v/a", "v.a.", "n/a", "none", ""]
#: Signs that a generated text declines to answer.
REFUSALS = ["unable to", "cannot write", "i cannot", "input data lacks", "insufficient data", "not enough information", "no clear connection", "i'm sorry"]
MIN_WORDS = 30


def tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def key_form(c: Column) -> Column:
    """JN-02: the exact key: trimmed, lower case."""
    return F.lower(F.trim(c))


def _identity(s: str | None) -> str | None:
    if s is None:
        return None
    t = unicodedata.normalize("NFKC", s).lower().replace(" & ", " and ")
    t = re.sub(r"\s+", " ", t).strip()
    if len(t) > 2 and (t[0], t[-1]) in (("(", ")"), ("[", "]")):
        t = t[1:-1].strip()
    return re.sub(r"\A(the|a) (?=.)", "", t)


@F.pandas_udf(StringType())
def normalize_identity(s: pd.Series) -> pd.Series:
    """STR-01: NFKC, lower case, ' & ' as ' and ', one enclosing bracket pair and a leading 'the ' or 'a ' off, blanks joined."""
    return s.map(_identity, na_action="ignore")


def _match(s: str) -> str:
    t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", s)).casefold().replace("ς", "σ")
    t = "".join(c for c in t if c == "‍" or not (unicodedata.combining(c) or unicodedata.category(c) == "Cf"))
    return re.sub(r"\s+", " ", t).strip()


@F.pandas_udf(StringType())
def match_form(s: pd.Series) -> pd.Series:
    """STR-02: compatibility decomposition, case folded, combining marks and format characters (but the joiner) off."""
    return s.map(_match, na_action="ignore")


def split_names(c: Column) -> Column:
    """STR-04: the parts of a joint name; a name with one part gives an empty array."""
    parts = F.filter(F.transform(F.split(c, NAME_SEPARATORS), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(ArrayType(StringType()))
def _identities(s: pd.Series) -> pd.Series:
    return s.map(lambda parts: None if parts is None else [_identity(x) for x in parts])


def normalized_forms(name: Column) -> Column:
    """STR-03: the identity forms of a name, of its parts and of the sides of ' aka ', each normalised by itself, each once; a
    form that comes out blank is none."""
    none = F.array().cast("array<string>")
    aka = F.when(F.lower(F.trim(name)).contains(" aka "), F.split(F.lower(F.trim(name)), " aka ")).otherwise(none)
    forms = _identities(F.concat(F.array(name), split_names(name), aka))
    return F.array_distinct(F.filter(forms, lambda x: F.coalesce(x != "", F.lit(False))))


def is_compilation(c: Column) -> Column:
    """STR-05."""
    return F.coalesce(c.rlike(COMPILATION_PATTERN), F.lit(False))


@F.pandas_udf(StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def decode_and_strip(c: Column) -> Column:
    """STR-06: HTML entities decoded, quotes and backslashes dropped, trimmed."""
    return F.trim(F.translate(html_unescape(c), "\"'\\", ""))


def repair_latin1(c: Column) -> Column:
    """STR-08: UTF-8 read as Latin-1, read rightly; null where it can't be or nothing changes. All in the JVM: the text must go
    into Latin-1 without loss, and the bytes be valid UTF-8."""
    fits = ~c.rlike("[^\\u0000-\\u00ff]") & c.rlike("[\\u0080-\\u00ff]")
    raw = F.encode(F.when(fits, c), "ISO-8859-1")
    ok = F.is_valid_utf8(raw.cast("string"))
    fixed = F.when(ok, F.decode(F.when(ok, raw), "UTF-8"))
    return F.when((fixed != c) & ~fixed.contains("�"), fixed)


def has_latin1_supplement(c: Column) -> Column:
    """STR-09."""
    return c.rlike("[\\u0080-\\u00ff]")


def looks_lossy(c: Column) -> Column:
    """STR-09: a question mark beside Latin-1 letters."""
    return c.contains("?") & has_latin1_supplement(c)


def stem(c: Column) -> Column:
    """STR-10: the first suffix that fits goes, if two letters and more remain besides one."""
    out = F.lit(None).cast("string")
    for s in reversed(SUFFIXES):
        out = F.when(c.endswith(s) & (F.length(c) > len(s) + 2), F.lit(s)).otherwise(out)
    return F.when(out.isNull(), c).otherwise(F.left(c, F.length(c) - F.length(out)))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1))


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once a row, however often the lambdas in ``f`` use it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def token_match_score(text: Column, source: Column, allowed: list[str] | None = None) -> Column:
    """STR-11: share of the text's content words whose stem is no stem of the source; 0 without content words."""
    skip = F.array(*[F.lit(w) for w in (allowed if allowed is not None else ALLOWED_WORDS)])
    content = F.filter(words(text), lambda w: ~F.array_contains(skip, w))
    n = F.size(content)
    missing = _let(F.transform(words(source), stem), lambda stems: F.size(F.filter(content, lambda w: ~F.array_contains(stems, stem(w)))))
    return F.when(n > 0, missing / n).otherwise(0.0)


def restore_aliases(c: Column, names: dict[str, str]) -> Column:
    """STR-12: each alias, as a whole word, becomes the real name."""
    return reduce(lambda x, kv: F.regexp_replace(x, rf"\b{re.escape(kv[0])}\b", kv[1].replace("\\", "\\\\").replace("$", "\\$")), names.items(), c)


def claim_counts(c: Column) -> tuple[Column, Column]:
    """STR-13: (grounded, ungrounded) of a 'COUNTS: Xg Yu' line, else the number of lines that begin with G: or U:."""
    line = F.regexp_extract(F.upper(c), r"(?m)^\s*(COUNTS:.*)$", 1)

    def one(mark: str) -> Column:
        found = F.regexp_extract(line, rf"(\d+)\s*{mark}", 1)
        lines = F.regexp_count(c, F.lit(rf"(?m)^\s*{mark}[:|]"))
        return F.when(line != "", F.coalesce(F.when(found != "", found.cast("int")), F.lit(0))).otherwise(lines)

    return one("G"), one("U")


def html_escape(c: Column) -> Column:
    """STR-15."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


_MARKUP = re.compile(r"\[([^\]]*)\]")
_SIMPLE = ("b", "i", "u")


def markup_to_html(text: str) -> str:
    """STR-14 for one text: a scanner over bracket tags; names link to a search, b, i, u and url become elements, labels plain
    text, unknown tags and bare references vanish."""
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    link = lambda to, show: f'<a href="{to}" target="_blank" rel="noopener">{show}</a>'
    base = "https://www.discogs.com"
    out, at = [], 0
    while at < len(text):
        m = _MARKUP.search(text, at)
        if not m:
            out.append(esc(text[at:]))
            break
        out.append(esc(text[at : m.start()]))
        tag, at = m[1], m.end()
        kind, _, arg = tag.partition("=")
        if tag in _SIMPLE or (kind == "url" and arg):
            end = text.find(f"[/{kind}]", at)
            if end >= 0:
                inner, at = esc(text[at:end]), end + len(kind) + 3
                out.append(link(esc(arg), inner) if kind == "url" else f"<{tag}>{inner}</{tag}>")
            elif kind == "url":
                out.append(esc(text[at:]))
                break
        elif kind == "a" and arg:
            out.append(link(f"{base}/search/?q={esc(arg)}&type=artist", esc(re.sub(r" \(\d+\)$", "", arg))))
        elif kind == "l" and arg:
            out.append(esc(arg))
        elif re.fullmatch(r"r=?\d+", tag):
            out.append(link(f"{base}/release/{tag.lstrip('r=')}", "[release]"))
        elif re.fullmatch(r"m=?\d+", tag):
            out.append(link(f"{base}/master/{tag.lstrip('m=')}", "[master]"))
    return "".join(out)


@F.pandas_udf(StringType())
def markup_html(s: pd.Series) -> pd.Series:
    """STR-14."""
    return s.map(markup_to_html, na_action="ignore")


def is_refusal(c: Column, min_words: int = MIN_WORDS) -> Column:
    """STR-16: null, of fewer than ``min_words`` words, or holding a phrase of refusal."""
    t = F.lower(c)
    few = F.size(F.filter(F.split(t, r"(?U)[\s\x{1c}-\x{1f}]+"), lambda w: w != "")) < min_words
    return F.coalesce(few | t.rlike("|".join(map(re.escape, REFUSALS))), F.lit(True))


def label_form(c: Column) -> Column:
    """STR-17: trimmed, lower case, blanks and dashes as underscores."""
    return F.translate(F.lower(F.trim(c)), " -", "__")


#: Separators of joint names and generation suffixes.
VARIANT_SEPARATORS = [" / ", " & ", " and ", " + ", " with ", " vs. ", " vs "]
GENERATIONS = [", jr.", ", iii", ", ii"]


def name_variants(c: Column) -> Column:
    """STR-18: from a folded name: itself, without 'the ', its parts at seven separators (with and without 'the '), without
    generation suffixes; four letters at least."""
    n = F.trim(F.lower(c))
    bare = lambda x: F.regexp_replace(x, r"^the ", "")
    parts = F.array().cast("array<string>")
    for sep in VARIANT_SEPARATORS:
        piece = F.when(n.contains(sep), F.transform(F.split(n, re.escape(sep)), lambda x: F.trim(x))).otherwise(F.array().cast("array<string>"))
        parts = F.concat(parts, piece, F.transform(piece, bare))
    cut = F.transform(F.array(*[F.lit(g) for g in GENERATIONS]), lambda s: F.trim(F.replace(n, s, F.lit(""))))
    every = F.array_distinct(F.concat(F.array(n, bare(n)), parts, cut))
    return F.when(F.length(n) >= 4, F.filter(every, lambda x: F.length(x) >= 4)).otherwise(F.array().cast("array<string>"))


def real_name(c: Column) -> Column:
    """FLT-12: whether a value is no placeholder."""
    return F.coalesce(~F.lower(F.trim(c)).isin(PLACEHOLDERS), F.lit(False))


def contains_ci(c: Column, q: str) -> Column:
    """FLT-05: case-insensitive containment, wildcards of the query taken literally."""
    return c.ilike("%" + q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%")


def hour_key(ts: Column) -> Column:
    """DAT-02, SRC-15: the object key of a timestamp's hour."""
    return F.date_format(ts, "yyyy/MM/dd/yyyyMMddHH'00.mp3'")


def offset_in_hour(ts: Column) -> Column:
    """DAT-02: seconds from the hour, clamped to 0..3600."""
    s = F.unix_micros(ts) / F.lit(1e6) - F.unix_timestamp(F.date_trunc("hour", ts))
    return F.greatest(F.lit(0.0), F.least(s.cast("double"), F.lit(3600.0)))


def month_or_zero(ts: Column) -> Column:
    """DAT-01: month, 0 without a time."""
    return F.coalesce(F.month(ts), F.lit(0))


def epoch_to_timestamp(c: Column, unit: str) -> Column:
    """Times given as epoch 's' or 'ms', 0 and less as null."""
    return F.when(c > 0, F.timestamp_millis(c) if unit == "ms" else F.timestamp_seconds(c))


def fame_band(plays: Column, low: tuple[int, int] = (100, 400), high: int = 800) -> Column:
    """CND-02, FLT-07: HIGH above ``high`` plays, LOW within ``low`` (ends included), null in between and below."""
    return F.when(plays > high, "HIGH").when(plays.between(*low), "LOW")


def richness(styles: Column, has_audio: Column, least: int = 3) -> Column:
    """CND-02: RICH with at least ``least`` styles and a sound profile, else THIN."""
    return F.when((styles >= least) & has_audio, "RICH").otherwise("THIN")


def regime(fame_a: Column, rich_a: Column, fame_b: Column, rich_b: Column) -> Column:
    """CND-02: the cell 'fame-richness' two nodes share, null where they differ or one has no band."""
    return F.when((fame_a == fame_b) & (rich_a == rich_b), F.concat_ws("-", fame_a, rich_a))


def month_name(month: Column) -> Column:
    """DAT-03: January to December for 1 to 12, '' for 0, null for anything else."""
    return F.when(month == 0, "").when(month.between(1, 12), F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMMM"))


def parse_array(c: Column) -> Column:
    """JSN-01: a JSON array of strings where the text begins with '[', else null; broken JSON is null."""
    return F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>"))


def array_weight(c: Column) -> Column:
    """JSN-02: the length of a JSON array as a weight, 0 where it is none."""
    return F.coalesce(F.json_array_length(c), F.lit(0))


def first_of(*sources: tuple[str, Column]) -> tuple[Column, Column]:
    """CND-04: (value, name of its source) of the first source that has a non-blank value."""
    kept = [(n, F.when(F.trim(c) != "", c)) for n, c in sources]
    named = [F.when(c.isNotNull(), F.lit(n)) for n, c in kept]
    return F.coalesce(*[c for _, c in kept]), F.coalesce(*named)


def first_seen(c: Column) -> Column:
    """SET-05: the distinct elements of an array in the order in which they first appear."""
    return F.array_distinct(c)


def no_compilation(name: Column) -> Column:
    """FLT-08: names that are no collective or unknown ones, by NOT LIKE."""
    return ~name.like("Various%") & ~name.like("V/A%") & ~name.like("%Soundtrack%") & (F.lower(name) != "unknown")


def within(ts: Column, start, end) -> Column:
    """FLT-10: a time in the half-open range [start, end); a null time is in none."""
    return F.coalesce((ts >= F.lit(start)) & (ts < F.lit(end)), F.lit(False))


def seconds_to_hour(now_epoch: int, hour: int) -> int:
    """DAT-04: seconds from an epoch time to the next full ``hour`` of the day (UTC), a day if it is that hour just now."""
    into = now_epoch % 86400
    return (hour * 3600 - into - 1) % 86400 + 1


@F.pandas_udf(StringType())
def main_text(s: pd.Series) -> pd.Series:
    """SRC-18: the readable text of an HTML page: scripts, styles and navigation off, tags off, entities decoded."""
    drop = re.compile(r"(?is)<(script|style|nav|header|footer|aside|noscript)\b.*?</\1\s*>|<!--.*?-->")
    block = re.compile(r"(?i)</?(p|div|br|li|h[1-6]|article|section|tr)\b[^>]*>")

    def one(h: str) -> str:
        t = re.sub(r"<[^>]+>", "", block.sub("\n", drop.sub(" ", h)))
        return re.sub(r"\s*\n\s*", "\n", re.sub(r"[ \t]+", " ", html.unescape(t))).strip()

    return s.map(one, na_action="ignore")


#: Weights of claim types; others weigh 1.
CLAIM_WEIGHTS = {"ARTIST": 3.0, "NEIGHBOR": 1.0, "CONTEXT": 1.0, "INTENT": 1.0, "STRUCTURE": 2.0}


def weighted_claims(c: Column) -> Column:
    """EXP-06: of the lines 'G|TYPE:' and 'U|TYPE:' the ungrounded share by weight of their types; 0 without such lines."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda s: s.rlike(r"^[GU]\|\w+:"))
    table = F.create_map(*[F.lit(x) for kv in CLAIM_WEIGHTS.items() for x in kv])
    weigh = lambda s: F.coalesce(F.try_element_at(table, F.regexp_extract(s, r"^[GU]\|(\w+):", 1)), F.lit(1.0))
    add = lambda xs: F.aggregate(F.transform(xs, weigh), F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.try_divide(add(F.filter(lines, lambda s: s.startswith("U"))), add(lines)), F.lit(0.0))


#: Words too common to need grounding by terms.
STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "that", "this", "these",
    "those", "it", "its", "they", "them", "their", "both", "each", "all", "any", "some", "no", "not", "more", "most", "other", "into", "over",
    "such", "than", "too", "very", "just", "also", "about", "up", "out", "so", "if", "when", "where", "how", "what", "which", "who", "whom", "while",
    "as", "yet", "between", "through", "during", "before", "after", "above", "below", "here", "there", "then", "once", "again", "further", "same",
    "own", "s", "t", "re", "ve", "ll", "d", "one", "two", "three", "near", "set", "sets", "music", "artists", "artist", "appear", "alongside",
    "station", "radio", "plays", "work", "genre", "shared",
]
#: Words of description that need no grounding.
PROSE_WORDS = [
    "textures", "texture", "textural", "soundscapes", "soundscape", "landscapes", "atmospherics", "atmospheric", "ambience", "arrangements",
    "arrangement", "sensibilities", "sensibility", "aesthetics", "aesthetic", "grooves", "groove", "rhythmic", "rhythms", "rhythm", "melodic",
    "melodies", "melody", "harmonic", "harmonies", "harmony", "sonic", "sonically", "layered", "layers", "layer", "driven", "rooted", "infused",
    "inflected", "oriented", "leaning", "tinged", "informed", "influenced", "blending", "blend", "blends", "channels", "channel", "crafts", "craft",
    "delivers", "explores", "exploring", "spans", "spanning", "pursues", "fusing", "fusion", "merging", "combines", "combining", "moderate",
    "moderately", "restrained", "higher", "lower", "similarly", "notably", "prominent", "subtle", "heavy", "light", "dense", "sparse", "propulsive",
    "subdued", "energetic", "contemplative", "meditative", "frameworks", "framework", "foundation", "foundations", "tradition", "traditions",
    "traditional", "approach", "approaches", "elements", "characteristics", "qualities", "components", "complementary", "contrasting", "distinct",
    "overlapping", "parallel", "different", "similar", "comparable", "shared", "common", "programming", "rotation", "transitions", "transition",
    "sets", "freeform", "dj", "djs", "vocal-driven", "voice", "singer", "vocals", "vocal", "production", "producer", "produced",
]
#: A term of the data and the words that rephrase it.
STEM_WORDS = {
    "ambient": ["ambience", "atmospheric", "atmospherics", "atmosphere"],
    "acoustic": ["acoustics", "unplugged"],
    "experimental": ["experimentation", "experiments", "experimenting"],
    "electronic": ["electronics", "electro-acoustic"],
    "instrumental": ["instrument", "instruments", "instrumentation"],
    "alternative": ["alt", "alternative"],
    "psychedelic": ["psychedelia", "psych"],
    "folk": ["folk-inflected", "folksy"],
    "jazz": ["jazzy", "jazz-inflected", "jazz-informed"],
    "blues": ["bluesy", "blues-inflected"],
    "punk": ["punky", "punk-inflected"],
    "funk": ["funky", "funk-inflected"],
    "soul": ["soulful", "soul-inflected"],
    "rock": ["rock-oriented", "rocking"],
    "pop": ["poppy", "pop-oriented"],
    "dance": ["danceable", "dance-oriented"],
    "noise": ["noisy", "noise-inflected"],
    "drone": ["droning", "drone-based"],
    "disco": ["disco-inflected", "discotheque"],
    "dub": ["dubby", "dub-inflected"],
    "minimal": ["minimalist", "minimalism"],
    "abstract": ["abstraction", "abstractionist"],
    "avantgarde": ["avant-garde", "avant"],
    "downtempo": ["down-tempo", "slow-tempo"],
    "lo-fi": ["lofi", "lo-fi"],
    "vocal": ["vocal-driven", "vocals", "voice", "singer", "singing"],
}


def _holds(stem: Column):
    return lambda t: t.contains(stem) | stem.contains(t)


def term_score(text: Column, terms: Column, expansions: dict[str, list[str]] | None = None, allowed: list[str] | None = None, station: list[str] | None = None) -> Column:
    """EXP-07: share of the text's content words (longer than two letters, no stop words) that are not among the terms; a term
    that holds a stem of ``expansions``, or stands in it, brings that stem's words along, ``allowed`` words always count, and the words of
    the ``station``'s own name are stop words too."""
    own = F.transform(terms, lambda t: F.lower(t))
    rows = [F.struct(F.lit(s).alias("stem"), F.array(*[F.lit(m) for m in more]).alias("words")) for s, more in (expansions or {}).items()]
    fixed = F.array(*[F.lit(a) for a in allowed]) if allowed else F.array().cast("array<string>")
    more = F.flatten(F.transform(F.filter(F.array(*rows), lambda e: F.exists(own, _holds(e["stem"]))), lambda e: e["words"])) if rows else F.array().cast("array<string>")
    stop = F.array(*[F.lit(w) for w in [*STOP_WORDS, *(station or [])]])
    content = F.filter(F.split(F.regexp_replace(F.lower(text), r"(?U)[^\w\s-]", " "), r"\s+"), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    n = F.size(content)
    lacking = _let(F.concat(own, more, fixed), lambda known: F.size(F.filter(content, lambda w: ~F.array_contains(known, w))))
    return F.when(n > 0, lacking / n).otherwise(0.0)
