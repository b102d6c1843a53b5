import pytest
from pyspark.sql import functions as F

from playgraph.functions import fuzzy
from playgraph.functions import text as tx
from playgraph.operators import resolver
from tests.util import rows

CODES = [(1, "Autechre"), (2, "The Beatles"), (3, "Duke Ellington & John Coltrane"), (4, "Various Artists"), (5, "Prince aka Camille"), (6, "Björk")]


def codes(spark):
    return spark.createDataFrame(CODES, "id long, presentation_name string")


def one(spark, value, f):
    df = spark.createDataFrame([(value,)], "c string")
    return df.select(f(F.col("c"))).first()[0]


@pytest.mark.parametrize("a,b,want", [("autechre", "auteurs", 0.868), ("martha", "marhta", 0.961), ("dixon", "dicksonx", 0.813), ("same", "same", 1.0), ("", "x", 0.0), ("abc", "xyz", 0.0)])
def test_jaro_winkler(a, b, want):
    assert round(fuzzy.jaro_winkler(a, b), 3) == want


def test_bounds_lose_nothing():
    import random

    r = random.Random(1)
    word = lambda: "".join(r.choice("abcde ") for _ in range(r.randrange(1, 12)))
    names = [word() for _ in range(300)]
    c = fuzzy.Candidates(names)
    for q in [word() for _ in range(60)]:
        for t in (0.82, 0.9):
            want = sorted(((n, fuzzy.jaro_winkler(q, n)) for n in set(names) if fuzzy.jaro_winkler(q, n) >= t), key=lambda x: (-x[1], x[0]))
            assert c.search(q, t, 99) == want


def test_resolver_tiers_in_order(spark):
    rel = spark.createDataFrame([(100, 1), (101, 4)], "id long, library_code_id long")
    data = [
        (1, "anything", 100, "t"), (2, " autechre ", 0, "t"), (3, "Beatles", 0, "t"), (4, "Duke Ellington and John Coltrane", None, "t"), (5, "Camille", 0, "t"), (6, "Autecher", 0, "t"),
        (7, "Various Artists", 101, "Deep Cut"), (8, "Somebody", 0, "t"), (9, None, 0, "t"), (10, "Outside", 0, "t"),
    ]
    e = spark.createDataFrame(data, "id long, artist_name string, library_release_id long, song_title string")
    credits = spark.createDataFrame([(101, "deep cut", "Nobody", 1), (101, "Deep Cut ", "autechre", 2)], "release_id long, track_title string, artist_name string, id long")
    ext = spark.createDataFrame([("outside", "Outside Act")], "name string, canonical string")
    got = {r["id"]: (r["canonical"], r["method"]) for r in resolver.resolve(e, rel, codes(spark), credits, ext).collect()}
    assert got == {
        1: ("Autechre", "catalog"), 2: ("Autechre", "exact"), 3: ("The Beatles", "normalized"), 4: ("Duke Ellington & John Coltrane", "normalized"), 5: ("Prince aka Camille", "normalized"),
        6: ("Autechre", "fuzzy"), 7: ("Autechre", "compilation_track"), 8: ("somebody", "raw"), 9: ("", "raw"), 10: ("Outside Act", "external"),
    }


def test_fuzzy_ambiguity_and_threshold(spark):
    c = spark.createDataFrame([(1, "abcdefgh1"), (2, "abcdefgh2")], "id long, presentation_name string")
    n = spark.createDataFrame([("abcdefgh3",), ("abcdefgh1x",), ("zzz",)], "name string")
    # 'abcdefgh3' is as near to both; 'abcdefgh1x' is clearly nearer to one
    assert rows(resolver.fuzzy_match(n, resolver.exact_index(c)), "name", "canonical") == [("abcdefgh1x", "abcdefgh1")]
    c = spark.createDataFrame([(1, "abcdefgh1")], "id long, presentation_name string")
    assert rows(resolver.fuzzy_match(n, resolver.exact_index(c)), "name", "canonical") == [("abcdefgh1x", "abcdefgh1"), ("abcdefgh3", "abcdefgh1")]


def test_relaxed_pass_needs_plays(spark):
    d = spark.createDataFrame([("autechra x", "raw")] * 3 + [("autecxxa", "raw"), ("Autechre", "exact")], "canonical string, method string")
    got = rows(resolver.re_resolve(d, codes(spark), 3))
    assert got.count(("Autechre", "fuzzy_relaxed")) == 3 and ("autecxxa", "raw") in got


def test_archive_matcher(spark):
    n = spark.createDataFrame([("AUTECHRE",), ("the beatles",), ("Autechre / Björk",), ("V/A",), ("nobody",)], "name string")
    assert rows(resolver.archive_match(n, codes(spark))) == [("AUTECHRE", "Autechre"), ("Autechre / Björk", "Autechre"), ("Autechre / Björk", "Björk"), ("the beatles", "The Beatles")]


def test_index_rules(spark):
    c = spark.createDataFrame([(2, "abba"), (1, "ABBA"), (3, "X & Y"), (4, "X and Y")], "id long, presentation_name string")
    assert dict(rows(resolver.exact_index(c)))["abba"] == "ABBA"
    assert "x and y" not in dict(rows(resolver.form_index(c)))


@pytest.mark.parametrize("raw,want", [("The  Beatles", "beatles"), ("X & B", "x and b"), ("A & B", "and b"), ("(Sandy) Alex", "(sandy) alex"), ("[Unknown]", "unknown"), ("Ｆｕｌｌ", "full"), ("The", "the"), ("", ""), (None, None)])
def test_identity_form(spark, raw, want):
    assert one(spark, raw, tx.normalize_identity) == want


@pytest.mark.parametrize("raw,want", [("Björk", "bjork"), ("ΣΊΣΥΦΟΣ", "σισυφοσ"), ("a​b", "ab"), ("Straße", "strasse"), (None, None)])
def test_match_form(spark, raw, want):
    assert one(spark, raw, tx.match_form) == want


@pytest.mark.parametrize("w,want", [("ambient", "ambien"), ("ambience", "ambien"), ("stories", "stor"), ("sing", "sing"), ("as", "as"), ("playing", "play"), ("cats", "cat")])
def test_stem(spark, w, want):
    assert one(spark, w, tx.stem) == want


def test_token_score(spark):
    df = spark.createDataFrame([("The ambience is warm jazz", "ambient jazz"), ("the and of", "x"), ("wholly made up", "")], "t string, s string")
    assert [r[0] for r in df.select(F.round(tx.token_match_score(F.col("t"), F.col("s")), 4)).collect()] == [0.3333, 0.0, 1.0]


def test_small_text_functions(spark):
    assert one(spark, "Café", lambda c: tx.repair_latin1(c)) is None
    assert one(spark, "CafÃ©", lambda c: tx.repair_latin1(c)) == "Café"
    assert one(spark, "plain", lambda c: tx.repair_latin1(c)) is None
    assert one(spark, "I like Artist A and Artist AB", lambda c: tx.restore_aliases(c, {"Artist A": "Tina $1"})) == "I like Tina $1 and Artist AB"
    assert one(spark, "COUNTS: 12g 3u", lambda c: F.struct(*tx.claim_counts(c))) == (12, 3)
    assert one(spark, "G: a\nU: b\n G: c", lambda c: F.struct(*tx.claim_counts(c))) == (2, 1)
    assert one(spark, ' &quot;Rock\\Roll&quot; &amp; "x" ', tx.decode_and_strip) == "RockRoll & x"
    assert one(spark, "Not-Wrong ", tx.label_form) == "not_wrong"
    assert one(spark, "The A Band & Someone Else", lambda c: F.array_sort(tx.name_variants(c))) == ["a band", "a band & someone else", "someone else", "the a band", "the a band & someone else"]
    assert one(spark, "short", tx.is_refusal) is True
    assert one(spark, " Unknown ", tx.real_name) is False
    assert one(spark, "100% x_y", lambda c: tx.contains_ci(c, "% X_")) is True
    assert one(spark, "V/A", tx.is_compilation) and not one(spark, "Vague", tx.is_compilation)


def test_markup():
    f = tx.markup_to_html
    assert f("[b]x & y[/b] [l=Warp] [zzz]") == "<b>x &amp; y</b> Warp "
    assert f("[a=Prince (2)]") == '<a href="https://www.discogs.com/search/?q=Prince (2)&type=artist" target="_blank" rel="noopener">Prince</a>'
    assert f("[url=http://x]go[/url]").endswith(">go</a>")
    assert f("open [b only") == "open [b only"


def test_main_text(spark):
    h = "<html><nav>menu</nav><p>One &amp; two</p><script>x()</script><p>three</p></html>"
    assert one(spark, h, tx.main_text) == "One & two\nthree"


def test_times(spark):
    assert tx.seconds_to_hour(0, 1) == 3600 and tx.seconds_to_hour(3600, 1) == 86400
    df = spark.sql("select timestamp'2020-03-14 19:20:30.5' t, timestamp_millis(0) z, 1584213630500L ms")
    r = df.select(tx.hour_key(F.col("t")), tx.offset_in_hour(F.col("t")), tx.epoch_to_timestamp(F.col("ms"), "ms") == F.col("t")).first()
    assert tuple(r) == ("2020/03/14/202003141900.mp3", 1230.5, True)


def test_registered_queries_take_all_names_and_rows(spark, tmp_path):
    from playgraph.plans.registry import QUERIES

    at = str(tmp_path)
    e = [(20, "Bjork Gudmundsdottír", 1, 7, 1), (40, "Various Ärtists", 1, 7, 3), (60, "V/A – Été", 1, 7, 9)]
    spark.createDataFrame(e, "id long, artist_name string, entry_type_code int, show_id long, sequence long").write.parquet(f"{at}/flowsheet_entry.parquet")
    spark.createDataFrame([(1, "Björk Gudmundsdottír"), (4, "Zürcher Quartett")], "id long, presentation_name string").write.parquet(f"{at}/library_code.parquet")
    spark.createDataFrame([(1, "\u00a0".join(["word"] * 40)), (2, "We heard one two three four five six tonight.")], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(9, "One Two Three Four Five Six")], "id long, canonical_name string").write.parquet(f"{at}/artist.parquet")
    q = lambda n, *c: rows(QUERIES[n](spark, at), *c)
    assert ("V/A – Été",) in q("compilation_names")
    assert q("jaro_winkler_pairs", "a", "b") == [(1, 4)]
    assert q("refusals") == [(1, False), (2, True)]
    assert q("text_coverage") == [(9, 1)]
    # sequences 1 and 3 lie 360,000 ms apart, 3 and 9 further: windows of 100,000 either way don't meet
    assert len(q("window_merge")) == len({s for *_, s in e})
    assert q("fuzzy_resolve", "name") == [("bjork gudmundsdottír",)]
