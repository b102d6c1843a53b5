from playgraph.llm import looks
from tests.util import rows

SCHEMA = "doc_id long, text string"
BASE = "Peter and the Parade opened the set with a quiet song"


def pairs(spark, texts):
    return rows(looks.alike_pairs(spark.createDataFrame(list(enumerate(texts, 1)), SCHEMA), "doc_id", "text"))


def test_kinds_of_look_alikes(spark):
    same = [
        BASE,
        BASE.replace("Parade", "Раrade"),  # Cyrillic P and a
        BASE.replace("and", "ａｎｄ"),
        BASE.replace(" ", "\u00a0", 1),
        BASE.replace("quiet", "qu​iet"),
        BASE.replace("set", "‪set‬"),
    ]
    other = [BASE.replace("quiet", "Quiet"), BASE.replace("set", "sét"), BASE + " 2", BASE + " ²"]
    n = len(same)
    assert pairs(spark, same + other) == [(i, j) for i in range(1, n + 1) for j in range(i + 1, n + 1)]


def test_composition_ligatures_and_ellipsis(spark):
    assert pairs(spark, ["café", "café", "cafe", "ﬁnd…", "find..."]) == [(1, 2), (4, 5)]


def test_repair_needs_the_vocabulary_and_keeps_other_scripts(spark):
    df = spark.createDataFrame([(1, "Ферли sang"), (2, "Фeрли sang"), (3, "Zоzо is odd")], SCHEMA)  # Latin e; Cyrillic o's
    form = dict(rows(looks.consistent_form(df, "doc_id", "text"), "id", "form"))
    assert form == {1: "Ферли sang", 2: "Ферли sang", 3: "Zоzо is odd"}


def test_null_empty_blank_copies_and_long_texts(spark):
    long = "word " * 200_000 + "еnd"
    assert pairs(spark, [None, "", " ", BASE, BASE, None, "\u00a0", "\u200b"]) == []
    assert pairs(spark, [long, long.replace("еnd", "end")]) == [(1, 2)]
    assert rows(looks.alike_pairs(spark.createDataFrame([], SCHEMA), "doc_id", "text")) == []


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "x", 1), (2, "a\u00a0b", "y", 2)], "doc_id long, text string, base string, form int")
    assert rows(looks.alike_pairs(df, "doc_id", "text")) == [(1, 2)]
