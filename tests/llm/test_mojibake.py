from playgraph.llm import mojibake as mj

SCHEMA = "id long, src string, title string"


def garble(s, *steps):
    for codec in steps:
        s = "".join(next(k for k, v in mj._table(codec).items() if v == b) if b > 127 else chr(b) for b in s.encode("utf-8"))
    return s


def test_every_chain_is_undone():
    for steps in (["cp1252"], ["latin_1"], ["cp437"], ["mac_roman"], ["cp1251"], ["cp1252", "cp1252"], ["cp1252", "cp1252", "cp1252"]):
        assert "Déjà Corazón" in mj.invertible(garble("Déjà Corazón", *steps)).values(), steps
    assert "Ночной" in mj.invertible("Ночной".encode("cp1251").decode("cp1252")).values()
    assert mj.invertible("plain") == {} and mj.lossy_form("Né", "question_bytes") == "N??"


def detect(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    return {(r["entry_id"], r["field_name"]): r for r in mj.detect(df, "id", "src", ["title"]).collect()}


def corpus():
    words = ["Café", "Corazón", "Señal", "Fähre", "Don’t", "Ночной", "Straße", "Over", "Rain", "Stone", "Harbor", "Naïve"]
    return [(i, "a", f"{words[i % 12]} {words[(i * 7 + i // 12) % 12]} {i % 40 if i % 3 else ''}".strip()) for i in range(600)]


def test_planted_cases_come_out_with_their_text(spark):
    bad = {1001: (garble("Café Rain", "cp1252"), "Café Rain"), 1002: (garble("Corazón Stone", "cp1252", "cp1252"), "Corazón Stone"), 1003: ("Se?al Over", "Señal Over"), 1004: ("Harbor F�hre", "Harbor Fähre"), 1005: (garble("Ночной Rain", "cp1251"), "Ночной Rain")}
    fine = [(2001, "a", "Who Rain?"), (2002, "a", "Naïve Ångström"), (2003, "b", None), (2004, "b", ""), (2005, None, "Café Over"), (2006, "a", "IRMÃ")]
    got = detect(spark, corpus() + [(i, "a", g) for i, (g, _) in bad.items()] + fine)
    assert {k[0] for k in got} == set(bad)
    assert {i: got[i, "title"]["repaired"] for i in bad} == {i: t for i, (_, t) in bad.items()}


def test_empty_tables_long_values_repeats_and_null_ids(spark):
    assert detect(spark, []) == {}
    assert detect(spark, [(1, "a", "only plain text")]) == {}
    long = garble("Café ", "cp1252") * 20_000
    g = garble("Señal Rain", "cp1252")
    df = spark.createDataFrame(corpus() + [(1, "a", long), (2, "a", g), (2, "a", g), (None, "a", g)], SCHEMA)
    got = sorted((str(r["entry_id"]), r["repaired"][:10]) for r in mj.detect(df, "id", "src", ["title"]).collect())
    assert got == [("1", "Café Café "), ("2", "Señal Rain"), ("2", "Señal Rain"), ("None", "Señal Rain")]


def test_single_byte_misreadings_are_undone_in_order():
    for token in ("Ïðèâåò", "Ã©tÃ©", "naïve", "Señal‰", "ночь", "Œuvre"):
        high = frozenset(c for c in token if c > "\x7f")
        for latin in (False, True):
            want = []
            for read in mj.READ_AS:
                for written in mj.WRITTEN_AS:
                    known, change = mj._swap(read, written)
                    if read not in ("latin_1", written) and not (latin and written in mj.OTHER_SCRIPTS) and high <= known and token.translate(change) != token:
                        want.append((f"{written}>{read};", token.translate(change)))
            ways, chains = mj._swaps(high, latin)
            assert [(c, token.translate(ways[i])) for c, i in chains] == want
            assert len({token.translate(w) for w in ways}) == len(ways)


def test_tokens_that_readings_share_are_weighed_once():
    got = mj.tally(["Café Rain", "Over Stone"], [1.0, 1.0])
    p, c = got[got["t"] == "p"], got[got["t"] == "c"]
    m, asked = mj.CharModel(dict(zip(zip(p["a"], p["b"]), p["n"])), dict(zip(c["a"], c["n"]))), []
    own = m.word
    m.word = lambda whole, a, core, b: asked.append(core) or own(whole, a, core, b)
    texts, done = ["CafÃ© Rain", "Café Rain"], {}
    got = [mj.likelihood(mj.CLEAN, mj.word_parts(t), 0.0, m, {}, {}, 9.0, done) for t in texts]
    assert asked.count("Rain") == 1 and {"Café", "CafÃ"} < set(asked)
    assert got == [mj.likelihood(mj.CLEAN, mj.word_parts(t), 0.0, m, {}, {}, 9.0, {}) for t in texts]


def test_rows_with_plain_values_only_are_left_out_before_fields_become_rows(spark):
    df = spark.createDataFrame(corpus() + [(1001, "a", garble("Café Rain", "cp1252")), (1001, "b", garble("Café Rain", "cp1252")), (1002, "a", "")], SCHEMA)
    found = mj.detect(df, "id", "src", ["title"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and plan.rindex("octet_length") > plan.rindex("Generate")
    assert sorted((r["entry_id"], r["field_name"], r["repaired"]) for r in found.collect()) == [(1001, "title", "Café Rain")] * 2


def test_a_unit_counts_for_each_of_its_values():
    def of(n, uid):
        texts = ("CafÃ©", "Café")
        return (uid, [7, 8], n, True, (mj.CLEAN, "utf8>cp1252;"), texts, (True, True), (0.0, 0.0), [0.25, 0.75]), [mj.word_parts(t) for t in texts]

    one, each = mj.Sums(), mj.Sums()
    unit, parts = of(3.0, 1)
    one.add(unit, parts, [[0.25, 0.75]] * 2)
    for i in range(3):
        each.add(of(1.0, i)[0], parts, [[0.25, 0.75]] * 2)
    assert sorted(one.rows(), key=str) == sorted(each.rows(), key=str)
    assert one.words == {mj._hash("café"): 2.25} and one.chances[8, "utf8>cp1252;"] == 2.25
    rows = mj.packed(5, [unit], [], one, mj.Sums("!"))
    assert set(rows["pid"]) == {5} and set(rows.loc[rows["what"] == "at", "b"]) == {7, 8} and (rows["what"] == "state").sum() == 1


def test_texts_are_passed_over_only_where_nothing_can_be_undone():
    for text in ("Café", "CafÃ©", "cafã©", "Ð\x9dÐ¾Ñ‡ÑŒ", "ñ", "Ñ ", "Ôé", "├®", "√©", "naïve’s"):
        for codec in mj.READ_AS:
            plain, raised = mj._as_bytes(codec)
            read = text.translate(plain)
            up = text.translate(raised) if text == text.lower() else read
            either = "".join(u if "\xc2" <= u <= "\xdf" and not "\x80" <= r <= "\xbf" else r for u, r in zip(up, read))
            assert mj._pair(codec).search(text) or not (mj._UTF8.search(read) or mj._UTF8.search(either)), (text, codec)


def test_groups_do_not_change_what_is_found_and_tokens_go_back_where_they_stood(spark, monkeypatch):
    bad = {1001: (garble("Café", "cp1252") + "  Rain (" + garble("Señal", "cp1252") + ") Over", "Café  Rain (Señal) Over"), 1002: ("Over " + garble("Corazón", "cp1252"), "Over Corazón"), 1003: ("Rain " + garble("Corazón", "cp1252"), "Rain Corazón"), 1004: ("Se?al Over", "Señal Over")}
    data = corpus() + [(i, "a", g) for i, (g, _) in bad.items()] + [(1005, "b", bad[1002][0])]
    got = {k[0]: v for k, v in detect(spark, data).items()}
    assert {i: r["repaired"] for i, r in got.items()} == {i: t for i, (_, t) in bad.items()} | {1005: "Over Corazón"}
    monkeypatch.setattr(mj, "GROUP_UNITS", 3)
    many = {k[0]: v for k, v in detect(spark, data).items()}
    assert set(many) == set(got) and all(many[i]["chain"] == r["chain"] and abs(many[i]["posterior"] - r["posterior"]) < 1e-6 for i, r in got.items())
