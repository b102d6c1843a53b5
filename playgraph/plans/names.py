"""Queries over names and texts: resolution tiers, text functions, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playgraph.catalog import table
from playgraph.functions import text as tx
from playgraph.functions.fuzzy import jaro_winkler_udf
from playgraph.operators import resolver, stats
from playgraph.plans.registry import query


def music(spark, d) -> DataFrame:
    return table(spark, d, "flowsheet_entry").where("entry_type_code < 7")


def codes(spark, d) -> DataFrame:
    return table(spark, d, "library_code").select("id", "presentation_name")


def releases(spark, d) -> DataFrame:
    return table(spark, d, "library_release")


@query("fk_chain_resolve", "select f.id, c.presentation_name as fk_name from flowsheet_entry f left join library_release r on f.library_release_id = r.id left join library_code c on c.id = r.library_code_id where entry_type_code < 7")
def fk_chain_resolve(spark, d):
    return resolver.fk_chain(music(spark, d), releases(spark, d), codes(spark, d)).select("id", "fk_name")


EXACT_SQL = "x as (select lower(trim(presentation_name, ' ')) as key, arg_min(presentation_name, id) as canonical from library_code where presentation_name is not null group by 1)"


@query("exact_resolve", f"with {EXACT_SQL} select f.id, canonical from flowsheet_entry f join x on x.key = lower(trim(artist_name, ' ')) where entry_type_code < 7")
def exact_resolve(spark, d):
    e = music(spark, d).withColumn("key", tx.key_form(F.col("artist_name")))
    return e.join(resolver.exact_index(codes(spark, d)), "key").select("id", "canonical")


NORM_MACRO = "regexp_replace(regexp_replace(replace(lower(nfc_normalize({c})), ' & ', ' and '), '\\s+', ' ', 'g'), '^(the|a) (.)', '\\2')"


@query("normalized_resolve")
def normalized_resolve(spark, d):
    names = music(spark, d).select(F.col("artist_name").alias("name")).distinct()
    n = names.withColumn("form", tx.normalize_identity(tx.key_form(F.col("name"))))
    return n.join(resolver.form_index(codes(spark, d)), "form").select("name", "canonical")


@query("fuzzy_resolve")
def fuzzy_resolve(spark, d):
    """A search: the queries are the names of entries whose id is divisible by 20, against the whole catalogue. Letters are
    compared, which SQL engines that compare bytes cannot state; tested against brute force."""
    idx = resolver.exact_index(codes(spark, d))
    n = music(spark, d).where("id % 20 = 0").select(tx.key_form(F.col("artist_name")).alias("name")).where("name <> ''").distinct()
    n = n.join(idx.select(F.col("key").alias("name")), "name", "left_anti")
    return resolver.fuzzy_match(n, idx).withColumn("score", F.round("score", 6))


@query("unambiguous_map", "select presentation_name, min(id) as id from library_code where presentation_name is not null group by 1 having count(*) = 1")
def unambiguous_map(spark, d):
    return stats.unambiguous(table(spark, d, "library_code"), "presentation_name", "id")


@query("unambiguous_discogs", "select discogs_artist_id, min(id) as id from artist where discogs_artist_id is not null group by 1 having count(*) = 1")
def unambiguous_discogs(spark, d):
    return stats.unambiguous(table(spark, d, "artist"), "discogs_artist_id", "id")


@query("duplicate_groups", "select discogs_artist_id, count(*) as n, string_agg(id::varchar, '|' order by id) as ids from artist where discogs_artist_id is not null group by 1 having count(*) > 1")
def duplicate_groups(spark, d):
    g = stats.duplicate_groups(table(spark, d, "artist"), "discogs_artist_id", "id")
    return g.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), "|"))


@query("composite_credit", "select library_release_id as release_id, lower(trim(song_title, ' ')) as title, arg_max(artist_name, id) as credit from flowsheet_entry where library_release_id > 0 and song_title is not null and artist_name is not null and entry_type_code < 7 group by 1, 2")
def composite_credit(spark, d):
    e = music(spark, d).where("library_release_id > 0 and song_title is not null and artist_name is not null")
    return resolver.composite_index(e.select(F.col("library_release_id").alias("release_id"), F.col("song_title").alias("track_title"), "artist_name", "id"))


def resolved(spark, d) -> DataFrame:
    credits = music(spark, d).where("library_release_id > 0 and song_title is not null and artist_name is not null").select(F.col("library_release_id").alias("release_id"), F.col("song_title").alias("track_title"), "artist_name", "id")
    ext = table(spark, d, "artist").where("wxyc_library_code_id is null").select(tx.key_form(F.col("canonical_name")).alias("name"), F.col("canonical_name").alias("canonical")).groupBy("name").agg(F.min("canonical").alias("canonical"))
    return resolver.resolve(music(spark, d), releases(spark, d), codes(spark, d), credits, ext)


@query("resolver")
def resolve(spark, d):
    return resolved(spark, d).select("id", "canonical", "method")


@query("resolver_methods")
def resolver_methods(spark, d):
    return stats.method_histogram(resolved(spark, d), "method")


@query("relaxed_resolve")
def relaxed_resolve(spark, d):
    r = resolver.re_resolve(resolver.resolve(music(spark, d), releases(spark, d), codes(spark, d), fuzzy=False), codes(spark, d), 3)
    return r.groupBy("method").agg(F.count("*").alias("n"), F.countDistinct("canonical").alias("names"))


@query("archive_match")
def archive_match(spark, d):
    a = table(spark, d, "segment_features").where("artist_name is not null").select(F.col("artist_name").alias("name")).distinct()
    return resolver.archive_match(a, codes(spark, d))


@query(
    "jaro_winkler_pairs",
    """with recursive p as (select a.id as a, b.id as b, lower(a.presentation_name) as x, lower(b.presentation_name) as y from library_code a join library_code b on b.id = a.id + 3),
q as (select a, b, string_split(x, '') as x, string_split(y, '') as y, greatest(0, greatest(length(x), length(y)) // 2 - 1) as w from p),
m as (select a, b, x, y, w, 0 as i, [0] as used, cast([] as varchar[]) as hit from q
  union all
  select a, b, x, y, w, i + 1, case when j is null then used else list_append(used, j) end, case when j is null then hit else list_append(hit, x[i + 1]) end
  from (select *, list_filter(range(greatest(1, i + 1 - w), least(len(y), i + 1 + w) + 1), lambda k: y[k] = x[i + 1] and not list_contains(used, k))[1] as j from m where i < len(x))),
d as (select a, b, x, y, hit, list_transform(list_sort(used[2:]), lambda k: y[k]) as other from m where i = len(x)),
s as (select a, b, x, y, len(hit)::double as n, len(list_filter(range(1, len(hit) + 1), lambda k: hit[k] <> other[k])) // 2 as t from d),
z as (select a, b, x, y, case when n = 0 then 0.0 else (n / len(x) + n / len(y) + (n - t) / n) / 3 end as j from s),
c as (select a, b, j, len(list_filter([1, 2, 3, 4], lambda k: k <= least(len(x), len(y)) and x[1:k] = y[1:k])) as pre from z)
select a, b, round(case when j > 0.7 then j + 0.1 * pre * (1 - j) else j end, 6) as score from c""",
)
def jaro_winkler_pairs(spark, d):
    c = codes(spark, d).where("presentation_name is not null")
    a, b = c.select(F.col("id").alias("a"), F.lower("presentation_name").alias("x")), c.select(F.col("id").alias("b"), F.lower("presentation_name").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 3).select("a", "b", F.round(jaro_winkler_udf("x", "y"), 6).alias("score"))


@query("compilation_names", "select distinct artist_name from flowsheet_entry where regexp_matches(artist_name, '(?i)^\\s*(various(\\s+artists?)?|v\\s*/\\s*a|v\\.\\s*a\\.?|va|soundtracks?|compilations?)\\b')")
def compilation_names(spark, d):
    return table(spark, d, "flowsheet_entry").where(tx.is_compilation(F.col("artist_name"))).select("artist_name").distinct()


@query("split_names", "select id, string_agg(trim(p, ' '), '|' order by k) as parts from (select id, unnest(string_split_regex(presentation_name, ', | / |/| \\+ ')) as p, generate_subscripts(string_split_regex(presentation_name, ', | / |/| \\+ '), 1) as k from (select id, artist_name as presentation_name from flowsheet_entry)) where trim(p, ' ') <> '' group by 1 having count(*) > 1")
def split_names(spark, d):
    e = table(spark, d, "flowsheet_entry").select("id", tx.split_names(F.col("artist_name")).alias("p")).where("size(p) > 1")
    return e.select("id", F.array_join("p", "|").alias("parts"))


@query("search_prefix", "select id, canonical_name, total_plays, row_number() over (order by (canonical_name ilike 'The %')::int desc, total_plays desc, id)::int as rank from artist where canonical_name ilike '%the %' order by rank limit 50")
def search_prefix(spark, d):
    from playgraph.plans.surface_ops import search

    return search(table(spark, d, "artist"), "the ", 50)


#: UTF-8 read as Latin-1, read rightly, null where it can't be or changes nothing.
FIXED_SQL = "case when regexp_full_match({c}, '(?s)[\\x{{0}}-\\x{{ff}}]*') and regexp_matches({c}, '[\\x{{80}}-\\x{{ff}}]') then try(decode(unhex(array_to_string(list_transform(string_split({c}, ''), lambda ch: printf('%02x', unicode(ch))), '')))) end"
SCANNED_SQL = "v as (select 'canonical_name' as field, canonical_name as s from artist union all select 'artist_name', artist_name from flowsheet_entry union all select 'song_title', song_title from flowsheet_entry union all select 'release_title', release_title from flowsheet_entry)"


@query(
    "mojibake_scan",
    f"""with {SCANNED_SQL}, f as (select field, s, {FIXED_SQL.format(c="s")} is not null as fixable from v)
select field, count(*) as total, count(*) filter (fixable) as fixable, count(*) filter (not fixable and regexp_matches(s, '[\\x{{80}}-\\x{{ff}}]') and s like '%?%') as lossy from f group by 1""",
)
def mojibake_scan(spark, d):
    """AGG-23: of each name and text field the values in all, those that can be fixed, and of the others the lossy ones."""
    e = table(spark, d, "flowsheet_entry")
    every = table(spark, d, "artist").select(F.lit("canonical_name").alias("field"), F.col("canonical_name").alias("s"))
    for c in ("artist_name", "song_title", "release_title"):
        every = every.unionByName(e.select(F.lit(c).alias("field"), F.col(c).alias("s")))
    s = F.col("s")
    fixable = F.coalesce(tx.repair_latin1(s).isNotNull(), F.lit(False))
    count = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    return every.groupBy("field").agg(F.count("*").alias("total"), count(fixable).alias("fixable"), count(~fixable & tx.looks_lossy(s)).alias("lossy"))


@query("repaired_texts", f"with v as (select distinct artist_name as s from flowsheet_entry union select distinct song_title from flowsheet_entry), f as (select s, {FIXED_SQL.format(c='s')} as fixed from v) select s as broken, fixed from f where fixed is not null and fixed <> s")
def repaired_texts(spark, d):
    e = table(spark, d, "flowsheet_entry")
    v = e.select(F.col("artist_name").alias("broken")).union(e.select("song_title")).distinct()
    return v.withColumn("fixed", tx.repair_latin1(F.col("broken"))).where("fixed is not null")


@query(
    "mojibake_duplicates",
    f"""with n as (select distinct artist_name as name from flowsheet_entry where artist_name is not null), a as (select name, count(*) as plays from flowsheet_entry join n on artist_name = name group by 1),
ec as (select id, count(*) as edges from (select source_id as id from dj_transition union all select target_id from dj_transition) group by 1), i as (select canonical_name as name, max(coalesce(edges, 0)) as edges from artist left join ec using (id) group by 1),
f as (select name, {FIXED_SQL.format(c="name")} as fixed, plays from a)
select f.name as corrupted_name, f.fixed as fixed_name, f.plays as corrupted_plays, b.plays as fixed_plays, coalesce(x.edges, 0)::bigint as corrupted_edges, coalesce(y.edges, 0)::bigint as fixed_edges from f join a b on b.name = f.fixed and f.fixed <> f.name left join i x on x.name = f.name left join i y on y.name = f.fixed""",
)
def mojibake_duplicates(spark, d):
    """GRF-20: typed names whose repaired form is another typed name, with the plays and edges of both."""
    a = table(spark, d, "flowsheet_entry").where("artist_name is not null").groupBy(F.col("artist_name").alias("name")).agg(F.count("*").alias("plays"))
    ids = table(spark, d, "artist").select("id", "canonical_name")
    e = stats.edge_counts({"t": (table(spark, d, "dj_transition"), "source_id", "target_id")}, ids).join(ids, "id").groupBy(F.col("canonical_name").alias("name")).agg(F.max("edges").alias("edges"))
    a = a.join(e, "name", "left").na.fill(0, ["edges"])
    return stats.mojibake_duplicates(a, tx.repair_latin1)


STEM = "case " + " ".join(f"when length(w) > {len(s) + 2} and w like '%{s}' then left(w, length(w) - {len(s)})" for s in tx.SUFFIXES) + " else w end"


@query(
    "token_match_score",
    f"""with r as (select row_id, lower(narrative) as t, lower(concat_ws(' ', edge, cell_id, source_name, target_name)) as s from labeling_row where narrative is not null),
c as (select row_id, unnest(regexp_extract_all(t, '[a-z]+')) as w from r), i as (select row_id, unnest(regexp_extract_all(s, '[a-z]+')) as w from r),
ci as (select distinct row_id, {STEM} as st from i), cc as (select row_id, w, {STEM} as st from c where w not in ({", ".join(repr(w) for w in tx.ALLOWED_WORDS)}))
select r.row_id, round(coalesce(sum(case when cc.w is not null and ci.st is null then 1 else 0 end) / nullif(count(cc.w), 0), 0), 6) as score from r left join cc using (row_id) left join ci on ci.row_id = cc.row_id and ci.st = cc.st group by 1""",
)
def token_match_score(spark, d):
    r = table(spark, d, "labeling_row").where("narrative is not null")
    s = tx.token_match_score(F.col("narrative"), F.concat_ws(" ", "edge", "cell_id", "source_name", "target_name"))
    return r.select("row_id", F.round(s, 6).alias("score"))


@query("stems", f"with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from documents) select w as word, {STEM} as stem from w")
def stems(spark, d):
    w = table(spark, d, "documents").select(F.explode(tx.words(F.col("text"))).alias("word")).distinct()
    return w.select("word", tx.stem(F.col("word")).alias("stem"))


@query(
    "eval_metrics",
    """with l as (select row_id, max(case when lower(trim(severity, ' ')) in ('severe', 'minor') then 1 else 0 end) as bad from narrative_label where lower(trim(severity, ' ')) in ('severe', 'minor', 'not_wrong') group by 1),
s as (select row_id, length(narrative) / 200.0::double as score, edge from labeling_row where narrative is not null),
m as (select edge, count(*) filter (score > 0.45 and bad = 1) as tp, count(*) filter (score > 0.45 and bad = 0) as fp, count(*) filter (score <= 0.45 and bad = 0) as tn, count(*) filter (score <= 0.45 and bad = 1) as fn from s join l using (row_id) group by 1),
p as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as pr, coalesce(tp / nullif(tp + fn, 0), 0) as re from m)
select edge, tp, fp, tn, fn, round(pr, 6) as precision, round(re, 6) as recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) as f1 from p""",
)
def eval_metrics(spark, d):
    sev = F.lower(F.trim("severity"))
    lab = table(spark, d, "narrative_label").where(sev.isin("severe", "minor", "not_wrong")).groupBy("row_id").agg(F.max(sev.isin("severe", "minor").cast("int")).alias("bad"))
    s = table(spark, d, "labeling_row").where("narrative is not null").withColumn("score", F.length("narrative") / F.lit(200.0))
    m = stats.classifier_metrics(s.join(lab, "row_id"), "score", "bad", 0.45, "edge")
    return m.select("edge", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("label_forms", "select distinct severity, translate(lower(trim(severity, ' ')), ' -', '__') as form from narrative_label where severity is not null")
def label_forms(spark, d):
    return table(spark, d, "narrative_label").where("severity is not null").select("severity", tx.label_form(F.col("severity")).alias("form")).distinct()


BLANKS_SQL = "[\\s\\x{b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


@query("refusals", f"select doc_id, (text is null or len(list_filter(string_split_regex(lower(text), '{BLANKS_SQL}'), lambda w: w <> '')) < 30 or regexp_matches(lower(text), 'unable to|cannot write|i cannot|input data lacks|insufficient data|not enough information|no clear connection|i''m sorry')) as refusal from documents")
def refusals(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", tx.is_refusal(F.col("text")).alias("refusal"))


@query("html_escaped", "select doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) as h from documents where text is not null")
def html_escaped(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(tx.html_escape(F.col("text"))).alias("h"))


@query(
    "name_variants",
    """with n as (select id, trim(lower(canonical_name), ' ') as n from artist where length(trim(lower(canonical_name), ' ')) >= 4),
s as (select id, n, unnest([' / ', ' & ', ' and ', ' + ', ' with ', ' vs. ', ' vs ']) as sep from n), p as (select id, trim(unnest(string_split(n, sep)), ' ') as v from s where contains(n, sep)),
g as (select id, trim(replace(n, unnest([', jr.', ', iii', ', ii']), ''), ' ') as v from n),
u as (select id, n as v from n union select id, regexp_replace(n, '^the ', '') from n union select id, v from p union select id, regexp_replace(v, '^the ', '') from p union select id, v from g)
select id, v as variant from u where length(v) >= 4""",
)
def name_variants(spark, d):
    return table(spark, d, "artist").select("id", F.explode(tx.name_variants(F.lower("canonical_name"))).alias("variant"))


def folded_variants(spark, d) -> DataFrame:
    a = table(spark, d, "artist").select("id", tx.match_form(F.col("canonical_name")).alias("folded"))
    return a.select("id", F.explode(tx.name_variants(F.col("folded"))).alias("variant"))


@query("text_coverage")
def text_coverage(spark, d):
    """EXP-08: documents in which a name variant of an artist stands; variants claimed by more than 5 artists are dropped. The
    variants meet the texts by their word sequences (of all lengths that variants have), an equi-join, not by containment of all in all."""
    v = folded_variants(spark, d)
    few = v.groupBy("variant").agg(F.countDistinct("id").alias("c")).where("c <= 5").select("variant")
    v = v.join(few, "variant").withColumn("size", F.size(F.split("variant", " ")))
    sizes = sorted(r["size"] for r in v.select("size").distinct().collect()) or [1]
    t = table(spark, d, "documents").where("text is not null").select("doc_id", tx.match_form(F.col("text")).alias("folded"))
    w = t.select("doc_id", F.filter(F.split(F.regexp_replace("folded", r"(?U)[^\w&/\s'-]", " "), r"\s+"), lambda x: x != "").alias("w"))
    gram = lambda n: lambda i: F.array_join(F.slice("w", i, n), " ")
    g = None
    for n in sizes:
        # the sequences of one text are made distinct before they meet the variants
        part = w.where(f"size(w) >= {n}").select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), gram(n)))).alias("variant"))
        g = part if g is None else g.unionByName(part)
    return v.join(g, "variant").groupBy("id").agg(F.countDistinct("doc_id").alias("documents"))


@query("real_names", "select count(*) as total, coalesce(sum((coalesce(lower(trim(label_name, ' ')) not in ('unknown', 'various', 'various artists', 'v/a', 'v.a.', 'n/a', 'none', ''), false))::int), 0)::bigint as named from flowsheet_entry")
def real_names(spark, d):
    return stats.conditional_counts(table(spark, d, "flowsheet_entry"), named=tx.real_name(F.col("label_name")))


STEM_WORDS_SQL = ", ".join(f"('{s}', '{w}')" for s, ws in tx.STEM_WORDS.items() for w in ws)


@query(
    "term_score",
    f"""with r as (select row_id, lower(narrative) as t, string_split(lower(concat_ws(' ', edge, cell_id, source_name, target_name)), ' ') as terms from labeling_row where narrative is not null),
x as (select * from (values {STEM_WORDS_SQL}) v(stem, word)),
g as (select row_id, list(word) as more from r, x where len(list_filter(terms, lambda t: contains(t, stem) or contains(stem, t))) > 0 group by 1),
w as (select r.row_id, list_concat(terms, coalesce(more, [])) as terms, unnest(string_split_regex(regexp_replace(t, '[^\\p{{L}}\\p{{N}}_\\s-]', ' ', 'g'), '\\s+')) as w from r left join g using (row_id)),
c as (select * from w where length(w) > 2 and w not in ({", ".join(repr(w) for w in tx.STOP_WORDS)}))
select r.row_id, round(coalesce(count(c.w) filter (not list_contains(c.terms, c.w) and c.w not in ({", ".join(repr(w) for w in tx.PROSE_WORDS)})) / nullif(count(c.w), 0), 0), 6) as score from r left join c using (row_id) group by 1""",
)
def term_score(spark, d):
    r = table(spark, d, "labeling_row").where("narrative is not null")
    terms = F.split(F.lower(F.concat_ws(" ", "edge", "cell_id", "source_name", "target_name")), " ")
    return r.select("row_id", F.round(tx.term_score(F.col("narrative"), terms, tx.STEM_WORDS, tx.PROSE_WORDS), 6).alias("score"))


@query("month_names", "select id, case when month = 0 then '' when month between 1 and 12 then monthname(make_date(2000, month, 1)) end as month from play")
def month_names(spark, d):
    return table(spark, d, "play").select("id", tx.month_name(F.col("month")).alias("month"))


@query("entries_within", "select id from flowsheet_entry where start_time >= timestamptz '2012-01-15 00:00:00+00' and start_time < timestamptz '2012-02-01 00:00:00+00'")
def entries_within(spark, d):
    import datetime as dt

    at = lambda m, d: dt.datetime(2012, m, d, tzinfo=dt.timezone.utc)
    return table(spark, d, "flowsheet_entry").where(tx.within(F.col("start_time"), at(1, 15), at(2, 1))).select("id")


@query("first_seen_titles", "select show_id, string_agg(artist_name, '|' order by p) as artists from (select show_id, artist_name, min(sequence * 100000000 + id) as p from flowsheet_entry where artist_name is not null and show_id is not null and sequence is not null group by 1, 2) group by 1")
def first_seen_titles(spark, d):
    """SET-05: the artists of each show once, in the order in which they first appear."""
    e = table(spark, d, "flowsheet_entry").where("artist_name is not null and show_id is not null and sequence is not null")
    # entries of one show
    every = e.groupBy("show_id").agg(F.array_sort(F.collect_list(F.struct((F.col("sequence") * 100_000_000 + F.col("id")).alias("p"), "artist_name"))).alias("x"))
    return every.select("show_id", F.array_join(tx.first_seen(F.col("x.artist_name")), "|").alias("artists"))


@query("first_sources", "select id, coalesce(nullif(trim(release_title, ' '), ''), nullif(trim(song_title, ' '), ''), nullif(trim(label_name, ' '), '')) is not null as found, case when trim(release_title, ' ') <> '' then 'release' when trim(song_title, ' ') <> '' then 'song' when trim(label_name, ' ') <> '' then 'label' end as source from flowsheet_entry")
def first_sources(spark, d):
    value, source = tx.first_of(("release", F.col("release_title")), ("song", F.col("song_title")), ("label", F.col("label_name")))
    return table(spark, d, "flowsheet_entry").select("id", value.isNotNull().alias("found"), source.alias("source"))


@query("json_arrays", "with k as (select library_release_id as id, list_sort(list(distinct label_name)) as labels from flowsheet_entry where library_release_id > 0 and label_name is not null group by 1) select id, len(labels)::int as weight, labels[1] as first from k")
def json_arrays(spark, d):
    """JSN-01, JSN-02: arrays written as JSON text, their lengths and elements read back."""
    e = table(spark, d, "flowsheet_entry").where("library_release_id > 0 and label_name is not null")
    k = e.groupBy(F.col("library_release_id").alias("id")).agg(F.to_json(F.array_sort(F.collect_set("label_name"))).alias("j"))
    return k.select("id", tx.array_weight(F.col("j")).alias("weight"), F.get(tx.parse_array(F.col("j")), F.lit(0)).alias("first"))
