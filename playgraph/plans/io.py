"""Queries that write fixtures of the test tables to the shared folder and read them back: sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playgraph.catalog import table
from playgraph.operators import identity, sharing
from playgraph.plans.edges import TRANSITIONS_SQL, transitions
from playgraph.plans.registry import query
from playgraph.session import shared_dir
from playgraph.sources import readers, sinks


def _place(spark) -> str:
    return f"{shared_dir(spark)}/io-{uuid.uuid4().hex}"


def _quoted(c: str):
    """A value as a dump writes it."""
    s = F.regexp_replace(F.regexp_replace(F.col(c), r"\\", r"\\\\"), "'", r"\\'")
    s = F.replace(F.replace(s, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.coalesce(F.concat(F.lit("'"), s, F.lit("'")), F.lit("NULL"))


def _dumped(spark, d) -> DataFrame:
    e, at = table(spark, d, "flowsheet_entry"), _place(spark)
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NULL"))
    row = F.concat(F.lit("("), F.concat_ws(",", number("id"), _quoted("artist_name"), _quoted("song_title"), number("library_release_id"), number("entry_type_code")), F.lit(")"))
    # a line holds many rows; other tables' lines stand between
    line = e.select(F.concat(F.lit("INSERT INTO `ENTRY` VALUES "), row, F.lit(","), row, F.lit(";")).alias("value"))
    line.unionByName(e.limit(3).select(F.lit("INSERT INTO `OTHER` VALUES (1,'x');").alias("value"))).write.text(at)
    return readers.read_dump(spark, at, "ENTRY", [("id", 0, "bigint"), ("artist_name", 1, "string"), ("song_title", 2, "string"), ("library_release_id", 3, "string"), ("entry_type_code", 4, "int")]).distinct()


@query("dump_read", "select id, artist_name, song_title, library_release_id::varchar as library_release_id, entry_type_code from flowsheet_entry")
def dump_read(spark, d):
    return _dumped(spark, d)


@query("dump_typed_entries", "select id, coalesce(artist_name, '') as artist_name, coalesce(song_title, '') as song_title, coalesce(library_release_id, 0) as library_release_id from flowsheet_entry where entry_type_code < 7")
def dump_typed_entries(spark, d):
    return readers.music_entries(readers.typed_entries(_dumped(spark, d))).select("id", "artist_name", "song_title", "library_release_id")


@query("enrichment_lookup", "select f.id, f.artist_name, f.song_title from flowsheet_entry f where lower(artist_name) in (select lower(canonical_name) from artist where id % 20 = 0)")
def enrichment_lookup(spark, d):
    names = table(spark, d, "artist").where("id % 20 = 0").select(F.col("canonical_name").alias("artist_name"))
    return readers.enrichment_lookup(names, table(spark, d, "flowsheet_entry").select("id", "artist_name", "song_title"))


@query(
    "search_artist",
    """with q as (select distinct artist_name, song_title as title from flowsheet_entry where artist_name is not null and song_title is not null and entry_type_code < 7),
p as (select lower(canonical_name) as a, lower(song_title) as t, min(x.id) as p from artist x join flowsheet_entry f on f.artist_name = x.canonical_name and f.library_release_id > 0 where song_title is not null group by 1, 2),
c as (select lower(artist_name) as a, lower(song_title) as t, min(library_release_id) as c from flowsheet_entry where library_release_id > 0 and artist_name is not null and song_title is not null group by 1, 2)
select q.artist_name, q.title, coalesce(p, c) as artist_id from q left join p on p.a = lower(artist_name) and p.t = lower(title) left join c on c.a = lower(artist_name) and c.t = lower(title)""",
)
def search_artist(spark, d):
    f = table(spark, d, "flowsheet_entry").where("artist_name is not null and song_title is not null")
    q = f.where("entry_type_code < 7").select("artist_name", F.col("song_title").alias("title")).distinct()
    a = table(spark, d, "artist").select(F.col("id").alias("artist_id"), F.col("canonical_name").alias("artist_name"))
    linked = f.where("library_release_id > 0").select("artist_name", F.col("song_title").alias("title"), "library_release_id")
    return readers.search_artist(q, linked.join(a, "artist_name"), linked.withColumnRenamed("library_release_id", "artist_id"))


@query(
    "assembled_releases",
    """with a as (select l_orderkey as k, string_agg(distinct s_name, '|' order by s_name) as artists from lineitem join supplier on s_suppkey = l_suppkey group by 1),
b as (select l_orderkey as k, string_agg(distinct p_brand, '|' order by p_brand) as labels from lineitem join part on p_partkey = l_partkey group by 1),
t as (select l_orderkey as k, string_agg(l_linenumber || ':' || l_partkey, '|' order by l_linenumber, l_partkey::varchar) as tracks from lineitem group by 1)
select o_orderkey as release_id, artists, labels, tracks from orders left join a on a.k = o_orderkey left join b on b.k = o_orderkey left join t on t.k = o_orderkey""",
)
def assembled_releases(spark, d):
    line = table(spark, d, "lineitem")
    k = F.col("l_orderkey").alias("release_id")
    artists = line.join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select(k, F.col("s_name").alias("name"), F.col("s_suppkey").alias("artist_id"), F.lit("").alias("role")).distinct()
    labels = line.join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(k, F.col("p_brand").alias("name"), F.lit(0).alias("label_id"), F.lit("").alias("catno")).distinct()
    tracks = line.select(k, F.col("l_linenumber").alias("position"), F.col("l_partkey").cast("string").alias("title"))
    r = readers.assemble_releases(table(spark, d, "orders").select(F.col("o_orderkey").alias("release_id")), artists, labels, tracks)
    track = F.transform("tracklist", lambda x: F.concat(x["position"].cast("string"), F.lit(":"), x["title"]))
    joined = lambda c: F.when(F.col(c).isNotNull(), F.array_join(F.col(c)["name"], "|"))
    return r.select("release_id", joined("artists").alias("artists"), joined("labels").alias("labels"), F.when(F.col("tracklist").isNotNull(), F.array_join(track, "|")).alias("tracks"))


@query("kb_influences", """with p as (select distinct 'Q' || source_id as s, case when target_id % 7 = 0 then 'P' || target_id else 'Q' || target_id end as t from dj_transition), l as (select 'Q' || id as qid, canonical_name as label from artist where id % 3 = 0)
select s as source_qid, t as target_qid, coalesce(label, t) as target_name from p left join l on qid = t where t like 'Q%'""")
def kb_influences(spark, d):
    q = lambda c: F.concat(F.lit("Q"), F.col(c).cast("string"))
    pairs = table(spark, d, "dj_transition").select(q("source_id").alias("source_qid"), F.when(F.col("target_id") % 7 == 0, F.concat(F.lit("P"), F.col("target_id").cast("string"))).otherwise(q("target_id")).alias("target_qid"))
    return readers.kb_influences(pairs, table(spark, d, "artist").where("id % 3 = 0").select(q("id").alias("qid"), F.col("canonical_name").alias("label")))


@query("kb_hierarchy", "select n_regionkey as parent, n_nationkey as child from nation union select s_nationkey, s_suppkey from supplier")
def kb_hierarchy(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("child"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("child"), F.col("s_nationkey").alias("parent"))
    return readers.kb_hierarchy(n.unionByName(n), s.select("parent", "child"))


@query("recordings_of", "select c_name as gid, string_agg(distinct o_orderkey::varchar, '|' order by o_orderkey::varchar) as recordings from customer join orders on o_custkey = c_custkey where c_custkey % 20 = 0 group by 1")
def recordings_of(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("gid"), F.col("c_custkey").alias("artist_id"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("artist_id"), F.col("o_orderkey").cast("string").alias("mbid"))
    r = readers.recordings_of(c.where("artist_id % 20 = 0").select("gid"), c, o)
    return r.select("gid", F.array_join("recordings", "|").alias("recordings"))


@query("parsed_distributions", "select artist_id, primary_genre as label, primary_genre_probability as p from audio_profile where primary_genre is not null and primary_genre_probability is not null and not isnan(primary_genre_probability)")
def parsed_distributions(spark, d):
    """Classifier outputs written as JSON, parsed and read by classifier and label."""
    a = table(spark, d, "audio_profile").where("primary_genre is not null and primary_genre_probability is not null and not isnan(primary_genre_probability)")
    inner = F.create_map(F.col("primary_genre"), F.col("primary_genre_probability"))
    j = a.select("artist_id", F.to_json(F.create_map(F.lit("genre"), inner)).alias("j"))
    return readers.parse_distributions(j, "j").select("artist_id", F.explode(F.col("j")["genre"]).alias("label", "p"))


@query("track_credits", "select library_release_id as release_id, song_title as track_title, artist_name from flowsheet_entry where library_release_id > 0 and song_title is not null and artist_name is not null")
def track_credits(spark, d):
    e = table(spark, d, "flowsheet_entry").where("library_release_id > 0 and song_title is not null")
    tracks = e.groupBy(F.col("library_release_id").alias("comp_id")).agg(F.collect_list(F.struct(F.col("song_title").alias("title"), F.array_compact(F.array("artist_name", "release_title")).alias("artists"), F.col("artist_name").isNotNull().alias("known"))).alias("tracks"))
    tracks = tracks.withColumn("tracks", F.transform("tracks", lambda t: F.struct(t["title"].alias("title"), F.when(t["known"], t["artists"]).otherwise(F.array().cast("array<string>")).alias("artists"))))
    return readers.track_credits(tracks.select(F.to_json(F.array(F.struct("comp_id", "tracks"))).alias("j")), "j").select("release_id", "track_title", "artist_name")


@query("label_rows", "select labeler, row_id, severity, updated_at::varchar as updated_at, kind from (select labeler, row_id, severity, strftime(updated_at at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as updated_at from narrative_label where trim(row_id, ' ') <> '') x, (values ('csv'), ('json')) k(kind)")
def label_rows(spark, d):
    """Labels as CSV and as JSON lines, read back."""
    at = _place(spark)
    rows = table(spark, d, "narrative_label").select("labeler", "row_id", "severity", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))
    rows.write.option("header", "true").option("nullValue", "\\N").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(f"{at}/l.csv")
    rows.write.json(f"{at}/l.jsonl")
    out = None
    for kind, path in (("csv", f"{at}/l.csv"), ("json", f"{at}/l.jsonl")):
        part = readers.read_label_rows(spark, path).select(*[F.nullif(c, F.lit("\\N")).alias(c) for c in ("labeler", "row_id", "severity", "updated_at")], F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


IDENTITIES_SQL = """i as (select canonical_name as n, 'reconciled' as status, case when id % 3 = 0 then discogs_artist_id + 1 end as discogs, case when id % 4 = 0 then 'Q' || id end as qid, case when id % 6 = 0 then 's' || id end as spotify from artist where id % 2 = 0 and id % 5 <> 0)"""


@query(
    "identity_import",
    f"""with {IDENTITIES_SQL}, e as (select id, canonical_name as name, 'Q0' || id as qid, cast(null as varchar) as spotify from artist where id % 8 = 0),
j as (select a.id, a.canonical_name, coalesce(i.discogs, a.discogs_artist_id) as discogs_artist_id, coalesce(i.status, 'new') as status, case when a.id % 8 = 0 then a.id end as old_entity, i.qid, i.spotify from artist a left join i on i.n = a.canonical_name),
w as (select *, case when old_entity is null and (qid is not null or spotify is not null) then (select max(id) from e) + row_number() over (partition by (old_entity is null and (qid is not null or spotify is not null)) order by encode(canonical_name)) end as new_entity from j)
select w.id, discogs_artist_id, status, coalesce(old_entity, new_entity) as entity_id, coalesce(w.qid, e.qid) as qid, coalesce(w.spotify, e.spotify) as spotify from w left join e on e.id = old_entity where coalesce(old_entity, new_entity) is not null
union all select w.id, discogs_artist_id, status, null, null, null from w where coalesce(old_entity, new_entity) is null""",
)
def identity_import(spark, d):
    a = table(spark, d, "artist").select("id", "canonical_name", "discogs_artist_id", F.lit("new").alias("status"), F.when(F.col("id") % 8 == 0, F.col("id")).alias("entity_id"))
    e = a.where("entity_id is not null").select("id", F.col("canonical_name").alias("name"), F.concat(F.lit("Q0"), F.col("id").cast("string")).alias("qid"), F.lit(None).cast("string").alias("spotify"))
    s = F.col("id").cast("string")
    i = a.where("id % 2 = 0").select(F.col("canonical_name").alias("library_name"), F.when(F.col("id") % 5 == 0, "unreconciled").otherwise("reconciled").alias("status"), F.col("id").alias("external_id"), F.when(F.col("id") % 3 == 0, F.col("discogs_artist_id") + 1).alias("discogs_artist_id"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("Q"), s)).alias("qid"), F.when(F.col("id") % 6 == 0, F.concat(F.lit("s"), s)).alias("spotify"))
    artists, entities = readers.merge_identities(a, e, readers.identity_import(i), ["discogs_artist_id"], ["qid", "spotify"])
    return artists.join(entities.withColumnRenamed("id", "entity_id").drop("name"), "entity_id", "left").select("id", "discogs_artist_id", "status", "entity_id", "qid", "spotify")


@query("property_bridge", "select distinct a.l_partkey::varchar as \"left\", b.l_suppkey::varchar as \"right\" from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = 1 and b.l_linenumber = 2")
def property_bridge(spark, d):
    line = table(spark, d, "lineitem").withColumn("qid", F.col("l_orderkey"))
    m = line.where("l_linenumber = 1").select("qid", F.lit("part").alias("property"), F.col("l_partkey").cast("string").alias("value"))
    m = m.unionByName(line.where("l_linenumber = 2").select("qid", F.lit("supp").alias("property"), F.col("l_suppkey").cast("string").alias("value")))
    return identity.property_bridge(m, "part", "supp")


@query("bridged_ids", "with m as (select artist_id as via, min(dj_id) as v from play where dj_id is not null and artist_id is not null group by 1 having count(distinct dj_id) = 1) select id, coalesce(discogs_artist_id, v) as dj from artist left join m on via = id")
def bridged_ids(spark, d):
    m = table(spark, d, "play").where("artist_id is not null").select(F.col("artist_id").alias("id"), F.col("dj_id").alias("dj"))
    return identity.bridge_ids(table(spark, d, "artist").select("id", F.col("discogs_artist_id").alias("dj")), m, "id", "dj")


@query("imported_xrefs", f"""with {TRANSITIONS_SQL}, n as (select id, canonical_name as name from artist where id % 3 <> 0), x as (select a.canonical_name as na, b.canonical_name as nb from t join artist a on a.id = source_id join artist b on b.id = target_id where raw_count >= 3),
o as (select source_id as a_id, target_id as b_id, 'old' as comment, 'code' as source from t where source_id % 2 = 0)
select * from o union all select * from (select distinct a.id as a_id, b.id as b_id, 'new' as comment, 'code' as source from x join n a on a.name = na join n b on b.name = nb) z where not exists (select 1 from o where o.a_id = z.a_id and o.b_id = z.b_id)""")
def imported_xrefs(spark, d):
    t, a = transitions(spark, d), table(spark, d, "artist").select("id", F.col("canonical_name").alias("name"))
    old = t.where("source_id % 2 = 0").select(F.col("source_id").alias("a_id"), F.col("target_id").alias("b_id"), F.lit("old").alias("comment"), F.lit("code").alias("source"))
    new = t.where("raw_count >= 3").join(a.select(F.col("id").alias("source_id"), F.col("name").alias("artist_a")), "source_id").join(a.select(F.col("id").alias("target_id"), F.col("name").alias("artist_b")), "target_id")
    return identity.import_xrefs(new.select("artist_a", "artist_b", F.lit("new").alias("comment"), F.lit("code").alias("source")), a.where("id % 3 <> 0"), old)


@query("kept_ids", "with o as (select id * 3 as id, presentation_name as name from library_code where id % 2 = 0), n as (select distinct canonical_name as name from artist where canonical_name not in (select name from o)) select * from o union all select (select max(id) from o) + row_number() over (order by encode(name)), name from n")
def kept_ids(spark, d):
    """SNK-02: names that have an id keep it, new ones follow."""
    old = table(spark, d, "library_code").where("id % 2 = 0").select((F.col("id") * 3).alias("id"), F.col("presentation_name").alias("name"))
    return sinks.assign_ids(table(spark, d, "artist"), "canonical_name", old)


@query("inserted_edges", """with e as (select s.canonical_name as a, upper(t.canonical_name) as b, raw_count, pmi from dj_transition join artist s on s.id = source_id join artist t on t.id = target_id where raw_count >= 2 and pmi > 0 and not isnan(pmi)),
l as (select lower(canonical_name) as n, min(id) as id from artist group by 1), j as (select a.id as source_id, coalesce(b.id, l.id) as target_id, raw_count, pmi from e join artist a on a.canonical_name = e.a left join artist b on b.canonical_name = e.b left join l on l.n = lower(e.b)),
k as (select *, row_number() over (partition by source_id, target_id order by raw_count desc, pmi desc) as k from j where target_id is not null) select source_id, target_id, raw_count, pmi from k where k = 1""")
def inserted_edges(spark, d):
    """SNK-03: edges by name, one end in another case."""
    a = table(spark, d, "artist").select("id", F.col("canonical_name").alias("name"))
    t = table(spark, d, "dj_transition").where("not isnan(pmi)")
    e = t.join(a.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id").join(a.select(F.col("id").alias("target_id"), F.upper("name").alias("target")), "target_id")
    return sinks.insert_edges(e.select("source", "target", "raw_count", "pmi"), a)


@query("written_tables", "select 'play' as \"table\", month as part, count(*) as n from play group by 2 union all select 'artist', 0, count(*) from artist")
def written_tables(spark, d):
    """SNK-05, SNK-07, DML-07: tables written twice to one folder, one of them partitioned, and read back."""
    at, p = _place(spark), table(spark, d, "play")
    sinks.write_tables({"play": p.limit(5), "artist": table(spark, d, "artist").select("id")}, at)
    sinks.write_tables({"play": p}, at, {"play": ["month"]})
    play = spark.read.parquet(f"{at}/play.parquet").groupBy(F.col("month").alias("part")).agg(F.count("*").alias("n")).select(F.lit("play").alias("table"), "part", "n")
    return play.unionByName(spark.read.parquet(f"{at}/artist.parquet").agg(F.count("*").alias("n")).select(F.lit("artist").alias("table"), F.lit(0).alias("part"), "n"))


@query("published_table", "select id, presentation_name from library_code")
def published_table(spark, d):
    """SNK-08: a version published after an older one is what readers find; the old one is cleaned away."""
    p = sinks.Publisher(spark, _place(spark))
    c = table(spark, d, "library_code").select("id", "presentation_name")
    p.publish({"code": c.limit(1)})
    p.publish({"code": c})
    p.clean()
    return p.read("code")


@query("written_reports", "select source_id, target_id, count(*) as n, kind from dj_transition, (values ('csv'), ('json')) k(kind) group by 1, 2, 4")
def written_reports(spark, d):
    """SNK-10: a report as CSV and as JSON, read back."""
    at = _place(spark)
    r = table(spark, d, "dj_transition").groupBy("source_id", "target_id").agg(F.count("*").alias("n"))
    out = None
    for kind in ("csv", "json"):
        sinks.write_reports(r, f"{at}/{kind}", kind)
        read = spark.read.schema("source_id long, target_id long, n long")
        part = (read.option("header", "true").csv(f"{at}/csv") if kind == "csv" else read.json(f"{at}/json")).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("kept_entries", "select count(*) as n, count(distinct artist_name) as names from flowsheet_entry where entry_type_code < 7")
def kept_entries(spark, d):
    """SRC-16: the second call reads what the first has kept."""
    path, at = f"{d}/flowsheet_entry.parquet", _place(spark)
    readers.cached(spark, path, lambda: table(spark, d, "flowsheet_entry").where("entry_type_code < 7").select("id", "artist_name"), at)
    again = readers.cached(spark, path, lambda: table(spark, d, "flowsheet_entry").limit(0).select("id", "artist_name"), at)
    return again.agg(F.count("*").alias("n"), F.countDistinct("artist_name").alias("names"))


@query("compilation_others", "with f as (select distinct library_release_id as release, artist_name as artist from flowsheet_entry where library_release_id > 0 and artist_name is not null and entry_type_code < 7) select a.artist, a.release, count(*)::int as n, min(b.artist) as first from f a join f b on b.release = a.release and b.artist <> a.artist group by 1, 2")
def compilation_others(spark, d):
    e = table(spark, d, "flowsheet_entry").where("library_release_id > 0 and entry_type_code < 7")
    o = sharing.compilation_appearances(e.select(F.col("library_release_id").alias("release"), F.col("artist_name").alias("artist")))
    return o.select("artist", "release", F.size("others").alias("n"), F.array_min("others").alias("first"))
