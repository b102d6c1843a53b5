"""Queries over plays: adjacency, PMI, facets, node statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playgraph.catalog import table
from playgraph.functions.text import month_or_zero
from playgraph.operators import adjacency, pmi, stats
from playgraph.plans.registry import query

#: Items that the per-center queries ask about: every row whose id is divisible by 20.
CENTERS = 20


def plays(spark, d) -> DataFrame:
    return table(spark, d, "play")


def centers(spark, d) -> DataFrame:
    return table(spark, d, "artist").where(f"id % {CENTERS} = 0").select(F.col("id").alias("center"))


def lineitem_pairs(spark, d) -> DataFrame:
    order = ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey"]
    return adjacency.adjacent_positional(table(spark, d, "lineitem"), "l_orderkey", order, "l_suppkey")


def play_pairs(spark, d) -> DataFrame:
    return adjacency.adjacent_positional(plays(spark, d).where("artist_id is not null"), "show_id", ["sequence", "id"], "artist_id")


def play_edges(spark, d) -> DataFrame:
    return pmi.pmi_edges(play_pairs(spark, d), plays(spark, d), "artist_id")


LINE_PMI = """
with p as (select l_suppkey as source, lead(l_suppkey) over (partition by l_orderkey order by l_linenumber, l_shipdate, l_partkey, l_suppkey) as target from lineitem),
ab as (select source, target, count(*) as raw_count from p where target is not null group by 1, 2),
n as (select l_suppkey as i, count(*) as n from lineitem group by 1),
t as (select (select sum(raw_count) from ab) as p, (select sum(n) from n) as t)
select source, target, raw_count, round(log2((raw_count / t.p) / ((a.n / t.t) * (b.n / t.t))), 6) as pmi
from ab join n a on a.i = source join n b on b.i = target, t"""

PAIRS_SQL = "pp as (select show_id, artist_id as source, lead(artist_id) over (partition by show_id order by sequence, id) as target from play where artist_id is not null)"
EDGES_SQL = f"""{PAIRS_SQL},
ab as (select source, target, count(*) as raw_count from pp where target is not null and show_id is not null group by 1, 2),
n as (select artist_id as i, count(*) as n from play where artist_id is not null group by 1),
t as (select (select sum(raw_count) from ab) as p, (select sum(n) from n) as t),
e as (select source, target, raw_count, log2((raw_count / t.p) / ((a.n / t.t) * (b.n / t.t))) as pmi from ab join n a on a.i = source join n b on b.i = target, t)"""


@query("pmi_edges", LINE_PMI)
def pmi_edges(spark, d):
    e = pmi.pmi_edges(lineitem_pairs(spark, d), table(spark, d, "lineitem"), "l_suppkey")
    return e.withColumn("pmi", F.round("pmi", 6))


@query("pmi_play_edges", f"with {EDGES_SQL} select source, target, raw_count, round(pmi, 6) as pmi from e")
def pmi_play_edges(spark, d):
    return play_edges(spark, d).withColumn("pmi", F.round("pmi", 6))


@query("transition_edges_filtered", f"with {EDGES_SQL} select source, target, raw_count, round(pmi, 6) as pmi from e where raw_count >= 2 and pmi > 0")
def transition_edges_filtered(spark, d):
    return pmi.strong_edges(play_edges(spark, d)).withColumn("pmi", F.round("pmi", 6))


@query("adjacent_positional", f"with {PAIRS_SQL} select show_id as session, source, target from pp where target is not null and show_id is not null")
def adjacent_positional(spark, d):
    return play_pairs(spark, d).where("session is not null")


@query("strict_pairs", "select a.show_id as session, a.artist_id as source, b.artist_id as target from play a join play b on a.show_id = b.show_id and b.sequence = a.sequence + 1")
def strict_pairs(spark, d):
    return adjacency.adjacent_strict(plays(spark, d), "show_id", "sequence", "artist_id")


@query(
    "session_cooccurrence",
    """with s as (select distinct show_id as s, artist_id as i from play where show_id is not null and artist_id is not null),
near as (select distinct a.show_id as s, least(a.artist_id, b.artist_id) as a, greatest(a.artist_id, b.artist_id) as b from play a join play b on a.show_id = b.show_id and b.sequence = a.sequence + 1)
select x.i as a, y.i as b, count(distinct x.s) as sessions from s x join s y on x.s = y.s and x.i < y.i
where not exists (select 1 from near n where n.s = x.s and n.a = x.i and n.b = y.i) group by 1, 2""",
)
def session_cooccurrence(spark, d):
    return adjacency.session_cooccurrence(plays(spark, d), "show_id", "sequence", "artist_id")


@query(
    "node_stats",
    """select f.artist_name as artist_name, count(*) as total_plays, min(case when start_time > timestamptz '1970-01-01 00:00:00+00' then year(start_time) end)::int as active_first_year,
max(case when start_time > timestamptz '1970-01-01 00:00:00+00' then year(start_time) end)::int as active_last_year, count(distinct label_name) as dj_count,
round(sum(case when request_flag = 1 then 1 else 0 end) / count(*), 6) as request_ratio, count(distinct show_id) as show_count, arg_min(c.genre_id, case when c.genre_id is not null then f.id end) as genre
from flowsheet_entry f left join library_release r on f.library_release_id = r.id left join library_code c on r.library_code_id = c.id
where artist_name is not null and entry_type_code < 7 group by 1""",
)
def node_stats(spark, d):
    e = table(spark, d, "flowsheet_entry").where("entry_type_code < 7")
    r = table(spark, d, "library_release").select(F.col("id").alias("library_release_id"), "library_code_id")
    c = table(spark, d, "library_code").select(F.col("id").alias("library_code_id"), F.col("genre_id").alias("g"))
    e = e.join(r, "library_release_id", "left").join(c, "library_code_id", "left")
    s = stats.node_stats(e, "artist_name", "start_time", "label_name", "request_flag", "show_id", "g")
    return s.withColumn("request_ratio", F.round("request_ratio", 6))


@query(
    "play_stats",
    """select artist_id, count(*) as total_plays, min(case when played_at > timestamptz '1970-01-01 00:00:00+00' then year(played_at) end)::int as active_first_year,
max(case when played_at > timestamptz '1970-01-01 00:00:00+00' then year(played_at) end)::int as active_last_year, count(distinct dj_id) as dj_count,
round(sum(case when request_flag = 1 then 1 else 0 end) / count(*), 6) as request_ratio, count(distinct show_id) as show_count from play where artist_id is not null group by 1""",
)
def play_stats(spark, d):
    s = stats.node_stats(plays(spark, d), "artist_id", "played_at", "dj_id", "request_flag", "show_id")
    return s.withColumn("request_ratio", F.round("request_ratio", 6))


@query(
    "facet_cube",
    """select artist_id, 'month' as facet, month::bigint as key, count(*) as plays from play where artist_id is not null and month > 0 group by 1, 3
union all select artist_id, 'dj', dj_id, count(*) from play where artist_id is not null and dj_id is not null group by 1, 3""",
)
def facet_cube(spark, d):
    return stats.facet_cube(plays(spark, d))


@query("month_counts", "select artist_id, month, count(*) as plays from play where artist_id is not null and month > 0 group by 1, 2")
def month_counts(spark, d):
    return stats.facet_cube(plays(spark, d)).where("facet = 'month'").select("artist_id", F.col("key").cast("int").alias("month"), "plays")


@query("dj_counts", "select artist_id, dj_id, count(*) as plays from play where artist_id is not null and dj_id is not null group by 1, 2")
def dj_counts(spark, d):
    return stats.facet_cube(plays(spark, d)).where("facet = 'dj'").select("artist_id", F.col("key").alias("dj_id"), "plays")


def _total_sql(facet: str) -> str:
    valid = f"{facet} is not null" + (" and month > 0" if facet == "month" else "")
    return f"""with p as (select *, lead(artist_id) over (partition by show_id order by sequence, id) as nxt from play where artist_id is not null),
a as (select {facet}, count(*) as total_plays from p where {valid} group by 1), b as (select {facet}, count(*) as total_pairs from p where {valid} and nxt is not null group by 1)
select {facet}, coalesce(total_plays, 0) as total_plays, coalesce(total_pairs, 0) as total_pairs from a full outer join b using ({facet})"""


@query("month_total", _total_sql("month"))
def month_total(spark, d):
    return stats.facet_totals(plays(spark, d), "month")


@query("dj_total", _total_sql("dj_id"))
def dj_total(spark, d):
    return stats.facet_totals(plays(spark, d), "dj_id")


@query("show_month", "select show_id, arg_min(month, sequence * 10000000000 + id) as month from play where month > 0 and show_id is not null group by 1")
def show_month(spark, d):
    return stats.show_month(plays(spark, d)).where("show_id is not null")


def _facet_sql(month: int | None, dj: int | None) -> str:
    f = " and ".join([*(["month = %d" % month] if month else []), *(["dj_id = %d" % dj] if dj else [])]) or "true"
    return f"""with inside as (select * from play where artist_id is not null and {f}),
a as (select * from inside where artist_id % {CENTERS} = 0 and artist_id in (select id from artist)),
ab as (select a.artist_id as center, b.artist_id as neighbor, count(*) as raw_count from a join play b on a.show_id = b.show_id and b.sequence in (a.sequence - 1, a.sequence + 1) where b.artist_id is not null group by 1, 2),
n as (select artist_id, count(*) as n from inside group by 1),
l as (select *, lead(artist_id) over (partition by show_id order by sequence, id) as nxt from play where artist_id is not null),
t as (select (select sum(n) from n) as t, (select count(*) from l where {f} and nxt is not null) as p),
e as (select center, neighbor, raw_count, log2((raw_count / t.p) / ((x.n / t.t) * (y.n / t.t))) as pmi from ab join n x on x.artist_id = center join n y on y.artist_id = neighbor, t where t.p > 0),
k as (select *, max(raw_count) over (partition by center) as mr, max(pmi) over (partition by center) as mp from e where pmi > 0),
w as (select *, 0.5 * raw_count / mr + 0.5 * pmi / mp as weight from k),
r as (select *, row_number() over (partition by center order by weight desc, neighbor)::int as rank from w)
select center, neighbor, raw_count, round(pmi, 4) as pmi, round(weight, 6) as weight, rank from r where rank <= 20"""


def _facet(name: str, month: int | None, dj: int | None):
    @query(name, _facet_sql(month, dj))
    def run(spark, d):
        r = pmi.facet_pmi(plays(spark, d), centers(spark, d), month, dj)
        return r.withColumn("weight", F.round("weight", 6))

    return run


facet_pmi_month = _facet("facet_pmi_month", 3, None)
facet_pmi_dj = _facet("facet_pmi_dj", None, 7)
facet_pmi_both = _facet("facet_pmi_both", 3, 7)
facet_pmi_none = _facet("facet_pmi_none", None, None)


@query(
    "top_neighbors",
    f"""with t as (select distinct source_id, target_id, raw_count, pmi from dj_transition where pmi is not null and not isnan(pmi)),
s as (select source_id as center, target_id as neighbor, raw_count, pmi from t union all select target_id, source_id, raw_count, pmi from t where source_id <> target_id),
r as (select *, row_number() over (partition by center order by pmi desc, neighbor, raw_count desc)::int as rank from s where center % {CENTERS} = 0 and center in (select id from artist))
select center, neighbor, raw_count, pmi, rank from r where rank <= 10""",
)
def top_neighbors(spark, d):
    t = table(spark, d, "dj_transition").where("pmi is not null and not isnan(pmi)").distinct()
    e = t.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "raw_count", "pmi")
    return pmi.top_neighbors(e, centers(spark, d), 10)


@query(
    "heat_neighbors",
    """with t as (select source_id, target_id, max(raw_count) as raw_count, max(pmi) as pmi from dj_transition where pmi is not null and not isnan(pmi) group by 1, 2),
m as (select *, max(raw_count) over (partition by source_id) as mr, max(pmi) over (partition by source_id) as mp from t),
w as (select *, round(0.5 * raw_count / (case when coalesce(mr, 0) = 0 then 1 else mr end) + 0.5 * pmi / (case when coalesce(mp, 0) = 0 then 1 else mp end), 9) as weight from m),
r as (select *, row_number() over (partition by source_id order by weight desc, target_id)::int as rank from w)
select source_id, target_id, raw_count, round(weight, 5) as weight, rank from r where rank <= 20""",
)
def heat_neighbors(spark, d):
    from pyspark.sql.window import Window

    t = table(spark, d, "dj_transition").where("pmi is not null and not isnan(pmi)").groupBy("source_id", "target_id").agg(F.max("raw_count").alias("raw_count"), F.max("pmi").alias("pmi"))
    w = Window.partitionBy("source_id")
    e = t.withColumn("weight", F.round(pmi.heat_blend(F.col("raw_count"), F.col("pmi"), F.max("raw_count").over(w), F.max("pmi").over(w), 0.5), 9))
    r = e.withColumn("rank", F.row_number().over(w.orderBy(F.desc("weight"), "target_id"))).where("rank <= 20")
    return r.select("source_id", "target_id", "raw_count", F.round("weight", 5).alias("weight"), "rank")


@query("raw_name_counts", "select lower(trim(artist_name, ' ')) as name, count(*) as plays from flowsheet_entry where entry_type_code < 7 group by 1 having count(*) >= 10 and lower(trim(artist_name, ' ')) <> ''")
def raw_name_counts(spark, d):
    return stats.raw_name_counts(table(spark, d, "flowsheet_entry").where("entry_type_code < 7"), "artist_name", 10)


@query("month_of_entry", "select id, coalesce(month(start_time), 0)::int as month, case when start_time > timestamptz '1970-01-01 00:00:00+00' then year(start_time)::int end as year from flowsheet_entry")
def month_of_entry(spark, d):
    e = table(spark, d, "flowsheet_entry")
    return e.select("id", month_or_zero(F.col("start_time")).alias("month"), F.when(F.col("start_time") > F.timestamp_seconds(F.lit(0)), F.year("start_time")).alias("year"))


@query("display_names", "select dj_id::varchar as key, coalesce(arg_min(c_name, case when c_name is not null and c_name <> dj_id::varchar then id end), dj_id::varchar) as name from (select p.dj_id, p.id, c.c_name from play p left join customer c on p.dj_id = c.c_custkey) where dj_id is not null group by dj_id")
def display_names(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("dj_id"), "c_name")
    return stats.display_names(plays(spark, d).join(c, "dj_id", "left"), "dj_id", "c_name", "id")


@query(
    "inferred_sessions",
    """with g as (select user_id, ts, event_id, case when lag(ts) over (partition by user_id order by ts, event_id) is null or epoch(ts)::bigint - epoch(lag(ts) over (partition by user_id order by ts, event_id))::bigint > 86400 then 1 else 0 end as s from events),
n as (select user_id, sum(s) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row)::int as session_no from g)
select user_id, max(session_no) as sessions, count(*) as events from n group by 1""",
)
def inferred_sessions(spark, d):
    e = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    s = adjacency.infer_sessions(e, "user_id", "ts", 86400)
    return s.groupBy("user_id").agg(F.max("session_no").alias("sessions"), F.count("*").alias("events"))


@query("json_props_rollup", "select event_type, coalesce(sum(cast(json_extract_string(props, '$.k') as bigint)), 0)::bigint as k_sum, count(json_extract_string(props, '$.k')) as k_count, count(*) as n from events group by 1")
def json_props_rollup(spark, d):
    e = table(spark, d, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    return e.groupBy("event_type").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k_sum"), F.count("k").alias("k_count"), F.count("*").alias("n"))


@query("orders_rollup", "select o_orderpriority as priority, year(o_orderdate)::int as year, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by rollup (o_orderpriority, year(o_orderdate))")
def orders_rollup(spark, d):
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    r = o.rollup(F.col("o_orderpriority").alias("priority"), "year").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return r.select("priority", "year", "n", "total")
