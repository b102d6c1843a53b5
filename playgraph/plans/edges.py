"""Queries over edges: shared attributes, pruning, neighbours, affinity, graph metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playgraph.catalog import table
from playgraph.operators import graph, identity, sharing
from playgraph.plans.plays import CENTERS, centers
from playgraph.plans.registry import query


def transitions(spark, d) -> DataFrame:
    """dj_transition with one row a pair: the highest count, then pmi; rows without a pmi are left out."""
    t = table(spark, d, "dj_transition").where("pmi is not null and not isnan(pmi) and source_id is not null and target_id is not null")
    return t.groupBy("source_id", "target_id").agg(F.max(F.struct("raw_count", "pmi")).alias("x")).select("source_id", "target_id", "x.raw_count", "x.pmi")


TRANSITIONS_SQL = """t as (select source_id, target_id, raw_count, pmi from (select *, row_number() over (partition by source_id, target_id order by raw_count desc nulls last, pmi desc) as k
  from dj_transition where pmi is not null and not isnan(pmi) and source_id is not null and target_id is not null) where k = 1)"""


def supplier_parts(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select("l_suppkey", "l_partkey")


def artist_djs(spark, d) -> DataFrame:
    return table(spark, d, "play").select("artist_id", "dj_id")


def _shared_sql(source: str, node: str, key: str, least: int) -> str:
    return f"""with f as (select distinct {node} as node, {key} as key from {source} where {node} is not null and {key} is not null),
k as (select key from f group by 1 having count(*) >= 2),
s as (select node, key from f join k using (key))
select x.node as a, y.node as b, count(*) as shared, string_agg(x.key::varchar, '|' order by x.key) as keys from s x join s y on x.key = y.key and x.node < y.node group by 1, 2 having count(*) >= {least}"""


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("keys", F.array_join(F.transform("keys", lambda k: k.cast("string")), "|"))


@query("shared_personnel", _shared_sql("lineitem", "l_suppkey", "l_partkey", 2))
def shared_personnel(spark, d):
    return _joined(sharing.shared_keys(supplier_parts(spark, d), "l_suppkey", "l_partkey", None, 2))


@query("label_family", _shared_sql("flowsheet_entry", "artist_name", "label_name", 1))
def label_family(spark, d):
    return sharing.shared_key_texts(table(spark, d, "flowsheet_entry"), "artist_name", "label_name")


JACCARD_SQL = """f as (select distinct artist_id as node, dj_id as key from play where artist_id is not null and dj_id is not null),
c as (select node, count(*) as n from f group by 1),
ab as (select x.node as a, y.node as b, count(*) as shared from f x join f y on x.key = y.key and x.node < y.node group by 1, 2),
j as (select a, b, shared, shared / (ca.n + cb.n - shared) as jaccard from ab join c ca on ca.node = a join c cb on cb.node = b where shared / (ca.n + cb.n - shared) >= 0.2)"""


def style_edges(spark, d) -> DataFrame:
    return sharing.jaccard(artist_djs(spark, d), "artist_id", "dj_id", None, 0.2)


@query("shared_style_jaccard", f"with {JACCARD_SQL} select a, b, shared, round(jaccard, 6) as jaccard from j")
def shared_style_jaccard(spark, d):
    return style_edges(spark, d).withColumn("jaccard", F.round("jaccard", 6))


@query(
    "compilation_coappearance",
    """with f as (select distinct artist_name as node, library_release_id as key from flowsheet_entry where artist_name is not null and library_release_id > 0 and entry_type_code < 7),
k as (select key from f group by 1 having count(*) >= 2), s as (select node, key from f join k using (key))
select x.node as a, y.node as b, count(*) as compilations from s x join s y on x.key = y.key and x.node < y.node group by 1, 2""",
)
def compilation_coappearance(spark, d):
    e = table(spark, d, "flowsheet_entry").where("library_release_id > 0 and entry_type_code < 7")
    return sharing.coappearance(e, "library_release_id", "artist_name")


@query(
    "enrichment_rollup",
    """with l as (select l_suppkey as artist, p_type as style, p_brand as label, p_partkey, o_orderpriority as role, c_mktsegment as person, l_orderkey * 100 + l_linenumber as ord
  from lineitem join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey),
s as (select artist, string_agg(distinct style, '|' order by style) as styles from l group by 1),
p0 as (select artist, person, string_agg(distinct role, ',' order by role) as roles from l group by 1, 2),
p as (select artist, string_agg(person || ':' || roles, '|' order by person) as personnel from p0 group by 1),
b0 as (select artist, label, min(p_partkey) as label_id from l group by 1, 2),
b as (select artist, string_agg(label || ':' || label_id, '|' order by label) as labels from b0 group by 1)
select artist, styles, personnel, labels from s join p using (artist) join b using (artist)""",
)
def enrichment_rollup(spark, d):
    t = lambda n: table(spark, d, n)
    lines = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    a = F.col("l_suppkey").alias("artist")
    e = sharing.enrichment(
        lines.select(a, F.col("p_type").alias("style")),
        lines.select(a, F.col("c_mktsegment").alias("person"), F.col("o_orderpriority").alias("role")),
        lines.select(a, F.col("p_brand").alias("label"), F.col("p_partkey").alias("label_id"), F.col("p_partkey").alias("ord")),
    )
    return e.select(
        "artist",
        F.array_join("styles", "|").alias("styles"),
        F.array_join(F.transform("personnel", lambda p: F.concat(p["person"], F.lit(":"), F.array_join(p["roles"], ","))), "|").alias("personnel"),
        F.array_join(F.transform("labels", lambda p: F.concat(p["label"], F.lit(":"), p["label_id"].cast("string"))), "|").alias("labels"),
    )


@query("styles_capped", "with f as (select distinct l_suppkey as node, p_type as v from lineitem join part on p_partkey = l_partkey where p_type is not null), r as (select *, row_number() over (partition by node order by v) as k from f) select node as l_suppkey, string_agg(v, '|' order by v) as styles from r where k <= 5 group by 1")
def styles_capped(spark, d):
    f = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return sharing.capped_sorted(f, "l_suppkey", "p_type", 5).select("l_suppkey", F.array_join("values", "|").alias("styles"))


PRUNE_SQL = f"""{JACCARD_SQL},
both_ends as (select a as node, b as other, jaccard from j union all select b, a, jaccard from j),
r as (select *, row_number() over (partition by node order by round(jaccard, 9) desc, other) as k from both_ends),
keep as (select distinct least(node, other) as a, greatest(node, other) as b from r where k <= 5)"""


@query("prune_topk", f"with {PRUNE_SQL} select j.a, j.b, shared, round(jaccard, 6) as jaccard from j join keep using (a, b)")
def prune_topk(spark, d):
    return sharing.jaccard_topk(artist_djs(spark, d), "artist_id", "dj_id", None, 0.2, 5)[0].withColumn("jaccard", F.round("jaccard", 6))


@query("prune_report", f"with {PRUNE_SQL} select (select count(*) from j) as before, (select count(*) from keep) as after")
def prune_report(spark, d):
    kept, before = sharing.jaccard_topk(artist_djs(spark, d), "artist_id", "dj_id", None, 0.2, 5)
    return before.crossJoin(kept.agg(F.count("*").alias("after")))


@query(
    "symmetric_neighbors",
    f"""with {JACCARD_SQL}, sc as (select a as center, b as neighbor, shared from j union all select b, a, shared from j),
r as (select *, row_number() over (partition by center order by shared desc, neighbor)::int as rank from sc where center % {CENTERS} = 0 and center in (select id from artist)) select center, neighbor, shared, rank from r where rank <= 20""",
)
def symmetric_neighbors(spark, d):
    return graph.symmetric_neighbors(style_edges(spark, d), centers(spark, d), "a", "b", "shared", 20)


@query(
    "personnel_or_member_neighbors",
    f"""with {JACCARD_SQL}, {TRANSITIONS_SQL},
u as (select a as center, b as neighbor, round(jaccard, 6) as weight from j union all select b, a, round(jaccard, 6) from j union all select source_id, target_id, 1.0 from t where raw_count >= 3),
r as (select *, row_number() over (partition by center order by weight desc, neighbor) as k from u where center % {CENTERS} = 0)
select center, neighbor, max(weight) as weight from r where k <= 20 group by 1, 2""",
)
def personnel_or_member_neighbors(spark, d):
    e = style_edges(spark, d)
    a = graph.symmetrize(e, "a", "b", "jaccard").select(F.col("node").alias("center"), F.col("other").alias("neighbor"), F.round("jaccard", 6).alias("weight"))
    m = transitions(spark, d).where("raw_count >= 3").select(F.col("source_id").alias("center"), F.col("target_id").alias("neighbor"), F.lit(1.0).alias("weight"))
    return graph.union_neighbors([x.where(f"center % {CENTERS} = 0") for x in (a, m)], 20)


def relations(spark, d) -> DataFrame:
    """The long-form view of all relations but transitions."""
    people = sharing.shared_keys(table(spark, d, "play"), "artist_id", "show_id", None, 2)
    return graph.long_edges({
        "style": (style_edges(spark, d), "a", "b", F.col("jaccard"), False),
        "personnel": (people, "a", "b", F.col("shared"), False),
    })


RELATIONS_SQL = f"""{JACCARD_SQL},
f2 as (select distinct artist_id as node, show_id as key from play where artist_id is not null and show_id is not null),
pe as (select x.node as a, y.node as b, count(*) as shared from f2 x join f2 y on x.key = y.key and x.node < y.node group by 1, 2 having count(*) >= 2),
rel as (select a as src, b as dst, 'style' as type, jaccard as score from j union all select a, b, 'personnel', shared::double from pe)"""


@query("long_edges", f"with {RELATIONS_SQL} select type, count(*) as edges, round(sum(score), 4) as total from rel group by 1")
def long_edges(spark, d):
    return relations(spark, d).groupBy("type").agg(F.count("*").alias("edges"), F.round(F.sum("score"), 4).alias("total"))


AFFINITY_SQL = f"""{RELATIONS_SQL}, {TRANSITIONS_SQL}, ct as (select id as center from artist where id % {CENTERS} = 0),
bt as (select source_id as center, target_id as neighbor, raw_count, pmi, 0 as way from t union all select target_id, source_id, raw_count, pmi, 1 from t) ,
tt as (select *, row_number() over (partition by center, way order by raw_count desc, neighbor) as k from bt where center in (select center from ct) and center <> neighbor),
t1 as (select center, neighbor, arg_max(raw_count, way) as raw_count, arg_max(pmi, way) as pmi from tt where k <= 100 group by 1, 2),
t2 as (select center, neighbor, 'transition' as type, 0.5 * raw_count / (case when coalesce(max(raw_count) over w, 0) = 0 then 1 else max(raw_count) over w end) + 0.5 * pmi / (case when coalesce(max(pmi) over w, 0) = 0 then 1 else max(pmi) over w end) as score
  from t1 window w as (partition by center)),
br as (select src as center, dst as neighbor, type, score, 0 as way from rel union all select dst, src, type, score, 1 from rel),
rr as (select *, row_number() over (partition by center, type, way order by score desc, neighbor) as k from br where center in (select center from ct) and center <> neighbor),
r1 as (select center, neighbor, type, arg_min(score, way * 1000000000 - score) as score from rr where k <= 100 group by 1, 2, 3),
ev as (select * from t2 union all select * from r1),
pt as (select center, neighbor, (case type when 'transition' then 3.0 when 'personnel' then 1.5 else 1.0 end) * score / (case when max(score) over (partition by center, type) = 0 then 1 else max(score) over (partition by center, type) end) as part from ev),
sm as (select center, neighbor, round(sum(part), 3) as affinity from pt group by 1, 2),
kk as (select *, row_number() over (partition by center order by affinity desc, neighbor)::int as rank from sm)"""


@query("affinity", f"with {AFFINITY_SQL} select center, neighbor, affinity, rank from kk where rank <= 20")
def affinity(spark, d):
    return graph.affinity(transitions(spark, d), relations(spark, d), centers(spark, d))


@query(
    "explain_pair",
    f"""with {RELATIONS_SQL}, {TRANSITIONS_SQL}, pr as (select distinct source_id as x, target_id as y from t where source_id % {CENTERS} = 0),
al as (select src, dst, type, score from rel union all select source_id, target_id, 'transition', pmi from t),
w as (select x, y, type, score from al join pr on src = x and dst = y union all select x, y, type, score from al join pr on src = y and dst = x and x <> y)
select x, y, type, round(max(score), 6) as score from w group by 1, 2, 3""",
)
def explain_pair(spark, d):
    t = transitions(spark, d)
    every = relations(spark, d).unionByName(graph.long_edges({"transition": (t, "source_id", "target_id", F.col("pmi"), True)}))
    pairs = t.where(f"source_id % {CENTERS} = 0").select(F.col("source_id").alias("x"), F.col("target_id").alias("y"))
    return graph.explain_pair(every, pairs).withColumn("score", F.round("score", 6))


SYM_SQL = f"{TRANSITIONS_SQL}, sy as (select distinct node, other from (select source_id as node, target_id as other from t union all select target_id, source_id from t) where node <> other), dg as (select node, count(distinct other) as degree from sy group by 1)"


@query("degree", f"with {SYM_SQL} select node, degree from dg")
def degree(spark, d):
    return graph.degree(transitions(spark, d), "source_id", "target_id")


@query("degree_ceiling", f"with {SYM_SQL}, o as (select degree, row_number() over (order by degree) as r, count(*) over () as n from dg), c as (select degree as cap from o where r = floor(n * 0.95) + 1) select node, degree from dg, c where degree <= cap")
def degree_ceiling(spark, d):
    return graph.degree_ceiling(graph.degree(transitions(spark, d), "source_id", "target_id"))


def center_pairs(spark, d) -> DataFrame:
    return transitions(spark, d).where(f"source_id % {CENTERS} = 0 and source_id <> target_id").select(F.col("source_id").alias("x"), F.col("target_id").alias("y"))


CENTER_PAIRS_SQL = f"pr as (select distinct source_id as x, target_id as y from t where source_id % {CENTERS} = 0 and source_id <> target_id), sn as (select x, y, a.other as shared from pr join sy a on a.node = x join sy b on b.node = y and b.other = a.other)"


@query("shared_neighbors", f"with {SYM_SQL}, {CENTER_PAIRS_SQL} select x, y, shared from sn")
def shared_neighbors(spark, d):
    return graph.shared_neighbors(transitions(spark, d), "source_id", "target_id", center_pairs(spark, d))


@query(
    "adamic_adar",
    f"""with {SYM_SQL}, {CENTER_PAIRS_SQL}, q as (select x, y, shared, degree, round(1 / ln(degree), 3) as term from sn join dg on node = shared where degree >= 2),
w as (select *, round(sum(term) over (partition by x, y), 3) as aa from q), r as (select *, row_number() over (partition by x, y order by term desc, shared)::int as rank from w where aa >= 0.8)
select x, y, shared, degree, term, aa, rank from r where rank <= 5""",
)
def adamic_adar(spark, d):
    return graph.adamic_adar(transitions(spark, d), "source_id", "target_id", center_pairs(spark, d))


@query(
    "resource_allocation",
    f"with {SYM_SQL}, {CENTER_PAIRS_SQL} select x, y, round(sum(1 / degree), 6) as ra, round(sum(case when degree <= 1 then 1.0 else 1 / ln(degree) end), 6) as aa1, count(*) as n from sn join dg on node = shared group by 1, 2",
)
def resource_allocation(spark, d):
    r = graph.resource_allocation(transitions(spark, d), "source_id", "target_id", center_pairs(spark, d))
    return r.select("x", "y", F.round("ra", 6).alias("ra"), F.round("aa1", 6).alias("aa1"), "n")


def middles(spark, d) -> DataFrame:
    """Nodes that may stand between two others: known ones that are no collection of artists."""
    n = F.col("canonical_name")
    return table(spark, d, "artist").where(~n.like("Various%") & ~n.like("V/A%")).select(F.col("id").alias("node"))


@query(
    "two_hop_no_edge",
    f"""with {SYM_SQL}, va as (select id from artist where canonical_name like 'Various%' or canonical_name like 'V/A%'),
m as (select sy.*, degree from sy join dg using (node) where degree >= 2 and node in (select id from artist) and node not in (select id from va)),
p as (select a.other as x, b.other as y, sum(1 / ln(a.degree)) as aa, count(*) as middles from m a join m b on a.node = b.node and a.other < b.other group by 1, 2 having sum(1 / ln(a.degree)) >= 0.8)
select x, y, round(aa, 6) as aa, middles from p where not exists (select 1 from sy where node = x and other = y)""",
)
def two_hop_no_edge(spark, d):
    return graph.two_hop(transitions(spark, d), "source_id", "target_id", 0.8, middles(spark, d)).withColumn("aa", F.round("aa", 6))


@query("pmi_graph", f"with {TRANSITIONS_SQL} select least(source_id, target_id) as a, greatest(source_id, target_id) as b, arg_max(raw_count, source_id * 100000000 + target_id) as raw_count, arg_max(pmi, source_id * 100000000 + target_id) as pmi from t where raw_count >= 2 and pmi > 0 group by 1, 2")
def pmi_graph(spark, d):
    e = transitions(spark, d).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "raw_count", "pmi")
    return graph.pmi_graph(e, 2, ["source", "target"])


@query("transition_graph", f"with {TRANSITIONS_SQL}, v as (select id from artist where regexp_matches(canonical_name, '(?i)^\\s*various')) select source_id as source, target_id as target, raw_count from t where raw_count >= 2 and source_id not in (select id from v) and target_id not in (select id from v)")
def transition_graph(spark, d):
    e = transitions(spark, d).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "raw_count")
    va = table(spark, d, "artist").where(F.col("canonical_name").rlike(r"(?i)^\s*various")).select(F.col("id").alias("node"))
    return graph.transition_graph(e, va, 2)


def _pagerank_sql(rounds: int) -> str:
    steps = [f"""with {TRANSITIONS_SQL}, e as (select distinct source_id as s, target_id as t from t), v as (select distinct node from (select s as node from e union all select t from e)),
o as (select s, count(*) as out from e group by 1), n as (select count(*) as n from v), r0 as (select node, 1.0 / n::double as pr from v, n)"""]
    for k in range(rounds):
        steps.append(f"""g{k} as (select e.t as node, sum(r.pr / o.out) as gain from e join r{k} r on r.node = e.s join o on o.s = e.s group by 1),
l{k} as (select coalesce(sum(r.pr), 0) as lost from r{k} r left join o on o.s = r.node where o.s is null),
r{k + 1} as (select v.node, 0.15 / n + 0.85 * (coalesce(gain, 0) + lost / n) as pr from v left join g{k} g on g.node = v.node, n, l{k})""")
    return ", ".join(steps) + f" select node, round(pr, 9) as pagerank from r{rounds}"


@query("pagerank_k", _pagerank_sql(10))
def pagerank_k(spark, d):
    return graph.pagerank(transitions(spark, d), "source_id", "target_id", 10).withColumn("pagerank", F.round("pagerank", 9))


@query("communities")
def communities(spark, d):
    return graph.communities(transitions(spark, d).where("raw_count >= 2"), "source_id", "target_id", "raw_count")


@query("betweenness")
def betweenness(spark, d):
    return graph.betweenness(transitions(spark, d).where("raw_count >= 2"), "source_id", "target_id")


@query(
    "community_metadata",
    """with m as (select c_custkey as node, c_nationkey as community from customer), st as (select c_custkey as node, o_orderpriority as style from orders join customer on c_custkey = o_custkey group by 1, 2),
sz as (select community, count(*) as size from m group by 1),
sr as (select community, style, count(*) as c from m join st using (node) group by 1, 2), sk as (select *, row_number() over (partition by community order by c desc, style) as k from sr),
ge as (select community, c_mktsegment as genre, row_number() over (partition by community order by count(*) desc, c_mktsegment) as k from m join customer on c_custkey = node group by 1, 2),
pl as (select o_custkey as node, count(*) as plays from orders group by 1), ar as (select community, node, row_number() over (partition by community order by plays desc, node) as k from m join pl using (node))
select community, size, coalesce((select string_agg(style, ' / ' order by k) from (select style, k from sk where sk.community = sz.community and k <= 10 and style <> '1-URGENT' order by k limit 2)), (select genre from ge where ge.community = sz.community and k = 1), '') as label,
coalesce((select string_agg(style, '|' order by k) from sk where sk.community = sz.community and k <= 5), '') as top_genres,
coalesce((select string_agg(node::varchar, '|' order by k) from ar where ar.community = sz.community and k <= 5), '') as top_artists from sz""",
)
def community_metadata(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    members = c.select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("community"))
    styles = o.select(F.col("o_custkey").alias("node"), F.col("o_orderpriority").alias("style")).distinct()
    plays = o.groupBy(F.col("o_custkey").alias("node")).agg(F.count("*").alias("plays"))
    genres = c.select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("genre"))
    m = graph.community_metadata(members, styles, plays, genres, ["1-URGENT"])
    return m.withColumn("top_genres", F.array_join("top_genres", "|")).withColumn("top_artists", F.array_join(F.transform("top_artists", lambda x: x.cast("string")), "|"))


@query("cross_reference", """with c as (select id, presentation_name as name from library_code), r as (select id, library_code_id as code from library_release),
x as (select id as a, id + 3 as b, case when id % 2 = 0 then 'see ' || id end as comment from library_code), y as (select library_code_id as a, id as b, cast(null as varchar) as comment from library_release)
select a.name as artist_a, b.name as artist_b, coalesce(x.comment, '') as comment, 'library_code' as source from x join c a on a.id = x.a join c b on b.id = x.b where a.name <> b.name
union all select a.name, b.name, coalesce(y.comment, ''), 'release' from y join c a on a.id = y.a join r on r.id = y.b join c b on b.id = r.code where a.name <> b.name""")
def cross_reference(spark, d):
    codes = table(spark, d, "library_code").select("id", F.col("presentation_name").alias("name"))
    rel = table(spark, d, "library_release")
    x = codes.select(F.col("id").alias("a"), (F.col("id") + 3).alias("b"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("see "), F.col("id").cast("string"))).alias("comment"))
    y = rel.select(F.col("library_code_id").alias("a"), F.col("id").alias("b"), F.lit(None).cast("string").alias("comment"))
    return identity.code_xrefs(x, codes).unionByName(identity.release_xrefs(y, rel, codes))


@query("influence_edges", f"""with {TRANSITIONS_SQL}, q as (select 'Q' || (id % 900) as qid, canonical_name as name from artist), p as (select 'Q' || (source_id % 900) as s, 'Q' || (target_id % 900) as t from t where raw_count >= 3)
select a.name as source, b.name as target, min(p.s || '>' || p.t) as qids from p join q a on a.qid = p.s join q b on b.qid = p.t where a.name <> b.name group by 1, 2""")
def influence_edges(spark, d):
    qid = lambda c: F.concat(F.lit("Q"), (F.col(c) % 900).cast("string"))
    names = table(spark, d, "artist").select(qid("id").alias("qid"), F.col("canonical_name").alias("name"))
    pairs = transitions(spark, d).where("raw_count >= 3").select(qid("source_id").alias("source_qid"), qid("target_id").alias("target_qid"))
    e = identity.influence_edges(pairs, names)
    return e.select("source", "target", F.concat_ws(">", "source_qid", "target_qid").alias("qids"))


@query("label_hierarchy", """with l as (select p_partkey as id, p_brand as name, case when p_partkey % 3 <> 0 then 'Q' || p_brand end as qid from part),
o as (select name, coalesce(min(case when qid is not null then id end), min(id)) as id, min(qid) as qid from l group by 1),
k as (select distinct a.p_brand as p, b.p_brand as c from part a join part b on b.p_partkey = a.p_partkey + 1)
select distinct p.id as parent_id, c.id as child_id from k join o p on p.qid = 'Q' || k.p join o c on c.qid = 'Q' || k.c where p.id <> c.id""")
def label_hierarchy(spark, d):
    part = table(spark, d, "part")
    labels = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("Q"), "p_brand")).alias("qid"))
    links = part.alias("a").join(part.alias("b"), F.col("b.p_partkey") == F.col("a.p_partkey") + 1).select(F.concat(F.lit("Q"), "a.p_brand").alias("parent_qid"), F.concat(F.lit("Q"), "b.p_brand").alias("child_qid")).distinct()
    return identity.label_hierarchy(labels, links)


@query("edge_counts", f"with {JACCARD_SQL}, {TRANSITIONS_SQL}, e as (select a as id from j union all select b from j union all select source_id from t union all select target_id from t), ec as (select id, count(*) as edges from e group by 1) select a.id, coalesce(edges, 0) as edges from (select distinct id from artist) a left join ec on a.id = ec.id")
def edge_counts(spark, d):
    from playgraph.operators.stats import edge_counts as count

    return count({"style": (style_edges(spark, d), "a", "b"), "transition": (transitions(spark, d), "source_id", "target_id")}, table(spark, d, "artist"))
