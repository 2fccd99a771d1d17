"""The registered queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmerge.functions.text import default_name
from fieldmerge.operators import assemble, candidates, forest, validate
from fieldmerge.operators.components import components
from fieldmerge.operators.expand import numbered
from fieldmerge.plans import outcomes
from fieldmerge.plans.adjudicate import adjudicate, process_submissions
from fieldmerge.plans.settled import settled
from fieldmerge.sources.submissions import event_bodies, event_observations, order_bodies, order_fields, table


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(event_observations(spark, sf_dir))


def _links(spark: SparkSession, sf_dir: str, banded: bool = False) -> DataFrame:
    make = candidates.candidate_links_banded if banded else candidates.candidate_links
    return make(_observations(spark, sf_dir))


def _long(name: str):
    return F.col(name).cast("bigint").alias(name)


def observations_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observations(spark, sf_dir).select("submission_id", _long("uid"), _long("field_idx"), _long("particle_idx"), "field_name", "particle_id", "category", "local_x", "local_y", "filter_x", "filter_y")


def candidate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("submission_id", "category", "a_id", "b_id", "w")


def candidate_links_banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir, True).select("submission_id", "category", "a_id", "b_id", "w")


def link_counts_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.link_counts(_links(spark, sf_dir))


def component_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(settled(_links(spark, sf_dir))).select("submission_id", _long("uid"), _long("component"))


def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = settled(_links(spark, sf_dir))
    return candidates.component_sizes(links, components(links)).select("submission_id", _long("component"), "n_nodes", "n_links", "over_limit")


def best_forest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = adjudicate(_observations(spark, sf_dir))
    return forest.forest_values(done.chosen).select("submission_id", _long("component"), "n_links", _long("weight"))


def chosen_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = adjudicate(_observations(spark, sf_dir))
    return done.chosen.select("submission_id", _long("component"), "a_id", "b_id", F.col("w").alias("manhattan"))


def partner_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = adjudicate(_observations(spark, sf_dir))
    return forest.partner_lists(done.observations, done.chosen).select("submission_id", "particle_id", F.array_join("partners", ",").alias("partners"))


def final_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = adjudicate(_observations(spark, sf_dir))
    return done.particles.select("submission_id", _long("particle_no"), "category", "rep_x", "rep_y", _long("n_obs"), F.size("links").cast("bigint").alias("n_links"))


def particle_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = adjudicate(_observations(spark, sf_dir))
    return assemble.particle_observations(done.particles).select("submission_id", _long("particle_no"), _long("field_idx"), "field_name", "particle_id", "local_x", "local_y", "filter_x", "filter_y")


def submission_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = adjudicate(_observations(spark, sf_dir))
    fields = done.observations.groupBy("submission_id", "tolerance").agg(F.countDistinct("field_idx").alias("field_count"))
    return assemble.summaries(done.particles, fields)


def greedy_links_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and weight of the greedy choice in components where no field occurs twice; there it is the best forest, and
    the SQL takes that."""
    observations, links, parts = _labelled(spark, sf_dir)
    nodes = observations.join(parts, ["submission_id", "uid"])
    free = nodes.groupBy("submission_id", "component").agg((F.count("*") == F.countDistinct("field_idx")).alias("free")).where("free").drop("free")
    greedy = forest.forest_values(forest.greedy_links(observations, links, parts))
    return greedy.join(free, ["submission_id", "component"]).select("submission_id", _long("component"), "n_links", _long("weight"))


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    links = settled(_links(spark, sf_dir))
    return _observations(spark, sf_dir), links, settled(components(links))


def greedy_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy choice of every component, the first bound of an exact search."""
    return forest.greedy_links(*_labelled(spark, sf_dir)).select("submission_id", _long("component"), _long("a_uid"), _long("b_uid"), _long("w"))


def submission_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job over the events as JSON bodies."""
    done = process_submissions(event_bodies(spark, sf_dir))
    numbers = [_long_of(f"result.{c}", n) for c, n in (("observationCount", "observation_count"), ("linkCount", "link_count"), ("totalParticles", "total_particles"))]
    return done.select("submission_id", _long("status"), F.size("issues").cast("bigint").alias("n_issues"), *numbers)


def _long_of(expression: str, name: str):
    return F.col(expression).cast("bigint").alias(name)


def order_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job over the orders as JSON bodies: status and issues, one row for each issue (or one without)."""
    done = process_submissions(order_bodies(spark, sf_dir))
    return done.select("submission_id", _long("status"), F.posexplode_outer("issues").alias("ord", "issue")).select("submission_id", "status", _long("ord"), "issue.path", "issue.message")


def validation_issues_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = order_fields(spark, sf_dir).groupBy("submission_id").agg(F.countDistinct("field_idx").alias("n"))
    before, after = validate.SAY_FIELD_COUNT.split("{}")
    bad = counts.where((F.col("n") < validate.FEWEST_FIELDS) | (F.col("n") > validate.MOST_FIELDS))
    return bad.select("submission_id", F.lit("fields").alias("path"), F.concat(F.lit(before), F.col("n").cast("string"), F.lit(after)).alias("message"))


def _particle_path(member: str):
    return F.format_string("fields[%d].particles[%d]." + member, F.col("field_idx"), F.col("particle_idx"))


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = order_fields(spark, sf_dir).select("submission_id", "field_idx", "particle_idx", _particle_path("id").alias("path"), F.col("particle_id").alias("id"))
    return validate.repeated_ids(ids, ["field_idx", "particle_idx"])


def validation_issues_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeated(spark, sf_dir).select("submission_id", "path", validate.twice_message(F.col("id"), F.col("first_path")).alias("message"))


def _odd_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_fields(spark, sf_dir)
    axes = F.array(*(F.struct(F.lit(i).alias("axis"), _particle_path(c).alias("path"), F.col(c).cast("double").alias("value")) for i, c in enumerate("xy")))
    values = rows.select("submission_id", "field_idx", "particle_idx", F.explode(axes).alias("v")).select("submission_id", "field_idx", "particle_idx", "v.*")
    return values.where((F.col("value") != F.floor("value")) | (F.abs("value") > validate.MOST_COORDINATE))


def validation_issues_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _odd_coordinates(spark, sf_dir).select("submission_id", "path", F.lit(validate.SAY_COORDINATE).alias("message"))


def issues_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first validate.MOST_ISSUES issues of each order."""
    order = ["field_idx", "particle_idx", "axis"]
    odd = _odd_coordinates(spark, sf_dir).select("submission_id", *order, "path", F.lit(validate.SAY_COORDINATE).alias("message"))
    twice = _repeated(spark, sf_dir).select("submission_id", "field_idx", "particle_idx", F.lit(-1).alias("axis"), "path", validate.twice_message(F.col("id"), F.col("first_path")).alias("message"))
    return validate.capped(odd.unionByName(twice), order)


def normalise_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names padded with white space, every third blank, as they would be submitted, then trimmed and defaulted."""
    nation = table(spark, sf_dir, "nation")
    padded = F.when(F.col("n_nationkey") % 3 == 0, F.lit(" 　\t")).otherwise(F.concat(F.lit(" ﻿ "), F.col("n_name"), F.lit(" \n")))
    return nation.select("n_nationkey", default_name(padded, F.col("n_nationkey")).alias("field_name"))


QUERIES = {
    f.__name__: f
    for f in (
        observations_expand, candidate_links, candidate_links_banded, link_counts_limits, component_labels, component_sizes, greedy_links_bound, greedy_links, best_forest_value, chosen_links,
        partner_lists, final_particles, particle_observations, submission_summary, validation_issues_fields, validation_issues_ids, validation_issues_coords, issues_capped, normalise_names,
        submission_outcomes, order_issues,
    )
} | outcomes.QUERIES

_OBS = """
obs as (select user_id as sub, (event_id % 5)::int as f, event_type as cat, 'E' || event_id as id, floor(value / 5)::bigint as fx, extract(hour from ts)::bigint as fy,
  row_number() over (partition by user_id order by event_id % 5, event_id) - 1 as uid, row_number() over (partition by user_id, event_id % 5 order by event_id) - 1 as pidx from events)"""
_EDGES = (
    _OBS
    + """,
edges as (select a.sub, a.cat, a.uid as a, b.uid as b, a.id as ida, b.id as idb, abs(a.fx - b.fx) + abs(a.fy - b.fy) as w
  from obs a join obs b on a.sub = b.sub and a.cat = b.cat and a.f < b.f and abs(a.fx - b.fx) <= 2 and abs(a.fy - b.fy) <= 2)"""
)
_COMP = (
    _EDGES
    + """,
und as (select sub, a as u, b as v from edges union all select sub, b, a from edges),
reach as (select distinct sub, u, u as r from und union select reach.sub, reach.u, und.v from reach join und on und.sub = reach.sub and und.u = reach.r),
comp as (select sub, u, min(r) as c from reach group by 1, 2)"""
)
# every subset of a component's links is built up link by link; forests with different fields in each tree survive
_BEST = (
    _COMP
    + """,
member as (select comp.sub, c, u, f, id, row_number() over (partition by comp.sub, c order by u) as i from comp join obs on obs.sub = comp.sub and obs.uid = comp.u),
link as (select e.sub, x.c, x.i as a, y.i as b, w, ida, idb, row_number() over (partition by e.sub, x.c order by w, x.i, y.i) as k
  from edges e join member x on x.sub = e.sub and x.u = e.a join member y on y.sub = e.sub and y.u = e.b),
grown as (
  select sub, c, 0::bigint as k, list(i order by i) as tree, list(1 << f order by i) as taken, []::bigint[] as sel, 0::bigint as w from member group by sub, c
  union all
  select g.sub, g.c, l.k, case when use then list_transform(g.tree, lambda t: case when t = g.tree[l.b] then g.tree[l.a] else t end) else g.tree end,
    case when use then list_transform(g.taken, lambda x, j: case when j = g.tree[l.a] then x | g.taken[g.tree[l.b]] else x end) else g.taken end,
    case when use then list_append(g.sel, l.k) else g.sel end, g.w + case when use then l.w else 0 end
  from grown g join link l on l.sub = g.sub and l.c = g.c and l.k = g.k + 1, (values (true), (false)) choice(use)
  where not use or (g.tree[l.a] <> g.tree[l.b] and g.taken[g.tree[l.a]] & g.taken[g.tree[l.b]] = 0)),
last as (select sub, c, max(k) as k from link group by 1, 2),
best as (select *, row_number() over () as fid from (
  select g.*, len(g.sel) as n, rank() over (partition by g.sub, g.c order by len(g.sel) desc, g.w) as place from grown g join last using (sub, c, k)) where place = 1),
partners as (select best.fid, best.sub, best.c, member.i, coalesce(list_sort(list(case when l.a = member.i then l.idb else l.ida end) filter (l.k is not null)), []::varchar[]) as p
  from best join member on member.sub = best.sub and member.c = best.c
  left join link l on l.sub = best.sub and l.c = best.c and list_contains(best.sel, l.k) and (l.a = member.i or l.b = member.i) group by 1, 2, 3, 4),
least as (select fid from (select fid, row_number() over (partition by sub, c order by s) as r from (select fid, sub, c, list(p order by i) as s from partners group by 1, 2, 3)) where r = 1),
chosen as (select l.sub, l.c, l.ida, l.idb, l.w, x.u as ua, y.u as ub from least join best using (fid) join link l on l.sub = best.sub and l.c = best.c and list_contains(best.sel, l.k)
  join member x on x.sub = l.sub and x.c = l.c and x.i = l.a join member y on y.sub = l.sub and y.c = l.c and y.i = l.b)"""
)
_ROOTS = (
    _BEST
    + """,
tied as (select sub, ua as u, ub as v from chosen union all select sub, ub, ua from chosen),
same as (select distinct sub, u, u as r from tied union select same.sub, same.u, tied.v from same join tied on tied.sub = same.sub and tied.u = same.r),
root as (select sub, u, min(r) as root from same group by 1, 2),
placed as (select obs.*, coalesce(root.root, obs.uid) as root from obs left join root on root.sub = obs.sub and root.u = obs.uid),
parts as (select sub, root, row_number() over (partition by sub order by root) as particle_no, any_value(cat) as category, floor(avg(fx) * 100 + 0.5) / 100.0::double as rep_x,
  floor(avg(fy) * 100 + 0.5) / 100.0::double as rep_y, count(*) as n_obs from placed group by 1, 2),
n_links as (select chosen.sub, placed.root, count(*) as n_links from chosen join placed on placed.sub = chosen.sub and placed.uid = chosen.ua group by 1, 2)"""
)
_ORDERS = """
with fields as (select *, dense_rank() over (partition by l_orderkey order by l_linenumber % 5) - 1 as f from lineitem),
rows_ as (select *, row_number() over (partition by l_orderkey, f order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as p, l_orderkey || '-' || l_linenumber as id from fields),
twice as (select l_orderkey as submission_id, f, p, -1 as axis, 'fields[' || f || '].particles[' || p || '].id' as path,
  '颗粒编号“' || id || '”重复（首次出现于 ' || first_value('fields[' || f || '].particles[' || p || '].id') over o || '）' as message, row_number() over o as nth from rows_ window o as (partition by l_orderkey, id order by f, p)),
odd as (select l_orderkey as submission_id, f, p, axis, 'fields[' || f || '].particles[' || p || '].' || name as path, '颗粒坐标必须是 |v| ≤ 1000000 的整数' as message
  from (select *, 0 as axis, 'x' as name, l_extendedprice::double as v from rows_ union all select *, 1, 'y', l_quantity::double from rows_) where v <> floor(v) or abs(v) > 1000000)"""

# the same links in the same order, but each is taken if it can be
_GREEDY = (
    _BEST[: _BEST.index("grown as (")]
    + """
greedy as (
  select sub, c, 0::bigint as k, list(i order by i) as tree, list(1 << f order by i) as taken, false as took, 0::bigint as a, 0::bigint as b, 0::bigint as w from member group by sub, c
  union all
  select sub, c, k, case when can then list_transform(tree, lambda t: case when t = tree[b] then tree[a] else t end) else tree end,
    case when can then list_transform(taken, lambda x, j: case when j = tree[a] then x | taken[tree[b]] else x end) else taken end, can, a, b, w
  from (select g.sub, g.c, l.k, g.tree, g.taken, l.a, l.b, l.w, g.tree[l.a] <> g.tree[l.b] and g.taken[g.tree[l.a]] & g.taken[g.tree[l.b]] = 0 as can
    from greedy g join link l on l.sub = g.sub and l.c = g.c and l.k = g.k + 1))"""
)

ORACLE = {
    "greedy_links": f"with recursive {_GREEDY} select g.sub as submission_id, g.c as component, x.u as a_uid, y.u as b_uid, g.w from greedy g join member x on x.sub = g.sub and x.c = g.c and x.i = g.a join member y on y.sub = g.sub and y.c = g.c and y.i = g.b where took",
    "submission_outcomes": f"with recursive {_ROOTS}, l as (select sub, count(*) as n from chosen group by 1), o as (select sub, count(distinct f) between 3 and 5 as good, count(*) as n from obs group by 1), p as (select sub, count(*) as n from parts group by 1) select o.sub as submission_id, case when good then 200 else 400 end::bigint as status, case when good then 0 else 1 end::bigint as n_issues, case when good then o.n end as observation_count, case when good then coalesce(l.n, 0) end as link_count, case when good then p.n end as total_particles from o join p on p.sub = o.sub left join l on l.sub = o.sub",
    "order_issues": f"{_ORDERS}, all_ as (select submission_id, f, p, axis, path, message from twice where nth > 1 union all select * from odd union all select l_orderkey, -1, 0, 0, 'fields', '视野数量必须为 3 ~ 5 个，当前为 ' || count(distinct f) || ' 个' from rows_ group by 1 having count(distinct f) not between 3 and 5 union all select distinct l_orderkey, -2, 0, 0, 'tolerance', '容差必须是 0 ~ 1000000 的整数' from rows_ where l_orderkey % 5 = 0), n as (select *, row_number() over (partition by submission_id order by f, p, axis) - 1 as ord from all_) select o.submission_id, case when ord is null then 200 else 400 end::bigint as status, ord, path, message from (select distinct l_orderkey as submission_id from lineitem) o left join n on n.submission_id = o.submission_id and n.ord < 50",
    "observations_expand": f"with {_OBS} select sub as submission_id, uid, f::bigint as field_idx, pidx as particle_idx, 'F' || (f + 1) as field_name, id as particle_id, cat as category, fx - 100 * f as local_x, fy + 50 * f as local_y, fx as filter_x, fy as filter_y from obs",
    "candidate_links": f"with {_EDGES} select sub as submission_id, cat as category, ida as a_id, idb as b_id, w from edges",
    "candidate_links_banded": f"with {_EDGES} select sub as submission_id, cat as category, ida as a_id, idb as b_id, w from edges",
    "link_counts_limits": f"with {_EDGES} select sub as submission_id, count(*) as n_links, count(*) > 100000 as over_limit from edges group by 1",
    "component_labels": f"with recursive {_COMP} select sub as submission_id, u as uid, c as component from comp",
    "component_sizes": f"with recursive {_COMP}, e as (select comp.sub, c, count(*) as n_links from edges join comp on comp.sub = edges.sub and comp.u = edges.a group by 1, 2) select comp.sub as submission_id, comp.c as component, count(*) as n_nodes, any_value(n_links) as n_links, count(*) > 200 or any_value(n_links) > 5000 as over_limit from comp join e on e.sub = comp.sub and e.c = comp.c group by 1, 2",
    "greedy_links_bound": f"with recursive {_BEST}, free as (select sub, c from member group by 1, 2 having count(*) = count(distinct f)) select chosen.sub as submission_id, chosen.c as component, count(*) as n_links, sum(w)::bigint as weight from chosen join free on free.sub = chosen.sub and free.c = chosen.c group by 1, 2",
    "best_forest_value": f"with recursive {_BEST} select sub as submission_id, c as component, count(*) as n_links, sum(w)::bigint as weight from chosen group by 1, 2",
    "chosen_links": f"with recursive {_BEST} select sub as submission_id, c as component, ida as a_id, idb as b_id, w as manhattan from chosen",
    "partner_lists": f"with recursive {_BEST}, e as (select sub, ua as u, idb as p from chosen union all select sub, ub, ida from chosen) select obs.sub as submission_id, obs.id as particle_id, coalesce(string_agg(p, ',' order by p), '') as partners from obs left join e on e.sub = obs.sub and e.u = obs.uid group by 1, 2",
    "final_particles": f"with recursive {_ROOTS} select parts.sub as submission_id, particle_no, category, rep_x, rep_y, n_obs, coalesce(n_links, 0) as n_links from parts left join n_links on n_links.sub = parts.sub and n_links.root = parts.root",
    "particle_observations": f"with recursive {_ROOTS} select parts.sub as submission_id, particle_no, f::bigint as field_idx, 'F' || (f + 1) as field_name, id as particle_id, fx - 100 * f as local_x, fy + 50 * f as local_y, fx as filter_x, fy as filter_y from placed join parts on parts.sub = placed.sub and parts.root = placed.root",
    "submission_summary": f"with recursive {_ROOTS}, l as (select sub, count(*) as n from chosen group by 1), o as (select sub, count(distinct f) as nf, count(*) as n from obs group by 1), p as (select sub, count(*) as n from parts group by 1) select o.sub as submission_id, 2::bigint as tolerance, nf as field_count, o.n as observation_count, coalesce(l.n, 0) as link_count, p.n as total_particles from o join p on p.sub = o.sub left join l on l.sub = o.sub",
    "validation_issues_fields": "select l_orderkey as submission_id, 'fields' as path, '视野数量必须为 3 ~ 5 个，当前为 ' || count(distinct l_linenumber % 5) || ' 个' as message from lineitem group by l_orderkey having count(distinct l_linenumber % 5) not between 3 and 5",
    "validation_issues_ids": f"{_ORDERS} select submission_id, path, message from twice where nth > 1",
    "validation_issues_coords": f"{_ORDERS} select submission_id, path, message from odd",
    "issues_capped": f"{_ORDERS}, both_ as (select submission_id, f, p, axis, path, message from twice where nth > 1 union all select * from odd), n as (select *, row_number() over (partition by submission_id order by f, p, axis) - 1 as ord from both_) select submission_id, ord, path, message from n where ord < 50",
    "normalise_names": "select n_nationkey, case when n_nationkey % 3 = 0 then 'F' || (n_nationkey + 1) else n_name end as field_name from nation",
} | outcomes.oracle(_ROOTS)
