"""The registered queries and their SQL.

Matrices come from the star schema: what customers buy by brand, type or part,
and what users do by event.  Computed columns are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import diversity as D
from ..operators import matrix as M
from ..operators import network as G
from ..operators import normalize as N
from ..operators import pairs as P
from ..operators import select as C
from ..operators import stats as T
from ..operators import temporal as TN
from ..operators import tree as TR
from ..streaming import windows as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def bought(spark: SparkSession, d: str, by: str = "p_brand") -> DataFrame:
    """Quantities by customer and part column."""
    o, li, p = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "part")
    rows = li.select("l_orderkey", "l_partkey", "l_quantity").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    if by == "l_partkey":
        return rows.groupBy(F.col("o_custkey").alias("obs"), F.col("l_partkey").alias("attr")).agg(F.sum("l_quantity").alias("v"))
    rows = rows.join(p.select("p_partkey", by), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("o_custkey").alias("obs"), F.col(by).alias("attr")).agg(F.sum("l_quantity").alias("v"))


def by_nation(spark: SparkSession, d: str) -> DataFrame:
    """Quantities by customers' nation and brand."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("obs"), F.col("c_nationkey").alias("nation"))
    return bought(spark, d).join(c, "obs").groupBy(F.col("nation").alias("obs"), "attr").agg(F.sum("v").alias("v"))


def did(spark: SparkSession, d: str) -> DataFrame:
    """Events by user and type."""
    return table(spark, d, "events").groupBy(F.col("user_id").alias("obs"), F.col("event_type").alias("attr")).agg(F.count(F.lit(1)).cast("double").alias("v"))


def lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("attr"), F.col("p_size").cast("double").alias("length"))


def classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("obs"), F.col("c_mktsegment").alias("class"))


def rounded(df: DataFrame, *names: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), n) + F.lit(0.0) for c in names})


def _x(by: str) -> str:
    part = "l_partkey" if by == "l_partkey" else by
    return f"x as (select o_custkey as obs, {part} as attr, sum(l_quantity) as v from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1, 2)"


BRAND, TYPE, PART = _x("p_brand"), _x("p_type"), _x("l_partkey")
NATION = f"{BRAND}, z as (select c_nationkey as obs, attr, sum(v) as v from x join customer on obs = c_custkey group by 1, 2)"
DID = "x as (select user_id as obs, event_type as attr, cast(count(*) as double) as v from events group by 1, 2)"
DENSE = "g as (select o.obs, a.attr, coalesce(x.v, 0) as v from (select distinct obs from x) o cross join (select distinct attr from x) a left join x on x.obs = o.obs and x.attr = a.attr)"
r6 = lambda e: f"round({e}, 6) + 0.0"


# normalisation
for _name, _f, _expr in (
    ("n01_tss", N.tss, "v / nullif(sum(v) over w, 0)"),
    ("n02_center", N.center, "v - avg(v) over w"),
    ("n04_minmax", N.minmax, "coalesce((v - min(v) over w) / nullif(max(v) over w - min(v) over w, 0), 0)"),
):
    query(_name, f"with {BRAND} select obs, attr, {r6(_expr)} as v from x window w as (partition by obs)")(lambda s, d, f=_f: rounded(f(bought(s, d)), "v"))

query("n03_zscore", f"with {BRAND} select obs, attr, round((v - avg(v) over w) / nullif(stddev_pop(v) over w, 0), 7) + 0.0 as v from x window w as (partition by obs)")(lambda s, d: rounded(N.zscore(bought(s, d)), "v", n=7))
query("n05_quantile", f"with {BRAND}, {DENSE}, r as (select obs, attr, row_number() over (partition by obs order by v, attr) as f, rank() over (partition by obs order by v) as l, v from g), m as (select f, avg(v) as m from r group by f) select obs, attr, {r6('m')} as v from r join m on r.l = m.f")(lambda s, d: rounded(N.quantile(M.densify(bought(s, d))), "v"))
query("n07_css", f"with {BRAND}, q as (select *, quantile_cont(v, 0.5) over (partition by obs) as q from x where v <> 0), f as (select *, sum(case when v <= q then v end) over (partition by obs) / 1000 as f from q) select obs, attr, {r6('v / nullif(f, 0)')} as v from f")(lambda s, d: rounded(N.css(bought(s, d)), "v"))
query("n09_rpk", f"with {PART} select obs, attr, {r6('v / p_size')} as v from x join part on attr = p_partkey")(lambda s, d: rounded(N.rpk(bought(s, d, "l_partkey"), lengths(s, d)), "v"))
query("n09_fpkm", f"with {PART} select obs, attr, round(v * 1e9 / (sum(v) over (partition by obs) * p_size), 2) + 0.0 as v from x join part on attr = p_partkey")(lambda s, d: rounded(N.fpkm(bought(s, d, "l_partkey"), lengths(s, d)), "v", n=2))
query("n09_tpm", f"with {PART}, k as (select obs, attr, v / p_size as v from x join part on attr = p_partkey) select obs, attr, round(v * 1e6 / sum(v) over (partition by obs), 4) + 0.0 as v from k")(lambda s, d: rounded(N.tpm(bought(s, d, "l_partkey"), lengths(s, d)), "v", n=4))
query("n11_clr", f"with {BRAND} select obs, attr, {r6('ln(v) - avg(ln(v)) over (partition by obs)')} as v from x where v > 0")(lambda s, d: rounded(N.clr(bought(s, d)), "v"))
query("n12_xlr_median", f"with {BRAND} select obs, attr, {r6('ln(v) - quantile_cont(ln(v), 0.5) over (partition by obs)')} as v from x where v > 0")(lambda s, d: rounded(N.xlr(bought(s, d), None, "median"), "v"))
query("n13_iqlr", f"with {BRAND}, c as (select obs, attr, ln(v) - avg(ln(v)) over (partition by obs) as c, ln(v) as l from x where v > 0), s as (select attr, var_samp(c) as s from c group by attr), b as (select quantile_cont(s, 0.25) as lo, quantile_cont(s, 0.75) as hi from s), r as (select attr from s, b where s > lo and s < hi) select obs, c.attr, {r6('l - avg(case when r.attr is not null then l end) over (partition by obs)')} as v from c left join r on c.attr = r.attr")(lambda s, d: rounded(N.iqlr(bought(s, d)), "v"))
query("n14_ilr", f"with {BRAND}, {DENSE}, i as (select obs, row_number() over (partition by obs order by attr) - 1 as i, ln(v + 1) as l, avg(ln(v + 1)) over (partition by obs order by attr rows between unbounded preceding and 1 preceding) as m from g) select obs, i as attr, {r6('sqrt(i / (i + 1.0)) * (m - l)')} as v from i where i > 0")(lambda s, d: rounded(N.ilr(M.densify(bought(s, d)).withColumn("v", F.col("v") + 1)).withColumn("attr", F.col("attr").cast("long")), "v"))


# diversity
@query("a03_diversity", f"with {BRAND}, p as (select obs, v, v / sum(v) over (partition by obs) as p, row_number() over (partition by obs order by v, attr) as i from x where v > 0) select obs, {r6('-sum(p * log2(p))')} as entropy, count(*) as richness, count(*) filter (v = 1) as singletons, {r6('2 * sum(i * p) / count(*) - (count(*) + 1.0) / count(*)')} as gini from p group by obs")
def _a03(s, d):
    return rounded(D.alpha_diversity(bought(s, d)), "entropy", "gini")


query("a01_depth_richness", f"with {BRAND} select obs, sum(v) as depth, count(*) filter (v > 0) as richness from x group by obs")(lambda s, d: D.depth_richness(bought(s, d)))
query("a02_prevalence", f"with {BRAND}, k as (select attr, count(*) filter (v > 0) as k from x group by attr), n as (select count(distinct obs) as n from x) select t as tolerance, (select count(*) from k where k >= t) as n_attributes from (select unnest(range(1, n + 1)) as t from n)")(lambda s, d: D.prevalence(bought(s, d)))


@query("a03b_by_level", f"with {PART}, l as (select 'attr' as level, obs, cast(attr as varchar) as attr, v from x union all select 'p_type', obs, p_type, sum(v) from x join part on attr = p_partkey group by 2, 3 union all select 'p_brand', obs, p_brand, sum(v) from x join part on attr = p_partkey group by 2, 3), p as (select level, obs, v, v / sum(v) over (partition by level, obs) as p from l where v > 0) select level, obs, {r6('-sum(p * log2(p))')} as entropy, count(*) as richness, count(*) filter (v = 1) as singletons from p group by level, obs")
def _a03b(s, d):
    levels = table(s, d, "part").select(F.col("p_partkey").alias("attr"), "p_type", "p_brand")
    return rounded(D.alpha_by_level(bought(s, d, "l_partkey").withColumn("attr", F.col("attr")), levels, ["p_type", "p_brand"]), "entropy").drop("gini")


@query("a04_beta_diversity", f"with {NATION}, e as (select a.obs as node_a, b.obs as node_b, sum(abs(a.v - b.v)) as weight from z a join z b on a.attr = b.attr and a.obs < b.obs group by 1, 2), c as (select e.*, ca.n_regionkey as a, cb.n_regionkey as b from e join nation ca on node_a = ca.n_nationkey join nation cb on node_b = cb.n_nationkey) select 'Intra' as kind, a as class, count(*) as n, {r6('avg(weight)')} as mean from c where a = b group by a union all select 'Inter', k, count(*), {r6('avg(weight)')} from (select a as k, weight from c where a <> b union all select b, weight from c where a <> b) group by k")
def _a04(s, d):
    y = table(s, d, "nation").select(F.col("n_nationkey").alias("obs"), F.col("n_regionkey").alias("class"))
    rows = D.beta_diversity(P.pairwise(by_nation(s, d), "cityblock", axis=0), y)
    return rounded(rows.groupBy("kind", "class").agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("mean")), "mean")


@query("a05_kl", f"with {BRAND}, t as (select attr, c_mktsegment as c, sum(v) as v from x join customer on obs = c_custkey group by 1, 2), n as (select *, v / sum(v) over (partition by c) as p from t) select {r6('sum(a.p * log2(a.p / b.p))')} as kl from n a join n b using (attr) where a.c = 'BUILDING' and b.c = 'MACHINERY'")
def _a05(s, d):
    t = bought(s, d).join(classes(s, d), "obs").groupBy("attr", "class").agg(F.sum("v").alias("v"))
    return rounded(D.kullback_leibler(t.where("class = 'BUILDING'"), t.where("class = 'MACHINERY'")), "kl")


@query("a10_infer_taxonomy", f"with h as (select l_orderkey as grp, p_type as taxon, l_quantity as w from lineitem join part on l_partkey = p_partkey), v as (select grp, taxon, sum(w) / 100 as w, count(*) as hits from h group by 1, 2), r as (select *, w / sum(w) over (partition by grp) as score, rank() over (partition by grp order by w desc) as r from v) select grp, string_agg(taxon, '|' order by taxon) filter (r = 1) as taxa, round(max(score), 7) + 0.0 as score, cast(sum(hits) as bigint) as hits from r group by grp")
def _a10(s, d):
    li, p = table(s, d, "lineitem"), table(s, d, "part")
    hits = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("grp"), F.col("p_type").alias("taxon"), F.col("l_quantity").alias("identity"))
    return rounded(D.infer_taxonomy(hits).select("grp", F.concat_ws("|", "taxa").alias("taxa"), "score", "hits"), "score", n=7)


def _sets(s, d):
    o, li, c = table(s, d, "orders"), table(s, d, "lineitem"), table(s, d, "customer")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("c_nationkey").alias("set_name"), F.col("l_partkey").alias("feature")).distinct()


SETS = "s as (select distinct c_nationkey as set_name, l_partkey as feature from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)"
QUERY = "q as (select p_partkey as feature from part where p_size <= 10)"
query("a11_enrichment_overlap", f"with {SETS}, {QUERY} select set_name, count(*) as set_size, count(q.feature) as overlap, (select count(distinct feature) from s) as universe, (select count(*) from q) as query_size from s left join q on s.feature = q.feature group by set_name")(
    lambda s, d: D.enrichment(table(s, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("feature")), _sets(s, d)).select("set_name", "set_size", "overlap", "universe", "query_size")
)
query("a12_centroid", f"select p_type, {r6('avg(p_size)')} as p_size, {r6('avg(p_retailprice)')} as p_retailprice from part group by 1")(lambda s, d: rounded(D.group_centroids(table(s, d, "part"), "p_type", ["p_size", "p_retailprice"]), "p_size", "p_retailprice"))
query("a13_ellipse", f"with s as (select p_type, avg(p_size) as cx, avg(p_retailprice) as cy, var_samp(p_size) as a, covar_samp(p_size, p_retailprice) as b, var_samp(p_retailprice) as c from part group by 1), h as (select *, (a + c) / 2 as h, sqrt(power((a - c) / 2, 2) + b * b) as g from s) select p_type, {r6('cx')} as cx, {r6('cy')} as cy, {r6('6 * sqrt(h + g)')} as width, {r6('6 * sqrt(greatest(h - g, 0))')} as height from h")(
    lambda s, d: rounded(D.ellipses(table(s, d, "part").withColumn("p_size", F.col("p_size").cast("double")), "p_type", "p_size", "p_retailprice"), "cx", "cy", "width", "height").drop("theta")
)
query("a08_summary", f"with {BRAND} select attr, count(v) as n, sum(v) as sum, {r6('avg(v)')} as mean, {r6('stddev_samp(v) / sqrt(count(v))')} as sem, {r6('var_pop(v)')} as var from x group by attr")(lambda s, d: rounded(T.summary(bought(s, d), ["attr"]).select("attr", "n", "sum", "mean", "sem", "var"), "mean", "sem", "var"))

# reshaping and joins
query("pf01_query", "select p_partkey from part where p_size > 25 and p_type like 'S%'")(lambda s, d: M.where_all(table(s, d, "part"), {"p_size": lambda c: c > 25, "p_type": lambda c: c.startswith("S")}).select("p_partkey"))
query("pf03_filter_compositional", f"with {BRAND}, a as (select x.* from x join (select obs from x group by obs having sum(v) >= 200) using (obs)), b as (select a.* from a join (select attr from a group by attr having count(*) filter (v > 0) >= round_even((select count(distinct obs) from a) * 0.3, 0)) using (attr)), c as (select b.* from b join (select obs from b group by obs having count(*) filter (v > 0) >= 5) using (obs)), e as (select c.* from c join (select attr from c group by attr having sum(v) >= 10) using (attr)) select obs, attr, v from e")(
    lambda s, d: M.filter_compositional(bought(s, d), depth=200, prevalence=0.3, richness=5, count=10)
)
query("pf09_collapse", "select c_mktsegment, count(distinct c_custkey) as n from customer group by 1")(lambda s, d: M.collapse(table(s, d, "customer"), "c_mktsegment", "c_custkey").select("c_mktsegment", F.size("keys").cast("long").alias("n")))
query("pf10_group_columns", "with r as (select n_name, n_regionkey, row_number() over (partition by n_regionkey order by n_name) - 1 as row from nation) select row, max(n_name) filter (n_regionkey = 0) as \"0\", max(n_name) filter (n_regionkey = 1) as \"1\", max(n_name) filter (n_regionkey = 2) as \"2\", max(n_name) filter (n_regionkey = 3) as \"3\", max(n_name) filter (n_regionkey = 4) as \"4\" from r group by row")(
    lambda s, d: M.group_columns(table(s, d, "nation"), "n_name", "n_regionkey", [0, 1, 2, 3, 4]).withColumn("row", F.col("row").cast("long"))
)
query("pf12_first_of_key", "select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as n from lineitem) where n = 1")(lambda s, d: M.drop_duplicates(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_linenumber", "l_partkey"))
query("pf14_matmul", f"with {BRAND}, m as (select p_brand as obs, p_type as attr, cast(count(*) as double) as v from part group by 1, 2) select x.obs, m.attr, sum(x.v * m.v) as v from x join m on x.attr = m.obs group by 1, 2")(lambda s, d: M.matmul(bought(s, d), table(s, d, "part").groupBy(F.col("p_brand").alias("obs"), F.col("p_type").alias("attr")).agg(F.count(F.lit(1)).cast("double").alias("v"))))
query("pf16_otu_to_level", f"with {PART} select obs, p_type as attr, sum(v) as v from x join part on attr = p_partkey group by 1, 2")(lambda s, d: M.to_level(bought(s, d, "l_partkey"), table(s, d, "part").select(F.col("p_partkey").alias("attr"), "p_type"), "p_type"))
query("so05_venn", f"with {SETS}, t as (select distinct n_regionkey as set_name, feature from s join nation on set_name = n_nationkey) select sig as signature, count(*) as n from (select feature, string_agg(cast(set_name as varchar), '&' order by cast(set_name as varchar)) as sig from t group by feature) group by sig")(
    lambda s, d: M.venn(_sets(s, d).join(table(s, d, "nation"), F.col("set_name") == F.col("n_nationkey")).select(F.col("n_regionkey").cast("string").alias("set_name"), "feature"))
)

query("j03_semi", "select c_custkey from customer where c_custkey in (select o_custkey from orders)")(lambda s, d: table(s, d, "customer").select("c_custkey").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi"))
query("j04_anti", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 49)")(lambda s, d: table(s, d, "part").select("p_partkey").join(table(s, d, "lineitem").where("l_quantity > 49"), F.col("p_partkey") == F.col("l_partkey"), "left_anti"))
query("j10_adjacent", "select * from (select l_orderkey, l_linenumber, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as next_part from lineitem) where next_part is not null")(
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")).alias("next_part")).where("next_part is not null")
)
query("so03_difference", "select c_nationkey as k from customer except select s_nationkey from supplier where s_acctbal > 9000")(lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(table(s, d, "supplier").where("s_acctbal > 9000").select("s_nationkey")))
query("pf11_extend", f"with {DID}, k as (select distinct c_custkey as obs from customer) select coalesce(x.obs, k.obs) as obs, coalesce(sum(x.v), 0) as v from x full join k on x.obs = k.obs group by 1")(
    lambda s, d: M.extend(did(s, d).groupBy("obs").agg(F.sum("v").alias("v")), table(s, d, "customer").select(F.col("c_custkey").alias("obs")), "obs", {"v": 0.0})
)
query("pf13_symmetric", "with c as (select l_returnflag as a, l_linestatus as b, cast(count(*) as double) as v from lineitem group by 1, 2), u as (select a, b, v from c union all select b, a, v from c) select a as obs, b as attr, sum(v) / 2 as v from u group by 1, 2")(
    lambda s, d: M.symmetric(table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("obs"), F.col("l_linestatus").alias("attr")).agg(F.count(F.lit(1)).cast("double").alias("v")))
)
query("pf17_redundant", f"with {NATION}, e as (select a.obs as node_a, b.obs as node_b, sum(abs(a.v - b.v)) as weight from z a join z b on a.attr = b.attr and a.obs < b.obs group by 1, 2) select node_a, node_b, weight from e union all select node_b, node_a, weight from e union all select n, n, 0.0 from (select distinct obs as n from z)")(lambda s, d: M.redundant(P.pairwise(by_nation(s, d), "cityblock", axis=0), 0.0))

# pairs
for _name, _expr in (
    ("euclidean", "sqrt(sum((a.v - b.v) * (a.v - b.v)))"),
    ("cityblock", "sum(abs(a.v - b.v))"),
    ("chebyshev", "max(abs(a.v - b.v))"),
    ("cosine", "1 - sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v)))"),
    ("braycurtis", "sum(abs(a.v - b.v)) / sum(a.v + b.v)"),
    ("canberra", "sum(coalesce(abs(a.v - b.v) / nullif(a.v + b.v, 0), 0))"),
    ("hamming", "avg(case when a.v <> b.v then 1.0 else 0 end)"),
    ("jaccard", "sum(case when a.v <> b.v then 1.0 else 0 end) / sum(case when a.v <> 0 or b.v <> 0 then 1.0 else 0 end)"),
):
    query(f"pw02_{_name}", f"with {BRAND}, {DENSE} select a.attr as node_a, b.attr as node_b, {r6(_expr)} as weight from g a join g b on a.obs = b.obs and a.attr < b.attr group by 1, 2")(lambda s, d, m=_name: rounded(P.pairwise(M.densify(bought(s, d)), m), "weight"))
query("pw_pearson", f"with {BRAND}, {DENSE} select a.attr as node_a, b.attr as node_b, {r6('corr(a.v, b.v)')} as weight from g a join g b on a.obs = b.obs and a.attr < b.attr group by 1, 2")(lambda s, d: rounded(P.pairwise(M.densify(bought(s, d)), "pearson"), "weight"))
query("pw_spearman", f"with {BRAND}, {DENSE}, k as (select obs, attr, rank() over (partition by attr order by v) + (count(*) over (partition by attr, v) - 1) / 2.0 as v from g) select a.attr as node_a, b.attr as node_b, {r6('corr(a.v, b.v)')} as weight from k a join k b on a.obs = b.obs and a.attr < b.attr group by 1, 2")(lambda s, d: rounded(P.pairwise(M.densify(bought(s, d)), "spearman"), "weight"))
query("pw03_bicor", f"with {TYPE}, {DENSE}, d as (select obs, attr, v - median(v) over (partition by attr) as d from g), m as (select *, d / (9 * median(abs(d)) over (partition by attr)) as u from d), b as (select obs, attr, case when abs(u) < 1 then d * power(1 - u * u, 2) else 0 end as b from m), n as (select obs, attr, b / sqrt(sum(b * b) over (partition by attr)) as v from b) select x.attr as node_a, y.attr as node_b, {r6('sum(x.v * y.v)')} as weight from n x join n y on x.obs = y.obs and x.attr < y.attr group by 1, 2")(lambda s, d: rounded(P.pairwise(M.densify(bought(s, d, "p_type")), "bicor"), "weight"))
query("pw04_vlr", f"with {BRAND} select a.attr as node_a, b.attr as node_b, {r6('var_samp(ln(a.v) - ln(b.v))')} as weight from x a join x b on a.obs = b.obs and a.attr < b.attr group by 1, 2")(lambda s, d: rounded(P.vlr(bought(s, d)), "weight"))
for _name, _expr in (("rho", "1 - var_samp(a.c - b.c) / (var_samp(a.c) + var_samp(b.c))"), ("phi", "var_samp(a.c - b.c) / var_samp(a.c)")):
    query(f"pw04_{_name}", f"with {BRAND}, c as (select obs, attr, ln(v) - avg(ln(v)) over (partition by obs) as c from x) select a.attr as node_a, b.attr as node_b, {r6(_expr)} as weight from c a join c b on a.obs = b.obs and a.attr < b.attr group by 1, 2")(lambda s, d, m=_name: rounded(P.proportionality(bought(s, d), m), "weight"))


def _groups(s, d):
    """Nations of the first region as controls, all others as treatments."""
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("obs"), "n_regionkey")
    return n.where("n_regionkey = 0"), n.where("n_regionkey <> 0")


PAIRED = "z t join z c on t.attr = c.attr where c.obs in (select n_nationkey from nation where n_regionkey = 0) and t.obs in (select n_nationkey from nation where n_regionkey <> 0)"
query("pw06_difference", f"with {NATION} select t.obs as treatment, c.obs as control, t.attr, t.v - c.v as v from {PAIRED}")(lambda s, d: P.difference(by_nation(s, d), *_groups(s, d)))
query("pw07_logfc", f"with {NATION} select t.obs as treatment, c.obs as control, t.attr, {r6('log2(t.v) - log2(c.v)')} as v from {PAIRED}")(lambda s, d: rounded(P.log_fold_change(by_nation(s, d), *_groups(s, d)), "v"))
query("pw_mannwhitneyu")(lambda s, d: P.pairwise(M.densify(did(s, d)), "mannwhitneyu"))

# tests
WELCH = f"with {BRAND}, y as (select x.*, c_mktsegment as class from x join customer on obs = c_custkey), m as (select attr, avg(v) filter (class = 'BUILDING') as ma, var_samp(v) filter (class = 'BUILDING') as sa, count(v) filter (class = 'BUILDING') as na, avg(v) filter (class = 'MACHINERY') as mb, var_samp(v) filter (class = 'MACHINERY') as sb, count(v) filter (class = 'MACHINERY') as nb from y group by attr) select attr, round((ma - mb) / sqrt(sa / na + sb / nb), 6) + 0.0 as t, round(power(sa / na + sb / nb, 2) / (power(sa / na, 2) / (na - 1) + power(sb / nb, 2) / (nb - 1)), 6) + 0.0 as df from m"
query("s01_welch_t", WELCH)(lambda s, d: rounded(T.welch(bought(s, d).join(classes(s, d), "obs"), "class", "BUILDING", "MACHINERY").select("attr", "t", "df"), "t", "df"))


def _pvalues(s, d):
    """Reproducible p-values: a share of each part's price, some missing."""
    p = table(s, d, "part")
    return p.select("p_partkey", F.when(F.col("p_size") != 7, (F.col("p_partkey") * 7919 % 100003) / 100003.0).alias("p_value"))


PV = "p as (select p_partkey, case when p_size <> 7 then (p_partkey * 7919 % 100003) / 100003.0 end as p from part), r as (select *, count(p) over () as m, row_number() over (partition by p is null order by p) as r from p)"
for _name, _method, _expr in (
    ("bonferroni", "bonferroni", "p * m"),
    ("sidak", "sidak", "1 - power(1 - p, m)"),
    ("holm", "holm", "max(p * (m - r + 1)) over (partition by p is null order by p, r rows unbounded preceding)"),
    ("hochberg", "simes-hochberg", "min(p * (m - r + 1)) over (partition by p is null order by p desc, r desc rows unbounded preceding)"),
    ("bh", "fdr_bh", "min(p * m / r) over (partition by p is null order by p desc, r desc rows unbounded preceding)"),
    ("by", "fdr_by", "min(p * m / r * (select sum(1.0 / k) from range(1, (select count(p) + 1 from p)) t(k))) over (partition by p is null order by p desc, r desc rows unbounded preceding)"),
):
    query(f"s02_{_name}", f"with {PV} select p_partkey, case when p is not null then {r6(f'least(1.0, {_expr})')} end as q_value from r")(lambda s, d, m=_method: rounded(T.p_adjust(_pvalues(s, d), "p_value", m).select("p_partkey", "q_value"), "q_value"))
query("s03_symbols", f"with {PV} select p_partkey, case when p <= 0.0001 then '****' when p <= 0.001 then '***' when p <= 0.01 then '**' when p <= 0.05 then '*' when p > 0.05 then 'ns' else '' end as symbol from p")(lambda s, d: _pvalues(s, d).select("p_partkey", T.symbols(F.col("p_value")).alias("symbol")))

# networks
SIM = f"{BRAND}, {DENSE}, e as (select a.attr as node_a, b.attr as node_b, (corr(a.v, b.v) + 1) / 2 as weight from g a join g b on a.obs = b.obs and a.attr < b.attr group by 1, 2)"
DEGREE = "k as (select node, sum(weight) as k from (select node_a as node, weight from e union all select node_b, weight from e) group by node)"


def _similarity(s, d):
    return P.pairwise(M.densify(bought(s, d)), "pearson").withColumn("weight", (F.col("weight") + 1) / 2)


query("a16_connectivity", f"with {SIM}, {DEGREE} select node, {r6('k')} as k from k")(lambda s, d: rounded(G.connectivity(_similarity(s, d)), "k"))
query("a15_network_metrics", f"with {SIM}, {DEGREE} select {r6('sum(k) / (count(*) * (count(*) - 1))')} as density, {r6('count(*) * (max(k) - avg(k)) / ((count(*) - 1) * (count(*) - 2))')} as centralization, round(sqrt(greatest(0, count(*) * sum(k * k) / (sum(k) * sum(k)) - 1)), 4) + 0.0 as heterogeneity from k")(
    lambda s, d: rounded(rounded(G.metrics(G.connectivity(_similarity(s, d))), "density", "centralization"), "heterogeneity", n=4)
)
query("a17_intramodular", f"with {SIM}, b as (select node_a, node_b, weight from e union all select node_b, node_a, weight from e), c as (select attr as node, cast(right(attr, 1) as int) % 2 as cluster from (select distinct attr from x)) select b.node_a as node, ca.cluster, {r6('sum(weight)')} as k_total, {r6('sum(case when ca.cluster = cb.cluster then weight else 0 end)')} as k_within from b join c ca on node_a = ca.node join c cb on node_b = cb.node group by 1, 2")(
    lambda s, d: rounded(G.intramodular(_similarity(s, d), bought(s, d).select(F.col("attr").alias("node")).distinct().withColumn("cluster", F.expr("cast(right(node, 1) as int) % 2"))).select("node", "cluster", "k_total", "k_within"), "k_total", "k_within")
)
query("g01_scalefree_lm1")(lambda s, d: G.scale_free(G.connectivity(_similarity(s, d))))
query("g02_soft_threshold", f"with {SIM}, b as (select node_a as node, weight from e union all select node_b, weight from e), k as (select beta, node, sum(power(weight, beta)) as k from b cross join (select unnest([1,2,3,4,5,6,7,8,9,10,12,14,16,18,20,22,24,26,28]) as beta) group by 1, 2) select beta, {r6('avg(k)')} as mean_k, {r6('max(k)')} as max_k from k group by beta")(lambda s, d: rounded(G.soft_threshold(_similarity(s, d)).select("beta", "mean_k", "max_k"), "mean_k", "max_k"))
query("g03_tom", f"with {SIM}, {DEGREE}, b as (select node_a, node_b, weight from e union all select node_b, node_a, weight from e), l as (select p.node_a, q.node_b, sum(p.weight * q.weight) as l from b p join b q on p.node_b = q.node_a where p.node_a < q.node_b group by 1, 2) select e.node_a, e.node_b, {r6('(coalesce(l, 0) + weight) / (least(ka.k, kb.k) + 1 - weight)')} as weight from e left join l on e.node_a = l.node_a and e.node_b = l.node_b join k ka on e.node_a = ka.node join k kb on e.node_b = kb.node")(lambda s, d: rounded(G.topological_overlap(_similarity(s, d)), "weight"))


@query("g03_tom_blocks", f"with v as (select vec_id as n, cast(embedding as double[64]) as e from embeddings), e as (select a.n as node_a, b.n as node_b, power((1 + array_cosine_similarity(a.e, b.e)) / 2, 6) as weight from v a join v b on a.n < b.n), b as (select node_a, node_b, weight from e union all select node_b, node_a, weight from e), k as (select node_a as node, sum(weight) as k from b group by 1), l as (select p.node_a, q.node_b, sum(p.weight * q.weight) as l from b p join b q on p.node_b = q.node_a where p.node_a < q.node_b group by 1, 2) select e.node_a, e.node_b, {r6('(coalesce(l, 0) + weight) / (least(ka.k, kb.k) + 1 - weight)')} as weight from e left join l on e.node_a = l.node_a and e.node_b = l.node_b join k ka on e.node_a = ka.node join k kb on e.node_b = kb.node")
def _g03_blocks(s, d):
    from ..operators import blocks as B

    vectors = table(s, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("vec"))
    return B.similarity_overlap(vectors, 6.0, digits=6)


def _partitions(s, d):
    return table(s, d, "nation").select(F.explode(F.array(*[F.lit(i) for i in range(6)])).alias("iter"), F.col("n_name").alias("node"), F.expr("n_nationkey").alias("k")).select("iter", "node", ((F.col("k") * (F.col("iter") + 3)) % (F.col("iter") + 2)).alias("cluster"))


query("g04_cooccurrence", f"with p as (select i as iter, n_name as node, (n_nationkey * (i + 3)) % (i + 2) as cluster from nation cross join (select unnest(range(6)) as i)) select a.node as node_a, b.node as node_b, {r6('avg(case when a.cluster = b.cluster then 1.0 else 0 end)')} as weight from p a join p b on a.iter = b.iter and a.node < b.node group by 1, 2")(lambda s, d: rounded(G.cooccurrence(_partitions(s, d)), "weight"))
query("g05_community_detection")(lambda s, d: G.community_detection(_similarity(s, d).withColumn("weight", F.pow("weight", F.lit(6))), 5))
query("g06_ensemble_network")(lambda s, d: G.ensemble(bought(s, d, "p_type"), n_iter=1000, fill=0.0))
query("g08_axis_connections", f"with {SIM}, b as (select node_a, node_b, weight from e union all select node_b, node_a, weight from e) select node_a as node, left(node_b, 7) as axis, {r6('sum(weight)')} as weight from b group by 1, 2")(lambda s, d: rounded(G.axis_connections(_similarity(s, d), bought(s, d).select(F.col("attr").alias("node")).distinct().withColumn("axis", F.expr("left(node, 7)"))), "weight"))


# temporal networks
def _contacts(s, d):
    e = table(s, d, "events").select("user_id", F.expr("cast(datediff(ts, timestamp '2024-01-01') as double)").alias("t"), "event_type").distinct()
    a, b = e.withColumnRenamed("event_type", "node_a"), e.withColumnRenamed("event_type", "node_b")
    return a.join(b, ["user_id", "t"]).where("node_a < node_b").groupBy("t", "node_a", "node_b").agg(F.count(F.lit(1)).cast("double").alias("weight"))


CONTACTS = "u as (select distinct user_id, cast(date_diff('day', timestamp '2024-01-01', ts) as double) as t, event_type as n from events), c as (select a.t, a.n as node_a, b.n as node_b, cast(count(*) as double) as weight from u a join u b on a.user_id = b.user_id and a.t = b.t and a.n < b.n group by 1, 2, 3)"
query("g10_intercontact_times", f"with {CONTACTS} select * from (select node_a, node_b, t, t - lag(t) over (partition by node_a, node_b order by t) as gap from c) where gap is not null")(lambda s, d: TN.intercontact_times(_contacts(s, d)))
query("g10_burstiness", f"with {CONTACTS}, g as (select node_a, node_b, t - lag(t) over (partition by node_a, node_b order by t) as gap from c) select node_a, node_b, {r6('(stddev_pop(gap) - avg(gap)) / nullif(stddev_pop(gap) + avg(gap), 0)')} as burstiness from g where gap is not null group by 1, 2")(lambda s, d: rounded(TN.burstiness(_contacts(s, d)), "burstiness"))
query("g10_temporal_degree", f"with {CONTACTS} select node, t, sum(weight) as degree from (select t, node_a as node, weight from c union all select t, node_b, weight from c) group by 1, 2")(lambda s, d: TN.temporal_degree(_contacts(s, d)))
query("g10_fluctuability", f"with {CONTACTS} select {r6('count(distinct node_a || node_b) / cast(count(*) as double)')} as fluctuability from c")(lambda s, d: rounded(TN.fluctuability(_contacts(s, d)), "fluctuability"))
query("g10_intertemporal", f"with {CONTACTS}, n as (select distinct t, node from (select t, node_a as node from c union all select t, node_b from c)) select * from (select t, node, lead(t) over (partition by node order by t) as t_next from n) where t_next is not null")(lambda s, d: TN.intertemporal(_contacts(s, d)).select("t", "node", "t_next"))


# sequences, nesting, windows
def _dna(s, d):
    """Texts as bases: letters in turn, all else N."""
    return table(s, d, "documents").select(F.col("doc_id").alias("seq_id"), F.regexp_replace(F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"), "[^ACGT]", "N").alias("seq"))


DNA = "q as (select doc_id as seq_id, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', 'N', 'g') as seq from documents)"
query("k_kmers", f"with {DNA}, k as (select seq_id, substr(seq, i, 4) as kmer from (select seq_id, seq, unnest(range(1, length(seq) - 2)) as i from q)), c as (select seq_id, kmer, count(*) as n from k where regexp_full_match(kmer, '[ACGT]+') group by 1, 2) select seq_id, kmer, {r6('n / sum(n) over (partition by seq_id)')} as v from c")(lambda s, d: rounded(S.count_kmers(_dna(s, d)), "v"))
query("k_revcomp", "select p_partkey, reverse(translate(upper(p_name), 'ACGT', 'TGCA')) as rc from part")(lambda s, d: table(s, d, "part").select("p_partkey", S.reverse_complement(F.upper("p_name")).alias("rc")))
query("json_props", "select event_type, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as k from events group by 1")(lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k")))
query("w02_top_n", f"with {BRAND}, t as (select attr, sum(v) as v from x group by attr) select attr, v from t order by v desc, attr limit (select cast(round_even(count(*) * 0.3, 0) as bigint) from t)")(
    lambda s, d: bought(s, d).groupBy("attr").agg(F.sum("v").alias("v")).withColumns({"r": F.row_number().over(Window.orderBy(F.desc("v"), "attr")), "n": F.count(F.lit(1)).over(Window.partitionBy())}).where("r <= bround(n * 0.3)").select("attr", "v")
)
query("w04_running_max", "with r as (select o_orderkey as n, o_totalprice as accuracy, max(o_totalprice) over (order by o_orderkey rows between unbounded preceding and 1 preceding) as b from orders) select n, accuracy from r where b is null or accuracy > b")(lambda s, d: C.progressive(table(s, d, "orders").select(F.col("o_orderkey").alias("n"), F.col("o_totalprice").alias("accuracy"))))
query("w05_cumulative", f"select p_brand, {r6('sum(n) over (order by n desc, p_brand rows unbounded preceding) / sum(n) over ()')} as share from (select p_brand, count(*) as n from part group by 1)")(
    lambda s, d: rounded(table(s, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).select("p_brand", (F.sum("n").over(Window.orderBy(F.desc("n"), "p_brand").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy())).alias("share")), "share")
)
query("w06_path_product", "with e as (select n_nationkey as obs, (n_nationkey % 5 + 1) / 10.0 as p, (n_nationkey % 3 + 1) / 10.0 as q from nation) select obs, 'a' as target, round(p * q / (p * q + (1 - p)), 6) + 0.0 as p from e union all select obs, 'b', round((1 - p) / (p * q + (1 - p)), 6) + 0.0 from e")(lambda s, d: _paths(s, d))


def _paths(s, d):
    e = table(s, d, "nation").select(F.col("n_nationkey").alias("obs"), ((F.col("n_nationkey") % 5 + 1) / 10.0).alias("p"), ((F.col("n_nationkey") % 3 + 1) / 10.0).alias("q"))
    rows = e.select("obs", F.explode(F.array(F.struct(F.lit("root").alias("parent"), F.lit("x").alias("child"), F.col("p").alias("p")), F.struct(F.lit("root").alias("parent"), F.lit("b").alias("child"), (1 - F.col("p")).alias("p")), F.struct(F.lit("x").alias("parent"), F.lit("a").alias("child"), F.col("q").alias("p")))).alias("e")).select("obs", "e.*")
    paths = s.createDataFrame([("a", "root", "x"), ("a", "x", "a"), ("b", "root", "b")], "target string, parent string, child string")
    return rounded(C.path_probabilities(rows, paths), "p")


query("st_depth_richness", f"select time_bucket(interval '1 hour', ts) as start, user_id, {r6('sum(value)')} as depth, count(*) as n, count(distinct event_type) as richness from events group by 1, 2")(lambda s, d: rounded(W.depth_richness(table(s, d, "events")), "depth"))


query("s08_volcano", f"with {NATION}, y as (select z.*, n_regionkey = 0 as c from z join nation on obs = n_nationkey), m as (select attr, log2(avg(v) filter (not c)) - log2(avg(v) filter (c)) as x, (length(attr) * 7919 + ascii(right(attr, 1)) * 104729) % 997 / 997.0 as p from y group by attr) select attr, {r6('x')} as x, {r6('-log2(p)')} as y, abs(x) >= 0.1 and p < 0.5 as significant from m")(lambda s, d: _volcano(s, d))


def _volcano(s, d):
    y = by_nation(s, d).join(table(s, d, "nation").select(F.col("n_nationkey").alias("obs"), (F.col("n_regionkey") == 0).alias("c")), "obs")
    m = y.groupBy("attr").agg((F.log2(F.avg(F.when(~F.col("c"), F.col("v")))) - F.log2(F.avg(F.when(F.col("c"), F.col("v"))))).alias("x"))
    m = m.withColumn("p", (F.length("attr") * 7919 + F.ascii(F.right("attr", F.lit(1))) * 104729) % 997 / 997.0)
    return rounded(T.volcano(m, "x", "p", 0.1, 0.5).drop("p"), "x", "y")


query("d_components", "with m as (select distinct p_partkey, p_brand || '|' || p_type as component from part) select o_custkey as obs, component as attr, sum(l_quantity) as v from lineitem join orders on l_orderkey = o_orderkey join m on l_partkey = p_partkey group by 1, 2")(lambda s, d: _components(s, d))


def _components(s, d):
    from ..operators import components as K

    p = table(s, d, "part")
    members = K.assign(p.select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("taxon")), p.select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("function")))
    return K.component_counts(bought(s, d, "l_partkey"), members)


@query("s04_differential_abundance")
def _s04(s, d):
    from ..operators import differential as DA

    y = classes(s, d).withColumn("class", F.when(F.col("class") == "BUILDING", "ref").otherwise("case"))
    x = bought(s, d, "p_type")
    return DA.likelihood_ratio(x, y.join(x.select("obs").distinct(), "obs", "left_semi"), "ref")


# models, trees and ordination: rows only, tested against invariants
def _embedded(s, d):
    e = table(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("obs"), F.posexplode("embedding").alias("attr", "v")).withColumn("v", F.col("v").cast("double"))


@query("o01_pca")
def _o01(s, d):
    from ..operators.ordination import pca

    return pca(_embedded(s, d), scale=True).explained


@query("o02_pcoa")
def _o02(s, d):
    from ..operators.ordination import pcoa

    labels, xy, share = pcoa(P.pairwise(M.densify(bought(s, d)), "braycurtis"))
    return s.createDataFrame([(a, float(p[0]), float(p[1])) for a, p in zip(labels, xy, strict=True)], "attr string, pc1 double, pc2 double")


@query("t01_linkage")
def _t01(s, d):
    return TR.merge_table(P.pairwise(M.densify(bought(s, d)), "euclidean"), "average")[1]


@query("r01_glm")
def _r01(s, d):
    from ..operators.regress import glm

    meta = table(s, d, "customer").select(F.col("c_custkey").alias("obs"), "c_acctbal", "c_mktsegment")
    return glm(bought(s, d, "p_type"), meta, ["c_acctbal", "c_mktsegment"])


@query("r02_mixed")
def _r02(s, d):
    from ..operators.regress import mixed

    meta = table(s, d, "customer").select(F.col("c_custkey").alias("obs"), "c_acctbal", "c_nationkey")
    return mixed(bought(s, d, "p_type"), meta.withColumn("c_acctbal", F.col("c_acctbal") / 1000), ["c_acctbal"], "c_nationkey")


@query("c08_feature_weights")
def _c08(s, d):
    y = table(s, d, "embeddings").select(F.col("vec_id").alias("obs"), F.col("label").cast("string").alias("class"))
    k = C.kernel(_embedded(s, d), y, "logistic", n_iter=10)
    return C.weights(k)


from . import extra  # noqa: E402, F401  (registers more, with the tables above)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
