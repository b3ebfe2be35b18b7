"""More registered queries with their SQL: readers over fixtures, normalisers, tests, trees, helpers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import collections as U
from ..functions import sequences as S
from ..operators import components as K
from ..operators import diversity as D
from ..operators import matrix as M
from ..operators import network as G
from ..operators import normalize as N
from ..operators import pairs as P
from ..operators import select as C
from ..operators import stats as T
from ..operators import temporal as TN
from ..operators import tree as TR
from ..sources import readers as R
from ..storage import new_folder
from .catalog import BRAND, CONTACTS, DENSE, DID, NATION, PV, QUERY, SETS, TYPE, WELCH, _contacts, _pvalues, _sets, bought, by_nation, classes, did, query, r6, rounded, table

# matrices
query("pf02_any", "select p_partkey from part where p_size > 45 or p_type like 'S%'")(lambda s, d: M.where_all(table(s, d, "part"), {"p_size": lambda c: c > 45, "p_type": lambda c: c.startswith("S")}, "any").select("p_partkey"))
query("pf08_prepend", f"with {DID} select 'events' as level, obs, attr, v from x")(lambda s, d: M.prepend_level(did(s, d), "level", "events"))
query("pf15_transpose", f"with {BRAND} select attr as obs, obs as attr, v from x")(lambda s, d: M.transpose(bought(s, d)))
query("j09_densify", f"with {DID}, {DENSE} select obs, attr, v from g")(lambda s, d: M.densify(did(s, d)))
query("a09_functional_potential", f"with {NATION}, r as (select p_brand, p_type, avg(p_size) / 50.0 as r from part group by 1, 2) select obs, p_type as attr, {r6('sum(v * r)')} as v from z join r on attr = p_brand group by 1, 2")(
    lambda s, d: rounded(K.functional_potential(by_nation(s, d), table(s, d, "part").groupBy(F.col("p_brand").alias("obs"), F.col("p_type").alias("attr")).agg((F.avg("p_size") / 50.0).alias("v"))), "v")
)


def _members(s, d):
    p = table(s, d, "part")
    return K.assign(p.select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("taxon")), p.where("p_size > 5").select(F.col("p_partkey").alias("gene"), F.col("p_type").alias("function")))


query("a08_component_metadata", f"with m as (select p_brand as taxon, case when p_size > 5 then p_type else 'unknown_function_collective' end as function, p_size from part) select taxon || '|' || function as component, taxon, function, count(*) as n, cast(sum(p_size) as double) as sum, {r6('avg(p_size)')} as mean from m group by taxon, function")(
    lambda s, d: rounded(K.component_metadata(_members(s, d), table(s, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_size").alias("length"))).select("component", "taxon", "function", "n", "sum", "mean"), "mean")
)

# normalisation
query("n08_dispatch_by_attribute", f"with {BRAND} select obs, attr, {r6('v / sum(v) over (partition by attr)')} as v from x")(lambda s, d: rounded(N.normalize(bought(s, d), "tss", axis=0), "v"))
query("n12_xlr_hmean", f"with {BRAND} select obs, attr, {r6('ln(v) - ln(count(*) over (partition by obs) / sum(1 / v) over (partition by obs))')} as v from x where v > 0")(lambda s, d: rounded(N.xlr(bought(s, d), None, "hmean"), "v"))
query("n12_xlr_reference", f"with {BRAND} select obs, attr, {r6('ln(v) - avg(case when attr < ' + repr('Brand#3') + ' then ln(v) end) over (partition by obs)')} as v from x where v > 0")(
    lambda s, d: rounded(N.xlr(bought(s, d), table(s, d, "part").where("p_brand < 'Brand#3'").select(F.col("p_brand").alias("attr")).distinct()), "v")
)
query("n16_clr_of_zeros", f"with {DID}, {DENSE}, n as (select count(distinct attr) as m, count(*) filter (v = 0) as zeros from g), c as (select obs, attr, ln(v + case when zeros > 0 then 1.0 / (m * m) else 0 end) as l from g, n) select obs, attr, {r6('l - avg(l) over (partition by obs)')} as v from c")(lambda s, d: rounded(N.transform(M.densify(did(s, d)), "clr"), "v"))
query("n10_rle", f"with {NATION}, n as (select count(distinct obs) as n from z), g as (select attr, avg(ln(v)) as g from z where v > 0 group by attr having count(*) = (select n from n)), l as (select obs, sum(v) as lib from z group by 1), f as (select obs, quantile_cont(v / exp(g), 0.5) as f from z join g using (attr) group by 1), r as (select obs, lib, f / lib as f from f join l using (obs)) select obs, lib, {r6('f / exp(avg(ln(f)) over ())')} as factor from r")(lambda s, d: rounded(N.size_factors(by_nation(s, d), "rle"), "factor"))
query("n10_upperquartile", f"with {NATION}, x2 as (select * from z), q as (select o.obs, a.attr, coalesce(z.v, 0) as v from (select distinct obs from z) o cross join (select attr from z group by 1 having sum(v) > 0) a left join z on z.obs = o.obs and z.attr = a.attr), r as (select obs, lib, quantile_cont(q.v, 0.75) / lib as f from q join (select obs, sum(v) as lib from z group by 1) using (obs) group by 1, 2) select obs, lib, {r6('f / exp(avg(ln(f)) over ())')} as factor from r")(
    lambda s, d: rounded(N.size_factors(by_nation(s, d), "upperquartile"), "factor")
)

# tests: tails by numerical integration, sums of logarithms, or all pairs
query("s01_welch_p", f"with w as ({WELCH.replace('round((ma', '((ma').replace('/ nb), 6) + 0.0 as t', '/ nb)) as t').replace('round(power', '(power').replace('(nb - 1)), 6) + 0.0 as df', '(nb - 1))) as df')}), k as (select *, exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) as c, abs(t) / 400 as h from w), i as (select attr, sum(case when j in (0, 400) then 1 when j % 2 = 1 then 4 else 2 end * c * power(1 + j * h * j * h / df, -(df + 1) / 2)) * max(h) / 3 as area from k cross join range(0, 401) r(j) group by attr) select attr, {r6('1 - 2 * area')} as p_value from i")(
    lambda s, d: rounded(T.welch(bought(s, d).join(classes(s, d), "obs"), "class", "BUILDING", "MACHINERY").select("attr", "p_value"), "p_value")
)
HOLM_SIDAK = "max(1 - power(1 - p, m - r + 1)) over (partition by p is null order by p, r rows unbounded preceding)"
query("s02_holm_sidak", f"with {PV} select p_partkey, case when p is not null then {r6(f'least(1.0, {HOLM_SIDAK})')} end as q_value from r")(lambda s, d: rounded(T.p_adjust(_pvalues(s, d), "p_value", "holm-sidak").select("p_partkey", "q_value"), "q_value"))
for _name, _level, _more in (("tsbh", "0.05", "1"), ("tsbky", "0.05 / 1.05", "1.05")):
    query(f"s02_fdr_{_name}", f"with {PV}, b as (select *, min(p * m / r) over (partition by p is null order by p desc, r desc rows unbounded preceding) as b from r), n as (select count(*) filter (b <= {_level}) as k, max(m) as m from b where p is not null) select p_partkey, case when p is not null then {r6(f'least(1.0, b * {_more} * case when n.k > 0 and n.k < n.m then (n.m - n.k) * 1.0 / n.m else 1 end)')} end as q_value from b, n")(
        lambda s, d, m=_name: rounded(T.p_adjust(_pvalues(s, d), "p_value", f"fdr_{m}").select("p_partkey", "q_value"), "q_value")
    )
query("s02_hommel", f"with {PV}, o as (select p_partkey, p, r, m from r where p is not null), q1 as (select s.m - (s.m - s.k) as k, min(s.k * o.p / (o.r - (o.m - s.k))) as q from (select m, unnest(range(2, m)) as k from (select max(m) as m from o)) s join o on o.r > o.m - s.k + 1 group by 1), h as (select k, least(k * p, q) as edge, q from q1 join o on r = m - k + 1), a as (select o.p_partkey, max(case when o.r <= o.m - h.k + 1 then least(h.k * o.p, h.q) else h.edge end) as q from o cross join h group by 1), z as (select min(m * p / r) as z from o) select p.p_partkey, {r6('least(1.0, greatest(a.q, z.z, p.p))')} as q_value from p left join a using (p_partkey) cross join z where p.p is not null union all select p_partkey, null from p where p is null")(
    lambda s, d: rounded(T.p_adjust(_pvalues(s, d), "p_value", "hommel").select("p_partkey", "q_value"), "q_value")
)
query("a11_enrichment", f"with {SETS}, {QUERY}, c as (select set_name, count(*) as n, count(q.feature) as k from s left join q on s.feature = q.feature group by set_name), t as (select (select count(distinct feature) from s) as big, (select count(*) from q) as draws), u as (select set_name, n, k, big, draws, unnest(range(greatest(k, draws + n - big, 0), least(n, draws) + 1)) as j from c, t) select set_name, {r6('least(1.0, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + lgamma(big - n + 1) - lgamma(draws - j + 1) - lgamma(big - n - draws + j + 1) - lgamma(big + 1) + lgamma(draws + 1) + lgamma(big - draws + 1))))')} as p_value from u group by set_name")(
    lambda s, d: rounded(D.enrichment(table(s, d, "part").where("p_size <= 10").select(F.col("p_partkey").alias("feature")), _sets(s, d)).select("set_name", "p_value"), "p_value")
)
query("pw_kendall", f"with {DID}, {DENSE}, p as (select a.attr as node_a, b.attr as node_b, a.obs, a.v as x, b.v as y from g a join g b on a.obs = b.obs and a.attr < b.attr) select p.node_a, p.node_b, {r6('sum(sign(p.x - q.x) * sign(p.y - q.y)) / sqrt(sum(abs(sign(p.x - q.x))) * sum(abs(sign(p.y - q.y))))')} as weight from p join p q on p.node_a = q.node_a and p.node_b = q.node_b group by 1, 2")(lambda s, d: rounded(P.pairwise(M.densify(did(s, d)), "kendall"), "weight"))

# temporal networks
query("g10_local_variation", f"with {CONTACTS}, g as (select node_a, node_b, t, t - lag(t) over (partition by node_a, node_b order by t) as gap from c), h as (select node_a, node_b, gap, lead(gap) over (partition by node_a, node_b order by t) as after from g where gap is not null) select node_a, node_b, {r6('3 * avg(power((gap - after) / (gap + after), 2))')} as local_variation from h where after is not null group by 1, 2")(lambda s, d: rounded(TN.local_variation(_contacts(s, d)), "local_variation"))
query("g10_volatility", f"with {CONTACTS}, n as (select t, lead(t) over (order by t) as next from (select distinct t from c)), b as (select next as t, node_a, node_b from c join n using (t) where next is not null), f as (select coalesce(c.t, b.t) as t, c.t as now, b.t as was from c full join b on c.t = b.t and c.node_a = b.node_a and c.node_b = b.node_b) select t, count(*) filter (now is null or was is null) as changes from f where t > (select min(t) from c) group by 1")(lambda s, d: TN.volatility(_contacts(s, d)))
query("g10_participation", f"with {CONTACTS}, e as (select t, node_a as node, node_b as other, weight from c union all select t, node_b, node_a, weight from c), k as (select t, node, length(other) % 2 as module, sum(weight) as k from e group by 1, 2, 3) select t, node, {r6('1 - sum(k * k) / power(sum(k), 2)')} as participation from k group by 1, 2")(
    lambda s, d: rounded(TN.participation(_contacts(s, d), table(s, d, "events").select(F.col("event_type").alias("node"), (F.length("event_type") % 2).alias("module")).distinct()), "participation")
)
query("a18_intratemporal", f"with {CONTACTS} select t, node_a, node_b, sign(weight - 30) * 1.0 as weight from c")(lambda s, d: TN.intratemporal(_contacts(s, d).withColumn("weight", F.col("weight") - 30), "sign"))
query("g10_node_times", f"with {CONTACTS} select node, count(distinct t) as n, min(t) as first from (select t, node_a as node from c union all select t, node_b from c) group by 1")(lambda s, d: TN.node_times(_contacts(s, d)).select("node", F.size("times").cast("long").alias("n"), F.array_min("times").alias("first")))


# trees: regions over nations over a root
def _tree(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    return n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.lit(2.0).alias("length"), F.lit(True).alias("is_leaf")).unionByName(
        r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit("root").alias("parent"), F.lit(0.5).alias("length"), F.lit(False).alias("is_leaf"))
    ).unionByName(s.createDataFrame([("root", None, None, False)], "node string, parent string, length double, is_leaf boolean"))


TREE = "k as (select 'n' || n_nationkey as node, 'r' || n_regionkey as parent, 2.0 as length from nation union all select 'r' || r_regionkey, 'root', 0.5 from region union all select 'root', null, null)"
query("t06_ancestors", f"with recursive {TREE}, up as (select node, node as ancestor, 0 as steps, cast(0 as double) as distance from k union all select u.node, k.parent, u.steps + 1, u.distance + k.length from up u join k on u.ancestor = k.node where k.parent is not null) select node, ancestor, steps, distance from up")(lambda s, d: TR.ancestors(_tree(s, d)))


def _taxonomy(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    return n.select((F.col("n_nationkey") + 100).alias("taxon_id"), F.col("n_regionkey").alias("parent"), F.col("n_name").alias("name"), F.lit("nation").alias("rank")).unionByName(
        r.select(F.col("r_regionkey").alias("taxon_id"), F.lit(None).cast("int").alias("parent"), F.col("r_name").alias("name"), F.lit("region").alias("rank"))
    )


query("tx1_lineage", "select s_suppkey, n_nationkey + 100 as taxon_id, n_name as nation, r_name as region from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")(
    lambda s, d: K.lineage(table(s, d, "supplier").select("s_suppkey", (F.col("s_nationkey") + 100).alias("taxon_id")), _taxonomy(s, d), ["nation", "region"])
)
query("tx2_identifiers", "select p.name, coalesce(n_nationkey + 100, -1) as taxon_id from (select distinct n_name as name from nation union all select 'nowhere') p left join nation on n_name = p.name")(
    lambda s, d: K.identifiers(table(s, d, "nation").select(F.col("n_name").alias("name")).unionByName(s.createDataFrame([("nowhere",)], "name string")), _taxonomy(s, d).where("rank = 'nation'")).fillna(-1)
)


# choices among scores
def _scores(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("n"), (F.col("p_size") / 50.0).alias("accuracy"), (F.col("p_retailprice") / 10000).alias("sem"))


query("w03_best_model", "select p_partkey as n, p_size / 50.0 as accuracy, p_retailprice / 10000 as sem from part order by 2 desc, 3, 1 limit 1")(lambda s, d: C.best_model(_scores(s, d)))
query("w12_until_stale", "with s as (select p_partkey as n, p_size / 50.0 as accuracy, p_retailprice / 10000 as sem from part), b as (select *, max(accuracy) over (order by n rows between unbounded preceding and 1 preceding) as best from s), l as (select *, max(case when best is null or accuracy > best then n end) over (order by n) as last from b) select n, accuracy, sem from l where n - last <= 30")(lambda s, d: C.until_stale(_scores(s, d), 30))
query("w07_idxmax", f"with {BRAND} select obs, attr as target from (select *, row_number() over (partition by obs order by v desc, attr desc) as i from x) where i = 1")(lambda s, d: C.most_likely(bought(s, d).select("obs", F.col("attr").alias("target"), F.col("v").alias("p"))))
query("c12_target_scores", "select p_brand || '/' || p_type as target, round(product(a), 9) + 0.0 as score from (select distinct p_brand, p_type, unnest([p_brand, p_type]) as m from part) join (select p_brand as m, avg(p_size) / 50.0 as a from part group by 1 union all select p_type, avg(p_size) / 50.0 from part group by 1) using (m) group by p_brand, p_type")(
    lambda s, d: rounded(
        C.target_scores(
            table(s, d, "part").groupBy(F.col("p_brand").alias("submodel")).agg((F.avg("p_size") / 50.0).alias("accuracy")).unionByName(table(s, d, "part").groupBy(F.col("p_type").alias("submodel")).agg((F.avg("p_size") / 50.0).alias("accuracy"))),
            table(s, d, "part").select("p_brand", "p_type").distinct().select(F.concat_ws("/", "p_brand", "p_type").alias("target"), F.explode(F.array("p_brand", "p_type")).alias("parent")).withColumn("child", F.lit("")),
        ),
        "score", n=9,
    )
)

# functions
query("f05_file_name", r"select p_partkey, regexp_replace(p_name, '[^\p{L}\p{N}]', '_', 'g') as name from part")(lambda s, d: table(s, d, "part").select("p_partkey", S.file_name(F.col("p_name")).alias("name")))
query("f08_softmax", f"select p_partkey, round(exp(p_size / 10.0) / sum(exp(p_size / 10.0)) over (partition by p_brand), 9) + 0.0 as v from part")(lambda s, d: rounded(table(s, d, "part").select("p_partkey", S.softmax(F.col("p_size") / 10.0, "p_brand").alias("v")), "v", n=9))
query("f09_value_range", "select case when lo < 0 and hi > 0 then 'diverging' else 'sequential' end as kind, case when lo < 0 and hi > 0 then -greatest(abs(lo), abs(hi)) else lo end as vmin, case when lo < 0 and hi > 0 then greatest(abs(lo), abs(hi)) else hi end as vmax from (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer)")(lambda s, d: S.value_range_kind(table(s, d, "customer"), "c_acctbal"))
query("v_compositional", f"with {BRAND}, p as (select obs, v, v / sum(v) over (partition by obs) as p from x where v > 0) select obs, {r6('log10(sum(v))')} as log_depth, count(*) as richness, {r6('-sum(p * log2(p))')} as entropy from p group by obs")(lambda s, d: rounded(D.compositional_table(bought(s, d)), "log_depth", "entropy"))
query("so07_sets", "with t as (select p_brand, p_type, bool_or(p_size <= 10) as a, bool_or(p_size > 45) as b from part group by 1, 2) select p_brand, count(*) filter (a and b) as n_both, count(*) filter (a or b) as n_any, bool_and(not a or b) as inside from t group by 1")(
    lambda s, d: table(s, d, "part").groupBy("p_brand").agg(F.collect_set(F.when(F.col("p_size") <= 10, F.col("p_type"))).alias("a"), F.collect_set(F.when(F.col("p_size") > 45, F.col("p_type"))).alias("b"))
    .select("p_brand", F.size(U.intersection(F.col("a"), F.col("b"))).cast("long").alias("n_both"), F.size(U.union(F.col("a"), F.col("b"))).cast("long").alias("n_any"), U.is_subset(F.col("a"), F.col("b")).alias("inside"))
)
query("pf19_maps", "with x as (select user_id as obs, event_type as attr, cast(count(*) as double) as v from events group by 1, 2), k as (select unnest(['click', 'view', 'none']) as key) select o.obs, k.key, coalesce(x.v, 0) as value from (select distinct obs from x) o cross join k left join x on x.obs = o.obs and x.attr = k.key")(
    lambda s, d: U.map_expand(did(s, d).groupBy("obs").agg(F.map_from_entries(F.collect_list(F.struct("attr", "v"))).alias("m")).withColumn("m", U.map_fill(U.map_keep(F.col("m"), F.array(*map(F.lit, ("click", "view", "none")))), F.array(*map(F.lit, ("click", "view", "none"))), 0.0)), "m")
)
query("f06_intergenic", "with g as (select l_orderkey as contig, l_linenumber as line, l_linenumber * 20 as a, l_linenumber * 20 + 5 + l_linenumber as b from lineitem), n as (select contig, line, b + 1 as f, lead(a) over (partition by contig order by line) - 1 as u, lead(line) over (partition by contig order by line) as nx from g) select cast(contig as varchar) as contig, cast(line as varchar) as gene, cast(nx as varchar) as next, substr(repeat('acgtg', 60), f, u - f + 1) as seq from n where u >= f")(
    lambda s, d: S.intergenic(
        table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("contig"), F.col("l_linenumber").alias("line"), F.col("l_linenumber").cast("string").alias("gene"), (F.col("l_linenumber") * 20).alias("pos_start"), (F.col("l_linenumber") * 21 + 5).alias("pos_end")),
        table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("seq_id"), F.repeat(F.lit("acgtg"), 60).alias("seq")),
    )
)


# readers: a table is written in the format and read back
def _read_back(s, df, reader, suffix=""):
    path = f"{new_folder(s)}{suffix}"
    df.write.text(path)
    return reader(s, path)


@query("io01_delimited", "select n_nationkey, n_name, n_regionkey from nation")
def _io01(s, d):
    path = f"{new_folder(s)}.tsv.gz"
    R.write_dataframe(table(s, d, "nation"), path, compression="gzip")
    return R.read_dataframe(s, path).select("n_nationkey", "n_name", "n_regionkey")


@query("io02_parquet", "select r_regionkey, r_name from region")
def _io02(s, d):
    path = f"{new_folder(s)}.parquet"
    R.write_dataframe(table(s, d, "region"), path)
    return R.read_dataframe(s, path)


@query("io04_lines", "select cast(n_nationkey as varchar) || ' ' || n_name as value from nation")
def _io04(s, d):
    return _read_back(s, table(s, d, "nation").select(F.concat(F.lit("  "), F.col("n_nationkey").cast("string"), F.lit(" "), F.col("n_name"), F.lit("\t")).alias("value")), R.read_textfile).where("value <> ''").select("value")


@query("io14_fasta", "select cast(p_partkey as varchar) as seq_id, upper(replace(p_type, ' ', '')) as seq from part")
def _io14(s, d):
    path = new_folder(s)
    R.write_fasta(table(s, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(" beta->gamma "), F.col("p_name")).alias("seq_id"), F.translate("p_type", " ", "\n").alias("seq")), path)
    return R.read_fasta(s, path)


@query("io14_fasta_descriptions", "select cast(p_partkey as varchar) || ' beta->gamma ' || p_brand as seq_id, lower(p_type) as seq from part")
def _io14b(s, d):
    path = new_folder(s)
    R.write_fasta(table(s, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(" beta->gamma "), F.col("p_brand")).alias("seq_id"), F.upper("p_type").alias("seq")), path)
    return R.read_fasta(s, path, description=True, case="lower")


@query("io16_blast", f"select cast(l_orderkey as varchar) as qseqid, cast(l_partkey as varchar) as sseqid, l_quantity as pident, l_linenumber as length, l_extendedprice as bitscore, {r6('(l_linenumber * 3 - l_linenumber) / 10.0')} as qratio from lineitem")
def _io16(s, d):
    li = table(s, d, "lineitem")
    n = F.col("l_linenumber")
    line = F.concat_ws("\t", "l_orderkey", "l_partkey", "l_quantity", n, F.lit(0), F.lit(0), n, n * 3, n, n * 3, F.lit(1e-5), "l_extendedprice")
    sizes = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("qseqid"), F.lit(10.0).alias("qlength"))
    hits = _read_back(s, li.select(line.alias("value")), lambda a, b: R.read_blast(a, b, query_lengths=sizes))
    return rounded(hits.select("qseqid", "sseqid", "pident", "length", "bitscore", "qratio"), "qratio")


@query("io17_gff", "select cast(l_orderkey as varchar) as seq_record, l_linenumber as pos_start, cast(l_partkey as varchar) as id, l_returnflag as flag from lineitem where l_linestatus = 'F'")
def _io17(s, d):
    line = F.concat_ws("\t", "l_orderkey", F.lit("src"), F.when(F.col("l_linestatus") == "F", "CDS").otherwise("gene"), "l_linenumber", (F.col("l_linenumber") + 9), F.lit("."), F.lit("+"), F.lit("0"), F.concat(F.lit("ID="), F.col("l_partkey").cast("string"), F.lit(";flag="), F.col("l_returnflag"), F.lit(";")))
    rows = _read_back(s, table(s, d, "lineitem").select(line.alias("value")), lambda a, b: R.read_gff(a, b, "gff3", "CDS"))
    return rows.select("seq_record", F.col("pos_start").cast("int").alias("pos_start"), F.col("fields")["ID"].alias("id"), F.col("fields")["flag"].alias("flag"))


@query("io11_distances", "select 'n' || a.n_nationkey as obs, 'n' || b.n_nationkey as attr, abs(a.n_nationkey - b.n_nationkey) / 4.0 as v from nation a cross join nation b")
def _io11(s, d):
    n = table(s, d, "nation").select("n_nationkey")
    rows = n.select(F.col("n_nationkey").alias("i")).crossJoin(F.broadcast(n.select(F.col("n_nationkey").alias("j"))))  # 25 nations
    lines = rows.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", (F.abs(F.col("i") - F.col("j")) / 4.0).alias("v")))).alias("c"))
    text = lines.select("i", F.concat(F.lit("n"), F.col("i").cast("string"), F.lit("  "), F.array_join(F.transform("c", lambda c: c["v"].cast("string")), " ")).alias("value"))
    return _read_back(s, text.coalesce(1).sortWithinPartitions("i").select("value"), R.read_distmat)


query("so01_union_all", "select 'a' as origin, n_nationkey as k from nation union all select 'b', r_regionkey from region")(
    lambda s, d: M.prepend_level(table(s, d, "nation").select(F.col("n_nationkey").alias("k")), "origin", "a").unionByName(M.prepend_level(table(s, d, "region").select(F.col("r_regionkey").alias("k")), "origin", "b"))
)
query("w10_bins", "with b as (select min(p_size) as lo, max(p_size) as hi from part) select greatest(1, least(10, cast(ceil((p_size - lo) / ((hi - lo) / 10.0)) as int))) as bin, count(*) as n from part, b group by 1")(
    lambda s, d: table(s, d, "part").withColumns({"lo": F.min("p_size").over(Window.partitionBy()), "hi": F.max("p_size").over(Window.partitionBy())}).groupBy(F.greatest(F.lit(1), F.least(F.lit(10), F.ceil((F.col("p_size") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 10.0)).cast("int"))).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
)


# weights, predictions, communities, cuts, balances, helpers
def _kernel(s, d):
    """Order lines as weights of fits, whose accuracy is a share of 97."""
    return table(s, d, "lineitem").select(F.col("l_linestatus").alias("class"), F.col("l_returnflag").alias("attr"), (F.col("l_quantity") - 25).alias("weight"), (F.col("l_orderkey") % 97 / 97.0).alias("accuracy"))


KERNEL = "f as (select l_linestatus as class, l_returnflag as attr, l_quantity - 25 as weight, (l_orderkey % 97) / 97.0 as accuracy from lineitem)"
STEPS = "t as (select i as step, 0.9 * i / 99.0 as threshold from (select unnest(range(100)) as i)), w as (select step, attr, sum(abs(weight)) as w from f join t on accuracy > threshold group by 1, 2), s as (select step, attr, w / sum(w) over (partition by step) as w from w)"
query("c10_weights_at", f"with {KERNEL}, w as (select attr, sum(abs(weight)) as w from f where accuracy > 0.4 group by 1) select attr, {r6('w / sum(w) over ()')} as weight from w")(lambda s, d: rounded(C.extract_weights(_kernel(s, d), 0, 0.4), "weight"))
query("c10_weights_by_threshold", f"with {KERNEL}, {STEPS} select step, attr, {r6('w')} as weight from s")(lambda s, d: rounded(C.extract_weights(_kernel(s, d), 1).select(F.round(F.col("threshold") * 99 / 0.9).cast("long").alias("step"), "attr", "weight"), "weight"))
query("c10_weights_over_thresholds", f"with {KERNEL}, {STEPS} select attr, {r6('sum(w) / sum(sum(w)) over ()')} as weight from s group by attr")(lambda s, d: rounded(C.extract_weights(_kernel(s, d)), "weight"))
query("c10_weights_by_class", f"with {KERNEL}, w as (select class, attr, sum(abs(weight)) as w from f group by 1, 2) select class, attr, {r6('w / sum(w) over (partition by class)')} as weight from w")(lambda s, d: rounded(C.extract_weights(_kernel(s, d), 3), "weight"))


def _answers(s, d):
    """Probabilities of two levels for each customer, and the paths."""
    c = F.col("c_custkey")
    p, q, r = (c % 10 + 1) / 13.0, (c % 7 + 1) / 9.0, (c % 5 + 1) / 7.0
    rows = ((parent, child, v) for parent, child, v in (("root", "x", p), ("root", "y", 1 - p), ("x", "a", q), ("x", "b", 1 - q), ("y", "c", r), ("y", "d", 1 - r)))
    edges = table(s, d, "customer").select(c.alias("obs"), F.explode(F.array(*[F.struct(F.lit(m).alias("parent"), F.lit(n).alias("child"), v.alias("p")) for m, n, v in rows])).alias("e")).select("obs", "e.*")
    return edges, s.createDataFrame([(t, m, n) for t, g in (("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")) for m, n in (("root", g), (g, t))], "target string, parent string, child string")


ANSWERS = "v as (select c_custkey as obs, (c_custkey % 10 + 1) / 13.0 as p, (c_custkey % 7 + 1) / 9.0 as q, (c_custkey % 5 + 1) / 7.0 as r from customer)"
PATHS = f"{ANSWERS}, l as (select obs, 'a' as target, p * q as w from v union all select obs, 'b', p * (1 - q) from v union all select obs, 'c', (1 - p) * r from v union all select obs, 'd', (1 - p) * (1 - r) from v)"
query("c03_component", f"with {ANSWERS} select obs, 'root' as submodel, case when p >= 0.5 then 'x' else 'y' end as child from v union all select obs, 'x', case when q >= 0.5 then 'a' else 'b' end from v union all select obs, 'y', case when r >= 0.5 then 'c' else 'd' end from v")(lambda s, d: C.predict(*_answers(s, d), "component"))
query("c03_directional", f"with {ANSWERS} select obs, case when p > 0.5 then case when q > 0.5 then 'a' else 'b' end else case when r > 0.5 then 'c' else 'd' end end as target from v")(lambda s, d: C.predict(*_answers(s, d)))
query("c04_softmax", f"with {PATHS} select obs, target, {r6('exp(w) / sum(exp(w)) over (partition by obs)')} as p from l")(lambda s, d: rounded(C.path_probabilities(*_answers(s, d), "softmax"), "p"))
query("c06_cumulative_weights", "select 'a' as target, 1 as step, 'root' as parent, 'x' as child, 0.5 as weight union all select 'a', 2, 'x', 'a', 0.125 union all select 'b', 1, 'root', 'x', 0.5 union all select 'b', 2, 'x', 'b', 0.375")(
    lambda s, d: C.cumulative_weights(s.createDataFrame([("a", 1, "root", "x"), ("a", 2, "x", "a"), ("b", 1, "root", "x"), ("b", 2, "x", "b")], "target string, step int, parent string, child string"), s.createDataFrame([("root", "x", 0.5), ("x", "a", 0.25), ("x", "b", 0.75)], "parent string, child string, weight double"))
)


def _regions(s, d):
    n = table(s, d, "nation")
    a, b = (n.select(F.col("n_name").alias(f"node_{i}"), F.col("n_regionkey").alias(f"r{i}")) for i in "ab")
    return a.join(b, F.col("ra") == F.col("rb")).where("node_a < node_b").select("node_a", "node_b", F.lit(1.0).alias("weight"))


@query("g05_louvain", "select n_name as node, min(n_name) over (partition by n_regionkey) as cluster from nation")
def _g05_louvain(s, d):
    out = G.louvain(_regions(s, d), driver_edges=0)
    return out.select("node", F.min("node").over(Window.partitionBy("cluster")).alias("cluster"))


query("g05_modularity", f"with e as (select a.n_name as node_a, b.n_name as node_b, 1.0 as weight, a.n_nationkey % 3 = b.n_nationkey % 3 as same, a.n_nationkey % 3 as ca, b.n_nationkey % 3 as cb from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_name < b.n_name), k as (select c, sum(weight) as d from (select ca as c, weight from e union all select cb, weight from e) group by 1) select {r6('(select sum(case when same then weight else 0 end) / sum(weight) from e) - sum(d * d) / (sum(d) * sum(d))')} as modularity from k")(
    lambda s, d: rounded(G.modularity(_regions(s, d), table(s, d, "nation").select(F.col("n_name").alias("node"), (F.col("n_nationkey") % 3).alias("cluster"))), "modularity")
)


@query("t07_hybrid_cut", "select n_nationkey as node, cast(dense_rank() over (order by n desc, first) - 1 as int) as cluster from (select n_nationkey, count(*) over (partition by n_regionkey) as n, min(n_nationkey) over (partition by n_regionkey) as first from nation)")
def _t07(s, d):
    n = table(s, d, "nation")
    a, b = (n.select(F.col("n_nationkey").alias(f"node_{i}"), F.col("n_regionkey").alias(f"r{i}")) for i in "ab")
    pairs = a.crossJoin(F.broadcast(b)).where("node_a < node_b")  # 25 nations
    return TR.clusters(pairs.select("node_a", "node_b", F.when(F.col("ra") == F.col("rb"), 1.0 + (F.col("node_a") + F.col("node_b")) % 3 / 100).otherwise(9.0 + F.abs(F.col("ra") - F.col("rb"))).alias("weight")), "average")


@query("n15_philr", f"with {NATION}, k as (select obs, least(cast(substr(attr, 7, 1) as int), 5) as k, sum(v) as l from z group by 1, 2), m as (select obs, ln(coalesce(max(l) filter (k = 1), 0) + 1) as a, ln(coalesce(max(l) filter (k = 2), 0) + 1) as b, ln(coalesce(max(l) filter (k = 3), 0) + 1) as c, ln(coalesce(max(l) filter (k = 4), 0) + 1) as d, ln(coalesce(max(l) filter (k = 5), 0) + 1) as e from k group by obs) select obs, 'n1' as attr, {r6('abs(sqrt(6.0 / 5) * ((a + b) / 2 - (c + d + e) / 3))')} as v from m union all select obs, 'n2', {r6('abs(sqrt(0.5) * (a - b))')} from m union all select obs, 'n3', {r6('abs(sqrt(2.0 / 3) * (c - (d + e) / 2))')} from m union all select obs, 'n4', {r6('abs(sqrt(0.5) * (d - e))')} from m")
def _n15(s, d):
    ten = F.concat(F.lit("B"), F.least(F.substr("attr", F.lit(7), F.lit(1)).cast("int"), F.lit(5)).cast("string"))
    tens = by_nation(s, d).groupBy("obs", ten.alias("attr")).agg(F.sum("v").alias("v"))
    tree = TR.parse_newick("((B1:1,B2:1)n2:1,(B3:1,(B4:1,B5:1)n4:1)n3:1)n1;")
    return rounded(N.philr(M.densify(tens).withColumn("v", F.col("v") + 1), tree).withColumn("v", F.abs("v")), "v")


query("io04_numbers", "select cast(row_number() over (order by n_nationkey) - 1 as int) as line, n_name as value from nation")(lambda s, d: _read_back(s, table(s, d, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select(F.col("n_name").alias("value")), R.read_textfile_raw).select("line", "value"))
query("f07_helpers", "select n_nationkey, lpad(cast(n_nationkey as varchar), 3, '0') as pad, n_nationkey % 2 = 1 as flag, printf('%.2f', n_nationkey / 4.0) as p, replace(replace(n_name, 'A', 'B'), 'BB', 'C') as c, n_name || '-' || n_regionkey as j from nation")(
    lambda s, d: table(s, d, "nation").select("n_nationkey", U.pad_left(F.col("n_nationkey"), 3).alias("pad"), U.boolean(F.when(F.col("n_nationkey") % 2 == 1, "Yes").otherwise("off")).alias("flag"), U.to_precision(F.col("n_nationkey") / 4.0, 2).alias("p"), U.consecutive_replace(F.col("n_name"), [("A", "B"), ("BB", "C")]).alias("c"), U.join_as_strings("-", F.col("n_name"), F.lit(None), F.col("n_regionkey")).alias("j"))
)
query("pf19_collapse", "select n_regionkey, string_agg(n_name, '|' order by n_name) as names from nation group by 1")(lambda s, d: U.collapse(table(s, d, "nation"), "n_name", "n_regionkey").select("n_regionkey", F.array_join("n_name", "|").alias("names")))
query("u02_metric", f"with {BRAND}, p as (select obs, v / sum(v) over (partition by obs) as p from x where v > 0) select obs, {r6('1 - sum(p * p)')} as value from p group by obs")(lambda s, d: rounded(D.alpha_diversity(bought(s, d), metric=lambda v, p: 1 - F.sum(p * p)), "value"))
query("a10_domains", f"with h as (select l_orderkey as grp, p_type as taxon, l_quantity as w from lineitem join part on l_partkey = p_partkey where p_brand in ('Brand#11', 'Brand#23')), v as (select grp, taxon, sum(w) / 100 as w, count(*) as hits from h group by 1, 2), r as (select *, rank() over (partition by grp order by w desc) as r from v) select grp, string_agg(taxon, '|' order by taxon) filter (r = 1) as taxa, cast(sum(hits) as bigint) as hits from r group by grp")(
    lambda s, d: D.infer_taxonomy(table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("grp"), F.col("p_type").alias("taxon"), F.col("l_quantity").alias("identity"), F.col("p_partkey").alias("seq")), table(s, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("domain")), ["Brand#11", "Brand#23"]).select("grp", F.array_join("taxa", "|").alias("taxa"), "hits")
)


@query("r01_glm_line", f"with {TYPE}, j as (select attr, v, c_acctbal as u from x join customer on obs = c_custkey) select attr, 'c_acctbal' as term, round(regr_slope(v, u), 8) + 0.0 as coef, count(*) as nobs, {r6('regr_r2(v, u)')} as r2 from j group by attr")
def _r01_line(s, d):
    from ..operators.regress import glm

    out = glm(bought(s, d, "p_type"), table(s, d, "customer").select(F.col("c_custkey").alias("obs"), "c_acctbal"), ["c_acctbal"])
    return rounded(rounded(out.where("term = 'c_acctbal'").select("attr", "term", "coef", F.col("nobs").cast("long").alias("nobs"), "r2"), "coef", n=8), "r2")


@query("s07_glm_test")
def _s07(s, d):
    from ..operators import differential as DA

    x = bought(s, d, "p_type")
    return DA.glm_test(x, classes(s, d).join(x.select("obs").distinct(), "obs", "left_semi"), "BUILDING")
