"""A query for each operator over the driver tables, and the SQL that must give the same rows.

Records come from `part`: names with typos, brands, types with gaps; the truth is the part without typos.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.similarity import LevenshteinSimilarity
from kinfold.operators import chain as C
from kinfold.operators import clusters as K
from kinfold.operators import records as R
from kinfold.operators import transition as T
from kinfold.operators.partition import KDTreePartitioner, SimplePartitioner, hard_partition, lpt_schedule, median_split
from kinfold.operators.sampler import diagnostics_header
from kinfold.operators.state import initial_tables
from kinfold.sources import tables

SEED = 7
PRIOR = R.BetaPrior(2.0, 8.0)
ATTRIBUTES = [R.Attribute("a0", LevenshteinSimilarity(7, 10), PRIOR), R.Attribute("a1", prior=PRIOR), R.Attribute("a2", prior=PRIOR)]
NAMES = ["a0", "a1", "a2"]
ER = """
    select cast(p_partkey as varchar(20)) as rec_id, cast(p_partkey % 2 as varchar(20)) as file_id,
           case when p_partkey % 7 = 0 then substr(p_name, 2)
                when p_partkey % 13 = 0 then concat(p_name, 'x') else p_name end as a0,
           p_brand as a1, case when p_partkey % 11 = 0 then null else p_type end as a2,
           concat(p_name, '|', p_brand, '|', p_type) as true_ent
    from part
"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return spark.sql(ER.replace("varchar(20)", "string").replace("from part", "from {part}"), part=part)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.to_cells(records(spark, sf_dir), ATTRIBUTES, "rec_id", "file_id")


class Brands:
    """Blocks by brand, four of them."""

    count = 4

    def fit(self, wide: DataFrame, values: str = "values") -> Brands:
        return self

    def fitted(self) -> object:
        return None

    def restore(self, said: object) -> Brands:
        return self

    def column(self, values: str = "values"):
        return hard_partition(F.element_at(values, 2), 4)


def state(spark: SparkSession, sf_dir: str, flips: bool = True) -> T.ChainState:
    """Three quarters as many entities as records. flips: hash-drawn distortions beside those observed."""
    keep = tables.keep
    own = keep(cells(spark, sf_dir))
    index = R.build_index(own, ATTRIBUTES, keep)
    encoded = R.encode(own, index.domain)
    count = own.where("attr_id = 0").count()
    entities, links, first = initial_tables(encoded, index, SEED, count * 3 // 4)
    if flips:
        more = F.col("value_id").isNotNull() & (T.uniform(SEED, 0, "flip", "rec_id", "attr_id") < 0.3)
        first = first.withColumn("distorted", F.col("distorted") | more)
    entities = keep(entities)
    return T.ChainState(1, SEED, index, entities, keep(T.place(entities, Brands())), keep(first), keep(links), keep(R.prior_theta(index.files, ATTRIBUTES)), Brands())


# --- the same in SQL -----------------------------------------------------------------------------

U = "((cast(('0x' || substr(md5(concat_ws('|', '7', '{it}', '{op}', {keys})), 1, 13)) as bigint))::double + 0.5) / 4503599627370496"


def u(it: int, op: str, *keys: str) -> str:
    return "(" + U.format(it=it, op=op, keys=", ".join(f"({k})::varchar" for k in keys)) + ")"


LEV = "(case when length(a.value) + length(b.value) = 0 then 1.0::double else 1 - 2.0::double * levenshtein(a.value, b.value) / (length(a.value) + length(b.value) + levenshtein(a.value, b.value)) end)"
BASE = f"""
    er as ({ER}),
    cells as (
        select rec_id, file_id, 0 as attr_id, a0 as value from er
        union all select rec_id, file_id, 1, a1 from er union all select rec_id, file_id, 2, a2 from er
    ),
    cnts as (select attr_id, value, count(*) as cnt from cells where value is not null group by all),
    dom as (
        select attr_id, (row_number() over (partition by attr_id order by value) - 1)::int as value_id, value, cnt,
               cnt::double / sum(cnt) over (partition by attr_id) as prob
        from cnts
    ),
    simraw as (
        select a.attr_id, a.value_id as v1, b.value_id as v2, greatest(0.0::double, (10.0::double / 3.0::double) * (10.0::double * {LEV} - 7.0::double)) as s
        from dom a join dom b on a.attr_id = 0 and b.attr_id = 0
    ),
    sim as (select attr_id, v1, v2, exp(s) as exp_sim from simraw where s > 0),
    norms as (
        select d.attr_id, d.value_id, d.value, d.cnt, d.prob, 1 / (1 + coalesce(x.extra, 0)) as sim_norm
        from dom d left join (
            select s.attr_id, s.v1, sum(o.prob * (s.exp_sim - 1)) as extra from sim s join dom o on o.attr_id = s.attr_id and o.value_id = s.v2 group by all
        ) x on x.attr_id = d.attr_id and x.v1 = d.value_id
    ),
    enc as (select c.rec_id, c.file_id, c.attr_id, d.value_id from cells c left join dom d on d.attr_id = c.attr_id and d.value = c.value)
"""
STATE = f"""{BASE},
    pos as (select rec_id, row_number() over (order by substr(md5(rec_id), 1, 2), rec_id) - 1 as pos from er),
    size as (select (count(*) * 3) // 4 as n from er),
    links as (select rec_id, (pos % n)::bigint as ent_id from pos, size),
    cdf as (
        select attr_id, value_id, sum(prob) over (partition by attr_id order by value_id rows unbounded preceding) as hi, prob,
               row_number() over (partition by attr_id order by value_id desc) = 1 as last
        from dom
    ),
    own as (select p.pos::bigint as ent_id, e.attr_id, e.value_id from enc e join pos p using (rec_id), size where p.pos < n),
    entities as (
        select o.ent_id, o.attr_id, coalesce(o.value_id, c.value_id) as value_id
        from (select *, {u(0, "initial", "ent_id", "attr_id")} as u from own) o
        left join cdf c on o.value_id is null and c.attr_id = o.attr_id and o.u >= c.hi - c.prob and (o.u < c.hi or c.last)
    ),
    parts as (select ent_id, value_id % 4 as partition_id from entities where attr_id = 1),
    flat as (
        select e.rec_id, e.file_id, e.attr_id, e.value_id, coalesce(e.value_id <> n.value_id, false) as differs
        from enc e join links l using (rec_id) join entities n on n.ent_id = l.ent_id and n.attr_id = e.attr_id
    ),
    st as (select rec_id, file_id, attr_id, value_id, differs or (value_id is not null and {u(0, "flip", "rec_id", "attr_id")} < 0.3) as distorted from flat),
    theta as (select attr_id, file_id, 0.2::double as theta from (select distinct attr_id, file_id from cells))
"""
PAIR_WEIGHT = """
    select p.rec_id, p.ent_id, coalesce(w.lw, 0) as lw from {pairs} p left join (
        select p.rec_id, p.ent_id, sum(ln(x.prob) + case when c.attr_id = 0 then ln(y.sim_norm) + ln(coalesce(s.exp_sim, 1)) else 0 end) as lw
        from {pairs} p join st c on c.rec_id = p.rec_id and c.value_id is not null and c.distorted
        join entities e on e.ent_id = p.ent_id and e.attr_id = c.attr_id
        join norms x on x.attr_id = c.attr_id and x.value_id = c.value_id join norms y on y.attr_id = c.attr_id and y.value_id = e.value_id
        left join sim s on s.attr_id = c.attr_id and s.v1 = e.value_id and s.v2 = c.value_id
        group by all
    ) w on w.rec_id = p.rec_id and w.ent_id = p.ent_id
"""
CANDIDATES = """
    obs as (select c.*, q.partition_id from st c join links l using (rec_id) join parts q using (ent_id) where value_id is not null),
    sure as (select * from obs where not distorted),
    need as (select rec_id, count(*) as need from sure group by all),
    met as (
        select s.rec_id, e.ent_id, count(*) as n from sure s join entities e on e.attr_id = s.attr_id and e.value_id = s.value_id
        join parts p on p.ent_id = e.ent_id and p.partition_id = s.partition_id group by all
    ),
    cand as (
        select m.rec_id, m.ent_id from met m join need using (rec_id) where n = need
        union all
        select l.rec_id, p.ent_id from links l join parts o on o.ent_id = l.ent_id join parts p on p.partition_id = o.partition_id
        where l.rec_id not in (select rec_id from need)
    )
"""
ALL_PAIRS = "allp as (select l.rec_id, p.ent_id from links l join parts o on o.ent_id = l.ent_id join parts p on p.partition_id = o.partition_id)"
DRAW_LINK = f"select rec_id, arg_max(ent_id, lw - ln(-ln({u(1, 'link', 'rec_id', 'ent_id')}))) as ent_id from w group by rec_id"
LINKED = "linked as (select l.ent_id, c.attr_id, c.rec_id, c.file_id, c.value_id as x, c.distorted from st c join links l using (rec_id) where c.value_id is not null)"
MIXTURE = f"""
    base as (
        select attr_id, k, value_id, w / sum(w) over (partition by attr_id, k) as base
        from (select q.attr_id, q.k, n.value_id, n.prob * pow(n.sim_norm, q.k) as w from (select distinct attr_id, k from keys) q join norms n using (attr_id))
    ),
    added as (
        select f.ent_id, f.attr_id, f.v, ln(b.base) + case when f.lf > 30 then f.lf else ln(exp(f.lf) - 1) end as lc
        from factors f join keys q using (ent_id, attr_id) join base b on b.attr_id = q.attr_id and b.k = q.k and b.value_id = f.v
        where f.lf > 0
    ),
    total as (select ent_id, attr_id, ln(sum(exp(lc - m))) + m as lw from (select *, max(lc) over (partition by ent_id, attr_id) as m from added) group by ent_id, attr_id, m),
    turned as (
        select q.*, coalesce(ln(1 / {u(1, "mixture", "q.ent_id", "q.attr_id")} - 1) > t.lw, true) as plain
        from keys q left join total t using (ent_id, attr_id)
    ),
    bcdf as (
        select attr_id, k, value_id, base, sum(base) over (partition by attr_id, k order by value_id rows unbounded preceding) as hi,
               row_number() over (partition by attr_id, k order by value_id desc) = 1 as last
        from base
    ),
    mixed as (
        select q.ent_id, q.attr_id, c.value_id from (select *, {u(1, "base", "ent_id", "attr_id")} as u from turned where plain) q
        join bcdf c on c.attr_id = q.attr_id and c.k = q.k and q.u >= c.hi - c.base and (q.u < c.hi or c.last)
        union all
        select ent_id, attr_id, arg_max(v, lc - ln(-ln({u(1, "added", "ent_id", "attr_id", "v")})))
        from added where (ent_id, attr_id) in (select ent_id, attr_id from turned where not plain) group by all
    )
"""
KEYS = "select e.ent_id, e.attr_id, case when e.attr_id = 0 then coalesce(c.k, 0) else 0 end as k from entities e left join (select ent_id, attr_id, count(*) as k from linked group by all) c using (ent_id, attr_id)"
PINNED = f"""{LINKED},
    pinned as (select ent_id, attr_id, min(x) as value_id from linked where not distorted group by all),
    keys as ({KEYS} where (e.ent_id, e.attr_id) not in (select ent_id, attr_id from pinned)),
    factors as (select l.ent_id, l.attr_id, s.v2 as v, sum(ln(s.exp_sim)) as lf from linked l join sim s on s.attr_id = l.attr_id and s.v1 = l.x group by all)
"""
CHAIN = """
    chain as (
        select i::bigint as iteration, (n % 3)::int as partition_id,
               case when n % 10 < i then concat('c', n % 5) else concat('d', n) end as cluster_id, n::varchar(20) as rec_id
        from (select p_partkey as n from part) p, (select unnest(range(10)) as i) q
    ),
    flatc as (select iteration, partition_id, cluster_id, string_agg(rec_id, ',' order by rec_id) as cluster, count(*) as size from chain group by all)
"""
LOGLIK = f"""
    with {STATE}
    select round((select sum(ln(n.prob)) from entities e join norms n using (attr_id, value_id))
         + (select sum(ln(x.prob) + case when c.attr_id = 0 then ln(y.sim_norm) + ln(coalesce(s.exp_sim, 1)) else 0 end)
            from {{cells}} c join links l using (rec_id) join entities e on e.ent_id = l.ent_id and e.attr_id = c.attr_id
            join norms x on x.attr_id = c.attr_id and x.value_id = c.value_id join norms y on y.attr_id = c.attr_id and y.value_id = e.value_id
            left join sim s on s.attr_id = c.attr_id and s.v1 = e.value_id and s.v2 = c.value_id where c.distorted and c.value_id is not null)
         + (select sum((2 + d - 1) * ln(0.2::double) + (8 + f.n - d - 1) * ln(1 - 0.2::double))
            from (select attr_id, file_id, count(*) filter (distorted) as d from {{cells}} group by all) q
            join (select file_id, count(*) as n from er group by all) f using (file_id)), 3) as log_likelihood
"""


def synthetic_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, i = F.col("p_partkey"), F.col("i")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(n).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9))))
    label = F.when(n % 10 < i, F.concat(F.lit("c"), (n % 5).cast("string"))).otherwise(F.concat(F.lit("d"), n.cast("string")))
    rows = rows.select(i.cast("long").alias("iteration"), (n % 3).cast("int").alias("partitionId"), label.alias("c"), n.cast("string").alias("rec_id"))
    per = rows.groupBy("iteration", "partitionId", "c").agg(F.collect_list("rec_id").alias("l"))
    return per.groupBy("iteration", "partitionId").agg(F.collect_list("l").alias("linkageStructure"))


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


@query(f"with {BASE} select file_id, count(*) as n from er group by all")
def ag01_file_sizes(spark, sf_dir):
    return R.file_sizes(cells(spark, sf_dir))


@query(f"with {BASE} select file_id, attr_id, count(*) as n_missing from cells where value is null group by all")
def ag02_missing_counts(spark, sf_dir):
    return R.missing_counts(cells(spark, sf_dir))


@query(f"with {BASE} select attr_id, value, cnt from cnts")
def ag03_value_counts(spark, sf_dir):
    return R.value_counts(cells(spark, sf_dir))


@query(f"with {BASE} select round(avg((value is null)::int) * 100, 6) as pct_missing from cells")
def ag04_pct_missing(spark, sf_dir):
    return R.percent_missing(cells(spark, sf_dir)).select(F.round("pct_missing", 6).alias("pct_missing"))


@query(f"with {BASE} select attr_id, value_id, value, cnt, round(prob, 9) as prob from dom")
def ag05_domain_index(spark, sf_dir):
    return R.domains(cells(spark, sf_dir)).withColumn("prob", F.round("prob", 9))


@query(f"with {BASE} select rec_id, file_id, attr_id, value_id from enc")
def pr02_encode_records(spark, sf_dir):
    own = cells(spark, sf_dir)
    return R.encode(own, R.domains(own))


@query(f"with {BASE} select e.rec_id, e.file_id, e.attr_id, d.value from enc e left join dom d using (attr_id, value_id)")
def pr02_decode_records(spark, sf_dir):
    own = cells(spark, sf_dir)
    domain = R.domains(own)
    return R.decode(R.encode(own, domain), domain)


@query(f"with {BASE} select attr_id, v1, v2, round(exp_sim, 6) as exp_sim from sim")
def jn03_similar_values(spark, sf_dir):
    return R.similar_values(R.domains(cells(spark, sf_dir)), ATTRIBUTES).withColumn("exp_sim", F.round("exp_sim", 6))


@query(f"with {BASE} select attr_id, value_id, round(sim_norm, 9) as sim_norm from norms")
def ag07_sim_norm(spark, sf_dir):
    domain = R.domains(cells(spark, sf_dir))
    return R.with_norms(domain, R.similar_values(domain, ATTRIBUTES)).select("attr_id", "value_id", F.round("sim_norm", 9).alias("sim_norm"))


@query(f"""with {BASE}, ks as (select unnest(range(1, 4))::int as k)
    select attr_id, k, value_id, round(w / sum(w) over (partition by attr_id, k), 9) as base
    from (select attr_id, k, value_id, prob * pow(sim_norm, k) as w from norms, ks)""")
def ag08_powered_base(spark, sf_dir):
    domain = R.domains(cells(spark, sf_dir))
    powers = spark.range(9).select((F.col("id") % 3).cast("int").alias("attr_id"), (F.floor(F.col("id") / 3) + 1).cast("int").alias("k"))
    return R.powered_base(R.with_norms(domain, R.similar_values(domain, ATTRIBUTES)), powers).withColumn("base", F.round("base", 9))


@query(f"""with er as ({ER}), own as (select p_partkey, p_name as a, a0 as b from part join er on er.rec_id = cast(p_partkey as varchar(20)))
    select p_partkey, a, b, levenshtein(a, b)::int as d,
    round(greatest(0.0::double, 10.0::double / 7 * (10.0::double * (1 - 2.0::double * levenshtein(a, b) / (length(a) + length(b) + levenshtein(a, b))) - 3)), 6) as sim
    from own""")
def fn02_levenshtein_typos(spark, sf_dir):
    """The functions over every part: its name against the name with typos."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_name").alias("a"))
    typos = records(spark, sf_dir).select(F.col("rec_id").cast(part.schema["p_partkey"].dataType).alias("p_partkey"), F.col("a0").alias("b"))
    both = part.join(typos, "p_partkey")
    return both.select("p_partkey", "a", "b", F.levenshtein("a", "b").alias("d"), F.round(LevenshteinSimilarity(3, 10).column(F.col("a"), F.col("b")), 6).alias("sim"))


@query(f"with {BASE} select attr_id, file_id, 0.2::double as theta from (select distinct attr_id, file_id from cells)")
def fn11_prior_theta(spark, sf_dir):
    return R.prior_theta(R.file_sizes(cells(spark, sf_dir)), ATTRIBUTES)


@query(f"with {STATE} select ent_id, attr_id, value_id from entities")
def mc01_initial_entities(spark, sf_dir):
    return state(spark, sf_dir).entities


@query(f"with {STATE} select rec_id, file_id, attr_id, value_id, differs as distorted from flat")
def mc01_initial_distortions(spark, sf_dir):
    return state(spark, sf_dir, False).cells


@query(f"with {STATE} select rec_id, ent_id from links")
def mc02_initial_links(spark, sf_dir):
    return state(spark, sf_dir).links


@query(f"with {STATE} select attr_id, file_id, count(*) filter (distorted) as n from st group by all")
def ag09_aggregate_distortions(spark, sf_dir):
    return T.aggregate_distortions(state(spark, sf_dir))


@query(f"with {STATE} select n_distorted, count(*) as n from (select rec_id, count(*) filter (distorted) as n_distorted from st group by all) group by all")
def ag10_record_distortions(spark, sf_dir):
    return T.record_distortions(state(spark, sf_dir))


@query(f"with {STATE}, {CANDIDATES}, w as ({PAIR_WEIGHT.format(pairs='cand')}), drawn as ({DRAW_LINK}) select count(*) as n_isolates from parts where ent_id not in (select ent_id from drawn)")
def ag11_isolates(spark, sf_dir):
    s = state(spark, sf_dir)
    s.links = tables.keep(T.links_by_candidates(s))
    return T.isolated(s)


@query(LOGLIK.format(cells="(select *, differs as distorted from flat)"))
def ag12_initial_loglik(spark, sf_dir):
    return T.log_likelihood(state(spark, sf_dir, False)).select(F.round("log_likelihood", 3).alias("log_likelihood"))


@query(LOGLIK.format(cells="st"))
def ag12_loglik(spark, sf_dir):
    return T.log_likelihood(state(spark, sf_dir)).select(F.round("log_likelihood", 3).alias("log_likelihood"))


@query(f"with {STATE}, {CANDIDATES} select rec_id, ent_id from cand")
def jn04_candidates(spark, sf_dir):
    return T.candidates(state(spark, sf_dir)).select("rec_id", "ent_id")


@query(f"with {STATE}, {CANDIDATES}, w as ({PAIR_WEIGHT.format(pairs='cand')}) {DRAW_LINK}")
def mc07_link_gibbs(spark, sf_dir):
    return T.links_by_candidates(state(spark, sf_dir))


@query(f"with {STATE}, {CANDIDATES}, w as ({PAIR_WEIGHT.format(pairs='cand')}) {DRAW_LINK}")
def mc08_link_seq(spark, sf_dir):
    """The full scan has the law, and with the same hashes the draws, of the inverted index."""
    return T.links_by_scan(state(spark, sf_dir))


@query(f"""with {STATE}, {ALL_PAIRS}, w as (
        select p.rec_id, p.ent_id, sum(ln((case when c.value_id = e.value_id then 1 - t.theta else 0 end)
                   + t.theta * x.prob * case when c.attr_id = 0 then y.sim_norm * coalesce(s.exp_sim, 1) else 1 end)) as lw
        from allp p join st c on c.rec_id = p.rec_id and c.value_id is not null join theta t on t.attr_id = c.attr_id and t.file_id = c.file_id
        join entities e on e.ent_id = p.ent_id and e.attr_id = c.attr_id
        join norms x on x.attr_id = c.attr_id and x.value_id = c.value_id join norms y on y.attr_id = c.attr_id and y.value_id = e.value_id
        left join sim s on s.attr_id = c.attr_id and s.v1 = e.value_id and s.v2 = c.value_id group by all
    ) {DRAW_LINK}""")
def mc09_link_collapsed(spark, sf_dir):
    return T.links_collapsed(state(spark, sf_dir))


@query(f"""with {STATE}, {LINKED}, keys as ({KEYS}), odd as (select l.*, x.prob, x.sim_norm, (1 / t.theta - 1) / x.prob as odds
        from linked l join theta t using (attr_id, file_id) join norms x on x.attr_id = l.attr_id and x.value_id = l.x),
    factors as (
        select ent_id, attr_id, v, sum(f) as lf from (
            select ent_id, attr_id, x as v, ln(1 + odds) as f from odd where attr_id <> 0
            union all
            select o.ent_id, o.attr_id, s.v2, ln(s.exp_sim + case when s.v2 = o.x then o.odds / o.sim_norm else 0 end)
            from odd o join sim s on s.attr_id = o.attr_id and s.v1 = o.x
        ) group by all
    ), {MIXTURE} select ent_id, attr_id, value_id from mixed""")
def mc10_value_collapsed(spark, sf_dir):
    return T.values_collapsed(state(spark, sf_dir))


@query(f"with {STATE}, {PINNED}, {MIXTURE} select ent_id, attr_id, value_id from pinned union all select ent_id, attr_id, value_id from mixed")
def mc11_value_gibbs(spark, sf_dir):
    return T.values_plain(state(spark, sf_dir))


@query(f"""with {STATE}, {PINNED}, w as (
        select q.ent_id, q.attr_id, n.value_id, ln(n.prob) + q.k * ln(n.sim_norm) + coalesce(f.lf, 0) as lw
        from keys q join norms n using (attr_id) left join factors f on f.ent_id = q.ent_id and f.attr_id = q.attr_id and f.v = n.value_id
    ) select ent_id, attr_id, value_id from pinned union all
    select ent_id, attr_id, arg_max(value_id, lw - ln(-ln({u(1, "scan", "ent_id", "attr_id", "value_id")}))) from w group by all""")
def mc12_value_seq(spark, sf_dir):
    return T.values_by_scan(state(spark, sf_dir))


@query(f"""with {STATE}, r as (
        select c.rec_id, c.file_id, c.attr_id, c.value_id, e.value_id as y, t.theta,
               t.theta * x.prob * case when c.attr_id = 0 then x.sim_norm * coalesce(s.exp_sim, 1) else 1 end as p1
        from st c join links l using (rec_id) join entities e on e.ent_id = l.ent_id and e.attr_id = c.attr_id
        join theta t on t.attr_id = c.attr_id and t.file_id = c.file_id
        left join norms x on x.attr_id = c.attr_id and x.value_id = c.value_id
        left join sim s on s.attr_id = c.attr_id and s.v1 = c.value_id and s.v2 = c.value_id
    ) select rec_id, file_id, attr_id, value_id,
        {u(1, "distortion", "rec_id", "attr_id")} < case when value_id is null then theta when value_id <> y then 1 else p1 / (p1 + 1 - theta) end as distorted
    from r""")
def mc14_distortion_update(spark, sf_dir):
    return T.distortions(state(spark, sf_dir))


@query(f"""with {STATE} select p.partition_id::int as partition_id, l.ent_id, string_agg(l.rec_id, ',' order by l.rec_id) as records
    from links l join parts p using (ent_id) group by all""")
def pr08_linkage_structure(spark, sf_dir):
    rows = T.linkage(state(spark, sf_dir)).select(F.col("partitionId").alias("partition_id"), F.explode("linkageStructure").alias("c"))
    own = state(spark, sf_dir).links.select("ent_id", "rec_id")
    flat = rows.select("partition_id", F.element_at("c", 1).alias("rec_id"), F.array_join("c", ",").alias("records"))
    return flat.join(own, "rec_id").select("partition_id", "ent_id", "records")


@query("""with v as (select a.value_id, count(*) as w from (select dense_rank() over (order by p_name) - 1 as value_id from part) a group by all),
    r as (select value_id, sum(w) over (order by value_id) as upto, sum(w) over () as total from v)
    select 0 as leaf, min(value_id)::int as split, min(upto)::bigint as below, any_value(total)::bigint as total from r where upto * 2 >= total""")
def pt04_range_split(spark, sf_dir):
    own = R.to_cells(spark.read.parquet(f"{sf_dir}/part.parquet"), [R.Attribute("p_name")], "p_partkey")
    counts = R.domains(own).select(F.lit(0).alias("leaf"), "value_id", F.col("cnt").alias("w"))
    return median_split(counts, ["leaf"])


@query(f"""with {BASE}, one as (select value_id from enc where attr_id = 0), v as (select value_id, count(*) as w from one group by all),
    s as (select min(value_id) as med from (select value_id, sum(w) over (order by value_id) as upto, sum(w) over () as total from v) where upto * 2 >= total),
    two as (select value_id, (value_id > med)::int as leaf from one, s), v2 as (select leaf, value_id, count(*) as w from two group by all),
    s2 as (select leaf, min(value_id) as med from (select leaf, value_id, sum(w) over (partition by leaf order by value_id) as upto, sum(w) over (partition by leaf) as total from v2) where upto * 2 >= total group by all)
    select case when two.value_id > med then two.leaf + 2 else two.leaf end as leaf, count(*) as n from two join s2 using (leaf) group by all""")
def pt02_kdtree_leaf_sizes(spark, sf_dir):
    """Two levels on the names; both levels' nodes have enough values for the weighted median."""
    wide = T.to_wide(R.encode(cells(spark, sf_dir), R.domains(cells(spark, sf_dir))).where("value_id is not null").withColumnRenamed("rec_id", "ent_id"))
    tree = KDTreePartitioner(2, [0]).fit(wide)
    return wide.groupBy(tree.column().alias("leaf")).agg(F.count(F.lit(1)).alias("n"))


#: Longest processing time first over jobs (job, size): each to the least loaded of four bins, the first of equals.
LPT = """
    ordered as (select *, row_number() over (order by size desc, job::varchar) as rn from jobs),
    dealt as (
        select 0::bigint as rn, null::varchar as job, 0::double as size, 0 as bin, [0.0::double, 0.0, 0.0, 0.0] as loads
        union all
        select o.rn, o.job::varchar, o.size, (list_position(d.loads, list_min(d.loads)) - 1)::int,
               list_transform(d.loads, lambda x, i: case when i = list_position(d.loads, list_min(d.loads)) then x + o.size else x end)
        from dealt d join ordered o on o.rn = d.rn + 1
    )
"""


@query(f"with recursive jobs as (select p_brand as job, count(*)::double as size from part where p_brand is not null group by all), {LPT} select job, size, bin from dealt where rn > 0")
def pt06_lpt_bins(spark, sf_dir):
    """Brands dealt to 4 bins by size."""
    most = 10_000
    jobs = [(r["p_brand"], float(r["count"])) for r in spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand").count().limit(most + 1).collect()]
    if len(jobs) > most:
        raise ValueError(f"there are more than {most} brands")
    sizes = dict(jobs)
    return spark.createDataFrame([(k, sizes[k], b) for k, b in lpt_schedule(jobs, 4).items()], "job string, size double, bin int")


@query(f"""with recursive {BASE}, jobs as (select value_id as job, count(*)::double as size from enc where attr_id = 1 and value_id is not null group by all), {LPT}
    select d.bin as block, count(*) as n from enc e join dealt d on d.rn > 0 and d.job = e.value_id::varchar where e.attr_id = 1 group by all""")
def pt07_simple_blocks(spark, sf_dir):
    own = cells(spark, sf_dir)
    wide = T.to_wide(R.encode(own, R.domains(own)).where("value_id is not null").withColumnRenamed("rec_id", "ent_id"))
    blocks = SimplePartitioner(1, 4).fit(wide)
    return wide.groupBy(blocks.column().alias("block")).agg(F.count(F.lit(1)).alias("n"))


@query("select p_partkey, (p_partkey % 4)::int as partition_id from part")
def pt08_hard_partition(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", hard_partition(F.col("p_partkey"), 4).cast("int").alias("partition_id"))


@query(f"with {CHAIN} select iteration, partition_id, cluster from flatc where iteration >= 5")
def pr03_iteration_cutoff(spark, sf_dir):
    flat = C.flat_clusters(C.after(synthetic_chain(spark, sf_dir), 5))
    return flat.select("iteration", F.col("partitionId").alias("partition_id"), F.array_join("cluster", ",").alias("cluster"))


@query(f"with {CHAIN} select cluster, round(count(*) / 10, 6) as frequency from flatc group by all")
def ag15_cluster_frequencies(spark, sf_dir):
    return C.cluster_frequencies(synthetic_chain(spark, sf_dir)).select(F.array_join("cluster", ",").alias("cluster"), F.round("frequency", 6).alias("frequency"))


MPC = """fr as (select cluster, count(*) / 10 as frequency from flatc group by all),
    mpc as (select rec_id, cluster, frequency from (select c.rec_id, f.cluster, f.frequency, row_number() over (partition by c.rec_id order by f.frequency desc, f.cluster) as rn
        from (select distinct rec_id, cluster from chain join flatc using (iteration, partition_id, cluster_id)) c join fr f using (cluster)) where rn = 1)"""


@query(f"with {CHAIN}, {MPC} select rec_id, cluster, round(frequency, 6) as frequency from mpc")
def ag16_most_probable_cluster(spark, sf_dir):
    best = C.most_probable_clusters(synthetic_chain(spark, sf_dir), F.array_join("cluster", ","))
    return best.select("rec_id", "cluster", F.round("frequency", 6).alias("frequency"))


@query(f"with {CHAIN}, {MPC} select string_agg(rec_id, ',' order by rec_id) as records from mpc group by cluster")
def ag17_shared_mpc(spark, sf_dir):
    return C.shared_best_clusters(synthetic_chain(spark, sf_dir)).select(F.array_join("cluster", ",").alias("records"))


@query(f"with {CHAIN} select iteration, partition_id, count(*) as size from flatc group by all")
def ag18_partition_sizes(spark, sf_dir):
    return C.partition_sizes(synthetic_chain(spark, sf_dir)).withColumnRenamed("partitionId", "partition_id")


@query(f"with {CHAIN} select iteration, size::int as cluster_size, count(*) as n from flatc group by all")
def ag19_cluster_sizes(spark, sf_dir):
    return C.cluster_size_distribution(synthetic_chain(spark, sf_dir))


@query(f"with {CHAIN} select iteration, count(*) filter (size = 0) as s0, count(*) filter (size = 1) as s1, count(*) filter (size > 1) as more from flatc group by all")
def sk04_cluster_size_pivot(spark, sf_dir):
    rows = C.cluster_size_counts(C.cluster_size_distribution(synthetic_chain(spark, sf_dir)))
    of = lambda k: F.coalesce(F.get("counts", F.lit(k)), F.lit(0)).cast("long")
    more = F.aggregate(F.slice("counts", F.lit(3), F.size("counts")), F.lit(0).cast("long"), lambda a, n: a + n)
    return rows.select("iteration", of(0).alias("s0"), of(1).alias("s1"), more.alias("more"))


@query(f"with {CHAIN} select iteration, count(*) filter (partition_id = 0) as p0, count(*) filter (partition_id = 1) as p1, count(*) filter (partition_id = 2) as p2 from flatc group by all")
def sk05_partition_size_pivot(spark, sf_dir):
    return C.pivot_partition_sizes(C.partition_sizes(synthetic_chain(spark, sf_dir))).toDF("iteration", "p0", "p1", "p2")


TRUTH = f"with {BASE}, truth as (select rec_id, min(rec_id) over (partition by true_ent) as cluster_id from er), pred as (select rec_id, min(rec_id) over (partition by a0, a1, a2) as cluster_id from er)"
PAIRS = "select least(x.rec_id, y.rec_id) as a, greatest(x.rec_id, y.rec_id) as b from {t} x join {t} y on x.cluster_id = y.cluster_id and x.rec_id < y.rec_id"
CONFUSED = f"{TRUTH}, pp as ({PAIRS.format(t='pred')}), tp as ({PAIRS.format(t='truth')}), cm as (select count(*) filter (p and t) as tp, count(*) filter (p and not t) as fp, count(*) filter (t and not p) as fn from (select coalesce(x.f, false) as p, coalesce(y.f, false) as t from (select *, true as f from pp) x full join (select *, true as f from tp) y using (a, b)))"


def truth(spark, sf_dir):
    return K.to_membership(K.to_clusters(records(spark, sf_dir), "rec_id", "true_ent"))


def predicted(spark, sf_dir):
    return K.exact_matches(records(spark, sf_dir), NAMES)


@query(f"{TRUTH} select string_agg(rec_id, ',' order by rec_id) as cluster from truth group by cluster_id")
def ag20_membership_clusters(spark, sf_dir):
    return K.to_clusters(records(spark, sf_dir), "rec_id", "true_ent").select(F.array_join("cluster", ",").alias("cluster"))


@query(f"{TRUTH} select rec_id, cluster_id from truth")
def pr12_membership(spark, sf_dir):
    return truth(spark, sf_dir)


@query(f"{TRUTH} {PAIRS.format(t='truth')}")
def pr11_pairs(spark, sf_dir):
    return K.pairs_of(truth(spark, sf_dir))


@query(f"{TRUTH} {PAIRS.format(t='truth')}")
def pr10_canonical_pairs(spark, sf_dir):
    """Pairs given twice and the wrong way round come out once, in order."""
    pairs = K.pairs_of(truth(spark, sf_dir))
    return K.canonical_pairs(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))


@query(f"{CONFUSED} select tp, fp, fn from cm")
def ag22_confusion(spark, sf_dir):
    return K.confusion(K.flagged_pairs(K.pairs_of(predicted(spark, sf_dir)), K.pairs_of(truth(spark, sf_dir))))


@query(f"{CONFUSED} select tp, fp, fn, round(tp / (tp + fp), 9) as precision, round(tp / (tp + fn), 9) as recall, round(2 * tp / (2 * tp + fn + fp), 9) as f1 from cm")
def ag24_pairwise_metrics(spark, sf_dir):
    m = K.membership_metrics(predicted(spark, sf_dir), truth(spark, sf_dir))
    return m.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"{TRUTH} select p.cluster_id as pred_id, t.cluster_id as true_id, count(*) as n from pred p join truth t using (rec_id) group by all")
def ag21_contingency(spark, sf_dir):
    return K.contingency(predicted(spark, sf_dir), truth(spark, sf_dir))


@query(f"""{TRUTH}, cells2 as (select p.cluster_id as p, t.cluster_id as t, count(*)::double as n from pred p join truth t using (rec_id) group by all),
    k as (select (select sum(n * (n - 1) / 2) from cells2) as c, (select sum(n * (n - 1) / 2) from (select sum(n) as n from cells2 group by p)) as a,
          (select sum(n * (n - 1) / 2) from (select sum(n) as n from cells2 group by t)) as b, (select sum(n) * (sum(n) - 1) / 2 from cells2) as m)
    select round((c - a * b / m) / ((a + b) / 2 - a * b / m), 9) as ari from k""")
def ag25_adjusted_rand(spark, sf_dir):
    return K.adjusted_rand(K.contingency(predicted(spark, sf_dir), truth(spark, sf_dir))).select(F.round("ari", 9).alias("ari"))


@query(f"{TRUTH} select rec_id, cluster_id from pred")
def ag26_exact_match(spark, sf_dir):
    return predicted(spark, sf_dir)


@query(f"""with {BASE} select pattern, string_agg(rec_id, ',' order by rec_id) as cluster from (
        select 'a0,a1' as pattern, rec_id, a0 as k1, a1 as k2 from er union all select 'a0,a2', rec_id, a0, a2 from er union all select 'a1,a2', rec_id, a1, a2 from er
    ) group by pattern, k1, k2""")
def ag27_near_match(spark, sf_dir):
    return K.near_matches(records(spark, sf_dir), NAMES, 1).select("pattern", F.array_join("cluster", ",").alias("cluster"))


def transitions(sampler: str):
    """Three transitions over all records: where each record went, and with whom."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = state(spark, sf_dir, False)
        s.iteration = 0
        for _ in range(3):
            s = T.step(s, sampler, tables.keep)
        return s.links.join(s.parts, "ent_id").select("rec_id", "ent_id", "partition_id")

    return run


for _name in T.SAMPLERS:
    QUERIES["mc15_sampler_" + _name.lower().replace("-", "_")] = transitions(_name)


# --- whole steps, with the distortion probabilities at the prior's mean, as SQL can't repeat Beta draws ---------

LINK_SQL = {False: ORACLE_SQL["mc07_link_gibbs"], True: ORACLE_SQL["mc09_link_collapsed"]}
VALUE_SQL = {"PCG-I": "mc10_value_collapsed", "PCG-II": "mc10_value_collapsed", "Gibbs": "mc11_value_gibbs", "Gibbs-Sequential": "mc12_value_seq"}


def step_sql(sampler: str) -> str:
    """The updates' SQL in turn, each over the tables that the ones before left."""
    own = lambda sql: sql.removeprefix(f"with {STATE}, ")
    links, values = own(LINK_SQL[T.SAMPLERS[sampler][0]]), own(ORACLE_SQL[VALUE_SQL[sampler]])
    moved = "links as (select * from new_links)"
    return f"""with {STATE}, new_links as (with {links}), new_values as (with {moved}, {values}),
        new_cells as (with {moved}, entities as (select * from new_values), {own(ORACLE_SQL["mc14_distortion_update"])})
        select c.rec_id, c.attr_id, c.value_id, c.distorted, l.ent_id, v.value_id as entity_value, p.value_id % 4 as partition_id
        from new_cells c join new_links l using (rec_id) join new_values v on v.ent_id = l.ent_id and v.attr_id = c.attr_id
        join new_values p on p.ent_id = l.ent_id and p.attr_id = 1"""


def whole_step(sampler: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = state(spark, sf_dir)
        s.iteration = 0
        s = T.step(s, sampler, tables.keep, s.theta)
        values = s.entities.withColumnRenamed("value_id", "entity_value")
        return s.cells.drop("file_id").join(s.links, "rec_id").join(values, ["ent_id", "attr_id"]).join(s.parts, "ent_id").select("rec_id", "attr_id", "value_id", "distorted", "ent_id", "entity_value", "partition_id")

    return run


for _name in T.SAMPLERS:
    _key = "mc03_step_" + _name.lower().replace("-", "_")
    QUERIES[_key], ORACLE_SQL[_key] = whole_step(_name), step_sql(_name)


DIAGNOSTICS = LOGLIK.format(cells="st").replace("select round(", "select (").replace(", 3) as log_likelihood", ") as log_likelihood").replace(f"with {STATE}", "")


@query(f"""with {STATE}, ll as ({DIAGNOSTICS}), per as (select rec_id, count(*) filter (distorted) as k from st group by all)
    select 'iteration' as name, '1' as value
    union all select 'numObservedEntities', count(distinct ent_id)::varchar from links
    union all select 'logLikelihood', printf('%.9e', log_likelihood) from ll
    union all select 'popSize', count(*)::varchar from parts
    union all select concat('aggDist-a', attr_id), (count(*) filter (distorted))::varchar from st group by attr_id
    union all select concat('recDistortion-', n), (select count(*) from per where k = n)::varchar from (select unnest(range(4)) as n)""")
def sk03_diagnostics(spark, sf_dir):
    """The diagnostics row of the initial state, without its clock."""
    from kinfold.operators.sampler import diagnostics_row

    s = state(spark, sf_dir)
    pairs = [(k, str(v)) for k, v in zip(diagnostics_header(s), diagnostics_row(s), strict=True) if k != "systemTime-ms"]
    return spark.createDataFrame(pairs, "name string, value string")
