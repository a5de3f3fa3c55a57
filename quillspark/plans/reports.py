"""Queries of the report, balance-check and order operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import names as N
from quillspark.operators import order as O
from quillspark.operators import report as R
from quillspark.plans.relations import Catalogue, scenarios, table, with_sql

CATALOGUE = Catalogue()
add = CATALOGUE.add
def dims(*names: str) -> dict[str, Column]:
    """Dimensions of scenarios as arrays of categories; all, or those named."""
    made = {
        "family": lambda: R.scalar_contribution(F.col("family")), "scope": lambda: R.scalar_contribution(F.col("scope")), "final_action": lambda: R.scalar_contribution(F.col("final_action")),
        "toolkit": lambda: R.contributions(F.col("toolkits")), "domain": lambda: R.contributions(F.col("domains")),
        "toolkit_signature": lambda: F.array(R.signature(F.col("toolkits"))), "domain_signature": lambda: F.array(R.signature(F.col("domains"))), "domain_arity": lambda: F.array(F.size("domains").cast("string")),
        "domain_pair": lambda: R.pairs_of(F.col("domains")),
    }
    return {n: made[n]() for n in names or made}


CAPS = {"family": 21.0, "scope": 33.4, "toolkit": 5.0, "domain": 20.0}
LONG = """long as (select id as pos, 'family' as dim, lower(trim(family)) as value from scenarios union all select id, 'scope', lower(trim(scope)) from scenarios
  union all select id, 'final_action', lower(trim(final_action)) from scenarios
  union all select id, 'toolkit', unnest(case when len(toolkits) = 0 then ['unknown'] else toolkits end) from scenarios
  union all select id, 'domain', unnest(case when len(domains) = 0 then ['unknown'] else domains end) from scenarios
  union all select id, 'toolkit_signature', case when len(toolkits) = 0 then 'unknown' else array_to_string(toolkits, '|') end from scenarios
  union all select id, 'domain_signature', case when len(domains) = 0 then 'unknown' else array_to_string(domains, '|') end from scenarios
  union all select id, 'domain_arity', len(domains)::varchar from scenarios
  union all select s.id, 'domain_pair', a.d || '|' || b.d from scenarios s, unnest(s.domains) a(d), unnest(s.domains) b(d) where a.d < b.d),
counts as (select dim, value, count(*) as n, min(pos) as first_pos from long group by 1, 2), n as (select count(*) as total from scenarios)"""


def _counts(spark: SparkSession, sf_dir: str, *names: str) -> tuple[DataFrame, int]:
    df = scenarios(spark, sf_dir)
    total = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).count()
    return R.long_counts(df, dims(*names), "id"), total


def _top_sql(k: int, dims: str) -> str:
    return with_sql(
        f"""select dim, least(rank, {k + 1})::int as rank, case when rank <= {k} then value else '(others)' end as value, sum(n)::bigint as n, round(100 * sum(n) / any_value(total), 6) as pct
from (select *, row_number() over (partition by dim order by n desc, first_pos) as rank from counts where dim in ({dims})), n group by 1, 2, 3""",
        "scenarios",
        more=LONG,
    )


@add(_top_sql(10, "'toolkit', 'domain', 'family', 'scope'"))
def category_mass_report(spark, sf_dir):
    counts, total = _counts(spark, sf_dir, "toolkit", "domain", "family", "scope")
    return R.top_with_others(counts, 10, total)


@add(_top_sql(50, "'family', 'scope', 'final_action', 'toolkit', 'domain', 'toolkit_signature', 'domain_signature', 'domain_arity', 'domain_pair'"))
def frequency_report(spark, sf_dir):
    counts, total = _counts(spark, sf_dir)
    return R.top_with_others(counts, 50, total)


@add(with_sql("select dim, count(*) as distinct_values, sum(n)::bigint as mass, max(n) as largest from counts group by 1", "scenarios", more=LONG))
def dimension_stats(spark, sf_dir):
    counts, _ = _counts(spark, sf_dir)
    return counts.groupBy("dim").agg(F.count("*").alias("distinct_values"), F.sum("n").alias("mass"), F.max("n").alias("largest"))


def _dim_query(name: str, dim: str):
    def query(spark, sf_dir):
        return _counts(spark, sf_dir, dim)[0].select("value", "n")

    query.__name__ = name
    add(with_sql(f"select value, n from counts where dim = '{dim}'", "scenarios", more=LONG))(query)


for _name, _dim in (("domain_pair_counts", "domain_pair"), ("domain_signature_counts", "domain_signature"), ("toolkit_signature_counts", "toolkit_signature"), ("family_counts", "family")):
    _dim_query(_name, _dim)


@add(with_sql("select dim, greatest(floor(total * pct / 100), 1)::bigint as cap, sum(greatest(c.n - greatest(floor(total * pct / 100), 1), 0))::bigint as excess from counts c join (values ('family', 21.0), ('scope', 33.4), ('toolkit', 5.0), ('domain', 20.0)) p(dim, pct) using (dim), n group by 1, 2", "scenarios", more=LONG))
def cap_excess(spark, sf_dir):
    counts, total = _counts(spark, sf_dir, *CAPS)
    return R.cap_excess(counts, total, CAPS)


SHARES = [("family", "building", 25.0), ("family", "furniture", 10.0), ("scope", "f", 40.0), ("toolkit", "Brand#99", 1.0)]


@add(with_sql("select dim, value, (ceil(total * pct / 100) - coalesce(c.n, 0))::bigint as missing from (values ('family', 'building', 25.0), ('family', 'furniture', 10.0), ('scope', 'f', 40.0), ('toolkit', 'Brand#99', 1.0)) p(dim, value, pct) left join counts c using (dim, value), n where ceil(total * pct / 100) > coalesce(c.n, 0)", "scenarios", more=LONG))
def min_share_violations(spark, sf_dir):
    counts, total = _counts(spark, sf_dir, "family", "scope", "toolkit")
    return R.min_share_violations(counts, total, SHARES)


@add(with_sql("select dim, count(distinct value) as categories, max(w)::int as widest, max(w) > 1 or count(distinct value) * any_value(pct) >= 100 as enforceable from (select *, count(*) over (partition by dim, pos) as w from long) join (values ('family', 15.0), ('scope', 33.4), ('toolkit', 5.0), ('final_action', 25.0)) p(dim, pct) using (dim) group by 1", "scenarios", more=LONG))
def enforceable_fields(spark, sf_dir):
    caps = {"family": 15.0, "scope": 33.4, "toolkit": 5.0, "final_action": 25.0}
    return R.enforceable(scenarios(spark, sf_dir), dims(*caps), caps)


@add(with_sql("""select id, round(sum(w * s / width), 6) as score from (select pos as id, dim, value, count(*) over (partition by dim, pos) as width from long where dim in ('final_action', 'toolkit', 'domain', 'family', 'scope'))
join (select dim, value, 1 / pow(1 + m / avg(m) over (partition by dim), 2) as s from (select dim, value, sum(case when dim = 'domain' then 1.0::double / width else 1 end) as m from (select *, count(*) over (partition by dim, pos) as width from long where dim in ('final_action', 'toolkit', 'domain', 'family', 'scope')) group by 1, 2)) using (dim, value)
join (values ('final_action', 4.0::double), ('domain', 2), ('toolkit', 1), ('family', 1), ('scope', 1)) w(dim, w) using (dim) group by 1""", "scenarios", more=LONG))
def novelty_scores(spark, sf_dir):
    weights = {"final_action": 4, "domain": 2, "toolkit": 1, "family": 1, "scope": 1}
    return R.novelty(scenarios(spark, sf_dir), "id", dims(*weights), weights, {"domain"})


@add("""with p as (select c_custkey as id, unnest([{'dim': 'a', 'value': lower(c_mktsegment)}, {'dim': 'b', 'value': c_nationkey::varchar}, {'dim': 'c', 'value': (c_custkey % 5)::varchar}], recursive := true) from customer),
s as (select dim, value, 1 / pow(1 + n / avg(n) over (partition by dim), 2) as s from (select dim, value, count(*)::double as n from p group by 1, 2))
select id, round(sum(s), 6) as score from p join s using (dim, value) group by 1""")
def profile_novelty(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    own = {"a": R.scalar_contribution(F.col("c_mktsegment")), "b": F.array(F.col("c_nationkey").cast("string")), "c": F.array((F.col("c_custkey") % 5).cast("string"))}
    return R.novelty(df, "c_custkey", own, dict.fromkeys(own, 1))


@add(with_sql("""select id, case when len(domains) = 0 then 'unknown' else array_to_string(domains, '|') end as domain_signature, case when len(toolkits) = 0 then 'unknown' else array_to_string(toolkits, '|') end as toolkit_signature,
case when id % 4 = 0 then 'unknown' when id % 4 = 1 then 'multi_subject' when id % 4 = 2 then 'self' else 'third_party' end as subject_scope,
case when id % 5 = 0 then 'nvidia' when id % 5 = 1 then 'gpt' when id % 5 = 2 then 'step' when id % 5 = 3 then 'qwen' else lower(family) end as model_family from scenarios""", "scenarios"))
def computed_fields(spark, sf_dir):
    df = scenarios(spark, sf_dir)
    k4, k5 = F.col("id") % 4, F.col("id") % 5
    sender = F.when(k4 == 0, "  ").otherwise("Dr. Ana Silva, clerk")
    subject = F.when(k4 == 1, "Ana Silva, clerk and Bo Li, nurse").when(k4 == 2, "ANA SILVA, at work").otherwise("Bo Li, nurse")
    probe = F.when(k5 == 0, "org/Nemotron-GPT").when(k5 == 1, "my-gpt-oss-20b").when(k5 == 2, "StepFun/step-3").when(k5 == 3, "gptx-Qwen3").otherwise(F.col("family"))
    return df.select("id", R.signature(F.col("domains")).alias("domain_signature"), R.signature(F.col("toolkits")).alias("toolkit_signature"), N.subject_scope(subject, sender).alias("subject_scope"), N.model_family(probe).alias("model_family"))


@add("""with w as (select p_partkey as id, unnest(list_distinct(string_split(p_name, ' '))) as name from part), n as (select count(*) as total from part)
select name, count(*) as n, greatest(ceil(any_value(total) * 2.0 / 100), 1)::bigint as threshold from w, n group by 1 having count(*) >= greatest(ceil(any_value(total) * 2.0 / 100), 1)""")
def name_frequency(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    least = N.abs_threshold(df.count(), 2.0)
    return N.frequent_names(df, F.split("p_name", " "), least).withColumn("threshold", F.lit(least).cast("long"))


@add("select o_orderkey as id, o_orderpriority as family, row_number() over (order by case o_orderpriority when '3-MEDIUM' then 0 when '1-URGENT' then 1 else 2 end, o_orderdate, o_orderkey) - 1 as combined_order_index from orders where o_orderpriority in ('3-MEDIUM', '1-URGENT', '5-LOW')")
def order_index(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("family"), "o_orderdate")
    return O.order_index(df, "family", ["3-MEDIUM", "1-URGENT", "5-LOW"], ["o_orderdate", "id"]).drop("o_orderdate")


@add("select p_partkey as id, case when rn = 1 then p_name else p_name || '__dup' || rn end as unique_name from (select *, row_number() over (partition by p_name order by p_partkey) as rn from part)")
def unique_names(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return O.unique_names(df, "p_name", "id", "unique_name").select("id", "unique_name")


@add("select min(doc_id) as doc_id from documents group by text, lang")
def keep_first_dedup(spark, sf_dir):
    return O.keep_first(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["text", "lang"], "doc_id").select("doc_id")


@add(with_sql("select id, row_number() over (order by rn, fp) - 1 as turn from (select id, row_number() over (partition by family order by id) as rn, case family when 'BUILDING' then 0 when 'MACHINERY' then 1 else 2 end as fp from scenarios where family in ('BUILDING', 'MACHINERY', 'FURNITURE'))", "scenarios"))
def round_robin_order(spark, sf_dir):
    return O.round_robin(scenarios(spark, sf_dir).select("id", "family"), "family", ["BUILDING", "MACHINERY", "FURNITURE"], "id").select("id", "turn")


@add(with_sql("""select id, row_number() over (order by last, rn, fp) - 1 as turn from (select id, n = m and k = 1 as last, row_number() over (partition by family order by id) as rn, fp from
(select *, case family when 'BUILDING' then 0 when 'MACHINERY' then 1 else 2 end as fp from scenarios where family in ('BUILDING', 'MACHINERY', 'FURNITURE'))
join (select family, n, max(n) over () as m, count(*) over (partition by n) as k from (select family, count(*) as n from scenarios where family in ('BUILDING', 'MACHINERY', 'FURNITURE') group by 1)) using (family))""", "scenarios"))
def protected_order(spark, sf_dir):
    return O.protected_order(scenarios(spark, sf_dir).select("id", "family"), "family", ["BUILDING", "MACHINERY", "FURNITURE"], "id").select("id", "turn")


@add("select c_custkey as id, sha1('7:' || c_name) as token, row_number() over (order by sha1('7:' || c_name), c_custkey) as place from customer")
def seeded_order(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), O.order_token(7, F.col("c_name")).alias("token"))
    return df.withColumn("place", F.row_number().over(Window.orderBy("token", "id")).cast("long"))
