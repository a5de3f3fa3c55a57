"""Queries of constrained subset selection, name plans, streams and files."""

from __future__ import annotations


from pyspark.sql import functions as F

from quillspark.operators import balance as B
from quillspark.operators import report as R
from quillspark.plans.relations import Catalogue, scenarios, table, with_sql
from quillspark.streaming import ledger as S

CATALOGUE = Catalogue()
add = CATALOGUE.add
RANKED = "ranked as (select *, row_number() over (partition by family order by sha1('42:' || id), id) as rank, count(*) over (partition by family) as n from scenarios)"
THREE = ["BUILDING", "MACHINERY", "FURNITURE"]


def _small(spark, sf_dir):
    return scenarios(spark, sf_dir).select("id", "family", "scope", "domains")


@add(with_sql("select id, family from ranked where family in ('BUILDING', 'MACHINERY', 'FURNITURE') and rank <= (select min(n) from ranked where family in ('BUILDING', 'MACHINERY', 'FURNITURE'))", "scenarios", more=RANKED))
def equalize_families(spark, sf_dir):
    df = _small(spark, sf_dir)
    return B.take_quotas(df, ["family"], B.equalized(B.counts_of(df, "family"), THREE), "id", 42).select("id", "family")


SHARE_RANKED = "ranked as (select *, row_number() over (partition by scope order by sha1('42:' || id), id) as rank from scenarios)"


@add(with_sql("""select id, scope from ranked join quota using (scope) where rank <= q""", "scenarios", more=SHARE_RANKED + """,
n as (select scope, count(*)::bigint as n from scenarios group by 1), t as (select least(sum(n), min(n * 100 // case scope when 'F' then 60 end))::bigint as t from n),
need as (select scope, n, case scope when 'F' then (t * 60 + 99) // 100 else 0 end as least_n, sum(n) over () - t as cut from n, t),
spare as (select *, n - least_n as s from need),
levels as (select distinct l from (select s as l from spare union all select 0)),
level as (select min(l) as l from levels where (select sum(greatest(0, s - l)) from spare) <= (select max(cut) from spare)),
base as (select scope, n, s, greatest(0, s - l) as gone, cut, l, least(s, l) as kept_spare from spare, level),
more as (select *, cut - sum(gone) over () as left_over from base),
quota as (select scope, n - gone - case when kept_spare > 0 and kept_spare = l then left_over // count(*) filter (kept_spare = l) over ()
  + case when row_number() over (partition by kept_spare = l order by n - gone desc, scope) <= left_over % greatest(1, count(*) filter (kept_spare = l) over ()) then 1 else 0 end else 0 end as q from more)"""))
def min_share_trim(spark, sf_dir):
    """Rows that stay where scope F is to have 60 percent: the others are trimmed, most where most is to spare."""
    df = _small(spark, sf_dir)
    counts = B.counts_of(df, "scope")
    return B.take_quotas(df, ["scope"], B.min_share_quotas(counts, {"F": 60.0}), "id", 42).select("id", "scope")


@add(with_sql("""select id, family from ranked join quota using (family) where rank <= q""", "scenarios", more="""ranked as (select *, row_number() over (partition by family order by sha1('42:' || id), id) as rank from scenarios where family in ('BUILDING', 'MACHINERY', 'FURNITURE')),
n as (select family, count(*)::bigint as n from ranked group by 1), t as (select least(sum(n), min(n * 100 // 33))::bigint as t from n),
o as (select family, n, n - (t * 33 + 99) // 100 as spare, sum(n) over () - t as cut from n, t),
quota as (select family, n - greatest(0, least(spare, cut - coalesce(sum(spare) over (order by n desc, family rows between unbounded preceding and 1 preceding), 0))) as q from o)"""))
def min_family_share(spark, sf_dir):
    df = _small(spark, sf_dir).where(F.col("family").isin(THREE))
    counts = B.counts_of(df, "family")
    return B.take_quotas(df, ["family"], B.min_family_quotas(counts, THREE, 33.0), "id", 42).select("id", "family")


@add()
def joint_family_scope(spark, sf_dir):
    df = _small(spark, sf_dir)
    quotas = B.joint_quotas(B.counts_of(df, "family", "scope"), THREE, "F", 40.0)
    return B.take_quotas(df, ["family", "scope"], quotas, "id", 42).groupBy("family", "scope").agg(F.count("*").alias("n"))


@add()
def exact_caps(spark, sf_dir):
    fields = {"family": F.array("family"), "scope": F.array("scope")}
    return B.exact_caps(_small(spark, sf_dir), fields, {"family": 20.0, "scope": 33.4}, "id").groupBy("family", "scope", "cap_status").agg(F.count("*").alias("n"))


@add(with_sql("select (3 * min(k))::bigint as equalized, least(sum(k), 100 * min(k) // 33)::bigint as with_share from (select family, count(*) as k from scenarios where family in ('BUILDING', 'MACHINERY', 'FURNITURE') group by 1)", "scenarios"))
def projected_sizes(spark, sf_dir):
    counts = B.counts_of(_small(spark, sf_dir).where(F.col("family").isin(THREE)), "family")
    return spark.createDataFrame([(B.projected_size(counts, THREE), B.projected_size(counts, THREE, 33.0))], "equalized long, with_share long")


@add("select c_custkey as id, place from (select c_custkey, row_number() over (order by round(ln((('0x' || substr(sha1('42:' || c_name), 1, 12))::bigint::double + 1) / (pow(16, 12) + 1)) / (1 + c_custkey % 7), 9) desc, c_custkey) as place from customer) where place <= 50")
def weighted_name_sample(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.round(B.weighted_order(1 + F.col("c_custkey") % 7, F.col("c_name")), 9).alias("o"))
    from pyspark.sql import Window

    top = df.orderBy(F.desc("o"), "id").limit(50)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc("o"), "id")).cast("long").alias("place"))


@add("""with b as (select n_name as name, sqrt(1 + n_nationkey) as w, n_nationkey % 3 as used from nation), u as (select name, w, used, k, ln((('0x' || substr(sha1('42:' || k || ':' || name), 1, 12))::bigint::double + 1) / (pow(16, 12) + 1)) as l from b, range(0, 61) r(k)),
t as (select name, false as soft, -l / w as due from u where k = 0 and used = 0 union all select name, true, sum(-l / w * pow(1 + 0.5 * (greatest(used, 1) + k - 1), 2)) over (partition by name order by k) from u where k > 0)
select place, name, soft from (select name, soft, row_number() over (order by soft, due, name) as place from t) where place <= 60""")
def soft_name_draws(spark, sf_dir):
    """More draws than unused names: each of those once, then any, those drawn often more rarely."""
    bank = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (1 + F.col("n_nationkey")).alias("frequency"), (F.col("n_nationkey") % 3).alias("used"))
    return B.draw_names(bank, 60, 0.5, 0.5)


@add("select id, surname from (select p_partkey as id, split_part(p_name, ' ', 2) as surname, row_number() over (partition by split_part(p_name, ' ', 2) order by sha1('42:' || p_partkey), p_partkey) as rank from part) where surname in ('ring', 'widget') and rank > 20")
def surname_excess(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").getItem(1).alias("surname"))
    return B.excess_names(df, "surname", "id", 20, ["ring", "widget"])


@add("select user_id % 10 as sample, event_type as model, count(*) as n, round(sum(value), 6) as total from events group by all")
def streaming_ledger(spark, sf_dir):
    """All events through a file stream that appends to a ledger batch by batch, then the ledger's counts."""
    ledger = S.run_ledger(spark, f"{sf_dir}/events.parquet")
    return ledger.groupBy((F.col("user_id") % 10).alias("sample"), F.col("event_type").alias("model")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@add("select epoch(time_bucket(interval 6 hours, ts))::bigint as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def windowed_counts(spark, sf_dir):
    df = S.windowed(table(spark, sf_dir, "events"), "6 hours")
    return df.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@add("""with d as (select event_type as value, event_id, sum(case when event_id % 3 = 0 or event_id < 40 then -1 else 1 end) over (partition by event_type order by event_id) as s from events)
select value, (max_by(s, event_id) - least(0, min(s)))::bigint as n from d group by 1""")
def rollback_counters(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.col("event_type").alias("value"), F.col("event_id").alias("pos"), F.when((F.col("event_id") % 3 == 0) | (F.col("event_id") < 40), -1).otherwise(1).alias("delta"))
    return S.signed_counts(df)
