"""Engine relations built from the driver's tables: as DataFrames, and as SQL for the oracles.

Each has one definition in each language, side by side: relation(name) gives the DataFrame builder, with_sql(query, ...)
puts the common table expressions of the relations that a query names in front of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario samples: id (also the position), family, scope, final_action, toolkits and domains (sorted sets), customer."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    sets = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_brand")).alias("toolkits"), F.array_sort(F.collect_set("p_type")).alias("domains"))
    none = F.array().cast("array<string>")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(sets, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("family"), F.col("o_orderstatus").alias("scope"), F.col("o_orderpriority").alias("final_action"),
            F.coalesce("toolkits", none).alias("toolkits"), F.coalesce("domains", none).alias("domains"), F.col("c_custkey").alias("customer"),
        )
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows: pos (file order), sample, model, prompt_sha1, status."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.element_at(F.array(*map(F.lit, ("ok", "parse_error", "empty_response", "api_error", "ok"))), F.pmod(k, F.lit(5)) + 1)
    sha = F.substring(F.sha1(F.concat_ws("/", F.col("user_id").cast("string"), F.pmod("event_id", F.lit(2)).cast("string"))), 1, 12)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("sample"), F.col("event_type").alias("model"), sha.alias("prompt_sha1"), status.alias("status"))


def sensibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes: name, judge, model, sensible (null where the judge's lines balance)."""
    sign = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", -1).otherwise(0)
    flat = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), F.concat(F.lit("judge"), (F.col("l_suppkey") % 3).cast("string")).alias("judge"), F.concat(F.lit("model"), (F.col("l_partkey") % 2).cast("string")).alias("model"), sign.alias("s"))
    return flat.groupBy("name", "judge", "model").agg(F.sum("s").alias("s")).select("name", "judge", "model", F.when(F.col("s") > 0, True).when(F.col("s") < 0, False).alias("sensible"))


def comparative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair judgments: name, judge, pair_family, differ, better_model, response_a_leaks, response_b_leaks, verdict."""
    flat = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("name"), F.concat(F.lit("judge"), (F.col("l_suppkey") % 3).cast("string")).alias("judge"))
    sums = flat.agg(F.sum("l_quantity").cast("long").alias("q"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count("*").alias("n"))
    differ = F.when(F.col("q") % 7 == 0, None).otherwise(F.col("q") % 4 != 0)
    return sums.select(
        "name", "judge", F.lit("model0_vs_model1").alias("pair_family"), differ.alias("differ"),
        F.when(differ, F.when(F.col("q") % 3 == 0, "model0").otherwise("model1")).alias("better_model"),
        F.when(F.col("q") % 5 == 0, None).otherwise(F.col("r") > 0).alias("response_a_leaks"), (F.col("r") == F.col("n")).alias("response_b_leaks"), F.concat(F.lit("v"), F.col("q").cast("string")).alias("verdict"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per annotation: id, preference (six classes), leak_a, leak_b (null: not labelled)."""
    band = F.floor(F.round(F.col("l_discount") * 100) / 2)
    names = F.array(*map(F.lit, ("agent_a", "agent_a_slightly", "tie", "agent_b_slightly", "agent_b", "agent_b")))
    pref = F.when(F.round(F.col("l_tax") * 100) == 8, "unsure").otherwise(F.element_at(names, band.cast("int") + 1))
    leak_a = F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), pref.alias("preference"), leak_a.alias("leak_a"), (F.col("l_linestatus") == "O").alias("leak_b"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgment rows: sample, judge, status, leaks, omits, model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    status = F.when(F.col("doc_id") % 7 == 0, "parse_error").when(F.col("doc_id") % 11 == 0, "skipped").otherwise("ok")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("sample"), F.col("lang").alias("judge"), status.alias("status"), (F.col("toxic") == 1).alias("leaks"), (F.col("quality") == 0).alias("omits"), F.col("source").alias("model"))


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled responses: prompt, generation, text, n_words, score (-2..2), invalid."""
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")).cast("long")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("prompt"), F.col("turn").alias("generation"), "text", words.alias("n_words"), ((F.length("text") % 5) - 2).cast("double").alias("score"), (F.col("role") == "system").alias("invalid"), "role")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


SQL = {
    "scenarios": """scenarios as (select o_orderkey as id, c_mktsegment as family, o_orderstatus as scope, o_orderpriority as final_action,
  coalesce(toolkits, []::varchar[]) as toolkits, coalesce(domains, []::varchar[]) as domains, c_custkey as customer
  from orders join customer on o_custkey = c_custkey left join (select l_orderkey, list_sort(list(distinct p_brand)) as toolkits, list_sort(list(distinct p_type)) as domains
    from lineitem join part on p_partkey = l_partkey group by 1) s on l_orderkey = o_orderkey)""",
    "ledger": """ledger as (select event_id as pos, user_id as sample, event_type as model, substr(sha1(user_id::varchar || '/' || (event_id % 2)::varchar), 1, 12) as prompt_sha1,
  ['ok', 'parse_error', 'empty_response', 'api_error', 'ok'][(props->>'$.k')::int % 5 + 1] as status from events)""",
    "sensibility": """sensibility as (select name, judge, model, case when s > 0 then true when s < 0 then false end as sensible from (
  select l_orderkey as name, 'judge' || (l_suppkey % 3) as judge, 'model' || (l_partkey % 2) as model, sum(case l_returnflag when 'R' then 1 when 'A' then -1 else 0 end) as s from lineitem group by all))""",
    "comparative": """comparative as (select name, judge, 'model0_vs_model1' as pair_family, case when q % 7 = 0 then null else q % 4 <> 0 end as differ,
  case when q % 7 <> 0 and q % 4 <> 0 then case when q % 3 = 0 then 'model0' else 'model1' end end as better_model,
  case when q % 5 = 0 then null else r > 0 end as response_a_leaks, r = n as response_b_leaks, 'v' || q as verdict from (
  select l_orderkey as name, 'judge' || (l_suppkey % 3) as judge, sum(l_quantity)::bigint as q, count(*) filter (where l_returnflag = 'R') as r, count(*) as n from lineitem group by all))""",
    "annotations": """annotations as (select l_orderkey as id, case when round(l_tax * 100) = 8 then 'unsure' else
  ['agent_a', 'agent_a_slightly', 'tie', 'agent_b_slightly', 'agent_b', 'agent_b'][floor(round(l_discount * 100) / 2)::int + 1] end as preference,
  case l_returnflag when 'R' then true when 'A' then false end as leak_a, l_linestatus = 'O' as leak_b from lineitem)""",
    "judged": """judged as (select doc_id as sample, lang as judge, case when doc_id % 7 = 0 then 'parse_error' when doc_id % 11 = 0 then 'skipped' else 'ok' end as status,
  toxic = 1 as leaks, quality = 0 as omits, source as model from labels join documents using (doc_id))""",
    "rollouts": r"""rollouts as (select conv_id as prompt, turn as generation, text, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint as n_words,
  (length(text) % 5 - 2)::double as score, role = 'system' as invalid, role from conversations)""",
    "vectors": "vectors as (select vec_id, embedding from embeddings)",
}


def with_sql(query: str, *names: str, more: str = "") -> str:
    """The query behind the relations it names; more: further expressions that may use them."""
    parts = [*[SQL[n] for n in names], *([more] if more else [])]
    return "with " + ",\n".join(parts) + "\n" + query


class Catalogue:
    """Queries and their SQL, registered side by side."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return register
