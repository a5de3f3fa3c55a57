"""Queries of projections and small record operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import projections as J
from quillspark.operators import records
from quillspark.plans.relations import Catalogue, annotations, rollouts, scenarios, table, with_sql

CATALOGUE = Catalogue()
add = CATALOGUE.add


@add(with_sql("select id, list_sort(list_distinct(list_transform(domains, lambda d: case d when 'ECONOMY' then 'budget' when 'PROMO' then 'budget' else lower(d) end))) as domains, case when len(domains) = 0 then 'unknown' else array_to_string(list_sort(list_distinct(list_transform(domains, lambda d: case d when 'ECONOMY' then 'budget' when 'PROMO' then 'budget' else lower(d) end))), '|') end as signature from scenarios", "scenarios"))
def canonical_domains(spark, sf_dir):
    aliases = spark.createDataFrame([("Economy", "budget"), ("promo", "Budget")], "variant string, canonical string")
    return J.canonical_domains(scenarios(spark, sf_dir), "id", "domains", aliases)


@add("select o_orderkey as id, case o_orderkey % 4 when 0 then 'Given' when 1 then 'ToolB' when 2 then 'JsonA' else '' end as training, case o_orderkey % 4 when 0 then 'Given' when 1 then 'ToolA' when 2 then 'JsonA' else '' end as evaluation from orders")
def final_actions(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    expected = F.when(k == 0, " Given ").otherwise(" ")
    a = F.struct(F.when(k == 1, "ToolA").alias("tool_name"), F.when(k == 2, '{"name": "JsonA"}').otherwise("{}").alias("action_raw"))
    b = F.struct(F.when(k == 1, "ToolB").alias("tool_name"), F.lit(None).cast("string").alias("action_raw"))
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), expected.alias("e"), a.alias("a"), b.alias("b"))
    return df.select("id", J.final_action(F.col("e"), F.col("a"), F.col("b"), True).alias("training"), J.final_action(F.col("e"), F.col("a"), F.col("b"), False).alias("evaluation"))


@add("select c_custkey as id, k::int as candidate, round((c_custkey * 7 + k * 13) % 11 / 10.0, 6)::double as score from (select c_custkey, k, row_number() over (partition by c_custkey order by (c_custkey * 7 + k * 13) % 11 desc, k) as rn from customer, range(4) r(k)) where rn = 1")
def best_candidates(spark, sf_dir):
    df = J.repeat(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), 4, "candidate")
    scored = df.withColumn("score", F.round((F.col("id") * 7 + F.col("candidate") * 13) % 11 / 10.0, 6))
    return J.best_candidate(scored, "id", "score", "candidate").select("id", "candidate", "score")


@add(with_sql("select dropped, count(*) as n from (select case when id % 10 = 0 then 'empty_response' when id % 3 = 0 and abs(t) < 1 then 'near_tie' end as dropped from (select id, ((id % 5) - 2) / 2.0 as t from scenarios)) where dropped is not null group by 1", "scenarios"))
def weak_pairs(spark, sf_dir):
    k = F.col("id")
    df = scenarios(spark, sf_dir).select("id", F.when(k % 10 == 0, " ").otherwise("x").alias("response_a"), F.lit("y").alias("response_b"), F.when(k % 3 == 0, "tie").alias("majority_bucket"), ((k % 5 - 2) / 2.0).alias("target_score"))
    return J.drop_weak(df)[1]


@add("select event_id % 50 as name, event_type as model, max(case when event_id % 4 <> 0 then event_id end) is not null as reused from events group by all")
def reused_responses(spark, sf_dir):
    df = table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("name"), F.col("event_type").alias("model"), F.when(F.col("event_id") % 4 != 0, F.col("event_id")).alias("a"))
    stored = df.groupBy("name", "model").agg(F.max("a").cast("string").alias("action"))
    return J.reuse_or_pending(df.select("name", "model").distinct(), stored, F.col("action") != "").select("name", "model", "reused")


@add("select user_id, list_sort(list_distinct(list(event_type))) as names, count(*) as n from events group by 1")
def trajectory_tools(spark, sf_dir):
    line = F.concat(F.lit('{"type":"tool_use","name":"'), "event_type", F.lit('"}'))
    df = table(spark, sf_dir, "events").groupBy("user_id").agg(F.concat_ws("\n", F.collect_list(line)).alias("t"), F.count("*").alias("n"))
    return df.select("user_id", F.array_sort(J.tool_names(F.col("t"))).alias("names"), "n")


@add("""select event_id, {'k': 'integer', 'b': 'string', 'c': 'array'} as types from events where event_id % 2 = 0 union all select event_id, {'k': 'integer', 'b': 'boolean', 'c': 'array'} from events where event_id % 2 = 1""")
def argument_schemas(spark, sf_dir):
    b = F.when(F.col("event_id") % 2 == 0, '{"b": "x", "c": [1]}').otherwise('{"b": true, "c": []}')
    types = J.argument_types(F.col("props"), b)
    return table(spark, sf_dir, "events").select("event_id", F.struct(*[types[k].alias(k) for k in "kbc"]).alias("types"))


@add(with_sql("select id, substr(sha1('family: ' || family || chr(10) || 'scope: ' || scope), 1, 12) as key from scenarios", "scenarios"))
def embedding_keys(spark, sf_dir):
    text = J.embedding_text({"family": F.col("family"), "story": F.lit(" "), "scope": F.col("scope")})
    return scenarios(spark, sf_dir).select("id", J.short_hash(text).alias("key"))


@add("select id, stage, reason from (select doc_id as id, case when n_chars < 300 then 'length' when lang <> 'en' then 'language' end as stage, case when n_chars < 300 then n_chars || ' characters' when lang <> 'en' then lang end as reason from documents)")
def staged_filter(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars", "lang")
    stages = [("length", F.col("n_chars") >= 300, F.concat(F.col("n_chars").cast("string"), F.lit(" characters"))), ("language", F.col("lang") == "en", F.col("lang"))]
    return records.staged(df, stages).select("id", "stage", "reason")


@add("select p_partkey as id, list_filter([case when p_size < 10 then 'small' end, case when p_retailprice > 950 then 'dear' end, case when p_brand like '%3' then 'brand' end], lambda x: x is not null) as errors from part")
def record_errors(spark, sf_dir):
    rules = [(F.col("p_size") >= 10, "small"), (F.col("p_retailprice") <= 950, "dear"), (~F.col("p_brand").like("%3"), "brand")]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), records.errors(rules).alias("errors"))


@add("select vec_id, list_transform(range(0, 8), lambda i: i > coalesce(list_position(list_transform(embedding[:8], lambda x: (abs(x) * 100)::int % 4), 0), 0) - 1 and true) as mask from (select vec_id, list_transform(embedding, lambda x: floor(abs(x) * 100) / 100 + 0.0001) as embedding from embeddings)")
def response_masks(spark, sf_dir):
    tokens = F.transform(F.slice("embedding", 1, 8), lambda x: (F.round((F.floor(F.abs(x.cast("double")) * 100) / 100 + 0.0001) * 100).cast("int") % 4))
    df = table(spark, sf_dir, "embeddings").select("vec_id", tokens.alias("t"))
    return df.select("vec_id", records.response_mask(F.col("t"), [[0]]).alias("mask"))


@add(with_sql("select id, string_agg('- ' || preference, chr(10) order by preference) as block, count(*) as n from annotations group by 1", "annotations"))
def memory_blocks(spark, sf_dir):
    return annotations(spark, sf_dir).groupBy("id").agg(J.bullet_list(F.array_sort(F.collect_list("preference"))).alias("block"), F.count("*").alias("n"))


@add()
def loader_batches(spark, sf_dir):
    prompts = rollouts(spark, sf_dir).select("prompt").distinct()
    return J.loader_batches(prompts, 7, 1, 16, "prompt")
