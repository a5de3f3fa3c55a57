"""Queries of records put together, prompts, fixed row layouts, batches for training, and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import names as N
from quillspark.functions import prompts as P
from quillspark.functions import text as X
from quillspark.operators import assembly as A
from quillspark.operators import identifiers as I
from quillspark.operators import training as K
from quillspark.plans.relations import Catalogue, ledger, rollouts, scenarios, table, with_sql
from quillspark.sources import files, splits
from quillspark.sources.store import scratch
from quillspark.streaming import batches

CATALOGUE = Catalogue()
add = CATALOGUE.add


def records(spark, sf_dir):
    """Output records of scenarios."""
    df = scenarios(spark, sf_dir)
    who = F.concat(F.lit("Customer "), F.col("customer").cast("string"))
    fields = {
        "name": F.concat(F.lit("s"), F.col("id").cast("string")), "model_name": F.when(F.col("id") % 5 != 0, F.col("family")), "data_subject": who, "data_sender": F.lit("Ana Silva, clerk"), "data_recipient": F.col("scope"), "data_sender_name": F.lit("Ana"),
        "domains": F.col("domains"), "story": F.concat(F.lit("About "), F.col("final_action")), "data_subject_concrete": F.when(F.col("id") % 2 == 0, who), "sensitive_info_items": F.slice("domains", 1, 1), "relevant_info_items": F.slice("toolkits", 1, 2),
        "memories": F.col("toolkits"), "user_name": F.lit("Ana Silva"), "user_email": F.lit("a.silva@mail.org"), "user_instruction": F.concat(F.lit("Do "), F.col("final_action")), "toolkits": F.col("toolkits"), "executable_trajectory": F.lit("t"),
        "final_action": F.col("final_action"), "leakage_judgment": F.when(F.col("id") % 3 == 0, True), "min_steps": F.col("id") % 4 + 2, "sensitive_memories": F.col("id") % 2 == 0,
    }
    return df.select("id", *A.output_record(fields, {"sex": F.lit("f"), "occupation": F.col("scope")}, judged=True))


@add(with_sql("""select id, 's' || id as name, case when id % 5 <> 0 then family else '' end as model, 'Customer ' || customer as subject, case when id % 2 = 0 then 'Customer ' || customer else '' end as concrete, domains[:1] as sensitive, toolkits as memories,
'Do ' || final_action as instruction, id % 3 = 0 as leaks, '' as judge_output, (id % 4 + 2)::int as min_steps, array_to_string(toolkits, '|') as signature, scope as occupation, '' as religion, 7 as parts from scenarios""", "scenarios"))
def output_records(spark, sf_dir):
    df = records(spark, sf_dir)
    return df.select(
        "id", "name", F.col("model_name").alias("model"), F.col("seed.data_subject").alias("subject"), F.col("vignette.data_subject_concrete").alias("concrete"), F.col("vignette.sensitive_info_items").alias("sensitive"), "memories",
        F.col("trajectory.user_instruction").alias("instruction"), F.col("trajectory.leakage_judgment").alias("leaks"), F.col("trajectory.leakage_judge_output").alias("judge_output"), F.col("generation_metadata.min_steps").alias("min_steps"),
        F.col("generation_metadata.toolkit_signature").alias("signature"), F.col("generation_metadata.profile_occupation").alias("occupation"), F.col("generation_metadata.profile_religion").alias("religion"), F.lit(len(df.columns) - 1).alias("parts"),
    )


@add(with_sql("select id, 'x' || id as subject, 'Ana Silva, clerk' as sender, id % 7 as deep, 's' || id as name from scenarios", "scenarios"))
def nested_fields(spark, sf_dir):
    df = A.set_nested(A.set_nested(A.set_nested(records(spark, sf_dir), "seed.data_subject", F.concat(F.lit("x"), F.col("id").cast("string"))), "extra.more.deep", F.col("id") % 7), "name.no.struct", F.lit(1))
    return df.select("id", F.col("seed.data_subject").alias("subject"), F.col("seed.data_sender").alias("sender"), F.col("extra.more.deep").alias("deep"), "name")


@add(with_sql("select id, 'Customer ' || customer as subject, toolkits, domains, toolkits as memories, final_action from scenarios union all select -id, 'Ana', toolkits, [], domains, case when id % 2 = 0 then final_action end from scenarios where id % 2 = 0", "scenarios"))
def prompt_inputs(spark, sf_dir):
    cols = lambda df: df.where("invalid is null").select("id", F.col("prompt_seed.data_subject").alias("subject"), F.col("prompt_seed.toolkits").alias("toolkits"), F.col("prompt_seed.domains").alias("domains"), F.col("prompt_vignette.memories").alias("memories"), F.col("prompt_seed.final_action").alias("final_action"))
    flat = scenarios(spark, sf_dir).select((-F.col("id")).alias("id"), F.lit("Ana").alias("user_name"), F.lit(None).cast("string").alias("user_email"), F.lit("i").alias("user_instruction"), "toolkits", F.lit("t").alias("trajectory"), F.when(F.col("id") % 2 == 0, F.col("final_action")).alias("final_action"), F.col("domains").alias("memories"))
    return cols(A.prompt_inputs(records(spark, sf_dir))).unionByName(cols(A.prompt_inputs(flat)))


def agent_prompt():
    t = lambda c: F.col(f"prompt_trajectory.{c}")
    values = {
        "user_name": t("user_name"), "user_email": t("user_email"), "user_instruction": t("user_instruction"), "toolkit_descriptions": P.bullets(t("toolkits")), "memories": P.bullets(F.col("prompt_vignette.memories")), "executable_trajectory": t("executable_trajectory"),
        "final_action": t("final_action"), "final_action_input_schema_json": F.lit("{}"), **P.task_lines(t("final_action")),
    }
    return P.stage_prompt("naive_agent", "User $user_name <$user_email>\n\n\n\n$user_instruction\n$memories\n$task_instructions\n$output_format_instructions", values)


PROMPT_SQL = """'User Ana Silva <a.silva@mail.org>' || chr(10) || chr(10) || 'Do ' || final_action || chr(10) || case when len(toolkits) > 0 then array_to_string(list_transform(toolkits, lambda x: '- ' || x), chr(10)) else '(none)' end || chr(10)
|| 'Generate exactly one `' || final_action || '` tool call based on the trajectory evidence.' || chr(10) || 'Output a single JSON object:' || chr(10) || '{"type": "tool_use", "name": "' || final_action || '", "arguments": { ... }}'"""


@add(with_sql(f"select 's' || id as sample_name, md5({PROMPT_SQL}) as digest, substr(sha1({PROMPT_SQL}), 1, 12) as prompt_sha1, final_action as expected_final_action, toolkits from scenarios", "scenarios"))
def eval_cases(spark, sf_dir):
    df = A.prompt_inputs(records(spark, sf_dir)).withColumn("sample_name", F.col("name"))
    return A.eval_cases(df, agent_prompt()).select("sample_name", F.md5("prompt").alias("digest"), "prompt_sha1", "expected_final_action", "toolkits")


@add(with_sql("""select id, md5(case when id % 2 = 0 then 'Customer ' || customer else 'Customer ' || customer end || ' to ' || scope || ': ' || case when len(domains) > 0 then '- ' || domains[1] else '(none)' end || ' | About ' || final_action) as leakage,
md5('About ' || final_action || ' [{"step":1,"action":"Act","action_input":{"a":' || id || '},"observation":"plain"}]') as quality from scenarios""", "scenarios"))
def stage_prompts(spark, sf_dir):
    df = A.prompt_inputs(records(spark, sf_dir))
    own = lambda c: df.schema[c].dataType.names
    ci = P.integrity_fields("prompt_vignette", "prompt_seed", (own("prompt_vignette"), own("prompt_seed")))
    t = lambda c: F.col(f"prompt_trajectory.{c}")
    base = {"story": F.col("prompt_vignette.story"), "user_name": t("user_name"), "user_instruction": t("user_instruction"), "memories": P.bullets(F.col("prompt_vignette.memories")), "executable_trajectory": t("executable_trajectory"), "generated_action": F.lit("{}")}
    items = {n: P.bullets(ci[n]) for n in ("sensitive_info_items", "relevant_info_items")}
    leakage = P.stage_prompt("leakage_judge", "$data_subject to $data_recipient: $sensitive_info_items | $story", {**base, **items, **{w: ci[w] for w in ("data_subject", "data_sender", "data_recipient")}})
    steps = F.array(F.struct(F.lit("Act").alias("action"), F.concat(F.lit('{"a": '), F.col("id").cast("string"), F.lit("}")).alias("action_input"), F.lit(" plain ").alias("observation")))
    quality = P.stage_prompt("quality_filter", "$story $observations_json", {**base, **items, "observations_json": P.observations(steps), "contextual_integrity_json": P.json_text(ci)})
    return df.select("id", F.md5(leakage).alias("leakage"), F.md5(quality).alias("quality"))


@add(with_sql("""select pos, 's' || sample as sample_name, model, regexp_replace(model, '[^A-Za-z0-9]+', '_', 'g') as model_slug, status, prompt_sha1, pos % 3 as attempt, case when status = 'ok' then 'out' || pos end as parsed_action, 18 as n_columns from ledger""", "ledger"))
def result_rows(spark, sf_dir):
    rows = ledger(spark, sf_dir).withColumn("sample_name", F.concat(F.lit("s"), F.col("sample").cast("string")))
    cases = rows.select("sample_name").distinct().withColumns({"expected_final_action": F.lit("Act"), "toolkits": F.array(F.lit("k")), "user_instruction": F.lit("i")})
    outputs = rows.select("sample_name", "model", "status", "prompt_sha1", F.concat(F.lit("out"), F.col("pos").cast("string")).alias("raw_output"), (F.col("pos") % 3).alias("attempt"), F.lit(3).alias("max_attempts")).withColumn("parsed_action", F.when(F.col("status") == "ok", F.col("raw_output")))
    out = A.result_rows(cases, outputs)
    return out.select(F.substring("raw_output", 4, 20).cast("long").alias("pos"), "sample_name", "model", "model_slug", "status", "prompt_sha1", "attempt", "parsed_action", F.lit(len(out.columns)).alias("n_columns"))


@add(with_sql("""select pos, model as responding_model, status as responding_status, case when pos % 4 <> 0 then pos % 2 = 0 end as leaks, case when pos % 4 <> 0 then 'why' || pos end as leaks_explanation, 15 as n_columns from ledger""", "ledger"))
def judgment_rows(spark, sf_dir):
    rows = ledger(spark, sf_dir).select(F.col("pos").cast("string").alias("sample_name"), "model", F.lit(1).alias("attempt"), "status", "pos")
    judged = rows.select("sample_name", F.col("model").alias("responding_model"), F.col("attempt").alias("responding_attempt"), F.lit("j").alias("judge_model"), F.when(F.col("pos") % 4 == 0, "parse_error").otherwise("ok").alias("judge_status"), (F.col("pos") % 2 == 0).alias("leaks"), F.concat(F.lit("why"), F.col("pos").cast("string")).alias("leaks_explanation"))
    out = A.judgment_rows(rows.drop("pos"), judged)
    return out.select(F.col("sample_name").cast("long").alias("pos"), "responding_model", "responding_status", "leaks", "leaks_explanation", F.lit(len(out.columns)).alias("n_columns"))


@add(with_sql("select prompt, generation, case when generation % 2 = 0 then 'judge' || prompt else 'rank' || prompt end as judge_demo, 'rank' || prompt as ranking_demo, case when text <> '' then 1 else 0 end + case when generation % 3 = 0 then 1 else 0 end as n_references from rollouts", "rollouts"))
def preference_examples(spark, sf_dir):
    key = F.col("prompt").cast("string")
    df = rollouts(spark, sf_dir).select(F.struct("prompt", "generation").alias("context"), F.when(F.col("generation") % 2 == 0, F.concat(F.lit("judge"), key)).alias("judge_demo"), F.concat(F.lit("rank"), key).alias("ranking_demo"), F.col("text").alias("reference_response"), F.when(F.col("generation") % 3 == 0, "x").otherwise("").alias("response_a"))
    return A.preference_examples(df).select("prompt.prompt", "prompt.generation", "judge_demo", "ranking_demo", F.size("references").alias("n_references"))


@add("select event_id, case event_id % 6 when 0 then '[' || event_id || ']' when 1 then 'nested' || event_id when 2 then '[{\"a\":' || event_id || '}]' when 3 then 'text' || event_id when 4 then '[9]' else '' end as found from events")
def trajectory_locator(spark, sf_dir):
    k, n = F.col("event_id") % 6, F.col("event_id").cast("string")
    normalized = F.when(k == 0, F.concat(F.lit('{"steps": ['), n, F.lit('], "events": [1]}'))).when(k == 1, F.concat(F.lit('{"steps": [], "trajectory": {"executable_trajectory": "nested'), n, F.lit('"}}'))).when(k == 3, F.concat(F.lit('{"executable_trajectory": "text'), n, F.lit('"}'))).otherwise('{"steps": null}')
    trajectory = F.when(k == 2, F.concat(F.lit('{"events": [{"a":'), n, F.lit("}]}"))).otherwise("{}")
    payload = F.when(k >= 4, F.when(k == 4, '{"steps": [9]}').otherwise('{"steps": ""}')).otherwise('{"steps": [0]}')
    return table(spark, sf_dir, "events").select("event_id", A.trajectory_data(normalized, trajectory, payload).alias("found"))


@add("""select event_id, case when event_id % 5 = 4 then false else event_id % 2 = 0 end as passed, case when event_id % 5 = 4 then ['llm_check_failed: non-object response'] when event_id % 5 = 3 then ['only ' || event_type]
when event_id % 5 = 2 then []::varchar[] else [event_type, 'n' || event_id] end as issues from events""")
def quality_results(spark, sf_dir):
    k, n = F.col("event_id") % 5, F.col("event_id").cast("string")
    yes = F.when(F.col("event_id") % 2 == 0, F.element_at(F.array(*map(F.lit, ('"Passed"', "true", "1", '" yes "'))), (F.col("event_id") % 4 + 1).cast("int"))).otherwise(F.element_at(F.array(*map(F.lit, ('"no"', "false", "0", '"maybe"'))), (F.col("event_id") % 4 + 1).cast("int")))
    many = F.concat(F.lit(', "issues": ["'), F.col("event_type"), F.lit('", "n'), n, F.lit('"]}'))
    tail = F.when(k == 3, F.concat(F.lit(', "issues": "only '), F.col("event_type"), F.lit('"}'))).when(k == 2, F.lit("}")).otherwise(many)
    answer = F.when(k == 4, F.concat(F.lit("I think "), n)).otherwise(F.concat(F.lit('<think>{"pass": false}</think> so\n```json\n{"pass": '), yes, tail, F.lit("\n```")))
    return table(spark, sf_dir, "events").select("event_id", A.quality_result(answer).alias("r")).select("event_id", "r.passed", "r.issues")


@add("""select event_id, case when value = 0 then '0.0000' else printf('%.4f', value) end as metric, event_type || '=' || event_id || ', v=' || case when value = floor(value) then value::bigint::varchar else printf('%.2f', value) end as counters from events where value = 0 or (abs(value) >= 0.001 and abs(value) < 10000)""")
def metric_texts(spark, sf_dir):
    df = table(spark, sf_dir, "events").where("value = 0 or (abs(value) >= 0.001 and abs(value) < 10000)")
    entries = F.array(F.struct(F.col("event_type").alias("key"), F.col("event_id").cast("double").alias("value")), F.struct(F.lit("v").alias("key"), F.col("value").cast("double").alias("value")))
    return df.select("event_id", A.metric_text(F.col("value")).alias("metric"), A.counter_text(entries).alias("counters"))


@add(with_sql("select sum(n_words // 2)::bigint as total_tokens, max(n_words // 2)::bigint as max_tokens from rollouts", "rollouts"))
def token_statistics(spark, sf_dir):
    df = rollouts(spark, sf_dir).select(F.transform(F.filter(F.sequence(F.lit(0), F.col("n_words")), lambda i: i > 0), lambda i: i % 2 == 0).alias("mask"))
    return A.mask_statistics(df, "mask")


@add(with_sql("""select count(*) as num_rows, 5 as num_cases, list_sort(list(distinct model)) as models, (select sum(n)::bigint from (select count(*) as n from ledger where status = 'ok' and model = 'view')) as view_ok,
(select count(*) from (select sample, model, max_by(status, pos) as s from ledger group by all) where model = 'view' and s = 'ok') as latest_view_ok from ledger""", "ledger"))
def run_summary(spark, sf_dir):
    df = splits.ledger_summary(ledger(spark, sf_dir), 5)
    return df.select("num_rows", "num_cases", "models", F.col("status_counts_by_model")["view"]["ok"].alias("view_ok"), F.col("latest_status_counts_by_model")["view"]["ok"].alias("latest_view_ok"))


@add("""select c_custkey as id, case c_custkey % 4 when 0 then 'east' when 1 then 'north' else 'anglo' end as origin, case when c_custkey % 3 = 0 then 'female' else 'male' end as gender from customer""")
def origin_gender(spark, sf_dir):
    key = F.col("c_custkey")
    first = F.element_at(F.array(*map(F.lit, ("Dr. Mira", "Jon", "Xyz"))), (key % 3 + 1).cast("int"))
    last = F.element_at(F.array(*map(F.lit, (" Ito", " Berg, clerk", " Unknown", ""))), (key % 4 + 1).cast("int"))
    bank = spark.createDataFrame([("ito", "east"), ("berg", "north")], "name string, origin string"), spark.createDataFrame([("mira", "female"), ("jon", "male")], "name string, gender string")
    df = table(spark, sf_dir, "customer").select(key.alias("id"), F.concat(first, last).alias("name"))
    return N.origin_and_gender(df, "name", *bank).select("id", "origin", "gender")


@add("select c_custkey as id, case c_custkey % 3 when 0 then ['jane roe'] when 1 then ['john roe', 'jane roe'] else []::varchar[] end as found, case when c_custkey % 2 = 0 then ['Al Stone'] else []::varchar[] end as forced from customer")
def placeholder_names(spark, sf_dir):
    key = F.col("c_custkey")
    text = F.element_at(F.array(*map(F.lit, ("Ask JANE Roe.", "jane roe and John Roe", "Jane Roed, xjohn roe"))), (key % 3 + 1).cast("int"))
    names = F.when(key % 2 == 0, F.array(F.lit("Al Stone"), F.lit("Bo Wood"))).otherwise(F.array(F.lit("Stone"), F.lit("Stone Al")))
    return table(spark, sf_dir, "customer").select(key.alias("id"), N.placeholders_in(text, ["john roe", "jane roe"]).alias("found"), N.forced_names(names, ["STONE"]).alias("forced"))


@add("select event_id, event_id % 7 in (0, 1, 3, 5) as refers from events")
def file_reference_walk(spark, sf_dir):
    cases = ['{"a": [{"invoice_id": "x%"}]}', '{"signed_deck_ids": [null, {"k": %1}]}', '{"file": "", "files": [], "attachment_id": 0}', '{"note": {"t": ["see [plan](reports/a%.pdf) now"]}}', '{"filed": "x%", "profile_x": 1}', '["in /tmp/out%.txt here"]', 'file: "x%"']
    text = F.replace(F.element_at(F.array(*map(F.lit, cases)), (F.col("event_id") % 7 + 1).cast("int")), F.lit("%"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", I.file_references(text).alias("refers"))


def _scored(df):
    return df.select("prompt", "generation", F.when(~F.col("invalid"), F.col("score")).alias("score"))


@add(with_sql("""select prompt, generation, valid, round(case when valid then s - m else 0 end, 9) as advantage from (select *, avg(s) over (partition by prompt) as m from (select prompt, generation, not invalid as valid, case when not invalid then greatest(-1, least(1, score)) end as s from rollouts))""", "rollouts"))
def policy_batches(spark, sf_dir):
    df = rollouts(spark, sf_dir)
    batch, _ = K.policy_batch(df.drop("score"), lambda b: _scored(df), ["prompt", "generation"], clip=(-1.0, 1.0))
    return batch.select("prompt", "generation", "valid", F.round("advantage", 9).alias("advantage"))


@add(with_sql("""select role, round(coalesce(sum(n * l) / nullif(sum(n), 0), 0), 6) as loss, sum(n)::bigint as tokens, sum((score > 0)::int)::bigint as positive_sequences from (select role, score, least(n_words, 5) as n, -(1 / (1 + exp(-(case when score > 0 then 1.0 else 1.05 end) * 0.1))) * 4 / (case when score > 0 then 1.0 else 1.05 end) * score as l from rollouts) group by 1""", "rollouts"))
def objective_metrics(spark, sf_dir):
    df = rollouts(spark, sf_dir).select("role", F.col("score").alias("advantage"), F.array_repeat(F.lit(1.1), 5).alias("ratio"), F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: i <= F.col("n_words")).alias("action_mask"))
    return K.objective_metrics(df, K.SurrogateObjective(), ["role"]).withColumn("loss", F.round("loss", 6))


@add(with_sql("select id, case when id % 3 = 0 then null when id % 5 = 0 then 'seed' else 'story' end as stage, case when id % 3 = 0 then 'seed' when id % 5 = 0 then 'story' end as failed_at, case when id % 3 = 0 or id % 5 = 0 then 'failed' else 'done' end as status, case when id % 3 <> 0 then 'st' || id end as story from scenarios", "scenarios"))
def staged_batches(spark, sf_dir):
    stages = [
        ("seed", lambda d: d.withColumn("seed", F.col("id") % 3), F.col("seed") != 0), ("story", lambda d: d.withColumn("story", F.concat(F.lit("st"), F.col("id").cast("string"))), F.col("id") % 5 != 0),
    ]
    return batches.run_stages(scenarios(spark, sf_dir).select("id"), stages).select("id", "stage", "failed_at", "status", "story")


@add("select event_id, event_type, value from events where event_id % 2 = 0")
def json_lines(spark, sf_dir):
    """Events written as ledger batches and as splits, read strictly, tolerantly and by split, all the same."""
    folder = scratch(spark, "lines")
    df = table(spark, sf_dir, "events").where("event_id % 2 = 0").select("event_id", "event_type", "value")
    schema = "event_id long, event_type string, value double"
    for again in range(2):
        files.append(df.where("event_id % 4 = 0"), f"{folder}/ledger", "0")
        files.append(df.where("event_id % 4 = 2"), f"{folder}/ledger", "1")
    splits.write_splits(df.withColumn("split", F.when(F.col("event_id") % 4 == 0, "train").otherwise("test")), f"{folder}/split")
    strict = files.jsonl_strict(spark, f"{folder}/ledger", schema)
    tolerant = files.jsonl_tolerant(spark, f"{folder}/ledger/batch=0", schema).drop("pos")
    both = splits.read_split(spark, [f"{folder}/split/split={s}" for s in ("train", "test")], schema).drop("pos")
    return strict.intersect(both).where("event_id % 4 = 2").unionByName(tolerant)


@add("""with l as (select event_id, value, event_id % 7 > 0 and event_id % 3 > 0 as usable, event_id % 20 = 0 as held from events where event_id % 11 > 0)
select event_id, value, (select count(*) from l where not usable) as skipped, (select count(*) from l where usable and held) as held_out from l where usable and not held""")
def counted_lines(spark, sf_dir):
    """Events as JSON lines, some blank, some cut off, some without an event type: the usable ones, and how many were not."""
    k, folder = F.col("event_id"), scratch(spark, "counted")
    whole = F.to_json(F.struct("event_id", "value", F.when(k % 3 > 0, F.col("event_type")).alias("event_type")))
    table(spark, sf_dir, "events").select(F.when(k % 11 == 0, "").when(k % 7 == 0, F.substring(whole, 1, 12)).otherwise(whole)).write.text(folder)
    rows, n = files.jsonl_counting(spark, folder, "event_id long, value double, event_type string", F.col("event_type").isNotNull(), k % 20 == 0)
    return rows.select("event_id", "value", F.lit(n["skipped_rows"]).cast("long").alias("skipped"), F.lit(n["held_out_rows"]).cast("long").alias("held_out"))


@add("""select line, step, value from (select event_id, event_type, row_number() over (order by event_id) - 1 as line, coalesce(last_value(case when event_type = 'view' then event_id end ignore nulls) over (order by event_id rows between unbounded preceding and current row), 0) as step, event_id % 1000 + 0.125::double as value from events) where event_type <> 'view'""")
def log_metric(spark, sf_dir):
    """Events as lines of a log over several files: steps, and losses with the step named before them."""
    folder = scratch(spark, "log")
    line = F.when(F.col("event_type") == "view", F.concat(F.lit("epoch 1, step "), "event_id")).otherwise(F.concat(F.lit("loss = "), F.col("event_id") % 1000, F.lit(".125, rate 0.1")))
    table(spark, sf_dir, "events").orderBy("event_id").select(line).write.text(folder)
    return files.training_log(spark, folder, "loss")


@add("select trim(n_name) as name, greatest(1, coalesce(case when n_nationkey % 4 > 0 then n_nationkey - 3 end, 1))::int as frequency from nation where n_nationkey % 5 > 0")
def name_list(spark, sf_dir):
    folder, k = scratch(spark, "names"), F.col("n_nationkey")
    table(spark, sf_dir, "nation").select(F.when(k % 5 > 0, F.concat(F.lit("  "), "n_name", F.lit(" "))).otherwise("  ").alias("name"), F.when(k % 4 > 0, k - 3).alias("frequency")).write.json(folder)
    return files.weighted_names(spark, folder)


@add("select n_nationkey as id, n_name as name from nation")
def json_array_scan(spark, sf_dir):
    folder = scratch(spark, "array")
    row = F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))
    table(spark, sf_dir, "nation").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(row), ",\n"), F.lit("\n]"))).write.text(folder)
    return files.json_array(spark, folder, "id long, name string")


SAMPLES_SQL = "select coalesce(case when c_custkey % 3 > 0 then 'c' || (c_custkey % 40) end, 'i' || (c_custkey % 30)) as key, max(c_custkey) as pos from customer group by 1"


def named_samples(spark, sf_dir):
    k = F.col("c_custkey")
    df = table(spark, sf_dir, "customer").select(k.alias("pos"), F.when(k % 3 > 0, F.concat(F.lit(" c"), k % 40)).otherwise(" ").alias("name"), F.concat(F.lit("i"), k % 30).alias("id"))
    return files.by_name(df).select("key", "pos")


@add(SAMPLES_SQL)
def samples_by_name(spark, sf_dir):
    return named_samples(spark, sf_dir)


@add(f"select place, name, pos from (select key as name, pos from ({SAMPLES_SQL})) join (values (0::int, 'c7'), (1, 'i3'), (2, 'c1')) w(place, name) using (name)")
def manifest_samples(spark, sf_dir):
    return files.manifest(named_samples(spark, sf_dir).withColumnRenamed("key", "name"), ["c7", "i3", "c1", "i6"], limit=3).select("place", "name", "pos")


@add("select o_orderkey as id, md5('answer ' || o_orderkey) as answer, case when o_orderkey % 2 = 0 then 1 else 2 end::int as run from orders where o_orderkey % 3 > 0")
def cached_answers(spark, sf_dir):
    """Answers to half of the keys, then to all, then from the cache alone: none is made twice."""
    folder, keys = scratch(spark, "cache"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    answer = lambda run: lambda df: df.select("id", F.md5(F.concat(F.lit("answer "), F.col("id").cast("string"))).alias("answer"), F.lit(run).alias("run"))
    files.cached(spark, folder, keys.where("id % 2 = 0"), ["id"], answer(1))
    files.cached(spark, folder, keys, ["id"], answer(2))
    return files.cached(spark, folder, keys.where("id % 3 > 0"), ["id"], None)


@add("select event_id, event_id % 4 > 0 as accepted, case when event_id % 4 = 0 then 'quality' end as stage from events")
def split_output(spark, sf_dir):
    """Accepted and rejected rows, the latter with the stage that turned them away."""
    folder, k = scratch(spark, "output"), F.col("event_id")
    df = table(spark, sf_dir, "events").select("event_id", F.when(k % 4 == 0, "quality").alias("stage"), F.when(k % 4 == 0, "short").alias("reason"))
    files.write_split(df, folder, k % 4 > 0)
    good, bad = spark.read.parquet(f"{folder}/accepted"), spark.read.parquet(f"{folder}/rejected")
    return good.select("event_id", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("stage")).unionByName(bad.select("event_id", F.lit(False).alias("accepted"), "stage"))
