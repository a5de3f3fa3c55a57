"""Queries of ledgers, votes and preferences."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import ledger as L
from quillspark.operators import prefs as P
from quillspark.operators import votes as V
from quillspark.plans.relations import Catalogue, annotations, comparative, judged, ledger, sensibility, table, with_sql

CATALOGUE = Catalogue()
add = CATALOGUE.add
JUDGES = 3


@add(with_sql("select sample, model, prompt_sha1, max(pos) as pos, max_by(status, pos) as status from ledger group by all", "ledger"))
def latest_rows(spark, sf_dir):
    return L.latest(ledger(spark, sf_dir), ["sample", "model", "prompt_sha1"])


@add(with_sql("select model, status, count(*) as n from (select sample, model, max_by(status, pos) as status from ledger group by all) group by all", "ledger"))
def latest_status(spark, sf_dir):
    return L.status_counts(L.latest(ledger(spark, sf_dir), ["sample", "model"]), ["model"])


@add(with_sql("select pos, count(*) over (partition by sample, model, prompt_sha1 order by pos) as attempt from ledger", "ledger"))
def attempt_counts(spark, sf_dir):
    df = ledger(spark, sf_dir)
    return df.select("pos", L.attempts(df, ["sample", "model", "prompt_sha1"]).alias("attempt"))


@add(with_sql("""select c.sample, c.model, c.prompt_sha1, coalesce(n_attempts, 0) as n_attempts, latest_status, case when n_attempts is null then true when latest_status = 'ok' then false
else latest_status in ('parse_error', 'api_error') and n_attempts < 3 end as should_run
from (select distinct sample, model, substr(sha1(sample::varchar || '/0'), 1, 12) as prompt_sha1 from (select sample from ledger), (select distinct model from ledger)) c
left join (select sample, model, prompt_sha1, count(*) as n_attempts, max_by(status, pos) as latest_status from ledger group by all) l using (sample, model, prompt_sha1)""", "ledger"))
def pending_cases(spark, sf_dir):
    df = ledger(spark, sf_dir)
    models = [F.lit(m) for m in ("click", "error", "purchase", "signup", "view")]
    sha = F.substring(F.sha1(F.concat(F.col("sample").cast("string"), F.lit("/0"))), 1, 12)
    cases = df.select("sample").distinct().select("sample", F.explode(F.array(*models)).alias("model"), sha.alias("prompt_sha1"))
    return L.should_run(cases, df, ["sample", "model", "prompt_sha1"], True, 3, ["parse_error", "api_error"])


@add(with_sql("select model, status, count(*) as n from ledger group by all", "ledger"))
def status_summary(spark, sf_dir):
    return L.status_counts(ledger(spark, sf_dir), ["model"])


@add(with_sql("select sample, model, count(*) as n from ledger l where not exists (select 1 from ledger o where o.sample = l.sample and o.model = l.model and o.status = 'ok') group by all", "ledger"))
def completed_antijoin(spark, sf_dir):
    df = ledger(spark, sf_dir)
    return df.join(df.where("status = 'ok'").select("sample", "model").distinct(), ["sample", "model"], "left_anti").groupBy("sample", "model").agg(F.count("*").alias("n"))


@add(with_sql("select judge, count(*) as n, count(*) filter (where status = 'ok') as ok, count(*) filter (where status = 'ok' and leaks) as leaks_true, count(*) filter (where status = 'ok' and not leaks) as leaks_false, count(*) filter (where status = 'ok' and omits) as omits_true, count(*) filter (where status = 'ok' and not omits) as omits_false from judged group by 1", "judged"))
def judgment_summary(spark, sf_dir):
    return L.judgment_summary(judged(spark, sf_dir))


@add(with_sql("""select model, count(*) as num_examples, count(*) filter (where f or p) as valid_judgments, count(*) filter (where not (f or p)) as invalid_judgments,
round(count(*) filter (where f or (p and leaks)) / greatest(count(*) filter (where f or p), 1), 6) as leak_rate, round(count(*) filter (where f or (p and omits)) / greatest(count(*) filter (where f or p), 1), 6) as omit_rate,
round(count(*) filter (where not f and p and not leaks and not omits) / greatest(count(*) filter (where f or p), 1), 6) as clean_rate from (select *, status = 'skipped' as f, status <> 'parse_error' as p from judged) group by 1""", "judged"))
def pointwise_rates(spark, sf_dir):
    df = judged(spark, sf_dir)
    parsed = F.col("status") != "parse_error"
    return L.pointwise_rates(df, F.col("status") == "skipped", F.when(parsed, F.col("leaks")), F.when(parsed, F.col("omits")), ["model"])


@add(with_sql("""select pos, sample, status, case when sample % 13 = 0 then 'missing_metadata' when sample % 5 = 0 then 'already_judged' when status <> 'ok' then 'skipped_responding_not_ok' when sample % 3 = 0 then 'missing_sample' else 'pending' end as route from ledger""", "ledger"))
def judgment_routing(spark, sf_dir):
    df = ledger(spark, sf_dir).select("pos", "sample", "status")
    ids = df.select("sample").distinct()
    return L.route(df, ids.where("sample % 3 <> 0"), ids.where("sample % 13 <> 0"), ids.where("sample % 5 = 0"))


VOTES = """vote as (select name, model, list_sort(list(judge) filter (where sensible)) as y, list_sort(list(judge) filter (where not sensible)) as n from sensibility group by all),
votes as (select name, model, coalesce(y, []) as yes_judges, coalesce(n, []) as no_judges, coalesce(len(y), 0)::int as yes_count, coalesce(len(n), 0)::int as no_count, case when len(y) >= 2 then true when len(n) >= 2 then false end as majority from vote)"""


@add(with_sql("select * from votes", "sensibility", more=VOTES))
def vote_majority(spark, sf_dir):
    return V.vote_stats(sensibility(spark, sf_dir), ["name", "model"], "sensible", JUDGES // 2 + 1)


@add(with_sql("select name, model, coalesce(majority, false) as sensibility_passed, case when majority then null when majority is null then 'sensibility lacked majority approval' else 'sensibility majority rejection' end as error from votes", "sensibility", more=VOTES))
def sensibility_refresh(spark, sf_dir):
    return V.refresh_sensibility(V.vote_stats(sensibility(spark, sf_dir), ["name", "model"], "sensible", 2), True).select("name", "model", "sensibility_passed", "error")


PAIRS = """leaks as (select name, pair_family, count(*) filter (where response_a_leaks) as a_yes, count(*) filter (where not response_a_leaks) as a_no, count(*) filter (where response_b_leaks) as b_yes, count(*) filter (where not response_b_leaks) as b_no from comparative group by all),
sums as (select name, pair_family, count(*) filter (where differ) as differ_count, count(*) filter (where not differ) as same_count, count(*) filter (where differ and better_model = 'model0') as better_a_count, count(*) filter (where differ and better_model = 'model1') as better_b_count from comparative group by all),
better as (select *, case when differ_count >= 3 then case when better_a_count >= 3 then 'model0' when better_b_count >= 3 then 'model1' end end as majority_better_model from sums)"""


@add(with_sql("select * from leaks", "comparative", more=PAIRS))
def pair_leak_votes(spark, sf_dir):
    return V.pair_leaks(comparative(spark, sf_dir))


@add(with_sql("select * from better", "comparative", more=PAIRS))
def unanimous_better(spark, sf_dir):
    return V.unanimous_better(comparative(spark, sf_dir), JUDGES)


@add(with_sql("""select name, pair_family, kind as agreement_kind, won as majority_better_model, n as support_count, judge as judge_model from (select *, row_number() over (partition by name, pair_family order by n desc, judge) as rn from (
select name, pair_family, case when differ then 'winner' else 'tie' end as kind, case when differ then better_model end as won, count(*) as n, min(judge) as judge from comparative where differ is not null group by all) where n >= 2) where rn = 1""", "comparative"))
def modal_outcome(spark, sf_dir):
    return V.modal_outcome(comparative(spark, sf_dir), JUDGES)


ANALYSIS = VOTES + ",\n" + PAIRS + """,
analysis as (select l.*, b.* exclude (name, pair_family), va.majority as sensibility_a, vb.majority as sensibility_b, coalesce(va.yes_count, 0)::int as sensibility_a_yes_count, coalesce(vb.yes_count, 0)::int as sensibility_b_yes_count,
list_filter([case when not coalesce(va.majority, false) then 'response_a_not_sensible' end, case when not coalesce(vb.majority, false) then 'response_b_not_sensible' end, case when greatest(a_yes, b_yes) < 3 then 'no_unanimous_leak' end, case when majority_better_model is null then 'no_unanimous_better' end], lambda x: x is not null) as filter_reasons
from leaks l join better b using (name, pair_family) left join votes va on va.name = l.name and va.model = 'model0' left join votes vb on vb.name = l.name and vb.model = 'model1')"""


@add(with_sql("select *, len(filter_reasons) = 0 as selectable from analysis", "sensibility", "comparative", more=ANALYSIS))
def pair_analysis(spark, sf_dir):
    return V.pair_analysis(sensibility(spark, sf_dir), comparative(spark, sf_dir), JUDGES)


@add(with_sql("select list_reduce(list_sort(flatten(list(filter_reasons))), lambda a, b: a)[1:0] as none, count(*) as pairs, count(*) filter (where len(filter_reasons) = 0) as selectable, count(*) filter (where sensibility_a) as sensible_a, count(*) filter (where sensibility_b) as sensible_b, count(majority_better_model) as unanimous from analysis", "sensibility", "comparative", more=ANALYSIS).replace("list_reduce(list_sort(flatten(list(filter_reasons))), lambda a, b: a)[1:0] as none, ", ""))
def mining_summary(spark, sf_dir):
    df = V.pair_analysis(sensibility(spark, sf_dir), comparative(spark, sf_dir), JUDGES)
    return df.agg(F.count("*").alias("pairs"), F.count_if("selectable").alias("selectable"), F.count_if("sensibility_a").alias("sensible_a"), F.count_if("sensibility_b").alias("sensible_b"), F.count("majority_better_model").alias("unanimous"))


@add()
def pair_selection(spark, sf_dir):
    pairs = comparative(spark, sf_dir)
    return V.select_pairs(V.selection_options(V.pair_analysis(sensibility(spark, sf_dir), pairs, JUDGES), pairs, JUDGES))


@add(with_sql("select name, case when va.yes_count = 3 and vb.yes_count = 3 then null else 'not_unanimously_sensible' end as prune_reason from (select distinct name from comparative) c left join votes va using (name) left join votes vb using (name) where coalesce(va.model, 'model0') = 'model0' and coalesce(vb.model, 'model1') = 'model1'", "sensibility", "comparative", more=VOTES).replace("left join votes va using (name) left join votes vb using (name) where coalesce(va.model, 'model0') = 'model0' and coalesce(vb.model, 'model1') = 'model1'", "left join (select * from votes where model = 'model0') va using (name) left join (select * from votes where model = 'model1') vb using (name)"))
def unanimity_prune(spark, sf_dir):
    return V.prune(comparative(spark, sf_dir).select("name").distinct(), sensibility(spark, sf_dir), JUDGES)


TARGETS = """counts as (select id, count(*) filter (where preference = 'agent_a') as agent_a, count(*) filter (where preference = 'agent_a_slightly') as agent_a_slightly, count(*) filter (where preference = 'tie') as tie,
count(*) filter (where preference = 'agent_b_slightly') as agent_b_slightly, count(*) filter (where preference = 'agent_b') as agent_b, count(*) filter (where preference = 'unsure') as unsure, avg(leak_a::int) as gold_leak_a, avg(leak_b::int) as gold_leak_b from annotations group by 1),
raws as (select *, (2.0 * agent_b + agent_b_slightly - 2.0 * agent_a - agent_a_slightly)::double as raw, agent_a + agent_a_slightly + agent_b + agent_b_slightly + tie as vote_count from counts),
targets as (select *, case when vote_count > 0 then greatest(-2, least(2, raw / vote_count)) else 0 end::double as target_score, round(case when vote_count > 0 then greatest(-2, least(2, raw / vote_count)) else 0 end)::int as target_signed_margin from raws)"""


def _targets(spark, sf_dir):
    df = annotations(spark, sf_dir)
    labels = df.groupBy("id").agg(P.soft_label("leak_a").alias("gold_leak_a"), P.soft_label("leak_b").alias("gold_leak_b"))
    return P.with_target(P.preference_counts(df)).join(labels, "id")


@add(with_sql("select id, vote_count, raw, round(target_score, 6) as target_score, target_signed_margin from targets", "annotations", more=TARGETS))
def preference_targets(spark, sf_dir):
    return P.with_target(P.preference_counts(annotations(spark, sf_dir))).select("id", "vote_count", "raw", F.round("target_score", 6).alias("target_score"), "target_signed_margin")


@add(with_sql("select id, round(gold_leak_a, 6) as gold_leak_a, round(gold_leak_b, 6) as gold_leak_b from counts", "annotations", more=TARGETS))
def soft_labels(spark, sf_dir):
    return annotations(spark, sf_dir).groupBy("id").agg(F.round(P.soft_label("leak_a"), 6).alias("gold_leak_a"), F.round(P.soft_label("leak_b"), 6).alias("gold_leak_b"))


SWAP = TARGETS + """,
swapped as (select id, vote_count, 'ab' as ordering, target_score, target_signed_margin, raw as raw_margin, gold_leak_a as gold_leak_response1, gold_leak_b as gold_leak_response2 from targets
union all select id, vote_count, 'ba', 0 - target_score, -target_signed_margin, 0 - raw, gold_leak_b, gold_leak_a from targets)"""


@add(with_sql("select id, vote_count, ordering, round(target_score, 6) as target_score, target_signed_margin, raw_margin, round(gold_leak_response1, 6) as gold_leak_response1, round(gold_leak_response2, 6) as gold_leak_response2, case when target_score > 0 then 2 else 1 end as preferred_slot from swapped", "annotations", more=SWAP))
def swap_union(spark, sf_dir):
    out = P.both_orderings(_targets(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("target_score", "gold_leak_response1", "gold_leak_response2")})


@add(with_sql("select bin::int as bin, coalesce(n, 0) as n from (values (-2), (-1), (0), (1), (2)) b(bin) left join (select target_signed_margin as bin, count(*) as n from swapped group by 1) using (bin)", "annotations", more=SWAP))
def target_histogram(spark, sf_dir):
    return P.histogram(P.both_orderings(_targets(spark, sf_dir)), "target_signed_margin", [-2, -1, 0, 1, 2])


@add("select o_orderkey as id, (('0x' || substr(sha256(o_orderkey::varchar), 1, 8))::bigint % 20)::int as bucket, ('0x' || substr(sha256(o_orderkey::varchar), 1, 8))::bigint % 20 in (0, 1) as validation from orders")
def hash_split(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), P.bucket(F.col("o_orderkey")).alias("bucket"), P.belongs_to(F.col("o_orderkey"), "validation").alias("validation"))


@add(with_sql("select ('0x' || substr(sha256(id::varchar), 1, 8))::bigint % 20 in (0, 1) as validation, count(*) as pair_rows, count(*) filter (where target_score > 0) as slot2, count(*) filter (where vote_count = 0) as without_votes, round(avg(abs(target_score)), 6) as mean_abs_target from swapped group by 1", "annotations", more=SWAP))
def split_summary(spark, sf_dir):
    df = P.both_orderings(_targets(spark, sf_dir)).withColumn("validation", P.belongs_to(F.col("id"), "validation"))
    return df.groupBy("validation").agg(F.count("*").alias("pair_rows"), F.count_if(F.col("preferred_slot") == 2).alias("slot2"), F.count_if(F.col("vote_count") == 0).alias("without_votes"), F.round(F.avg(F.abs("target_score")), 6).alias("mean_abs_target"))
