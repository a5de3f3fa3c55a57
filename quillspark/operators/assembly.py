"""Records put together and taken apart: nested output records, re-prompt inputs, fixed row layouts, cleaning, locators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import text as X


def set_nested(df: DataFrame, path: str, value: Column) -> DataFrame:
    """df with a field set by its dotted path; structs on the way are made where they don't exist or are null.

    Where something on the way is no struct, nothing changes.
    """
    head, *rest = path.split(".")

    def put(own: Column | None, kind: T.DataType | None, names: list[str]) -> Column | None:
        if not names:
            return value
        if kind is not None and not isinstance(kind, T.StructType):
            return None
        fields = kind.names if kind is not None else []
        inner = put(own[names[0]] if names[0] in fields else None, kind[names[0]].dataType if names[0] in fields else None, names[1:])
        if inner is None:
            return None
        parts = [inner.alias(n) if n == names[0] else own[n].alias(n) for n in fields]
        return F.struct(*parts, *([] if names[0] in fields else [inner.alias(names[0])]))

    there = head in df.columns
    found = put(F.col(head) if there else None, df.schema[head].dataType if there else None, rest)
    return df if found is None else df.withColumn(head, found)


def named(df: DataFrame, name: str, pos: str, names: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows of the listed names (all without a list), the first limit of them by position."""
    own = df if names is None else df.where(F.col(name).isin(names))
    return own if limit is None else own.orderBy(pos).limit(max(limit, 0))


def head(df: DataFrame, pos: str, most: int | None) -> DataFrame:
    """The first rows by position: as many as most, all where it is None or beyond the number of rows."""
    return df if most is None else df.orderBy(pos).limit(max(most, 0))


def text_or(c: Column, default: str = "") -> Column:
    return F.coalesce(c, F.lit(default))


def strings(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


#: Fields of an output record, by part, in their order.
SEED = ["data_subject", "data_sender", "data_sender_name", "data_recipient", "domains", "source", "source_details"]
VIGNETTE = ["story", "data_subject_concrete", "data_sender_concrete", "data_recipient_concrete", "sensitive_info_items", "relevant_info_items"]
TRAJECTORY = ["user_name", "user_email", "user_instruction", "toolkits", "executable_trajectory", "final_action"]
LEAKAGE = ["generated_final_action", "leakage_judgment", "leakage_judge_output"]
PROFILE = ["sex", "ethnicity", "religion", "citizenship", "occupation"]


def output_record(fields: dict[str, Column], profile: dict[str, Column], judged: bool = False, diagnostics: bool = False) -> list[Column]:
    """Columns of a scenario's output record: name, model_name, seed, vignette, memories, trajectory, generation_metadata.

    fields: what the record says, by field name; profile: the sender's. Absent texts are empty, absent lists are empty
    lists. Leakage fields are there only if judged, the hash of the profile only with diagnostics.
    """
    lists = {"domains", "toolkits", "sensitive_info_items", "relevant_info_items", "memories"}

    def get(name: str) -> Column:
        own = fields.get(name)
        if name in lists:
            return strings(own) if own is not None else F.array().cast("array<string>")
        if name == "leakage_judgment":
            return F.coalesce(own, F.lit(False)) if own is not None else F.lit(False)
        if name == "source_details":
            return F.create_map().cast("map<string,string>") if own is None else own
        return text_or(own) if own is not None else F.lit("")

    part = lambda names: F.struct(*[get(n).alias(n) for n in names])
    own = {n: text_or(profile[n]) if n in profile else F.lit("") for n in PROFILE}
    metadata = [own[n].alias(f"profile_{n}") for n in PROFILE]
    metadata += [get("domains").alias("domains"), fields.get("min_steps", F.lit(3)).cast("int").alias("min_steps"), F.array_join(F.array_sort(get("toolkits")), "|").alias("toolkit_signature")]
    metadata.append(F.coalesce(fields.get("sensitive_memories", F.lit(True)), F.lit(True)).alias("sensitive_memories"))
    if diagnostics:
        metadata.append(F.substring(F.sha1(F.to_json(F.struct(*[profile[n].alias(n) for n in sorted(profile)]))), 1, 12).alias("profile_hash"))
    return [
        get("name").alias("name"), get("model_name").alias("model_name"), part(SEED).alias("seed"), part(VIGNETTE).alias("vignette"), get("memories").alias("memories"),
        part([*TRAJECTORY, *(LEAKAGE if judged else [])]).alias("trajectory"), F.struct(*metadata).alias("generation_metadata"),
    ]


def prompt_inputs(df: DataFrame) -> DataFrame:
    """df with trajectory, seed and vignette inputs for a new prompt, and invalid: why a row has none (null: it has).

    Two shapes are read: a catalogue row with source (or the nested record itself: trajectory, seed, vignette), and a flat row
    whose trajectory is a text. Domains come from the metadata, else the seed, else the legacy single domain.
    """
    kind = df.schema["trajectory"].dataType if "trajectory" in df.columns else None
    if isinstance(kind, T.StringType):
        name = text_or(F.col("user_name").cast("string"))
        kits, domains = strings(F.col("toolkits")), strings(F.col("domains")) if "domains" in df.columns else F.array().cast("array<string>")
        flat = F.struct(name.alias("user_name"), text_or(F.col("user_email")).alias("user_email"), text_or(F.col("user_instruction")).alias("user_instruction"), kits.alias("toolkits"), text_or(F.col("trajectory")).alias("executable_trajectory"), F.col("final_action").alias("final_action"))
        seed = F.struct(name.alias("data_subject"), name.alias("data_sender"), F.lit("").alias("data_recipient"), F.col("final_action").alias("final_action"), kits.alias("toolkits"), domains.alias("domains"))
        none = F.array().cast("array<string>")
        vignette = F.struct(strings(F.col("memories")).alias("memories"), none.alias("sensitive_info_items"), none.alias("relevant_info_items"))
        bad = F.when(F.col("final_action").isNull() | (F.trim("final_action") == ""), "no final action")
        return df.withColumns({"prompt_trajectory": flat, "prompt_seed": seed, "prompt_vignette": vignette, "invalid": bad})
    at = (lambda x: F.col(f"source.{x}")) if "source" in df.columns and isinstance(df.schema["source"].dataType, T.StructType) else F.col
    have = df.select(at("seed").alias("s"), at("generation_metadata").alias("m")).schema
    legacy = [at(f"{part}.scenario_domain") for part, key in (("generation_metadata", "m"), ("seed", "s")) if "scenario_domain" in have[key].dataType.names]
    filled = lambda c: F.when(F.size(c) > 0, c)
    lists = [filled(at(f"{part}.domains")) for part, key in (("generation_metadata", "m"), ("seed", "s")) if "domains" in have[key].dataType.names]
    one = [F.when(F.trim(c) != "", F.array(c)) for c in legacy]
    domains = strings(F.coalesce(*lists, *one)) if lists or one else F.array().cast("array<string>")
    seed = F.struct(*[at(f"seed.{n}").alias(n) for n in ("data_subject", "data_sender", "data_recipient")], at("trajectory.final_action").alias("final_action"), at("trajectory.toolkits").alias("toolkits"), domains.alias("domains"))
    reasons = [F.when(at(c).isNull(), F.lit(f"no {c}")) for c in ("trajectory", "seed", "vignette")]
    reasons += [F.when(at(f"trajectory.{c}").isNull(), F.lit(f"no {c}")) for c in ("final_action", "toolkits")]
    return df.withColumns({"prompt_trajectory": at("trajectory"), "prompt_seed": seed, "prompt_vignette": at("vignette").withField("memories", strings(at("memories"))), "invalid": F.coalesce(*reasons)})


#: Fields of result rows, of judgment rows, and of comparative judgments after cleaning.
RESULT = ["sample_name", "model", "model_slug", "status", "attempt", "max_attempts", "prompt_sha1", "expected_final_action", "toolkits", "user_instruction", "source_model_name", "pair_family", "comparative_verdict", "raw_output", "parsed_action", "error", "duration_s"]
JUDGMENT = ["judge_model", "judge_status", "error", "duration_s", "num_annotators", "leaks", "leaks_explanation", "omits", "omits_explanation", "raw_judge_output", "cleaned_judge_output"]
COMPARATIVE = [
    "assistant_a", "assistant_b", "differ", "better_model", "response_a_leaks", "response_a_leaks_details", "response_a_omits", "response_a_omits_details", "response_b_leaks", "response_b_leaks_details",
    "response_b_omits", "response_b_omits_details", "comparison", "explanation", "verdict", "output",
]


def laid_out(df: DataFrame, fields: list[str]) -> DataFrame:
    """Exactly these columns, in this order; those that df lacks are null texts."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields])


def eval_cases(df: DataFrame, prompt: Column) -> DataFrame:
    """Cases to answer, of rows with prompt_trajectory (see prompt_inputs): the prompt, its hash, and what results are held against."""
    keep = [c for c in ("source_model_name", "pair_family", "comparative_verdict", "original_action", "new_action") if c in df.columns]
    return df.where("invalid is null").select(
        "sample_name", prompt.alias("prompt"), F.substring(F.sha1(prompt), 1, 12).alias("prompt_sha1"), F.col("prompt_trajectory.final_action").alias("expected_final_action"),
        F.col("prompt_trajectory.toolkits").alias("toolkits"), text_or(F.col("prompt_trajectory.user_instruction")).alias("user_instruction"), *keep,
    )


def result_rows(cases: DataFrame, outputs: DataFrame, save_prompt: bool = False) -> DataFrame:
    """One ledger row for each case and output (sample_name, model, attempt, max_attempts, raw_output, status, ...), in the fixed layout."""
    both = cases.join(outputs, "sample_name").withColumn("model_slug", X.slug(F.col("model")))
    return laid_out(both, [*RESULT, *(["prompt"] if save_prompt else [])]).withColumn("created_at", utc_text(F.current_timestamp()))


def judgment_rows(results: DataFrame, judged: DataFrame) -> DataFrame:
    """One row for each judged result: what was judged, and the judgment in the fixed layout; flags are null where it couldn't be parsed."""
    own = results.select("sample_name", F.col("model").alias("responding_model"), F.col("attempt").alias("responding_attempt"), F.col("status").alias("responding_status"))
    both = own.join(judged, ["sample_name", "responding_model", "responding_attempt"])
    for c in ("leaks", "omits", "leaks_explanation", "omits_explanation"):
        if c in both.columns:
            both = both.withColumn(c, F.when(F.col("judge_status") == "ok", F.col(c)))
    return laid_out(both, ["sample_name", "responding_model", "responding_attempt", "responding_status", *JUDGMENT])


def cleaned(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """df without internal columns (a leading underscore) and raw texts; with fields just these, null where absent."""
    if fields is not None:
        return laid_out(df, fields)
    return df.drop(*[c for c in df.columns if c.startswith("_") or c.startswith("raw_")])


#: Fields that may hold reference responses.
REFERENCES = ["reference_response", "chosen_response", "response_a", "response_b"]


def preference_examples(df: DataFrame) -> DataFrame:
    """prompt, judge_demo, ranking_demo (JSON or struct), and the reference responses that aren't empty; judge_demo falls back to ranking_demo.

    A row with neither demo fails at run time.
    """
    judge = F.col("judge_demo") if "judge_demo" in df.columns else F.lit(None).cast(df.schema["ranking_demo"].dataType)
    ranking = F.col("ranking_demo") if "ranking_demo" in df.columns else F.lit(None).cast(df.schema["judge_demo"].dataType)
    demo = F.coalesce(judge, ranking)
    there = [c for c in REFERENCES if c in df.columns]
    filled = F.map_filter(F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in there])), lambda k, v: v.isNotNull() & (v != "")) if there else F.create_map().cast("map<string,string>")
    ok = df.where(F.when(demo.isNull(), F.raise_error(F.lit("no judge_demo or ranking_demo")).cast("boolean")).otherwise(True))
    return ok.select(F.col("context").alias("prompt"), demo.alias("judge_demo"), ranking.alias("ranking_demo"), filled.alias("references"))


#: Keys under which a payload may hold its steps, in their order: of the payload, and of its nested trajectory.
STEP_KEYS = ["steps", "trajectory_steps", "tool_events", "tool_calls", "actions", "events", "messages", "executable_trajectory"]
NESTED_STEP_KEYS = ["executable_trajectory", "steps", "tool_events", "tool_calls", "events", "messages"]


def trajectory_data(normalized: Column, trajectory: Column, payload: Column) -> Column:
    """The first value that isn't empty of the known keys in three JSON texts: normalized and its nested trajectory, trajectory, payload; else empty."""

    def get(c: Column, path: str) -> Column:
        v = F.get_json_object(c, path)
        return F.when(~F.trim(v).isin("", "[]", "{}", "0", "false", "null"), v)

    found = [get(normalized, f"$.{k}") for k in STEP_KEYS] + [get(normalized, f"$.trajectory.{k}") for k in NESTED_STEP_KEYS]
    found += [get(trajectory, f"$.{k}") for k in NESTED_STEP_KEYS[1:]] + [get(payload, "$.steps")]
    return F.coalesce(*found, F.lit(""))


def quality_result(x: Column) -> Column:
    """passed and issues of a quality judge's JSON answer: passed by the words of pass flags or a number other than 0, issues always a list of texts.

    An answer that is no object is rejected, with an issue that says so. Fences and reasoning around it don't matter.
    """
    body = F.regexp_extract(X.strip_reasoning(x), r"(?s)(\{.*\})", 1)
    there = F.try_parse_json(F.when(body != "", body)).isNotNull()
    flag, issues = F.get_json_object(body, "$.pass"), F.get_json_object(body, "$.issues")
    passed = X.pass_flag(flag) | F.coalesce(flag.rlike(r"^-?\d+(\.\d+)?$") & (flag.cast("double") != 0), F.lit(False))
    listed = F.when(issues.isNull(), F.array().cast("array<string>")).when(issues.startswith("["), F.from_json(issues, "array<string>")).otherwise(F.array(issues))
    none = F.struct(F.lit(False).alias("passed"), F.array(F.lit("llm_check_failed: non-object response")).alias("issues"))
    return F.when(there, F.struct(F.coalesce(passed, F.lit(False)).alias("passed"), listed.alias("issues"))).otherwise(none)


def utc_text(ts: Column) -> Column:
    """A timestamp as ISO-8601 text in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def elapsed_seconds(start: Column, end: Column, digits: int = 3) -> Column:
    """Seconds between two timestamps; null where one is missing."""
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / 1e6, digits)


def metric_text(v: Column) -> Column:
    """A metric with four decimals, or in powers of ten with six where it is small or large."""
    size = F.abs(v)
    return F.when(size == 0, "0.0000").when((size >= 1e-3) & (size < 1e4), F.format_string("%.4f", v)).otherwise(F.format_string("%.6e", v))


def counter_text(entries: Column) -> Column:
    """key=value of (key, value) entries, in their order: whole numbers without decimals, others with two."""
    one = lambda e: F.concat(e["key"], F.lit("="), F.when(e["value"] == F.floor(e["value"]), F.format_string("%d", e["value"].cast("long"))).otherwise(F.format_string("%.2f", e["value"])))
    return F.array_join(F.transform(entries, one), ", ")


def mask_statistics(df: DataFrame, mask: str) -> DataFrame:
    """total_tokens and max_tokens of an array column of flags or 0/1; 0 and 0 without a row."""
    n = F.aggregate(F.coalesce(mask, F.array().cast(df.schema[mask].dataType)), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x.cast("int"), F.lit(0)))
    return df.agg(F.coalesce(F.sum(n), F.lit(0)).alias("total_tokens"), F.coalesce(F.max(n), F.lit(0)).alias("max_tokens"))
