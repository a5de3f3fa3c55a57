"""Operators on hand-made rows, kernels against brute force, and every query with SQL against DuckDB."""

import itertools
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark import catalogue
from quillspark.functions import names as N
from quillspark.functions import parsers as P
from quillspark.functions import rewrite as W
from quillspark.functions import text as X
from quillspark.operators import balance as B
from quillspark.operators import dedup as D
from quillspark.operators import identifiers as I
from quillspark.operators import prefs, records
from quillspark.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, dict):
        v = list(v.values())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted("|".join(norm(r[c]) for c in cols) for r in df.collect())
    if name in catalogue.ORACLE_SQL:
        q = duck.execute(catalogue.ORACLE_SQL[name])
        names = [d[0] for d in q.description]
        want = sorted("|".join(norm(dict(zip(names, r))[c]) for c in cols) for r in q.fetchall())
        assert sorted(names) == cols and got == want


def column(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_scopes_differ(spark):
    row = spark.createDataFrame([("Ana Silva, clerk", "Dr. Ana Silva"), ("Ana Silva", ""), ("Bo and Li", "X Y")], "a string, b string")
    got = [(r.s, r.t) for r in row.select(N.subject_scope(F.col("a"), F.col("b")).alias("s"), N.tracker_scope(F.col("a"), F.col("b")).alias("t")).collect()]
    assert got == [("self", "third_party"), ("unknown", "third_party"), ("multi_subject", "multi_subject")]


@pytest.mark.parametrize("text, want", [("qwen-gpt", "gpt"), ("nvidia gpt", "nvidia"), ("stepwise", "stepwise"), ("my step model", "step"), (None, "unknown")])
def test_family(spark, text, want):
    assert column(spark, text, N.model_family) == want


def test_hash_split_of_null(spark):
    import hashlib

    want = int(hashlib.sha256(b"None").hexdigest()[:8], 16) % 20
    assert column(spark, None, prefs.bucket) == want


def test_targets(spark):
    df = spark.createDataFrame([(1, p) for p in ["agent_b"] * 1 + ["tie"] * 3] + [(2, "unsure")] + [(3, "agent_a"), (3, "tie"), (3, "tie"), (3, "tie")], "id long, preference string")
    got = {r.id: (r.target_score, r.target_signed_margin, r.vote_count) for r in prefs.with_target(prefs.preference_counts(df)).collect()}
    assert got == {1: (0.5, 1, 4), 2: (0.0, 0, 0), 3: (-0.5, -1, 4)}


@pytest.mark.parametrize("text, want", [("a</think>b", "b"), ("<think>x</think> <think>y</think>z<|im_end|>", "z"), ("[THINK]q[/THINK]\nok</s>", "ok"), ("ok <revised_thinking>r</revised_thinking>", "ok"), (None, "")])
def test_strip_trace(text, want):
    assert P.strip_trace(text) == want


def test_judgments():
    assert P.judgment('{"leaks": "false", "omits": 0}')["leaks"] is True
    assert P.pointwise('{"leaks": "false", "omits": 0}') == {"leaks": False, "omits": False, "explanation": ""}
    two = '{"leaks": true, "omits": true} then {"leaks": false, "omits": false} end'
    assert P.judgment(two)["leaks"] is True and P.pointwise(two)["leaks"] is False
    assert P.judgment("Leaks: TRUE\nomits = false\nleaks_explanation: 'x'") == {"leaks": True, "omits": False, "explanation": "x"}


def test_verdicts():
    assert P.verdict("**PREFERENCE:** TIE\n**VERDICT:** A")["differ"] is False
    assert P.verdict("VERDICT:\nAssistant B wins\nEXPLANATION: A is better")["better"] == "B"
    assert P.verdict("nothing") is None and P.section("**COMPARISON:** one\ntwo\n**VERDICT:** A", "COMPARISON") == "one\ntwo"


@pytest.mark.parametrize("text, want", [("", "empty"), ("x", "invalid_json"), ("[1]", "not_json_object"), ("{}", "missing_tool_use_type"), ('{"type":"tool_use"}', "missing_tool_name"), ('{"type":"tool_use","name":"B"}', "wrong_tool_name"), ('{"type":"tool_use","name":"A"}', "missing_arguments_object"), ('```json\n{"type":"tool_use","name":"A","arguments":{}}\n```', None)])
def test_format_violation(text, want):
    assert P.format_violation(text, "A") == want


def test_steps_round_trip():
    steps = [{"action": "A", "action_input": '{"x": "é"}', "observation": '{"r": [1]}'}, {"action": "B", "action_input": "{}", "observation": '"t"'}]
    assert P.parse_steps(P.render_steps(steps)) == steps
    use, other = {"type": "tool_use", "id": "1", "name": "A", "arguments": {}}, {"type": "tool_result", "tool_use_id": "2", "content": 1}
    assert [s["observation"] for s in P.parse_steps([use, other])] == [""]
    assert P.parse_steps("prose [" + json.dumps(use) + "] more")[0]["action"] == "A"
    assert P.parse_steps({"steps": [{"tool": "T", "args": {"a": 1}}]}) == [{"action": "T", "action_input": '{"a": 1}', "observation": ""}]
    assert P.loose_json('text {"a": "}"} x') == {"a": "}"} and P.loose_json("none") is None


def test_name_rewriting():
    plan = {"Ana Silva": "Eva Costa", "Ana Reis": "Ida Cruz"}
    assert W.replace_names("ANA SILVA wrote a.silva@x.org; Ana left", plan) == "EVA COSTA wrote e.costa@x.org; Ana left"
    assert json.loads(W.replace_names('{"to": "Bo Li <bo.li@x.org>", "n": 1}', {"Bo Li": "Al Ray"})) == {"to": "Al Ray <al.ray@x.org>", "n": 1}
    assert W.reconcile(["AB-123"], ["policy number"], "her policy XY-999 and room ZZ-111") == "her policy AB-123 and room ZZ-111"


def test_identifiers(spark):
    df = spark.createDataFrame([(1, "id 555123456, ssn 214-45-6780"), (2, "again 555123456 (604) 555-0198"), (3, "lazy 123456789")], "pos long, t string")
    found = I.scan(df, "pos", "t")
    plan = {(r.pos, r.value) for r in I.replacements(found, I.owners(found)).collect()}
    assert plan == {(2, "555123456"), (3, "123456789")}
    out = {r.pos: r.t for r in I.apply_replacements(df, I.replacements(found, I.owners(found)), "pos", "t").collect()}
    assert out[1] == df.first().t and "555123456" not in out[2] and len(out[2]) == len("again 555123456 (604) 555-0198")


def test_greedy_keep_equals_scan(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").limit(200).collect()
    kept: list = []
    for r in rows:
        if all(sum(a * b for a, b in zip(r.embedding, k.embedding)) <= 0.3 for k in kept):
            kept.append(r)
    spark.sparkContext.setCheckpointDir("/tmp/quillspark-tests")
    df = spark.createDataFrame([(r.vec_id, r.embedding) for r in rows], "vec_id long, embedding array<float>")
    assert {r.id for r in D.greedy_keep(df, 0.3).collect()} == {r.vec_id for r in kept}
    assert D.similar_pairs(df, 0.3, block=64).count() == D.similar_pairs(df, 0.3).count()


def best_size(classes, caps, shares=()):
    best = 0
    for take in itertools.product(*[range(n + 1) for _, n in classes]):
        t = sum(take)
        ok = all(sum(k for k, (s, _) in zip(take, classes) if v in s[f]) <= max(int(t * c / 100), 1) for f, c in enumerate(caps) if c for v in {v for s, _ in classes for v in s[f]})
        ok = ok and all(100 * sum(k for k, (s, _) in zip(take, classes) if v in s[f]) >= p * t for f, v, p in shares)
        best = max(best, t) if ok else best
    return best


def test_exact_caps_equal_brute_force():
    rng = random.Random(3)
    for case in range(40):
        multi = case % 2
        classes = [((frozenset(rng.sample("abc", rng.randint(1, 1 + multi))), frozenset(rng.choice("xy"))), rng.randint(1, 3)) for _ in range(5)]
        caps = [rng.choice([30, 40, 50]), rng.choice([50, 60, None])]
        shares = [(1, "x", 30)] if case % 3 == 0 else []
        want = best_size(classes, caps, shares)
        if want:
            counts, status = B.solve_caps(classes, caps, shares)
            assert sum(counts) == want and status == "optimal"


def test_quotas():
    assert B.min_share_quotas({"a": 10, "b": 30}, {"a": 50.0}) == {"a": 10, "b": 10}
    assert B.equalized({"a": 3, "b": 5, "c": 9}, ["a", "b", "z"]) == {"a": 3, "b": 3}
    quotas = B.joint_quotas({("a", "s"): 4, ("a", "o"): 6, ("b", "s"): 2, ("b", "o"): 9}, ["a", "b"], "s", 40.0)
    size = {f: sum(n for (g, _), n in quotas.items() if g == f) for f in "ab"}
    assert size["a"] == size["b"] and 100 * sum(n for (_, s), n in quotas.items() if s == "s") >= 40 * sum(size.values())


def test_records(spark):
    steps = [("MailSend", "ok"), ("MailRead", "ok"), ("CalendarAdd", "ok")]
    rows = [("Ana Silva", "Bo Li", ["d"], ["Mail", "Calendar"], steps, ["m"] * 5, "t"), ("John Doe, x", "John Doe, x", [], [], [], [], "t")]
    df = spark.createDataFrame(rows, "subject string, recipient string, domains array<string>, toolkits array<string>, steps array<struct<action: string, observation: string>>, memories array<string>, trajectory string")
    rules = [(ok, m) for ok, m in records.scenario_rules() if m != "a toolkit is not used"]
    got = [r.e for r in df.select(records.errors(rules).alias("e")).collect()]
    assert got[0] == [] and len(got[1]) >= 5 and "subject is a placeholder" in got[1]
    out = records.staged(df, [("quality", F.size("steps") > 0, F.lit("no steps"))]).select("stage", "reason").collect()
    assert [tuple(r) for r in out] == [(None, None), ("quality", "no steps")]
    mask = spark.createDataFrame([([1, 9, 8, 2, 3],), ([1, 2],)], "t array<int>").select(records.response_mask(F.col("t"), [[9, 8], [7]]).alias("m")).collect()
    assert [r.m for r in mask] == [[False, False, False, True, True], [True, True]]
    kits = spark.createDataFrame([("Mail", [("Send", "s", [("to", True), ("cc", False)])]), ("MailBox", [("Open", "o", [])])], "toolkit string, tools array<struct<name: string, summary: string, parameters: array<struct<name: string, required: boolean>>>>")
    tools = records.toolkit_tools(kits)
    found = {r.action: r.toolkit for r in records.toolkit_of(spark.createDataFrame([("MailSend",), ("MailBoxNew",), ("Zip",)], "action string"), tools).collect()}
    assert found == {"MailSend": "Mail", "MailBoxNew": "MailBox", "Zip": None}
    lacks = records.missing_parameters(spark.createDataFrame([("MailSend", '{"cc": 1}')], "action string, action_input string"), tools).first().missing
    assert lacks == ["to"]


def test_sources(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"name": "a", "n": 1}\n\nbroken\n{"name": "b", "n": 2}\n{"name": "a", "n": 3}\n')
    rows = files.jsonl_tolerant(spark, f"file://{path}", "name string, n int")
    assert [(r.pos, r.name, r.n) for r in rows.orderBy("pos").collect()] == [(0, "a", 1), (1, "b", 2), (2, "a", 3)]
    assert {(r.key, r.n) for r in files.by_name(rows).collect()} == {("a", 3), ("b", 2)}
    assert files.jsonl_tolerant(spark, f"file://{path}.missing", "name string").count() == 0
    kept, counts = files.jsonl_counting(spark, f"file://{path}", "name string, n int", F.col("name").isNotNull(), F.col("n") == 2)
    assert kept.count() == 2 and counts["held_out_rows"] == 1 and counts["skipped_rows"] == 1
    with pytest.raises(ValueError):
        files.manifest(rows.select("name").distinct(), ["a", "zz"])
    assert [r.name for r in files.manifest(rows.select("name").distinct(), ["b", "a"]).collect()] == ["b", "a"]
    log = tmp_path / "train.log"
    log.write_text("clean_rate: 0.1\nstep 5 loss\nclean_rate: 0.5\nstep 9\nnoise\nclean_rate: 0.7\n")
    assert [(r.step, r.value) for r in files.training_log(spark, f"file://{log}", "clean_rate").orderBy("line").collect()] == [(0, 0.1), (5, 0.5), (9, 0.7)]
    assert files.discover(["main_data_generated_b.json", "main_data_generated_a.json", "main_data_generated_a_2.json", "main_data_generated_mined.json", "x.json"]) == ["main_data_generated_a_2.json", "main_data_generated_a.json", "main_data_generated_b.json"]
    want = spark.createDataFrame([(1,), (2,)], "k int")
    make = lambda m: m.withColumn("v", F.col("k") * 2)
    cache = f"file://{tmp_path}/cache"
    assert files.cached(spark, cache, want.where("k = 1"), ["k"], make).count() == 1
    assert {r.v for r in files.cached(spark, cache, want, ["k"], make).collect()} == {2, 4}
    with pytest.raises(ValueError):
        files.cached(spark, cache, spark.createDataFrame([(3,)], "k int"), ["k"], None)


def test_text_functions(spark):
    assert column(spark, " fooBar-Baz qux!", X.normalize_key) == "foo_bar_baz_qux"
    assert column(spark, "Answer: yes\nFinal Answer: No", X.yes_no) is False
    assert column(spark, "the verdict: yes but no", X.yes_no) is True
    assert column(spark, "score: 1\nscore: 5", X.pairwise_score) == 1
    assert column(spark, "score: 9", X.signed_score) is None
    assert column(spark, "see https://a.b/c).", X.urls) == ["https://a.b/c"]


def test_signals(spark):
    assert X.beginnings(r"(?i)\b(?:sad(?:ly)?|low mood)\b") == ["sad", "low mood"] and X.beginnings(r"(?i)\bcolou?r") == ["colo"]
    assert X.beginnings("ab|cd") == X.beginnings(r"[ab]c") == X.beginnings(r"ab\(|cd\)") == X.beginnings("a*b") == []
    table = {"phi": r"(?i)\bphi\b", "comp": r"(?i)\bworkers?\s+comp\b", "either": "(?i)one|two", "exact": r"\bNo\b"}
    for text, want in (("éPHIñ", ["phi"]), ("graphic phi_", []), ("a wor\u212aerſ \t COMP", ["comp"]), ("workers\x0bcomp", []), ("tWo no", ["either"]), ("x" * 9000 + " phi " + "NóNo", ["phi", "exact"]), (None, [])):
        assert column(spark, text, lambda x: X.signals(x, table)) == want, text
    plan = spark.range(1).select(X.signals(F.col("id").cast("string"), {str(k): rf"(?i)\ba{k}\b" for k in range(60)}).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and "regexp_extract_all" not in plan  # the text is prepared once, not for each pattern


def against_sql(spark, tmp_path, name, table, rows, schema):
    """A query's rows on a hand-made table, held against its SQL."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(got.columns)} from ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert sorted(norm(tuple(r)) for r in got.collect()) == sorted(map(norm, want))


HALVES = [(2 * k + 1) / 2000 * sign for k in range(64) for sign in (1, -1)]


@pytest.mark.parametrize("rows", [[(12 * i + 11, HALVES[i * 11 : i * 11 + 11]) for i in range(11)], [(-3, HALVES[:9]), (-11, [0.5]), (5, None), (None, [0.5]), (7, [0.25, None, 0.0625]), (12, [1.0]), (23, [])]])
def test_pad_and_trim_rows(spark, tmp_path, rows):
    against_sql(spark, tmp_path, "pad_and_trim", "embeddings", rows, "vec_id long, embedding array<float>")


WHOLE = ["q ñno q", "q yes ñno q", "q knoé yesñ q", "q éyes_no q", "q yes no", "", " \n\t", None]


@pytest.mark.parametrize("kinds", [[2, 3, 6], [0, 1, -1, -2, None]])
def test_verdicts_in_prose_rows(spark, tmp_path, kinds):
    rows = [(i, k, "user", t) for i, t in enumerate(WHOLE) for k in kinds]
    against_sql(spark, tmp_path, "verdicts_in_prose", "conversations", rows, "conv_id long, turn long, role string, text string")


def test_layouts():
    from quillspark.operators.training import Layout

    base = Layout(prompt=("p",), sequence=("s",), packed=(("o", "v"),))
    more = base.extended(sequence=("s", "adv"), host=("adv",))
    assert more.columns == ["p", "s", "adv", "o", "v"] and more.host == ("adv",)
    for bad in ({"prompt": ("a",), "sequence": ("a",)}, {"host": ("z",)}):
        with pytest.raises(ValueError):
            Layout(**bad)


def test_scores_match_sequences(spark):
    from quillspark.operators import training as K

    df = spark.createDataFrame([(1, 0), (1, 1)], "prompt int, generation int")
    good = lambda b: b.withColumn("score", F.lit(1.0))
    assert K.scored(df, good, ["prompt", "generation"]).count() == 2
    with pytest.raises(ValueError):
        K.scored(df, lambda b: good(b).where("generation = 0"), ["prompt", "generation"])
    with pytest.raises(ValueError):
        K.Layout(sequence=("prompt",)).check(df)
    assert [r.x for r in df.select(K.hook(str.upper)(F.lit("a")).alias("x")).collect()] == ["A", "A"]


def test_split_resolution(spark, tmp_path):
    from quillspark.sources import splits

    (tmp_path / "data").mkdir()
    for part in ("train", "test"):
        (tmp_path / "data" / f"{part}.jsonl").write_text(f'{{"x": "{part}1"}}\n{{"x": "{part}2"}}\n')
    root = str(tmp_path)
    rows = splits.read_split(spark, splits.split_paths(spark, root, "all"), "x string").orderBy("pos").collect()
    assert [r.x for r in rows] == ["train1", "train2", "test1", "test2"]
    assert splits.split_paths(spark, root, "validation") == [f"{root}/data/train.jsonl"] and splits.split_paths(spark, "/a/b.jsonl", "any") == ["/a/b.jsonl"]
    with pytest.raises(FileNotFoundError):
        splits.split_paths(spark, root, "dev")
    fetched = splits.split_paths(spark, root, "dev", cache=f"{root}/cache", fetch=lambda part, path: (tmp_path / "cache").mkdir() or (tmp_path / "cache" / f"{part}.jsonl").write_text('{"x": "d"}'))
    assert fetched == [f"{root}/cache/dev.jsonl"]
    assert splits.source_of(spark, f"{root}/mined.json", {"input_path": "data/test.jsonl"}, None, f"{root}/none") == f"{root}/data/test.jsonl"
    with pytest.raises(ValueError):
        splits.source_of(spark, "m", {}, None, root)


def test_name_bank_and_aliases(spark, tmp_path):
    from quillspark.sources import splits

    bank = {"first_names": {"x": {"male": ["Jon"], "female": ["Mira"]}}, "last_names": {"east": ["Ito"], "west": ["Ito", "Ray"]}, "extra_first_name_genders": {"jon": "female"}, "placeholder_names": ["Jane Roe"], "forced_last_names": ["Stone"]}
    (tmp_path / "b.json").write_text(json.dumps(bank))
    (tmp_path / "a.json").write_text(json.dumps({"Bank": "finance", "Money": "finance"}))
    got = {k: {tuple(r) for r in df.collect()} for k, df in splits.name_bank(spark, str(tmp_path / "b.json")).items()}
    assert got == {"last": {("ito", "west"), ("ray", "west")}, "first": {("jon", "female"), ("mira", "female")}, "placeholders": {("jane roe",)}, "forced": {("stone",)}}
    assert splits.domain_aliases(spark, str(tmp_path / "a.json")).count() == 2


def test_snapshots(spark, tmp_path):
    from quillspark.sources import splits

    path = str(tmp_path / "s")
    assert splits.read_snapshot(spark, path, ["t"]) == ({}, {})
    for n in (1, 2):
        splits.write_snapshot({"t": spark.range(n)}, {"passes": ["m"] * n}, path)
    tables, done = splits.read_snapshot(spark, path, ["t"])
    assert tables["t"].count() == 2 and done == {"passes": ["m", "m"]}


def test_generation_resumes(spark, tmp_path):
    from quillspark.streaming import batches

    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(6).repartition(2).write.parquet(source)
    stages = [("a", lambda d: d.withColumn("y", F.col("id") * 2), F.col("id") != 3)]
    assert batches.generate(spark, source, folder, stages).count() == 6
    spark.range(6, 8).write.mode("append").parquet(source)
    rows = batches.generate(spark, source, folder, stages).collect()
    assert sorted(r.id for r in rows) == list(range(8)) and [r.failed_at for r in rows if r.status == "failed"] == ["a"]


def test_rewriting_on_frames(spark):
    df = spark.createDataFrame([(1, "Ann Lee wrote to ann.lee@x.org", None), (2, "Ann Lee", "keep")], "id int, a string, b string")
    plan = spark.createDataFrame([(1, "Ann Lee", "Mia Wood")], "id int, name string, replacement string")
    got = {r.id: r for r in W.rewrite_names(df, plan, "id", ["a", "b"]).collect()}
    assert got[1].a == "Mia Wood wrote to mia.wood@x.org" and got[1].b is None and got[2].a == "Ann Lee"
    ids = spark.createDataFrame([(["123-45-6789"], ["case number 123-45-6789"], "case number 987-65-4321"), ([], [], "x"), (None, None, None)], "c array<string>, s array<string>, t string")
    assert [r.o for r in W.reconciled(ids, "c", "s", "t", "o").collect()] == ["case number 123-45-6789", "x", None]


def test_owners_across_formats(spark):
    rows = spark.createDataFrame([(1, "phone_paren", "(604) 555-0198"), (2, "phone_dash", "604-555-0198"), (2, "ssn", "1-2")], "pos int, kind string, value string")
    assert {(r.value, r.owner, r.samples) for r in I.owners(rows).collect()} == {("(604) 555-0198", 1, 2), ("604-555-0198", 1, 2), ("1-2", 2, 1)}


def test_training_log(spark, tmp_path):
    (tmp_path / "l").write_text("acc: 0.5\nstep 3 x\nacc: 0.6\nnoise\nstep=9\nacc = 0.7\nacc 0.8\n")
    assert [(r.step, r.value) for r in files.training_log(spark, str(tmp_path / "l"), "acc").orderBy("line").collect()] == [(0, 0.5), (3, 0.6), (9, 0.7), (9, 0.8)]


def test_templates(spark, tmp_path):
    from quillspark.functions import prompts

    (tmp_path / "one.txt").write_text("Hi $x")
    assert prompts.templates(spark, str(tmp_path), ["one"]) == {"one": "Hi $x"}
    with pytest.raises(FileNotFoundError):
        prompts.templates(spark, str(tmp_path), ["one", "two"])
    with pytest.raises(ValueError):
        prompts.stage_prompt("sensibility_check", "x", {})


def test_positions_and_ranks(spark):
    from quillspark.operators import order as O

    df = spark.createDataFrame([("a" if k % 10 else "b", (k * 37) % 101) for k in range(101)] + [(None, 200), (None, 201)], "f string, p int")
    got = O.rank_within(df, ["f"], ["p"], "r").collect()
    for f in ("a", "b", None):
        own = sorted((r.p, r.r) for r in got if r.f == f)
        assert [r for _, r in own] == list(range(1, len(own) + 1))


def test_greedy_and_pairs_against_plain_versions(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(3 * k + 1, [float(x) for x in row]) for k, row in enumerate(v)], "vec_id long, embedding array<double>")
    kept = []
    for k in range(60):
        if all(v[k] @ v[j] <= 0.6 for j in kept):
            kept.append(k)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        from quillspark.sources.store import shared_folder

        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    assert sorted(r.id for r in D.greedy_keep(df, 0.6).collect()) == [3 * k + 1 for k in kept]
    got = {r.id: r.max_similarity for r in D.earlier_maximum(df, block=16).collect()}
    assert all(abs(got[3 * k + 1] - max([0.0, *(float(v[k] @ v[j]) for j in range(k))])) < 1e-9 for k in range(60))


def test_payload_words():
    assert P.payload_words(None) == P.payload_words("") == P.payload_words("{}") == 0
    assert P.payload_words("it's a well-known fact") == 4
    assert P.payload_words('<think>a b</think>{"type": "x y", "arguments": {"To": "a", "body": ["one two", {"note": "three", "url": "u"}], "n": 5}}') == 3
    assert P.payload_words('{"arguments": "one two", "text": "three", "cc": ["four"]}') == 3
    assert P.payload_words('[{"a": "b c"}]') == 3
    assert P.payload_words("[" * 200_000) == 0


def test_email_parts_fold_marks(spark):
    rows = [("José Núñez", "jose.nunez7@a.b"), ("José Núñez", "j_oldname@a@b"), ("Łucja Gärtner", "ucja-gartner.x@c"), ("José Núñez", "josé.nunez@a"), (None, "a.b@c"), ("Jo Li", "jo.li@c"), ("José Núñez", None), ("ﬁona ½lamb", "fiona.lamb@c")]
    got = [r.p for r in spark.createDataFrame(rows, "n string, e string").select(X.email_parts(F.col("n"), F.col("e")).alias("p")).collect()]
    assert [(p.prefix, p.surname, p.digits, p.last, p.domain) if p else None for p in got] == [
        ("jose", "nunez", "7", "nunez", "a.b"), ("j", "oldname", "", "nunez", "a@b"), ("ucja", "gartner", "", "gartner", "c"), None, None, None, None, ("fiona", "lamb", "", "12lamb", "c"),
    ]


def test_draw_names(spark):
    bank = lambda rows: spark.createDataFrame(rows, "name string, frequency double, used int")
    assert B.draw_names(bank([]), 5, 1.0, 1.0).count() == 0
    got = B.draw_names(bank([("a", 5.0, 0), ("b", 1.0, 3), ("c", 1.0, None), (None, 9.0, 0), ("d", 0.0, 0), ("a", 1.0, 0)]), 12, 1.0, 1.0).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 13)) and {r.name for r in got[:2]} == {"a", "c"} and [r.soft for r in got] == [False] * 2 + [True] * 10
    assert {r.name for r in got} <= {"a", "b", "c"}
    few = B.draw_names(bank([("a", 5.0, 0), ("b", 1.0, 0), ("c", 1.0, 0)]), 2, 1.0, 1.0).collect()
    assert len({r.name for r in few}) == 2 and not any(r.soft for r in few)


def test_draw_names_law(spark):
    """The share of seeds by which the second soft draw repeats the first is what drawing one after the other gives."""
    rows = [("a", 2.0, 1), ("b", 1.0, 1)]
    bank = spark.createDataFrame(rows, "name string, frequency double, used int").cache()
    u = lambda k: F.concat(F.lit(f"{k}:"), F.col("name"))
    one = lambda k: -B.weighted_order(F.col("frequency") / (1 + k) ** 2, F.concat(F.col("s").cast("string"), F.lit(":"), u(k)), 42)
    times = bank.crossJoin(spark.range(20_000).withColumnRenamed("id", "s")).select("s", "name", one(1).alias("t1"), (one(1) + one(2)).alias("t2"))
    side = times.groupBy("s").pivot("name", ["a", "b"]).agg(F.first("t1").alias("t1"), F.first("t2").alias("t2"))
    got = side.agg(F.avg(((F.col("a_t2") < F.col("b_t1")) | (F.col("b_t2") < F.col("a_t1"))).cast("int"))).first()[0]
    a, b, a2, b2 = 2 / 4, 1 / 4, 2 / 9, 1 / 9
    want = a / (a + b) * a2 / (a2 + b) + b / (a + b) * b2 / (b2 + a)
    assert abs(got - want) < 0.02
    bank.unpersist()
