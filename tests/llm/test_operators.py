"""Each training-data operator against a brute-force version or the library, with odd rows: nulls, empty and long texts, repeats, clashing columns."""

import collections
import re
import sys

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import bpe, decontaminate, html, language, licenses, neardup, quality, tokens, toxicity, urls

SF = "/root/testdata/sf0.001"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards quietly box many jars of liquid amber near old stone bridges".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + k * k + k * seed) % len(WORDS)] + ("" if k % 9 else f"{seed}x{k}") for k in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, None, "en", 5), (2, "", "en", 5), (3, "   \n\t ", None, 5), (None, "no id here at all", "de", 1), (4, prose(1, 300), "en", 2), (4, prose(1, 300), "en", 2),
        (5, prose(1, 300) + " more words", "en", 2), (6, "word " * 30_000, "en", 1), (7, "x" * 50_000, None, 1), (8, "one two three", "fr", 0), (9, "ONE two three", "fr", 0),
        (10, "12 34 !!", "fr", 0), (11, "don't <|endoftext|> stop  é́ 日本\r\n\n", "fr", 0), (12, "a b c\x1cd", "es", 0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, score int")


def test_bpe_matches_library(odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = bpe.encode_documents(odd, path, keep=["doc_id", "text"], with_ids=True).collect()
    assert len(got) == odd.count()
    for r in got:
        want = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
        assert r.decoded == lib.decode(want, skip_special_tokens=False)
    assert bpe.encode_documents(empty, path).count() == 0


def test_bpe_plain_and_odd_texts_match_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        coder = bpe.WordEncoder(f.read())
    odd = "'sSİıſŸßẞ×÷ªº²½µ¿¡«»“”’–—…٣Ⅷ日я\u0301\u0327\x00\x1c\x7f\x85\xa0\u2028"
    texts = [f"Don{a}T {a}{b}1{a}s x{b}'{a}Re É{a}\t{b}" for a in odd for b in odd]
    texts += [None, "", " \n", "<|endoftext|>s'<|startoftext|>'s", "<|ENDOFTEXT|>", "é" * 3_000, "the " * 10 + "z" * 100 + " " + "z" * 100, *texts[:9]]
    for text, (ids, decoded) in zip(texts, coder.texts(texts), strict=True):
        want = lib.encode(text or "", add_special_tokens=False).ids
        assert ids == b"".join(k.to_bytes(4, "little") for k in want), ascii(text)
        assert decoded == lib.decode(want, skip_special_tokens=False)
    assert max(map(len, coder.young)) <= 64


def test_bpe_table_is_bounded_and_forgets_rightly(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 50)
    monkeypatch.setattr(bpe, "GROUP", 40)
    monkeypatch.setattr(bpe, "STEPS", 30)
    monkeypatch.setattr(bpe, "PAIRS", 30)
    monkeypatch.setattr(bpe, "MEMO", 5)
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        coder = bpe.WordEncoder(f.read())
    texts = [prose(k % 23, 30) + f" я{k % 7}я <|endoftext|>" for k in range(120)]
    for text, (ids, _) in zip(texts, coder.texts(texts), strict=True):
        assert memoryview(ids).cast("I").tolist() == lib.encode(text, add_special_tokens=False).ids
    assert len(coder.young) <= 50 + 80 and len(coder.old) <= 50 + 80


def test_bpe_calls_by_word(spark, monkeypatch):
    """What the interpreter does for a text of words that each occur twice, counted in calls, as the clock depends on the machine."""
    path = public_tokenizers.path("word_bpe_49k.json")
    syllables = "an ti on the re sh wh ou er st ble ly in ed nd ha".split()
    words = ["".join(syllables[k * 7919 >> s & 15] for s in (0, 4, 8, 12)) for k in range(4_000)]
    texts = [" ".join(words[k : k + 100]) + ", " + ". ".join(words[k : k + 100]) for k in range(0, 4_000, 100)]
    docs, runs, calls = spark.createDataFrame([(1, "a")], "doc_id long, text string"), [], collections.Counter()
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: runs.append(run) or self)
    bpe.encode_documents(docs, path)
    with open(path, encoding="utf-8") as f:
        bpe.encoder(f.read())
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "__text": texts})
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        (out,) = runs[0](iter([batch]))
    finally:
        sys.setprofile(None)
    assert out.num_rows == len(texts)
    assert calls["call"] + calls["c_call"] < 50 * 8_000  # 67 if a word is encoded until it is asked for again, by its cuts and by itself


def test_bpe_prefixes_equal_merges():
    merges = [("a", "b"), ("b", "c"), ("ab", "c"), ("c", "a"), ("ca", "b"), ("b", "b"), ("abc", "abc"), ("bb", "a")]
    vocab = {t: k for k, t in enumerate(dict.fromkeys(["a", "b", "c", *[x + y for x, y in merges]]))}
    own = bpe.PrefixBpe(vocab, merges)
    rank = {m: k for k, m in reversed(list(enumerate(merges)))}

    def plain(word):
        s = list(word)
        while True:
            best = min((rank.get(p, 99), k) for k, p in enumerate([*zip(s, s[1:]), ("", "")]))
            if best[0] == 99:
                return s
            s[best[1] : best[1] + 2] = ["".join(s[best[1] : best[1] + 2])]

    import itertools

    for n in range(1, 8):
        for word in itertools.product("abc", repeat=n):
            assert own.encode("".join(word)) == plain(word), word


def test_token_counts_match_library(odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = [r.text or "" for r in odd.collect()]
    want = collections.Counter((len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for t in texts)
    got = tokens.count_tokens(odd, path).collect()
    assert collections.Counter((r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert tokens.count_tokens(empty, path).count() == 0


def test_language(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.language_query(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    found = {(r.doc_id, r.text): r for r in language.identify(odd, docs, label="language", score="sure").collect()}
    assert [found[k, t].language for k, t in ((1, None), (2, ""), (10, "12 34 !!"))] == ["und"] * 3
    assert all(0 <= r.sure <= 1 for r in found.values())
    assert language.identify(odd, empty, label="language", score="sure").where("language <> 'und' or sure <> 0").count() == 0


def test_licenses(spark, odd, empty):
    mit = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + licenses.MIT_BODY.replace("sublicense", "sub-licence").upper()
    df = odd.select("doc_id", "text", F.lit(1).alias("license")).unionByName(spark.createDataFrame([(20, mit, 1), (20, mit, 1)], "doc_id long, text string, license int"))
    got = licenses.scan(df).collect()
    assert len(got) == df.count() and [r.license for r in got if r.matched] == ["MIT", "MIT"]
    assert licenses.scan(empty).count() == 0


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(sets):
    label = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_near_duplicates(spark, odd, empty):
    base = prose(3, 200).split()
    chain = [" ".join([*base[:k], *(f"new{k}" for _ in range(k // 2)), *base[k:]]) for k in range(0, 120, 6)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(chain)], "doc_id long, text string")
    df = docs.unionByName(more)
    want = components({r.doc_id: shingles(r.text, 4) for r in df.collect()})
    got = {r.doc_id: r for r in neardup.near_duplicates(df, size=4).collect()}
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.kept == (d == r.component_id) for d, r in got.items())
    out = neardup.near_duplicates(odd, size=4).collect()
    assert len(out) == odd.count()
    by_id = {r.doc_id: r for r in out}
    assert by_id[1].n_shingles == by_id[2].n_shingles == by_id[3].n_shingles == 0 and by_id[2].component_id == 2
    assert by_id[9].component_id == 8 and by_id[5].component_id == 4 and by_id[None].kept
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.keep_one(odd, size=4)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, None, 4, 6, 7, 8, 10, 11, 12], key=str)


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 130), (130, 115)]
    got = {(r.key, r.label) for r in neardup.label_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(k, 0) for k in range(41)} | {(k, 100) for k in (100, 115, 130)}


def test_urls_rules_and_links(spark):
    page = '<a href="http://{}/x">x</a>'
    rows = [
        (1, "https://A.org/x?y#z", page.format("friend.net")), (2, "http://sub.example.org/es/1", page.format("bad.net")), (3, "http://example.org/en/12", None), (4, "http://x.com/fr/", ""),
        (5, "http://x.com/de/", page.format("x.com")), (6, None, None), (7, "nothing", ""), (8, "http://friend.net", ""), (9, "http://farm.net/1", page.format("x.com")), (10, "http://notorg/x", ""), (10, "http://notorg/x", ""),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("a.org", "/x", "org/", "allow") and got[2] == ("sub.example.org", "/es/1", "example.org/es/", "block")
    assert got[3][2:] == ("example.org/en/1", "block") and got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block")
    assert got[6] == ("", "", None, "allow") == got[7] and got[8][3] == "allow" and got[9] == ("farm.net", "/1", None, "block") and got[10][3] == "allow"
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.filter_urls(none).count() == 0


def leaks(docs, items, k=5, least=0.8):
    own = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in items}
    grams = lambda w: collections.Counter(tuple(w[p : p + k]) for p in range(len(w) - k + 1))
    df = collections.Counter(s for w in own.values() for s in grams(w))
    out = {}
    for d, t in docs:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        for i, v in own.items():
            a = grams(v)
            weight = lambda s, a=a: 1 / df[s] if s in a else 1.0
            for p in range(len(w) - len(v) + 1) if len(v) >= k else ():
                b = grams(w[p : p + len(v)])
                both = sum(min(a[s], b[s]) * weight(s) for s in a)
                sim = both / (sum(n * weight(s) for s, n in a.items()) + sum(n * weight(s) for s, n in b.items()) - both)
                if sim >= least:
                    out[d, i] = max(out.get((d, i), 0), sim)
    return out


def test_decontamination(spark, odd, empty):
    items = [(1, prose(11, 60)), (2, "Short one"), (3, prose(12, 40).upper()), (4, prose(13, 33)), (5, prose(13, 33)), (6, None)]
    edited = prose(11, 60).split()
    edited[30] = "changed"
    far = prose(12, 40).split()
    far[8] = far[16] = far[24] = "changed"
    docs = [(1, "before " + prose(11, 60) + " after"), (2, "x " * 50 + " ".join(edited)), (3, " ".join(far)), (4, prose(12, 40) + ". " + prose(12, 40)), (5, prose(99, 400)), (6, prose(13, 33)), (6, prose(13, 33))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("item_id", F.lit(7))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(df, bench).collect()}
    want = leaks(docs, [(i, t) for i, t in items if t])
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want) and len(want) == 5
    assert decontaminate.find_leaks(odd, bench).count() == 0 and decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(df, bench.where("false")).count() == 0


def test_edited_leaks_of_shared_items(spark):
    words = [f"w{k}" for k in range(59)]
    edited = " ".join([*words[:30], "changed", *words[31:]])
    template = [f"t{k}" for k in range(50)]
    items = [(1, " ".join(words)), (2, " ".join(words)), *[(10 + k, " ".join([*template, *(f"i{k}x{m}" for m in range(6))])) for k in range(9)]]
    filled = " ".join([*template[:25], "changed", *template[26:], *(f"i3x{m}" for m in range(6))])
    df = spark.createDataFrame([(1, edited), (2, filled)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got.keys() == {(1, 1), (1, 2), (2, 13)} and abs(got[1, 1] - 50 / 60) < 1e-9 and got[2, 13] > 0.8


def test_leaks_of_longer_items(spark):
    words, many = [f"w{k}" for k in range(59)], " ".join(f"m{k}" for k in range(1 << 16))
    df = spark.createDataFrame([(1, " ".join([*words[:30], *words[31:]])), (2, many), (3, " ".join(words[:40]))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontaminate.find_leaks(df, spark.createDataFrame([(1, " ".join(words)), (2, many)], "item_id long, text string")).collect()}
    assert got.keys() == {(1, 1), (2, 2)} and abs(got[1, 1][0] - 50 / 59) < 1e-9 and got[1, 1][1] == 0 and abs(got[2, 2][0] - 1) < 1e-9


def test_toxicity(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = toxicity.score_toxicity(docs, model, with_spans=True).join(labels, "doc_id").collect()
    hit = [r for r in got if r.toxic == 1 and r.score >= 0.3]
    assert len(hit) >= 0.7 * sum(r.toxic for r in got) and sum(r.toxic == 0 and r.score >= 0.3 for r in got) <= 0.05 * len(got)
    assert all(0 <= s.start < s.end <= len(r.text) for r in hit for s in r.spans) and any(r.spans for r in hit)
    out = toxicity.score_toxicity(odd.drop("score"), model).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score_toxicity(empty.drop("score"), toxicity.fit(empty, labels.where("false"))).count() == 0


def test_chain_marginals_equal_enumeration():
    import itertools

    import numpy as np

    model = toxicity.ChainModel()
    model.trans = np.array([[0.2, -0.7], [-0.4, 1.1]])
    for e in ([0.3], [0.5, -1.0, 2.0, 0.1], [-2.0, 1.5, 1.0]):
        total, own = 0.0, np.zeros(len(e))
        for tags in itertools.product((0, 1), repeat=len(e)):
            p = np.exp(sum(x for x, t in zip(e, tags) if t) + sum(model.trans[a, b] for a, b in zip(tags, tags[1:])))
            total += p
            own += p * np.array(tags)
        short, got = model.marginals([np.array([0.3]), np.array(e)])
        assert np.allclose(got, own / total) and len(short) == 1


PAGE = "<html><head><title>t</title></head><body><nav><a>Menu</a></nav><div>Welcome to our little site please enjoy reading</div>{}<div id='sidebar'>side</div><p>Call us any day of the week now</p></body></html>"


def test_html(spark):
    cases = {
        "<article><h1>A &amp; b</h1><p>wor<b>d</b> two<br>three<!-- x --><script>var t='</p>'</script><div class='ad'>buy</div><p>nb&nbsp;sp</article>": "A & b word two three nb sp",
        "<main><header>kept</header><p>m</p><section id=comments>c</section></main>": "kept m",
        "<p>Alpha{} beta{} gamma{}</p>": "Alpha{} beta{} gamma{}",
    }
    rows, want = [(90, "http://h/", None), (91, "http://h/", ""), (92, None, "<p>a < b &am"), (93, "http://long/", "<p>" + "w " * 20_000)], {90: "", 91: "", 92: "a < b &am", 93: ("w " * 20_000).strip()}
    for k in range(12):
        body, text = list(cases.items())[k % 3]
        rows.append((k, f"http://h/{k}", PAGE.format(body.replace("{}", f"n{k}"))))
        want[k] = text.replace("{}", f"n{k}")
    rows += rows[-1:]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_html_runs_decide_beside_articles(spark):
    body = "<article><p>story {0}</p></article><div>{0}a {0}b {0}c</div><main><p>Our offices are closed on the last Friday of May</p><p>{0}d {0}e</p></main>"
    rows = [(k, f"http://h/{k}", PAGE.format(body.format(f"n{k}"))) for k in range(4)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"story n{k} n{k}a n{k}b n{k}c n{k}d n{k}e" for k in range(4)}


def test_html_every_page_goes_through_the_runs(spark):
    """Articles and chrome only: runs find the footer, the check takes the advert that no page repeats and keeps the article that two pages share."""
    shared = "a story of seven words in two papers"
    body = "<div class='ad'>only here n{0}</div><article><p>{1}</p></article><footer>All rights reserved by our little site</footer>"
    rows = [(k, f"http://h/{k}", body.format(k, shared if k < 2 else f"n{k}a n{k}b")) for k in range(4)] + [(9, "http://g/", f"<article>{shared}</article>"), (10, "http://g/2", None)]
    got = {r.page_id: (r.text, r.n_repeated) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: (shared, 7), 1: (shared, 7), 2: ("n2a n2b", 7), 3: ("n3a n3b", 7), 9: (shared, 0), 10: ("", 0)}


def test_html_notice_beside_articles_that_differ(spark):
    """What stands outside is equal on all pages of h; on g whole pages are copies."""
    body = "<div>Our offices are closed on the last Friday of May</div><article>story {0}</article><p>Call us any day of the week now</p>"
    rows = [(k, f"http://h/{k}", body.format(f"n{k}")) for k in range(3)] + [(10 + k, f"http://g/{k}", body.format("one")) for k in range(3)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = "Our offices are closed on the last Friday of May story one Call us any day of the week now"
    assert got == {k: f"story n{k}" for k in range(3)} | {10 + k: whole for k in range(3)}


def test_html_runs_cross_shards(spark):
    own = lambda k: " ".join(f"n{k}w{i}" for i in range(9))
    notice = "Our offices are closed on the last Friday of May"
    rows = [(k, f"http://h/{k}", f"<p>{own(k)}</p>" + (f"<div>{notice}</div>" if k % 100 == 7 else "")) for k in range(300)]
    rows += [(1000 + k, "http://copies/", f"<p>{own(0)}</p>") for k in range(200)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: own(k) for k in range(300)} | {1000 + k: own(0) for k in range(200)}


def base_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    again = {p + k for p in range(len(w) - 2) for k in range(3) if c[tuple(w[p : p + 3])] > 1}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_quality(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    trusted = docs.where("doc_id % 3 = 0").select("doc_id")
    ratios = quality.fit_ratio(docs, trusted)
    long = spark.createDataFrame([(99, " ".join(f"w{k % 40_000}" for k in range(70_000)))], "doc_id long, text string")
    df = docs.unionByName(odd.select("doc_id", "text")).unionByName(long)
    want = collections.Counter(base_counts(r.text or "") for r in df.collect())
    got = quality.quality_rules(df, ratios).collect()
    assert collections.Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (r.kept <= (not r.base_failed)) for r in got)
    assert set(quality.fit_ratio(docs, trusted.where("false"))) == {0.0}
    assert quality.quality_rules(empty, ratios).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns and after.exceptAll(kept).count() == 0
        kept = spark.createDataFrame(after.collect(), docs.schema)
    out = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in kept.collect())


def test_many_languages(spark):
    import random

    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"x{k:02}": ["".join(rng.choices(letters, k=6)) for _ in range(12)] for k in range(70)}
    rows = [(d, " ".join(rng.choices(words[lang], k=20)), lang) for d, lang in enumerate(sorted(words) * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs.drop("lang"), docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got) and len({r.lang_pred for r in got}) == 70


def test_language_votes_equal_plain_version(spark):
    import numpy as np

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text rlike '[a-z]'").limit(60).toPandas()
    x = np.array([language.features(t) for t in docs.text])
    langs = sorted(docs.lang.dropna().unique())
    known = docs.lang.isin(langs).to_numpy()
    model = language.LanguageModel(langs, x[known], np.array([langs.index(v) for v in docs.lang[known]]))
    for v in x:
        s = [float(np.dot(w[:-1], v) + w[-1]) for w in model.weights]
        family = max(range(len(model.families)), key=lambda f: s[f]) if len(model.families) > 1 else 0
        shift = len(model.families) if len(model.families) > 1 else 0
        sure = lambda m: 1 / (1 + np.exp(-3 * m))
        votes = {k: sum((sure(m) + (m >= 0) if a == k else 1 - sure(m) + (m < 0)) for (a, b), m in zip(model.pairs, s[shift:]) if k in (a, b) and {a, b} <= set(model.members[family])) for k in model.members[family]}
        assert model.predict(v)[0] == max(votes, key=votes.get)


def test_licences_at_all_widths(spark):
    import textwrap

    rows = []
    for k, (name, text) in enumerate(licenses.KNOWN):
        for width in range(50, 101):
            rows.append((k, name, "Copyright (c) 2020-2024 Some Body\nCopyright The Other Authors\nAll rights reserved.\n\n" + "\n".join(textwrap.wrap(text, width, break_long_words=False)), width))
    spelled = [(0, "MIT", licenses.MIT_BODY + " licence licence"), (1, "MIT", licenses.MIT_BODY + " license license"), (2, "MIT", "Copyright (c) 2020 Some Body. All rights reserved. " + licenses.MIT_BODY)]
    df = spark.createDataFrame([(100 * k + w, t) for k, _, t, w in rows] + [(90_000 + k, t) for k, _, t in spelled], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert all(got[100 * k + w].license == name for k, name, _, w in rows)
    assert got[90_000].digest == got[90_001].digest and got[90_002].license == "MIT"


def test_licence_sql_agrees(spark, tmp_path):
    import duckdb

    texts = ["Copyright (c) 2020 A\n" + licenses.MIT_BODY, licenses.MIT_BODY.upper(), "licence licence\ncopyright notice\n(c) you may\n© 2020 x", None, "", "copyright 2020 x all rights reserved. permission to use a"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = con.execute(licenses.oracle()).fetchall()
    got = [tuple(r) for r in licenses.scan(spark.read.parquet(str(tmp_path / "d"))).collect()]
    assert sorted(got) == sorted(want) and sum(r[3] for r in got) == 2


def test_many_rules(spark):
    rules = [*urls.RULES, *[urls.Rule("block", f"h{k}.net/p{k % 7}/") for k in range(1500)]]
    rows = [(k, f"http://{'a.' if k % 2 else ''}h{k}.net/p{k % 5}/x", "") for k in range(400)] + [(9000, "http://x.org/", ""), (9001, None, ""), (9002, "http:///p", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    got = {r.page_id: r.rule for r in urls.filter_urls(df, rules).collect()}
    assert len(got) == len(rows) and all(got[k] == (f"h{k}.net/p{k % 7}/" if k % 7 == k % 5 else None) for k in range(400))
    assert got[9000] == "org/" and got[9001] is None and got[9002] is None


def test_trust_reaches_the_fixed_point(spark):
    import numpy as np

    links = [(k, k + 1) for k in range(20)] + [(20, 0), (3, 9), (9, 3), (5, 5 + 7), (12, 2)]
    edges = urls.shares(spark.createDataFrame([(f"h{a}", f"h{b}", 1 + a % 3) for a, b in links], "src string, dst string, n long"))
    got = {r.host: r.v for r in urls.spread(edges, spark.createDataFrame([("h0", 0.75), ("h4", 0.25)], "host string, v double")).collect()}
    m, seed = np.zeros((21, 21)), np.zeros(21)
    seed[0], seed[4] = 0.75, 0.25
    for r in edges.collect():
        m[int(r.dst[1:]), int(r.src[1:])] = r.share
    want = np.linalg.solve(np.eye(21) - 0.85 * m, 0.15 * seed)
    assert sum(abs(want[k] - got.get(f"h{k}", 0.0)) for k in range(21)) < urls.TOLERANCE and got["h20"] > 0


def test_runs_equal_enumeration():
    import random

    import numpy as np

    rng = random.Random(3)
    for _ in range(30):
        streams = [[rng.randrange(3) for _ in range(rng.randrange(14))] for _ in range(5)]
        pages = [rng.randrange(4) for _ in streams]
        place, low, high, run = html.shard_runs([np.array(s, dtype=np.int64) for s in streams], pages, 4)
        flat, owner = [], []
        for k, s in enumerate(streams):
            flat += [*s, None]
            owner += [pages[k]] * (len(s) + 1)
        grams = {}
        for at in range(len(flat) - 3):
            if None not in flat[at : at + 4]:
                grams.setdefault(tuple(flat[at : at + 4]), []).append(at)
        got = {tuple(flat[p : p + 4]): (a, b) for p, a, b in zip(place, low, high)}
        assert got == {g: (min(owner[k] for k in at), max(owner[k] for k in at)) for g, at in grams.items()}
        assert all((run[k] >= 0) == any(k in at for at in grams.values()) for k in range(len(flat)))


def test_html_names_beside_prose(spark):
    body = "<article><h1>T{0}</h1><div class='social-science'><p>prose {0} about markets</p></div><section class='related-work'>earlier {0} work here</section><div class='share-buttons'>share me {0}</div><div class='social-plug'>Follow us on all the usual networks today</div></article>"
    rows = [(k, f"http://h/{k}", body.format(f"n{k}")) for k in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("shard", F.lit(2))
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got == {k: f"Tn{k} prose n{k} about markets earlier n{k} work here" for k in range(4)}
    assert html.extract(df.where("false")).count() == 0


def test_quality_ratio_equals_plain_version(spark):
    import math

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").withColumn("llr", F.lit("x")).withColumn("__text", F.lit(1))
    trusted = {r.doc_id for r in docs.where("doc_id % 3 = 0").collect()}
    ratios = quality.fit_ratio(docs, docs.where("doc_id % 3 = 0").select("doc_id"))
    rows = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in docs.collect()}
    grams = {d: [(a,) for a in w] + list(zip(w, w[1:])) for d, w in rows.items()}
    every = sorted({g for gs in grams.values() for g in gs})
    one = spark.createDataFrame([(k, *(g if len(g) == 2 else (g[0], None))) for k, g in enumerate(every)], "k long, a string, b string")
    found = one.select("k", F.when(F.col("b").isNull(), quality.bucket(F.col("a"))).otherwise(quality.bucket(F.col("a"), F.col("b"))).alias("n")).collect()
    of = {every[r.k]: r.n for r in found}
    n = collections.Counter(of[g] for gs in grams.values() for g in gs)
    t = collections.Counter(of[g] for d, gs in grams.items() if d in trusted for g in gs)
    a, b, size = sum(t.values()), sum(n.values()), quality.BUCKETS
    s = quality.SMOOTHING
    ratio = {k: math.log((t[k] / a + s / size) / (1 + s)) - math.log((n[k] / b + s / size) / (1 + s)) for k in n}
    for r in quality.quality_rules(docs, ratios).collect():
        want = sum(ratio[of[g]] for g in grams[r.doc_id]) / len(grams[r.doc_id]) if grams[r.doc_id] else 0.0
        assert abs(r.llr - want) < 1e-5
        assert r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD)


def test_toxicity_scores_equal_plain_forward_backward(spark):
    import numpy as np

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    t = np.exp(model.trans)
    for r in toxicity.score_toxicity(docs, model).limit(40).collect():
        e = np.array([model.emission(w) for w in toxicity.WORD.findall((r.text or "").lower())])
        x = np.exp(np.clip(np.stack([0 * e, e], axis=1), -30, 30)) if len(e) else np.zeros((0, 2))
        ahead, behind = x.copy(), np.ones_like(x)
        for k in range(1, len(e)):
            ahead[k] = x[k] * (ahead[k - 1] @ t)
            ahead[k] /= ahead[k].sum()
        for k in range(len(e) - 2, -1, -1):
            behind[k] = t @ (x[k + 1] * behind[k + 1])
            behind[k] /= behind[k].sum()
        p = ahead * behind
        p = (p / p.sum(axis=1, keepdims=True))[:, 1] if len(e) else np.zeros(0)
        strong = p[p >= 0.1].sum()
        f = [1, np.log1p(strong), p.max() if len(p) else 0, min(1, 10 * strong / len(p)) if len(p) else 0]
        assert abs(r.score - 1 / (1 + np.exp(-np.dot(model.doc, f)))) < 1e-6


def test_long_and_short_texts_have_equal_marginals_apart_and_together():
    import numpy as np

    rng = np.random.default_rng(1)
    model = toxicity.ChainModel()
    model.trans = np.array([[0.3, -0.5], [-0.2, 0.8]])
    docs = [rng.normal(size=n) for n in (0, 1, 5, 70_000, 3, 200, 40)] * 20
    together = model.marginals(docs)
    assert all(np.allclose(a, model.marginals([d])[0]) for a, d in zip(together[:7], docs)) and all(len(a) == len(d) for a, d in zip(together, docs))


def test_near_duplicates_in_large_groups(spark):
    import random

    rng = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    docs = [(0, " ".join(base))]
    for d in range(1, 260):
        words = list(base)
        for k in rng.sample(range(120), rng.randrange(1, 6)):
            words[k] = f"d{d}x{k}"
        docs.append((d, " ".join(words)))
    passage = " ".join(f"p{k}" for k in range(60))
    docs += [(1000 + d, passage + " " + " ".join(f"q{d}y{k}" for k in range(30))) for d in range(120)] + [(2000 + d, docs[7][1]) for d in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = components({d: shingles(t, 4) for d, t in docs})
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df, size=4).collect()} == want


def test_keep_one_of_nothing(spark, empty):
    assert neardup.keep_one(empty).count() == 0 and neardup.keep_one(empty).columns == empty.columns


def test_unknown_symbols():
    vocab = {"a": 0, "b": 1, "ab": 2, "?": 3}
    assert bpe.PrefixBpe(vocab, [("a", "b")]).encode("axbx") == ["ab"]
    assert bpe.PrefixBpe(vocab, [("a", "b")], unknown="?").encode("abxxa") == ["ab", "?", "?", "a"]
    assert bpe.PrefixBpe(vocab, [("a", "b")], unknown="?", fuse=True).encode("xxab") == ["?", "ab"]


def test_token_counts_with_clashing_columns(odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = odd.withColumn("row", F.lit(1)).withColumn("rest", F.lit(2)).withColumn("pretoken", F.lit(3))
    assert tokens.count_tokens(df, path).exceptAll(tokens.count_tokens(odd, path)).count() == 0


def test_pipeline_stages_on_odd_rows(spark, odd):
    odd = odd.drop("score").withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long")).withColumn("__more", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, odd.where("false")):
            out = stage(spark, df, SF)
            rows = out.count()
            assert rows <= df.count() and (name == "bpe" or out.columns == df.columns)
            if name in ("toxicity", "decontamination", "bpe"):
                assert rows == df.count()
