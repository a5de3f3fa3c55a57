"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

A window as long as an item, or a shorter document as a whole, counts as a leak if its fingerprint is within RADIUS bits of the item's and their weighted
Jaccard similarity over SHINGLE-word shingles is at least THRESHOLD. Fingerprints are cut into RADIUS + 1 blocks; two of
them within RADIUS bits agree in one block at least, so the join on (length, block, value) finds all of them.

Which windows are fingerprinted is decided without loss. A window that reaches the threshold shares that part of the
item's shingle weight, so it spans enough places where the document has a shingle of the item. One pass over all
documents looks up every shingle of theirs among the items'; only documents with enough of an item's shingles go on, and
there every window start that spans enough of them is taken. All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import few, materialise, read_table

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 12


def with_tokens(df: DataFrame, text: str, tokens: str) -> DataFrame:
    """df with the lower-cased runs of letters and digits of a text; explode() of one array keeps it from being computed anew."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return df.withColumn(tokens, F.explode(F.array(F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " ")))))


def shingle_hashes(tokens: str, size: int) -> Column:
    w = F.col(tokens)
    return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (size - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)]))


def with_simhash(df: DataFrame, features: str, out: str = "hash") -> DataFrame:
    """df with the 64-bit SimHash of an array column of hashes, each occurrence with weight 1; a tie of a bit gives 0.

    Sixteen sums, each with four counters of 16 bits, or for more than 65,535 features 64 sums; they are made once per row, before the bits.
    """
    f = F.col(features)

    def counters(g: int) -> Column:
        return F.aggregate(f, F.lit(0).cast("long"), lambda a, x: a + F.shiftrightunsigned(x, g).bitwiseAND(F.lit(0x0001000100010001)))

    def single(bit: int) -> Column:
        return F.aggregate(f, F.lit(0).cast("long"), lambda a, x: a + F.shiftrightunsigned(x, bit).bitwiseAND(F.lit(1)))

    long = F.size(f) > 0xFFFF
    df = df.withColumn("__c", F.explode(F.array(F.when(long, F.array(*[single(b) for b in range(64)])).otherwise(F.array(*[counters(g) for g in range(16)])))))
    bits = F.lit(0).cast("long")
    for bit in range(64):
        packed = F.shiftrightunsigned(F.get("__c", F.lit(bit % 16)), 16 * (bit // 16)).bitwiseAND(F.lit(0xFFFF))
        many = 2 * F.when(long, F.get("__c", F.lit(bit))).otherwise(packed) > F.size(f)
        value = (1 << bit) if bit < 63 else -(1 << 63)
        bits = bits.bitwiseOR(F.when(many, F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return df.withColumn(out, bits).drop("__c")


def block_keys(fingerprint: Column, radius: int) -> Column:
    """(block, value) of radius + 1 blocks that cover the 64 bits."""
    n = radius + 1
    edges = [64 * k // n for k in range(n + 1)]
    blocks = [F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("v")) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return F.array(*blocks)


def prepare_items(items: DataFrame, shingle: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """item_id, n (words), hash, shingles (h, c: count, w: weight), weight (of all), need (least hits), places of items with enough words.

    A shingle's weight is one over the number of items that have it; find_leaks weighs what replaces it alike. Items that repeat an id are taken one by one.
    """
    own = with_tokens(items.select(items[id_col].alias("item_id"), items[text_col].alias("text")), "text", "t").where(F.size("t") >= shingle)
    own = own.select("item_id", F.size("t").alias("n"), F.xxhash64("text").alias("item"), shingle_hashes("t", shingle).alias("h"), F.transform("t", lambda x: F.xxhash64(x)).alias("f"))
    own = with_simhash(own.dropDuplicates(["item_id", "item"]), "f").drop("f")
    flat = own.select("item_id", "item", F.explode("h").alias("h")).groupBy("item_id", "item", "h").agg(F.count("*").alias("c"))
    df = flat.groupBy("h").agg((1 / F.count("*")).alias("w"))
    rows = flat.join(df, "h").groupBy("item_id", "item").agg(F.collect_list(F.struct("h", "c", "w")).alias("shingles"), F.sum(F.col("c") * F.col("w")).alias("weight"), F.max("w").alias("top"))
    need = F.greatest(F.lit(1), F.ceil(threshold * F.col("weight") / F.col("top") - 1e-9)).cast("int")
    return own.select("item_id", "item", "n", "hash").join(rows, ["item_id", "item"]).withColumn("need", need).drop("top")


def find_leaks(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, start, n_windows: one row for each document and item of which it has a leaking window.

    A document with fewer words than an item is one window for it. similarity: the largest of any window, and start its place in words, the first on ties; n_windows: windows that leak.
    Null or short texts, and items of fewer than shingle words, leak nothing. Rows that share an id are judged one by one
    and reported once, with the best window of any; a row without an id is reported with a null id.
    """
    known = materialise(prepare_items(items, shingle, threshold, item_id, item_text), "items")
    lookup = known.select("item_id", "item", "n", "need", F.explode("shingles").alias("s")).select(F.col("s.h").alias("h"), "item_id", "item", "n", "need", F.col("s.c").alias("c"))
    flat = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).withColumn("doc", F.xxhash64("text"))
    # every shingle of every document, looked up among the items'
    words = with_tokens(flat.select("doc_id", "doc", "text"), "text", "t").select("doc_id", "doc", "t")
    places = words.select("doc_id", "doc", F.posexplode(shingle_hashes("t", shingle)).alias("p", "h"))
    hits = places.join(few(lookup), "h").groupBy("doc_id", "doc", "item_id", "item", "n", "need").agg(F.collect_set("p").alias("p"))
    enough = hits.where(F.size("p") >= F.col("need")).withColumn("p", F.sort_array("p"))
    p, m, span = F.col("p"), F.col("need"), F.col("n") - shingle
    runs = F.transform(
        F.slice(p, 1, F.size(p) - m + 1),
        lambda x, i: F.when(F.get(p, i + m - 1) - x <= span, F.sequence(F.greatest(F.lit(0), F.get(p, i + m - 1) - span), x)).otherwise(F.array().cast("array<int>")),
    )
    windows = enough.select("doc_id", "doc", "n", F.explode(F.array_distinct(F.flatten(runs))).alias("start")).distinct()
    starts = materialise(windows.groupBy("doc_id", "doc", "n").agg(F.sort_array(F.collect_list("start")).alias("starts")), "windows")
    # candidates only: tokens again, fingerprints of their windows
    ids = starts.select(F.col("doc").alias("__doc")).distinct()
    texts = with_tokens(flat.join(few(ids), F.col("doc") == F.col("__doc"), "left_semi"), "text", "t").dropDuplicates(["doc_id", "doc"])
    rows = texts.alias("a").join(starts.alias("b"), F.expr("a.doc = b.doc and a.doc_id <=> b.doc_id")).select("a.doc_id", "a.doc", "a.t", "b.n", "b.starts")
    cut = rows.select("doc_id", "doc", "n", "t", F.explode("starts").alias("start")).where((F.col("start") + F.col("n") <= F.size("t")) | ((F.col("start") == 0) & (F.size("t") < F.col("n"))))
    cut = cut.select("doc_id", "doc", "n", "start", F.slice("t", F.col("start") + 1, F.col("n")).alias("t"))
    cut = cut.withColumn("f", F.explode(F.array(F.transform("t", lambda x: F.xxhash64(x)))))
    prints = with_simhash(cut, "f").select("doc_id", "doc", "n", "start", "hash", shingle_hashes("t", shingle).alias("h"))
    prints = materialise(prints, "fingerprints")
    index = lambda df, *cols: df.select(*cols, "n", "hash", F.explode(block_keys(F.col("hash"), radius)).alias("b")).select(*cols, "n", "hash", "b.k", "b.v")
    left, right = index(prints, "doc_id", "doc", "start").alias("a"), few(index(known, "item_id", "item")).alias("b")
    near = left.join(right, F.expr(f"a.n = b.n and a.k = b.k and a.v = b.v and bit_count(a.hash ^ b.hash) <= {radius}"))
    near = near.select("a.doc_id", "a.doc", "a.n", "a.start", "b.item_id", "b.item").distinct().alias("c")
    pairs = near.join(prints.alias("a"), F.expr("c.doc = a.doc and c.doc_id <=> a.doc_id and c.n = a.n and c.start = a.start")).select("c.*", "a.h")
    pairs = pairs.alias("c").join(few(known).alias("b"), F.expr("c.item = b.item and c.item_id <=> b.item_id")).select("c.doc_id", "c.start", "c.item_id", "c.h", "b.shingles", "b.weight")
    # weighted Jaccard: shared weight against all weight. Shingles that the item doesn't have weigh, each, what the item's missing ones weigh on average
    entry = lambda h, c, w, side: F.struct(h.alias("h"), F.lit(side).alias("side"), c.cast("int").alias("c"), w.alias("w"))
    both = F.concat(F.transform("shingles", lambda s: entry(s["h"], s["c"], s["w"], 0)), F.transform("h", lambda x: entry(x, F.lit(0), F.lit(0.0), 1)))
    state = {"h": F.lit(0).cast("long"), "c": F.lit(-1), "w": F.lit(0.0), "both": F.lit(0.0), "own": F.lit(0.0), "n_both": F.lit(0), "n_own": F.lit(0), "n_item": F.lit(0)}

    def step(a: Column, e: Column) -> Column:
        # an item's shingle comes before the window's equal ones; c counts down how many are left to share
        item, same = e["side"] == 0, (a["c"] >= 0) & (a["h"] == e["h"])
        known, shared = ~item & same, ~item & same & (a["c"] > 0)
        new = {
            "h": e["h"],
            "c": F.when(item, e["c"]).when(shared, a["c"] - 1).when(same, F.lit(0)).otherwise(F.lit(-1)),
            "w": F.when(item, e["w"]).otherwise(a["w"]),
            "both": a["both"] + F.when(shared, a["w"]).otherwise(F.lit(0.0)),
            "own": a["own"] + F.when(known, a["w"]).otherwise(F.lit(0.0)),
            "n_both": a["n_both"] + shared.cast("int"),
            "n_own": a["n_own"] + known.cast("int"),
            "n_item": a["n_item"] + F.when(item, e["c"]).otherwise(F.lit(0)),
        }
        return F.struct(*[v.alias(k) for k, v in new.items()])

    sums = F.aggregate(F.array_sort(both), F.struct(*[v.alias(k) for k, v in state.items()]), step)
    scored = pairs.withColumn("s", F.explode(F.array(sums)))
    scale = F.when(F.col("s.n_item") > F.col("s.n_both"), F.least(F.lit(1.0), (F.col("weight") - F.col("s.both")) / (F.col("s.n_item") - F.col("s.n_both")))).otherwise(F.lit(1.0))
    scored = scored.withColumn("sim", F.col("s.both") / (F.col("weight") + F.col("s.own") + (F.size("h") - F.col("s.n_own")) * scale - F.col("s.both")))
    found = scored.where(F.col("sim") >= threshold - 1e-12)
    best = F.max_by(F.col("start"), F.struct(F.round("sim", 9), -F.col("start")))
    return found.groupBy("doc_id", "item_id").agg(F.max("sim").alias("similarity"), best.alias("start"), F.countDistinct("start").alias("n_windows"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_leaks of all documents and items. Null, empty and short texts and items leak nothing; repeated rows are reported once;
    of windows that tie the first counts; an empty table on either side gives no row."""
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
