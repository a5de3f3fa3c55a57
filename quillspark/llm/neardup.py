"""Near duplicates: universal-hash minima with banding, signature and exact verification, components by large-star and small-star.

1. One pass makes each text's set of word shingles, a 128-bit digest of it (the class of equal sets) and BANDS * ROWS minima.
2. Classes that agree in a band meet in a bucket. Not all pairs of a bucket are tested: each member meets the hub, the
   member that meets most others over all bands (in a group of edited copies the one nearest to the original).
   Signatures sort out pairs far below the threshold, and full shingle sets decide the others. Members that are then
   outside their hub's component meet two more, one of that component and one outside it, chosen by the hash of their
   keys alone, so that the buckets of a group mostly choose the same and a member has few partners.
3. Links give components. Where a bucket's members still lie in several components, the rest is exact: members outside
   the largest component of their group (see Corpus.rest) are compared with the whole group, block by block. A task gets two bounded blocks with
   signatures and sets, skips pairs that its own links have joined by then, and returns links that join components, so
   fewer than it has members. So every two classes of a bucket lie in one component or are below the threshold.

A pair at the threshold shares no bucket with probability (1 - 0.8**ROWS)**BANDS, 3e-6. Edges, signatures and components
stay in tables; nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, few, give_back, materialise, read_table

SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Least share of equal minima: 6 standard deviations below 0.8.
SIGNATURE = 0.6
#: Share from which a member belongs to its hub's group, and up to which it (also) belongs to its bucket's own: a member
#: below the first and a near duplicate of it can't be more than 0.2 apart in similarity to the hub; 0.1 is for chance.
LOOSE, FAR = 0.4, 0.7
#: Members of a block in the exact rest.
BLOCK = 512
#: Words and classes a task remembers, and shingles hashed at a time.
MEMO, CHUNK = 200_000, 256
#: Parts that a group's rows are dealt to where they meet one row of the group.
SALTS = 16
SET = np.dtype("<u8")


class Sets:
    """Shingle sets as sorted arrays of 64-bit hashes."""

    def __init__(self, size: int):
        self.size = size
        self.words: dict[bytes, int] = {}
        rng = np.random.Generator(np.random.PCG64(12345))
        self.a = rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)

    def hashes(self, text: str) -> np.ndarray:
        """The distinct shingles of a text: A to Z lower-cased, words between ASCII white space."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, dtype=SET)
        memo = self.words
        if len(memo) > MEMO:
            memo.clear()
        out = np.empty(len(words), dtype=np.uint64)
        for k, w in enumerate(words):
            h = memo.get(w)
            if h is None:
                h = memo[w] = xxhash.xxh3_64_intdigest(w)
            out[k] = h
        n = min(self.size, len(words))
        mixed = out[: len(out) - n + 1].copy()
        for k in range(1, n):
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed += out[k : len(out) - n + 1 + k] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + n * 131)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        return np.unique(mixed)

    def minima(self, found: np.ndarray) -> bytes:
        """Minima of the universal hashes (a x + b) mod 2**64, upper half, of the upper halves of the set's hashes."""
        x = found >> np.uint64(32)
        low = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(x), CHUNK):
            low = np.minimum(low, (self.a[:, None] * x[None, at : at + CHUNK] + self.b[:, None]).min(axis=1))
        return (low >> np.uint64(32)).astype("<u4").tobytes()


def shared_size(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = len(a) - 1
    return int((a[at] == b).sum())


def with_sets(docs: DataFrame, size: int) -> DataFrame:
    """rid, id, n, key, minima of each row: minima only where a task meets a key for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, seen = Sets(size), set()
        for batch in batches:
            n, keys, minima = [], [], []
            for text in batch.column(2):
                found = sets.hashes(text.as_py() or "")
                key = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
                n.append(len(found))
                keys.append(key)
                if key is None or key in seen:
                    minima.append(None)
                    continue
                if len(seen) < MEMO:
                    seen.add(key)
                minima.append(sets.minima(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(minima, pa.binary())], names=["rid", "id", "n", "key", "minima"])
        del sets, seen
        give_back()

    return docs.select("rid", "id", "text").mapInArrow(run, f"rid binary, id {docs.schema['id'].dataType.simpleString()}, n long, key binary, minima binary")


def agreement(pairs: DataFrame) -> DataFrame:
    """a, b, share of the pairs (a, b, ma, mb: minima): how many of their minima agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype="<u4").reshape(-1, HASHES) for k in (2, 3))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array((x == y).mean(axis=1), pa.float64())], names=["a", "b", "share"])

    return pairs.mapInArrow(run, "a binary, b binary, share double")


def salted(rows: DataFrame, single: DataFrame, on: str, by: str = "key", how: str = "inner") -> DataFrame:
    """rows joined to single, which has one row for each value of on. A value may hold most rows: these are dealt to SALTS parts by another column, and its one row goes to each."""
    each = single.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(each, [on, "salt"], how).drop("salt")


class Corpus:
    """Classes of equal sets, their buckets, and the tests made so far. docs: id, text, rid (16 bytes for both)."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.docs, self.size, self.percent = docs, size, percent
        bounded_batches(docs.sparkSession)
        self.rows = materialise(with_sets(docs, size), "sets")
        classes = self.rows.where("n > 0").groupBy("key").agg(F.max("minima").alias("minima"), F.min("rid").alias("rid"), F.min("id").alias("id"), F.count("*").alias("rows"))
        self.classes = materialise(classes, "classes")
        width = 4 * ROWS
        bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring("minima", k * width + 1, F.lit(width))))
        buckets = self.classes.select("key", F.explode(bands).alias("band"))
        sizes = buckets.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
        shared = materialise(buckets.join(sizes, "band"), "buckets")
        meets = shared.groupBy("key").agg(F.sum("size").alias("meets"))
        central = F.max_by("key", F.struct("meets", "key"))
        hubs = shared.join(meets, "key").groupBy("band").agg(central.alias("hub"))
        self.members = materialise(shared.join(hubs, "band").select("band", "key", "hub"), "members")

    def tested(self, pairs: DataFrame) -> DataFrame:
        """a, b, share, near: the pairs (a < b, distinct), tested on their full sets where signatures don't sort them out (near is null there)."""
        m = self.classes.select("key", "minima")
        own = pairs.join(m.withColumnRenamed("key", "b").withColumnRenamed("minima", "mb"), "b")
        own = own.join(m.withColumnRenamed("key", "a").withColumnRenamed("minima", "ma"), "a").select("a", "b", "ma", "mb")
        shares = materialise(agreement(own), "shares")
        left = shares.where(F.col("share") >= SIGNATURE).select("a", "b")
        keys = left.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        full = self.full_sets(keys)
        percent = self.percent

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = (np.frombuffer(v.as_py(), dtype=SET) for v in (x, y))
                    both = shared_size(x, y)
                    whole = len(x) + len(y) - both
                    near.append(100 * both >= percent * whole)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], names=["a", "b", "near"])

        both = left.join(full.withColumnRenamed("key", "b").withColumnRenamed("s", "sb"), "b").join(full.withColumnRenamed("key", "a").withColumnRenamed("s", "sa"), "a")
        found = both.select("a", "b", "sa", "sb").mapInArrow(exact, "a binary, b binary, near boolean")
        return materialise(shares.join(found, ["a", "b"], "left"), "tests")

    def full_sets(self, keys: DataFrame) -> DataFrame:
        """key, s: the whole sets of the classes in keys, made again from the text of one row of each."""
        wanted = self.classes.join(keys, "key", "left_semi").select("rid")
        texts = self.docs.join(few(wanted), "rid", "left_semi").select("text")
        size = self.size

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made, seen = Sets(size), set()
            for batch in batches:
                out = []
                for text in batch.column(0):
                    found = made.hashes(text.as_py() or "").tobytes()
                    key = xxhash.xxh3_128_digest(found)
                    if key not in seen:
                        out.append((key, found))
                        if len(seen) < MEMO:
                            seen.add(key)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([s for _, s in out], pa.binary())], names=["key", "s"])
            del made, seen
            give_back()

        return materialise(texts.mapInArrow(sets, "key binary, s binary").dropDuplicates(["key"]), "shingles")

    def mixed(self, labels: DataFrame) -> DataFrame:
        """band, key, hub, label of the members of buckets with several components."""
        own = self.members.join(labels, "key", "left").select("band", "key", "hub", F.coalesce("label", "key").alias("label"))
        several = own.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("band")
        return own.join(several, "band", "left_semi")

    def second(self, labels: DataFrame) -> DataFrame:
        """a, b: members outside their hub's component, each with one member inside it and one outside."""
        own = materialise(self.mixed(labels), "mixed")
        other = F.min(F.when(F.col("key") != F.col("hub"), F.struct(F.xxhash64("key").alias("o"), "key")))
        parts = own.groupBy("band", "label").agg(other.alias("one"), F.max(F.col("key") == F.col("hub")).alias("home"))
        chosen = parts.groupBy("band").agg(
            F.max(F.when(F.col("home"), F.col("label"))).alias("home"), F.max(F.when(F.col("home"), F.col("one.key"))).alias("inside"), F.min(F.when(~F.col("home"), F.col("one"))).alias("outside")
        )
        pairs = salted(own, chosen, "band").where("label <> home").select("key", F.explode(F.array("inside", "outside.key")).alias("with")).where("with is not null and key <> with")
        return pairs.select(F.least("key", "with").alias("a"), F.greatest("key", "with").alias("b")).distinct()

    def rest(self, labels: DataFrame, shares: DataFrame) -> DataFrame:
        """a, b: links that join components of members of one bucket. shares: share of equal minima of each member and its hub.

        Members that are similar to their bucket's hub form groups over all buckets, so that each pair is met once; what
        only shares a passage with it stays in its bucket, lest common passages tie everything to everything.
        """
        own = self.mixed(labels).withColumn("a", F.least("key", "hub")).withColumn("b", F.greatest("key", "hub")).join(shares, ["a", "b"], "left")
        own = materialise(own.select("band", "key", "hub", "label", F.when(F.col("key") == F.col("hub"), 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("share")), "mixed")
        groups = label_components(own.where(F.col("share") >= LOOSE).select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()).withColumnRenamed("label", "group")
        parts = own.select("key", "label").distinct().join(groups, "key").select("group", "key", "label")
        parts = parts.unionByName(own.where(F.col("share") < FAR).select(F.col("band").cast("string").cast("binary").alias("group"), "key", "label"))
        sizes = parts.groupBy("group", "label").agg(F.count("*").alias("n"))
        main = sizes.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("largest"))
        width = lambda n: F.ceil(n / BLOCK).cast("int")
        parts = salted(parts, main.where("all > largest"), "group").select("group", "key", "label", (F.col("label") != F.col("main")).alias("poor"), width(F.col("all")).alias("ja"), width(F.col("all") - F.col("largest")).alias("jp"))
        parts = materialise(parts.where("ja > 0 and jp > 0"), "groups")
        block = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
        upto = lambda n: F.sequence(F.lit(0), n - 1)
        left = parts.where("poor").select("group", block(F.col("jp")).alias("i"), F.explode(upto(F.col("ja"))).alias("j"), "key", "label", F.lit(True).alias("poor"))
        right = parts.select("group", F.explode(upto(F.col("jp"))).alias("i"), block(F.col("ja")).alias("j"), "key", "label", F.lit(False).alias("poor"))
        full = self.full_sets(parts.select("key").distinct()).join(self.classes.select("key", "minima"), "key")
        percent = self.percent

        def compare(table: pa.Table) -> pa.Table:
            poor = np.array(table.column("poor").to_pylist(), dtype=bool)
            keys, labels = table.column("key").to_pylist(), table.column("label").to_pylist()
            minima = np.frombuffer(b"".join(table.column("minima").to_pylist()), dtype="<u4").reshape(-1, HASHES)
            sets = [np.frombuffer(x, dtype=SET) for x in table.column("s").to_pylist()]
            root = {x: x for x in labels}

            def find(x: bytes) -> bytes:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            out, others = [], np.flatnonzero(~poor)
            for p in np.flatnonzero(poor):
                agree = (minima[others] == minima[p]).sum(axis=1)
                near = np.flatnonzero(agree >= SIGNATURE * HASHES)
                for q in others[near[np.argsort(-agree[near], kind="stable")]]:
                    x, y = find(labels[p]), find(labels[q])
                    if x == y:
                        continue
                    small, large = sorted((len(sets[p]), len(sets[q])))
                    if 100 * small < percent * large:
                        continue
                    both = shared_size(sets[p], sets[q])
                    if 100 * both >= percent * (small + large - both):
                        root[max(x, y)] = min(x, y)
                        out.append((min(keys[p], keys[q]), max(keys[p], keys[q])))
            return pa.table([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], names=["a", "b"])

        both = left.unionByName(right).join(full, "key")
        return materialise(both.groupBy("group", "i", "j").applyInArrow(compare, "a binary, b binary").distinct(), "rest")

    def grouped(self, labels: DataFrame) -> DataFrame:
        """key, id, label of the classes that are linked or have several rows; each other row is a group of its own."""
        of = self.classes.join(labels, "key", "left").where("label is not null or rows > 1")
        return materialise(of.select("key", "id", F.coalesce("label", "key").alias("label")), "grouped")

    def components(self) -> DataFrame:
        """key, label of every class that is linked with another."""

        def pairs(m: DataFrame) -> DataFrame:
            return m.where("key <> hub").select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()

        first = self.tested(pairs(self.members))
        links = first.where("near").select("a", "b")
        labels = label_components(links)
        more = self.second(labels)
        links = materialise(links.unionByName(self.tested(more.join(first, ["a", "b"], "left_anti")).where("near").select("a", "b")), "links")
        labels = label_components(links)
        more = self.rest(labels, first.select("a", "b", "share"))
        return labels if more.isEmpty() else label_components(links.unionByName(more))


def label_components(edges: DataFrame) -> DataFrame:
    """key, label: the least node of each node's component, by alternating large-star and small-star rounds until nothing moves."""
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not are_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        e = materialise(small.distinct(), "edges")
    give_back()
    return e.select(F.col("u").alias("key"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("key"), F.col("v").alias("label")).distinct())


def are_stars(e: DataFrame) -> bool:
    """Whether each node is either a centre or tied to one centre only: no u occurs twice, and none is a v too."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("tied"), F.lit(0).alias("centre")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("tied"), F.lit(1).alias("centre")))
    return ends.groupBy("x").agg(F.sum("tied").alias("tied"), F.max("centre").alias("centre")).where("tied + centre > 1").isEmpty()


def row_id(own: Column, text: Column) -> Column:
    """16 bytes that stand for a row's id and text; null and empty differ."""
    return F.unhex(F.md5(F.concat_ws("\n", F.coalesce(own.cast("string"), F.lit("\t")), F.coalesce(F.length(text), F.lit(-1)).cast("string"), text).cast("binary")))


def prepare(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).withColumn("rid", row_id(F.col("id"), F.col("text")))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the least id of its component), kept.

    Texts with fewer words than size have the whole sequence as one shingle; texts without a word (empty, null) have
    none, are linked with nothing and are their own component. Rows with equal sets are one class. A null id is no least
    id while there is another; kept is null-safe. Repeated rows get equal results.
    """
    corpus = Corpus(prepare(docs, id_col, text_col), size, percent)
    labels = corpus.components()
    of = corpus.grouped(labels)
    least = of.groupBy("label").agg(F.min("id").alias("component_id"))
    of = salted(of, least, "label").select("key", "component_id")
    out = salted(corpus.rows.select("rid", F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "key"), of, "key", "rid", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near duplicates: of each component the row with the least id (with no id: of least hash).

    Rows without a word all stay. Rows that repeat an id together with its text count as one document and leave one row.
    """
    flat = prepare(docs, id_col, text_col)
    corpus = Corpus(flat, size, percent)
    labels = corpus.components()
    of = corpus.grouped(labels).select("key", "label")
    rows = salted(corpus.rows.where("n > 0").select("rid", "id", "key"), of, "key", "rid").select("rid", "id", "label")
    best = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("m")).select("label", F.col("m.rid").alias("best"))
    gone = materialise(salted(rows, best, "label", "rid").where("rid <> best").select("rid").distinct(), "gone")
    rid = docs.withColumn("__rid", row_id(docs[id_col], docs[text_col]))
    out = rid.join(few(gone).withColumnRenamed("rid", "__rid"), "__rid", "left_anti")
    repeated = corpus.rows.groupBy("rid").count().where("count > 1").select(F.col("rid").alias("__rid"))
    if not repeated.isEmpty():
        again = few(repeated)
        out = out.join(again, "__rid", "left_anti").unionByName(out.join(again, "__rid", "left_semi").dropDuplicates(["__rid"]))
    return out.select(*docs.columns)


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of all documents on four-word shingles: one row each, repeated rows included. Null, empty and blank
    texts are their own component; equal texts are one; of ties the least id is kept; an empty table gives no row."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), size=4)
