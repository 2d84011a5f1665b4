"""Checking new batches against all history: a prefix-tree hash forest kept in sorted runs.

Every entry has a set of features. For each of `trees` permutations its signature is one number made of `depth` min-hashes
of the features, a byte each, the first one highest. A run of the forest is a table of (tree, sig, key, features, first)
in folders by tree and leading bits of the signature (`head`), sorted by signature inside: all entries under a prefix are
one range of numbers.

A batch is located by range search: the ranges its prefixes fall into are collected at a fixed resolution (at most 2 ** CELL_BITS
a tree, whatever the batch), and of each run only the folders, row groups and pages with such ranges are read. Entries of
these with the same tree and prefix are candidates and are verified. A batch that is small against history reads a small part
of it; one with entries in most ranges reads the signatures once.

Equal feature sets have equal signatures, so a search for exact identity finds all under the longest prefix. For a similarity the search
starts at the longest prefix that suffices by the collision formula and widens to shorter ones until the recall, measured
against brute force on a bounded sample of the batch, reaches its target; it is measured again whenever history has doubled.
If the shortest prefix misses the target, the batch is compared with all entries that share a feature, which misses none.
`reached` reports it all. What was not found is accepted and becomes a new run; runs of similar size are merged, so history
is rewritten a logarithmic number of times, and the runs that went into a merged one are deleted.

Copies are merged into one entry before anything is shuffled by signature; a listing with a third of all rows is one entry.
A prefix that very many entries share (one template, say) is split into salts.
"""

from __future__ import annotations

import operator
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.session import delete, new_folder

#: Bits of a signature at which the ranges of a batch are told apart.
CELL_BITS = 12
#: Ranges of a tree that are handed to the scan of a run; near ones are joined until so many are left.
RANGES = 64
#: Entries of one prefix that one task gets.
PREFIX_ROWS = 100_000


def same_key(a: Column, b: Column) -> Column:
    """Verification for exact identity: `key` must agree. Features are not needed, so runs don't keep them."""
    return a["key"] == b["key"]


same_key.exact = True


def jaccard_from(threshold: float) -> Callable[[Column, Column], Column]:
    """Verification for near-duplicates: Jaccard similarity of the features of at least `threshold`."""

    def similar(a: Column, b: Column) -> Column:
        common = F.size(F.array_intersect(a["features"], b["features"]))
        return common >= threshold * (F.size(F.array_distinct(a["features"])) + F.size(F.array_distinct(b["features"])) - common)

    similar.threshold = threshold
    return similar


def shingles(text: Column, n: int = 5) -> Column:
    """Different runs of n words of a text (words in lower case, between anything but letters and digits); a shorter text is one run, an empty or null one none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    runs = lambda ws: F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - (n - 1), F.lit(1))), lambda k: F.array_join(F.slice(ws, k, n), " "))
    return F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, F.array_distinct(runs(ws))).otherwise(F.array().cast("array<string>")))[0]


def merged_ranges(cells: Iterable[int], most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges (first, last) that cover all cells, at most `most` of them: the widest gaps stay open."""
    cells = sorted(set(cells))
    gaps = sorted(((b - a, a, b) for a, b in zip(cells, cells[1:], strict=False) if b - a > 1), reverse=True)[: most - 1]
    starts = sorted(b for _, _, b in gaps)
    ends = sorted(a for _, a, _ in gaps)
    return list(zip(cells[:1] + starts, ends + cells[-1:], strict=True))


class Run(NamedTuple):
    path: str
    rows: int
    bits: int  # leading bits of the signature in the name of the folder


@dataclass
class HashForest:
    """A forest in the shared folder.

    trees, depth: permutations, and min-hashes in each (at most 7). recall, sample: the target and the number of probes it is
    measured on. verify: whether two entries (structs of key and features) match. merge_ratio: a run is merged into the
    one before it as soon as it has at least this share of its entries. head_rows: entries of a folder.
    reached: (prefix length, recall measured), one a search of a similarity; length 0 is the comparison by common features.
    """

    spark: SparkSession
    path: str = ""
    trees: int = 3
    depth: int = 4
    recall: float = 0.95
    sample: int = 200
    merge_ratio: float = 0.5
    head_rows: int = 2_000_000
    verify: Callable[[Column, Column], Column] = same_key
    runs: list[Run] = field(default_factory=list)
    schema: str = ""
    reached: list[tuple[int, float]] = field(default_factory=list)
    measured_at: int = 0

    def __post_init__(self) -> None:
        if not 1 <= self.depth <= 7:
            raise ValueError("depth must be 1 to 7")
        self.path = self.path or new_folder(self.spark, "forest")
        self.exact = getattr(self.verify, "exact", False)

    @property
    def rows(self) -> int:
        return sum(r.rows for r in self.runs)

    def signatures(self, entries: DataFrame) -> DataFrame:
        """(tree, sig, key, features, first) of entries (key, features, first); without features there is no signature."""
        byte = lambda seed: F.pmod(F.array_min(F.transform("features", lambda x: F.xxhash64(F.lit(seed), x))), F.lit(256))
        one = lambda t: reduce(operator.add, [F.shiftleft(byte(t * self.depth + k), 8 * (self.depth - 1 - k)) for k in range(self.depth)])
        sig = lambda t: F.struct(F.lit(t).alias("tree"), one(t).alias("sig"))
        usable = entries.filter(F.size("features") > 0)
        kept = F.array().cast("array<string>") if self.exact else F.col("features")
        return usable.select(F.explode(F.array(*[sig(t) for t in range(self.trees)])).alias("s"), "key", kept.alias("features"), "first").select("s.tree", "s.sig", "key", "features", "first")

    def _stored(self, path: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(path)

    def history(self) -> DataFrame | None:
        """All accepted entries in all trees."""
        parts = [self._stored(r.path) for r in self.runs]
        return reduce(DataFrame.unionByName, parts).drop("head") if parts else None

    def _prefix(self, sig: Column, length: int) -> Column:
        return F.shiftright(sig, 8 * (self.depth - length))

    def near(self, signed: DataFrame, length: int) -> DataFrame:
        """The entries of history that lie in the ranges of the batch's prefixes of `length` min-hashes (and some between)."""
        width = 8 * self.depth
        bits = min(CELL_BITS, 8 * length)
        cells: dict[int, list[int]] = {}
        for r in signed.groupBy("tree", F.shiftright("sig", width - bits).alias("cell")).agg(F.lit(1)).collect():  # at most trees * 2 ** CELL_BITS
            cells.setdefault(r.tree, []).append(r.cell)
        ranges = {t: merged_ranges(c) for t, c in cells.items()}
        low, high = (lambda c: c << (width - bits)), (lambda c: ((c + 1) << (width - bits)) - 1)
        between = lambda t: reduce(operator.or_, [F.col("sig").between(low(a), high(b)) for a, b in ranges[t]])
        wanted = reduce(operator.or_, [(F.col("tree") == t) & between(t) for t in sorted(ranges)], F.lit(False))
        parts = []
        for run in self.runs:
            part = self._stored(run.path)
            shift = width - run.bits
            heads = sorted({h for rs in ranges.values() for a, b in rs for h in range(low(a) >> shift, (high(b) >> shift) + 1)})
            if len(heads) < 2**run.bits:
                part = part.filter(F.col("head").isin(heads))
            parts.append(part.filter(wanted).drop("head"))
        return reduce(DataFrame.unionByName, parts)

    def _pairs(self, probes: DataFrame, history: DataFrame, length: int) -> DataFrame:
        """(key, other, first): verified pairs under prefixes of `length` min-hashes, once for each tree that finds them."""
        p = probes.select(F.col("tree").alias("t"), self._prefix(F.col("sig"), length).alias("x"), F.struct("key", "features").alias("a"))
        h = history.select(F.col("tree").alias("t"), self._prefix(F.col("sig"), length).alias("x"), F.struct("key", "features").alias("b"), "first")
        on = ["t", "x"]
        if not self.exact:
            # At most 1000 prefixes of a tree hold so many entries.
            limit = max(PREFIX_ROWS, self.rows // 1000)
            hot = h.groupBy("t", "x").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("t", "x", F.ceil(F.col("n") / PREFIX_ROWS).cast("int").alias("salts")).collect()
            if hot:
                salts = F.broadcast(self.spark.createDataFrame(hot, "t int, x bigint, salts int"))
                n = F.coalesce("salts", F.lit(1))
                p = p.join(salts, on, "left").withColumn("s", F.explode(F.sequence(F.lit(0), n - 1))).drop("salts")
                h = h.join(salts, on, "left").withColumn("s", F.pmod(F.xxhash64("b.key"), n).cast("int")).drop("salts")
                on = [*on, "s"]
        h = h.select(*[F.col(c).alias(f"h_{c}") for c in on], "b", "first")
        equal = reduce(operator.and_, [F.col(c) == F.col(f"h_{c}") for c in on])
        return p.join(h, equal & self.verify(F.col("a"), F.col("b"))).select(F.col("a.key").alias("key"), F.col("b.key").alias("other"), "first")

    def _by_features(self, probes: DataFrame, history: DataFrame) -> DataFrame:
        """(key, other, first): pairs by brute force, every entry with a common feature being compared."""
        one = lambda df: df.filter(F.col("tree") == 0)
        f = one(probes).select(F.struct("key", "features").alias("a"), F.explode(F.array_distinct("features")).alias("f"))
        h = one(history).select(F.struct("key", "features").alias("b"), "first", F.explode(F.array_distinct("features")).alias("f"))
        return h.join(f, "f").filter(self.verify(F.col("a"), F.col("b"))).select(F.col("a.key").alias("key"), F.col("b.key").alias("other"), "first")

    def longest(self) -> int:
        """The longest prefix at which a match just at verify's threshold is expected to be found with the target recall; at least 1.

        A min-hash agrees with probability of the similarity. A `verify` without a threshold counts as exact.
        """
        threshold = getattr(self.verify, "threshold", 1.0)
        expected = lambda length: 1 - (1 - threshold**length) ** self.trees
        return next((length for length in range(self.depth, 1, -1) if expected(length) >= self.recall), 1)

    def _length(self, signed: DataFrame) -> int:
        """The prefix length for a batch; 0 if none reaches the target."""
        if self.exact:
            return self.depth
        if self.reached and self.rows < 2 * self.measured_at:
            return self.reached[-1][0]
        self.measured_at = self.rows
        # A bounded sample (self.sample entries); it only measures, the search is over all entries.
        some = signed.filter(F.col("tree") == 0).orderBy(F.xxhash64(F.lit(-1), "key")).limit(self.sample).select("key", "features", "first")
        some = self.signatures(self.spark.createDataFrame(some.collect(), some.schema))
        history = self.history()
        # Only other entries count: each entry is under its own prefixes.
        keys = lambda pairs: {(r.key, r.other) for r in pairs.filter(F.col("key") != F.col("other")).select("key", "other").distinct().collect()}
        truth = keys(self._by_features(some, history))
        # A sample without matches, or with exact copies only, says nothing of those at the threshold: `longest` bounds the prefix.
        rate = 1.0
        for length in range(self.longest(), 0, -1):
            rate = len(keys(self._pairs(some, history, length)) & truth) / len(truth) if truth else 1.0
            if rate >= self.recall:
                self.reached.append((length, rate))
                return length
        self.reached.append((0, 1.0))
        return 0

    def pairs(self, signed: DataFrame) -> DataFrame:
        """(key, other, first): the matches in history of the signed entries, at times more than once each."""
        if not self.runs:
            return signed.select("key", F.col("key").alias("other"), "first").limit(0)
        length = self._length(signed)
        return self._pairs(signed, self.near(signed, length), length) if length else self._by_features(signed, self.history())

    def locate(self, signed: DataFrame) -> DataFrame:
        """(key, first) for the signed entries that match history; `first` is the least of the matches."""
        return self.pairs(signed).groupBy("key").agg(F.min("first").alias("first"))

    def insert(self, signed: DataFrame, expected: int | None = None) -> int:
        """Store signed entries as a run, merged with the runs before it while these aren't much larger. Returns entries stored.

        `expected`: about how many rows they are, if known; it only sets the number of folders.
        """
        self.schema = ", ".join([*(f"`{n}` {t}" for n, t in signed.dtypes), "head int"])
        merged: list[Run] = []
        run = signed
        n = -1
        while True:
            at = f"{self.path}/run-{uuid.uuid4().hex}"
            size = sum(r.rows for r in merged) or (run.count() if expected is None else expected)
            bits = min(CELL_BITS, (size // self.trees // self.head_rows).bit_length())
            head = F.shiftright("sig", 8 * self.depth - bits).cast("int") if bits else F.lit(0)
            run.withColumn("head", head).repartitionByRange("tree", "sig").sortWithinPartitions("tree", "head", "sig").write.partitionBy("tree", "head").parquet(at)
            stored = self._stored(at)
            rows = stored.count()
            n = rows // self.trees if n < 0 else n
            for old in merged:
                delete(self.spark, old.path)
            if rows == 0:
                delete(self.spark, at)
                return n
            if not self.runs or rows < self.merge_ratio * self.runs[-1].rows:
                self.runs.append(Run(at, rows, bits))
                return n
            merged = [Run(at, rows, bits), self.runs.pop()]
            run = stored.unionByName(self._stored(merged[1].path)).drop("head")

    def accept(self, entries: DataFrame) -> DataFrame:
        """Check a batch of entries (key, features, first), unique in key, and store those not found.

        Returns (key, first, known) for every entry with features: `first` is history's, where `known`, else the entry's own.
        """
        at = f"{self.path}/batch-{uuid.uuid4().hex}"
        signed = self.signatures(entries)
        signed.write.parquet(at)
        signed = self.spark.read.schema(signed.schema).parquet(at)
        found = self.locate(signed).withColumnRenamed("first", "before")
        checked = signed.filter(F.col("tree") == 0).select("key", "first").join(found, "key", "left")
        result = checked.select("key", F.coalesce("before", "first").alias("first"), F.col("before").isNotNull().alias("known"))
        out = f"{self.path}/checked-{uuid.uuid4().hex}"
        result.write.parquet(out)
        result = self.spark.read.schema(result.schema).parquet(out)
        self.insert(signed.join(result.filter("known").select("key"), "key", "left_anti").select(*signed.columns), signed.count())
        delete(self.spark, at)
        return result

    def drop(self) -> None:
        """Delete all the forest has stored, results of `accept` included."""
        delete(self.spark, self.path)
        self.runs.clear()


def boundaries(df: DataFrame, column: str, batches: int, sample: int = 1000) -> list[str]:
    """Values that cut df into about equal `batches` by `column`, from a sample of bounded size; they only balance the work."""
    some = sorted(r[0] for r in df.filter(F.col(column).isNotNull()).select(column).orderBy(F.xxhash64(column)).limit(sample).collect())
    return sorted({some[len(some) * i // batches] for i in range(1, batches)}) if some else []


def repeated_rows(rows: DataFrame, batches: int = 4, **forest: object) -> DataFrame:
    """(id) of every row for which a row with a smaller id has an identity in common.

    `rows` is (id, identities: array<string>). They arrive in the order of id and are checked batch by batch against a
    forest of what was accepted before. Rows without identities repeat nothing; rows that share an id count once.
    All signatures of an exact identity say the same, so one tree is enough; its prefix is seven bytes.
    """
    spark = rows.sparkSession
    f = HashForest(spark, **({"trees": 1, "depth": 7} | forest))
    kept = f"{f.path}/rows"
    rows.filter(F.size("identities") > 0).select("id", F.array_distinct("identities").alias("identities")).write.parquet(kept)
    rows = spark.read.parquet(kept)
    cuts = boundaries(rows, "id", batches)
    firsts: DataFrame | None = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = rows if low is None else rows.filter(F.col("id") >= low)
        batch = batch if high is None else batch.filter(F.col("id") < high)
        entries = batch.select("id", F.explode("identities").alias("key")).groupBy("key").agg(F.min("id").alias("first"))
        checked = f.accept(entries.select("key", F.array("key").alias("features"), "first")).filter(~F.col("known")).select("first")
        firsts = checked if firsts is None else firsts.unionByName(checked)
    # A row repeats nothing if it is the first of all its identities. Joining on the id keeps hot listings spread.
    count = firsts.groupBy(F.col("first").alias("id")).agg(F.count("*").alias("n"))
    ids = rows.groupBy("id").agg(F.max(F.size("identities")).alias("of"))
    return ids.join(count, "id", "left").filter(F.coalesce("n", F.lit(0)) < F.col("of")).select("id")


def similar_texts(rows: DataFrame, queries: Column, threshold: float = 0.8, words: int = 5, **forest: object) -> DataFrame:
    """(id, first, links) of the rows (id, text) that `queries` selects, against all rows.

    `links` counts the other different texts with a Jaccard similarity of word shingles of at least `threshold`, `first` is
    the least id that shows one of them or the row's own text. Rows without words are left out; rows that share an id and a text count once.
    Equal texts (equal sets of shingles) are one entry of the forest. The recall is the forest's.
    """
    spark = rows.sparkSession
    f = HashForest(spark, verify=jaccard_from(threshold), **({"trees": 6, "depth": 4, "recall": 0.98} | forest))

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{f.path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{f.path}/{name}")

    # Shingles are kept as 64-bit hashes.
    shown = rows.select("id", queries.alias("asked"), F.array_sort(F.transform(shingles(F.col("text"), words), lambda x: F.xxhash64(x))).alias("features")).filter(F.size("features") > 0)
    digest = F.concat_ws("-", F.hex(F.xxhash64(F.lit(0), "features")), F.hex(F.xxhash64(F.lit(1), "features")))
    shown = written(shown.withColumn("key", digest), "texts")
    entries = written(shown.groupBy("key").agg(F.min("id").alias("first"), F.first("features").alias("features"), F.bool_or("asked").alias("asked")), "entries")
    if entries.isEmpty():
        return entries.select(F.col("first").alias("id"), "first", F.lit(0).cast("long").alias("links"))
    f.insert(f.signatures(entries), entries.count() * f.trees)
    found = f.pairs(written(f.signatures(entries.filter("asked")), "probes"))
    per_key = found.groupBy("key", "other").agg(F.min("first").alias("first")).groupBy("key").agg(F.min("first").alias("first"), (F.count("*") - 1).alias("links"))
    return shown.filter("asked").select("id", "key").distinct().join(per_key, "key").select("id", "first", "links")
