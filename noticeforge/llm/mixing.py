"""Mixing sources to target weights, by blocks.

The words of each source stand in one stream, its documents in a pseudorandom
order that reruns repeat; the stream is packed into blocks of BLOCK_WORDS. How many
slots a source gets in each output shard is drawn from a multinomial, given the
source's slots in all, so that over all shards a source gives just its target. A
source's slots map to its blocks through pseudorandom permutations, one for each
pass over the source; slots and documents' spans then meet by block number.

Targets: weights cycle over the sources by code point, null last, and share all
words; a target above MOST_PASSES times its source's words stops there, and the
excess is shared by weight among the others, until none is above. No block is
taken more often than that, so no document is either. Sources are rows of a table,
numbered in parts by range, and each round of resharing is one aggregation: there is
no bound on their number, and the driver sees sums only.

Cases: null and empty texts have size 0 and are taken 0 times; a null source is a
source; repeated rows stand in the stream as often as they come; an empty table
gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeforge.llm import common

BLOCK_WORDS = 128
WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
#: Slots that a shard should have, and shards at most; beyond that, shards are larger.
SHARD_SLOTS, MAX_SHARDS = 4096, 65_536
#: Slots that one task makes, about.
TASK_SLOTS = 1 << 20
SEED = 20_240_229


def numbered(sources: DataFrame) -> DataFrame:
    """The table of sources (source, size) with ix: its place by code point, null last. Parts by range are numbered apart, then moved by what comes before."""
    spark = sources.sparkSession
    key = [F.col("source").isNull().alias("none"), F.col("source")]
    parts = common.cut(sources.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *key).withColumn("part", F.spark_partition_id()), "mix-parts")
    # One row for each part, at most as many as there are shuffle partitions.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*key))
    return parts.withColumn("within", within).join(moved, "part").select("source", "size", (F.col("before") + F.col("within") - 1).alias("ix"))


def with_targets(sources: DataFrame, weights=WEIGHTS, most: float = MOST_PASSES) -> DataFrame:
    """Numbered sources with target. Each round finds the share of a unit of weight among those that aren't at their most; it only grows."""
    cycle = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("ix") % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", cycle)
    total, share = float(rows.agg(F.sum("size")).first()[0] or 0), 0.0
    while True:
        # Those at their most for the share so far stay there, as it never falls.
        full = F.col("weight") * share > most * F.col("size")
        r = rows.agg(F.sum(F.when(full, F.col("size") * float(most)).otherwise(0.0)).alias("given"), F.sum(F.when(~full, F.col("weight"))).alias("weights")).first()
        if not r["weights"]:
            break
        new = (total - (r["given"] or 0.0)) / r["weights"]
        if new <= share:
            break
        share = new
    return rows.withColumn("target", F.least(F.col("weight") * share, F.col("size") * float(most))).drop("weight")


def draw(slots: int, shards: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """The shards that get slots of a source, and how many each: multinomial counts that add up to slots. A source of few slots draws the shard of each, so that work follows slots where they are fewer than shards."""
    random = np.random.Generator(np.random.Philox(key))
    if slots < shards:
        return np.unique(random.integers(0, shards, slots), return_counts=True)
    n = random.multinomial(slots, np.full(shards, 1 / shards))
    at = np.flatnonzero(n)
    return at, n[at]


def permuted(at: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n): a Feistel network, walked until it falls within the range."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.Generator(np.random.Philox(key)).integers(0, 1 << 63, 4, dtype=np.uint64)
    out = at.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            x = out[todo]
            left, right = x >> np.uint64(half), x & mask
            for k in keys:
                h = (right + k) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                left, right = right, left ^ ((h >> np.uint64(32)) & mask)
            out[todo] = left << np.uint64(half) | right
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


class Mix:
    """The tables of a mix: sources, documents' spans and slots."""

    def __init__(self, df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", block_words: int = BLOCK_WORDS) -> None:
        self.spark, self.block_words = df.sparkSession, block_words
        # Equal rows are alike to the mix; a hash of all columns orders the rest.
        self.columns = df.columns
        key = [F.xxhash64(*df.columns).alias("k1"), F.xxhash64(F.lit("again"), *df.columns).alias("k2")]
        rows = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), common.word_count(F.col(text_col)).alias("size"), *key)
        self.rows = common.cut(rows, "mix-rows")
        sums = common.cut(self.rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "mix-sums")
        self.n_rows = sums.agg(F.sum("n")).first()[0] or 0
        found = with_targets(common.cut(numbered(sums.select("source", "size")), "mix-numbered"))
        blocks = F.ceil(F.col("size") / block_words)
        slots = F.when(F.col("size") > 0, F.least(MOST_PASSES * F.col("blocks"), F.round(F.col("target") * F.col("blocks") / F.col("size")).cast("long"))).otherwise(F.lit(0).cast("long"))
        #: ix, source, size, target, blocks and slots of each source.
        self.sources = common.cut(found.withColumn("blocks", blocks).withColumn("slots", slots), "mix-sources")

    def spans(self) -> DataFrame:
        """Rows with ix (of the source), source_size, target and start: the place of their first word in the source's stream.

        A source's rows are dealt to buckets; there are as many buckets as a bucket of the largest source can have rows, so that neither becomes large.
        """
        known = self.sources.select("ix", F.col("source").alias("name"), F.col("size").alias("source_size"), "target")
        n = max(1, int(self.n_rows**0.5))
        rows = self.rows.join(known, F.col("name").eqNullSafe(F.col("source"))).drop("name", "source")
        rows = rows.withColumn("bucket", F.pmod("k1", F.lit(n)))
        sums = rows.groupBy("ix", "bucket").agg(F.sum("size").alias("sum"))
        before = Window.partitionBy("ix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("ix", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
        within = Window.partitionBy("ix", "bucket").orderBy("k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
        # Neither table's size has a bound, so neither may be broadcast.
        return rows.join(sums.hint("merge"), ["ix", "bucket"]).withColumn("start", F.col("before") + F.col("within")).drop("bucket", "before", "within")

    def drawn(self) -> DataFrame:
        """shard, at (the slot where the source's ones begin), ix, first (of the source's slots), n and blocks, where a source has slots in a shard."""
        total = self.sources.agg(F.sum("slots")).first()[0] or 0
        shards = min(MAX_SHARDS, max(1, -(-total // SHARD_SLOTS)))
        names = ["shard", "ix", "first", "n", "blocks"]

        def run(batches):
            for batch in batches:
                for ix, slots, blocks in zip(*(c.to_pylist() for c in batch.columns)):
                    at, n = draw(slots, shards, SEED + ix)
                    first = np.cumsum(n) - n
                    full = lambda x: np.full(len(at), x)
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (at, full(ix), first, n, full(blocks))], names=names)

        plan = common.map_arrow(self.sources.where("slots > 0").select("ix", "slots", "blocks"), run, ", ".join(f"{c} long" for c in names))
        before = Window.partitionBy("shard").orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
        return plan.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("tasks", F.lit(max(1, -(-total // TASK_SLOTS))))

    def slots(self) -> DataFrame:
        """shard, slot, ix and block of every output slot."""
        plan = common.cut(self.drawn(), "mix-drawn")
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), plan.agg(F.max("tasks")).first()[0] or 1)

        def run(batches):
            for batch in batches:
                for shard, at, ix, start, n, blocks in zip(*(c.to_pylist() for c in batch.columns)):
                    for a in range(0, n, 100_000):
                        q = start + a + np.arange(min(100_000, n - a), dtype=np.int64)
                        out = np.empty(len(q), dtype=np.int64)
                        for turn in np.unique(q // blocks):
                            own = q // blocks == turn
                            out[own] = permuted(q[own] % blocks, blocks, SEED + ix * 8 + int(turn))
                        full = lambda x: pa.array(np.full(len(q), x, dtype=np.int64))
                        yield pa.RecordBatch.from_arrays([full(shard), pa.array(at + a + np.arange(len(q))), full(ix), pa.array(out)], names=["shard", "slot", "ix", "block"])

        dealt = plan.select("shard", "at", "ix", "first", "n", "blocks").repartition(tasks, "shard", "ix")
        return common.map_arrow(dealt, run, "shard long, slot long, ix long, block long")

    def taken(self, detail: bool = False) -> DataFrame:
        """doc_id, size, source_size, target, taken (and, for detail, k1, k2 and parts: from, to and times of runs of words)."""
        b = self.block_words
        rows = self.spans()
        times = self.slots().groupBy("ix", "block").agg(F.count("*").alias("times"))
        some = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}"))))
        some = some.withColumn("from", F.greatest(F.col("block") * b, F.col("start")) - F.col("start"))
        some = some.withColumn("to", F.least(F.col("block") * b + b, F.col("start") + F.col("size")) - F.col("start"))
        met = some.join(times.hint("merge"), ["ix", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
        keys = ["ix", "start", "doc_id", "size", "source_size", "target", "k1", "k2"]
        sums = [F.sum((F.col("to") - F.col("from")) * F.col("times")).alias("taken")]
        if detail:
            sums.append(F.array_sort(F.collect_list(F.struct("from", "to", "times"))).alias("parts"))
        out = ["doc_id", "size", "source_size", "target", "taken"] + (["k1", "k2", "parts"] if detail else [])
        none = rows.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
        if detail:
            none = none.withColumn("parts", F.lit(None).cast("array<struct<from:bigint,to:bigint,times:bigint>>"))
        return met.groupBy(*keys).agg(*sums).select(*out).unionByName(none.select(*out))


def mix(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The mix as rows of df: for each pass over a document, a row with the words that pass takes.

    A pass that takes every word keeps the text as it is; otherwise its runs of words, as they stand in the text, on
    lines of their own. Where chars_col exists it gets the new text's length.
    """
    own = Mix(df, text_col, id_col, source_col)
    plans = common.cut(own.taken(detail=True).where("taken > 0").groupBy("k1", "k2").agg(F.collect_list("parts").alias("_plans")), "mix-plans")
    keyed = df.select("*", F.xxhash64(*df.columns).alias("_k1"), F.xxhash64(F.lit("again"), *df.columns).alias("_k2"))
    if own.rows.groupBy("k1", "k2").count().where("count > 1").limit(1).count():
        keyed = keyed.dropDuplicates(["_k1", "_k2"])  # equal rows; their plans stand in one list
    both = keyed.join(plans, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2"))).select(*df.columns, "_plans")
    at, names = df.columns.index(text_col), df.columns
    word = re.compile(common.WORD_PATTERN)

    def run(batches):
        for part in common.rows(batches, at):
            which, texts = [], []
            for i, (text, plans) in enumerate(zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist())):
                where = [m.span() for m in word.finditer(text)]
                for parts in plans:
                    for turn in range(max(p["times"] for p in parts)):
                        runs = []
                        for p in parts:
                            if p["times"] > turn:
                                if runs and runs[-1][1] == p["from"]:
                                    runs[-1][1] = p["to"]
                                else:
                                    runs.append([p["from"], p["to"]])
                        whole = runs == [[0, len(where)]]
                        which.append(i)
                        texts.append(text if whole else "\n".join(text[where[a][0] : where[b - 1][1]] for a, b in runs))
            columns = list(part.select(names).take(pa.array(which, pa.int64())).columns)
            columns[at] = pa.array(texts, pa.string())
            if chars_col in names:
                j = names.index(chars_col)
                columns[j] = pa.array([len(t) for t in texts], columns[j].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return common.map_arrow(both, run, df.schema)
