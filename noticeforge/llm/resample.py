"""Importance resampling towards a target distribution: word tries of hashed n-gram features.

A task reads its texts in slices of bounded bytes and grows a trie over each slice's
words: a path of one, two or three words is a feature. A node knows how often its
path occurs and the CRC state after its words, so that the state of a longer feature
is its parent's state led on by a space and one word, once for each different path.
Nodes' counts go to BUCKETS totals (state modulo BUCKETS), which a task emits once;
they are merged by an aggregation. Scoring grows the same tries, attaches to each
node the gain of its bucket, and sums gains along the walks of each text.

A draw without replacement adds Gumbel noise, fixed by the seed and the id, to the
weight and takes the highest; ranks come from a range-partitioned sort and the
partitions' row counts, so no task and no driver holds all rows.

Cases: null and empty texts have no words, weight 0 and are never drawn; a text
without target words has a negative weight; very long texts are one slice of their
own. Rows with the same id have the same noise and each counts; ties go to the
smaller id, then to the lower feature count; a null id is hashed as empty text and
comes first among ties. An empty corpus or target gives totals of 0, and gains
follow from the smoothing alone. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeforge.llm import common

BUCKETS, DEPTH, SMOOTHING = 10_000, 3, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Bytes of a CRC that tables carry on for many words at once; the rest of longer words goes word by word.
TOGETHER = 48

#: Bytes of words: digits, a to z, and all of characters from U+0080. Fixed by the query's contract.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
CRC = np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)], dtype=np.uint32)


class Words:
    """The words of texts: number in a vocabulary, and the text that each is of."""

    def __init__(self, texts: pa.Array) -> None:
        whole = texts.cast(pa.large_binary()).fill_null(b"")
        at = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
        raw = whole.buffers()[2]
        data = LOWER[np.frombuffer(raw, dtype=np.uint8)[at[0] : at[-1]]] if raw else np.zeros(0, np.uint8)
        at = at - at[0]
        inside = IN_WORD[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[at] = True
        starts = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
        ends = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1
        self.doc = np.searchsorted(at, starts, "right") - 1
        ends = np.append(0, np.cumsum(ends - starts))
        own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
        coded = own.dictionary_encode()
        self.code = coded.indices.to_numpy().astype(np.int64)
        self.known = coded.dictionary
        self.at = np.frombuffer(self.known.buffers()[1], dtype=np.int64)[: len(self.known) + 1] if len(self.known) else np.zeros(1, np.int64)
        self.bytes = np.frombuffer(self.known.buffers()[2], dtype=np.uint8) if len(self.known) else np.zeros(0, np.uint8)

    def carry(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """CRC states (before the final inversion) led on by one word each."""
        start, length = self.at[code], self.at[code + 1] - self.at[code]
        order = np.argsort(-length, kind="stable")
        state, start, length = state[order], start[order], length[order]
        for i in range(min(int(length[0]), TOGETHER) if len(length) else 0):
            n = int(np.searchsorted(-length, -i, "left"))
            state[:n] = CRC[(state[:n] ^ self.bytes[start[:n] + i]) & 255] ^ (state[:n] >> 8)
        for i in range(int(np.searchsorted(-length, -TOGETHER, "left"))):
            rest = self.bytes[start[i] + TOGETHER : start[i] + length[i]].tobytes()
            state[i] = zlib.crc32(rest, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        out = np.empty_like(state)
        out[order] = state
        return out


class Trie:
    """Nodes of one slice by depth: bucket and count of each, and the walks of the texts through them."""

    def __init__(self, texts: pa.Array) -> None:
        words = Words(texts)
        self.doc, self.buckets, self.counts, self.walks = words.doc, [], [], []
        vocabulary = max(1, len(words.known))
        places, path = np.arange(len(words.code)), words.code
        state = words.carry(np.full(len(words.known), 0xFFFFFFFF, np.uint32), np.arange(len(words.known)))
        for depth in range(1, DEPTH + 1):
            if depth > 1:  # a walk goes on where its text has a further word
                last = places + depth - 1
                more = last < len(self.doc)
                more[more] = self.doc[places[more]] == self.doc[last[more]]
                places = places[more]
                coded = pa.array(path[more] * vocabulary + words.code[places + depth - 1]).dictionary_encode()
                parent, word = np.divmod(coded.dictionary.to_numpy(), vocabulary)
                path = coded.indices.to_numpy().astype(np.int64)
                state = words.carry(CRC[(state[parent] ^ 32) & 255] ^ (state[parent] >> 8), word)
            self.walks.append((places, path))
            self.buckets.append((state ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % BUCKETS)
            self.counts.append(np.bincount(path, minlength=len(state)))

    def totals(self) -> np.ndarray:
        return sum(np.bincount(b, weights=n, minlength=BUCKETS) for b, n in zip(self.buckets, self.counts)).astype(np.int64)

    def weights(self, gains: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: words, features, sum of the gains that its walks meet."""
        words = np.bincount(self.doc, minlength=texts)
        weight, features = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
        for (places, path), bucket in zip(self.walks, self.buckets):
            doc = self.doc[places]
            features += np.bincount(doc, minlength=texts)
            weight += np.bincount(doc, weights=gains[bucket][path], minlength=texts).astype(np.int64)
        return words, features, weight


def bucket_totals(df: DataFrame, text_col: str = "text") -> DataFrame:
    """bucket and n of all features of the texts: at most BUCKETS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(BUCKETS, np.int64)
        for part in common.rows(batches):
            totals += Trie(part.column(0)).totals()
        met = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(totals[met])], names=["bucket", "n"])

    return common.map_arrow(df.select(text_col), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def fit(raw: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text") -> np.ndarray:
    """The gain of each bucket, by the totals of both collections; only the totals come to the driver."""
    s, t = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for totals, df, col in ((s, raw, text_col), (t, target, target_col)):
        for bucket, n in bucket_totals(df, col).collect():
            totals[bucket] = n
    low, high = float(s.sum() + SMOOTHING), float(t.sum() + SMOOTHING)
    return np.array([math.floor(1000 * math.log((b + 1) * low / ((a + 1) * high))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weigh(df: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """id, n_words, n_features, weight and score (weight and noise) of every text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.rows(batches, 1):
            found = Trie(part.column(1)).weights(gains, len(part))
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, found)], names=[id_col, "n_words", "n_features", "weight"])

    out = common.map_arrow(df.select(id_col, text_col), run, f"`{id_col}` {kind}, n_words long, n_features long, weight long")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return out.withColumn("score", F.col("weight") + noise)


def draw(weighed: DataFrame, id_col: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """weighed with rank: 1, 2, 3, ... for the drawn percent of texts that have enough words, by score; null for all others."""
    weighed = common.cut(weighed, "resample")
    order = [F.desc("score"), F.asc(id_col), F.asc("n_features"), F.asc("weight")]
    # Ranges are fixed when they are written, so that counts and rows see the same parts whatever is run again.
    fit_for = common.cut(weighed.where(F.col("n_words") >= least_words).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "resample-order")
    sizes = fit_for.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each part
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"), F.floor(F.sum("_n").over(Window.partitionBy()) * percent / 100).alias("_most"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    placed = fit_for.join(F.broadcast(parts), "_part").withColumn("rank", place.cast("long"))
    ranked = placed.withColumn("rank", F.when(F.col("rank") <= F.col("_most"), F.col("rank"))).select(*weighed.columns, "rank")
    rest = weighed.where(F.coalesce(F.col("n_words") < least_words, F.lit(True))).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)


def resample(raw: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The drawn rows of raw, all their columns: texts whose features are frequent in the target. Ids must be unique and not null."""
    drawn = draw(weigh(raw, fit(raw, target, text_col, text_col), id_col, text_col), id_col, percent)
    return raw.join(drawn.where("rank IS NOT NULL").select(id_col), id_col, "left_semi").select(raw.columns)


def sql() -> str:
    """The query in DuckDB: CRCs by a table-driven reduction over the bytes of each different feature."""
    def features(table: str, key: str) -> str:
        return f"""SELECT {key} AS id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM {table}"""

    def words(table: str, key: str) -> str:
        return rf"""SELECT {key}, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM {table}"""

    return f"""
WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
dw AS ({words("documents", "doc_id")}), bw AS ({words("benchmark", "item_id")}),
df AS ({features("dw", "doc_id")}), bf AS ({features("bw", "item_id")}),
dn AS (SELECT f, count(*) AS n FROM df GROUP BY f), bn AS (SELECT f, count(*) AS n FROM bf GROUP BY f),
every AS (SELECT f FROM dn UNION SELECT f FROM bn),
c AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)), lambda s, b: xor(s >> 8, t[1 + (xor(s, b) & 255)])), 4294967295) % 10000 AS b FROM every, tab),
s AS (SELECT b, sum(n) AS n FROM dn JOIN c USING (f) GROUP BY b), t AS (SELECT b, sum(n) AS n FROM bn JOIN c USING (f) GROUP BY b),
big AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
gains AS (SELECT r.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (big.s + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * (big.t + 10000))))::BIGINT AS gain FROM range(10000) r(b) LEFT JOIN s USING (b) LEFT JOIN t USING (b), big),
weights AS (SELECT id AS doc_id, sum(gain) AS weight, count(*) AS n FROM df JOIN c USING (f) JOIN gains USING (b) GROUP BY id),
scored AS (SELECT doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM dw LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, (count(*) OVER () * 5) // 100 AS most FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS "rank" FROM scored LEFT JOIN ranked USING (doc_id)
"""
