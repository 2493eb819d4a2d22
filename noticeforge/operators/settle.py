"""Identity within a run: which entity each notice of a batch belongs to, notices and entities taken in order.

A notice sees what those before it in the run made: the first stage that finds an
entity decides (item, primary reference, citation, canonical key, similar title), and
two notices of one source with other ids, or with other numbers of posts, are kept
apart where only key or title would join them. What a notice merges into its entity
(posts, access, group, year, organisation) is what the next ones are compared with.

Notices can only meet if an item, a reference, a key or the organisation leads from
one to the other. These labels make blocks, as connected components of the few labels
that share a value; blocks are independent, so they are settled in parallel, each in
the order of its notices. A block streams through its task, which holds the entities
of the block in short form, not the notices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeforge.functions import identity, rules
from noticeforge.operators import resolve
from noticeforge.operators.components import components

#: What a notice needs: seq orders the run; keep_new and keep_tracked tell whether it is kept if it makes an entity, or finds one.
NOTICE = "seq long, source string, external_id string, references array<string>, cited array<string>, canonical_key string, organisation string, signature string, `group` string, access string, positions int, published string, titled string, keep_new boolean, keep_tracked boolean"
#: What is known of an entity; published and titled are the years of its publication and title.
SHARED = ("canonical_key", "organisation", "signature", "group", "access", "positions", "published", "titled")
SETTLED = "seq long, entity string, stage string, made long"
_NAMES = [x.split()[0].strip("`") for x in NOTICE.split(", ")]


def known(notices: DataFrame, processes: DataFrame, items: DataFrame, references: DataFrame, aliases: DataFrame, newest: int = resolve.NEWEST) -> DataFrame:
    """Entities of the state that notices may meet: by item, reference, key, or as one of the newest of an organisation.

    processes has id, first_seen, last_seen and SHARED. Beside these, each has the
    items of the notices that lead to it, the references that notices ask for, by
    source the least and the greatest external id, and the entity that it is an alias of.
    """
    asked = notices.select(F.explode(F.array_union("references", "cited")).alias("reference")).distinct()
    hits = resolve.follow_alias(notices.select("source", "external_id").distinct().join(items.select("source", "external_id", "process_id"), ["source", "external_id"]), aliases, "process_id")
    hits = hits.select(F.col("process_id").alias("id"), F.struct("source", "external_id").alias("hit"))
    refs = references.join(asked, "reference", "left_semi").select(F.col("process_id").alias("id"), "reference")
    keyed = processes.join(notices.select("canonical_key").distinct(), "canonical_key", "left_semi").select("id")
    rank = F.row_number().over(Window.partitionBy("organisation").orderBy(F.desc("last_seen"), "id"))
    near = processes.where("organisation <> ''").join(notices.select("organisation").distinct(), "organisation", "left_semi").withColumn("rank", rank).where(F.col("rank") <= newest).select("id")
    ids = hits.select("id").unionByName(refs.select("id")).unionByName(keyed).unionByName(near).distinct()
    leads = aliases.select(F.col("alias_id").alias("id"), F.col("process_id").alias("canonical"))
    ids = ids.unionByName(leads.join(ids, "id", "left_semi").select(F.col("canonical").alias("id"))).distinct()
    spans = items.select(F.col("process_id").alias("id"), "source", "external_id").join(ids, "id", "left_semi").groupBy("id", "source").agg(F.min("external_id").alias("low"), F.max("external_id").alias("high"))
    spans = spans.groupBy("id").agg(F.collect_list(F.struct("source", "low", "high")).alias("spans"))
    return (
        processes.join(ids, "id", "left_semi")
        .join(leads, "id", "left")
        .join(spans, "id", "left")
        .join(hits.groupBy("id").agg(F.collect_set("hit").alias("hits")), "id", "left")
        .join(refs.groupBy("id").agg(F.collect_set("reference").alias("references")), "id", "left")
    )


def _label() -> F.Column:
    """What a notice or an entity is found by, as a hash: if two share one by chance, their blocks are settled as one, with the same result."""
    return F.xxhash64(F.when(F.col("organisation") == "", F.concat(F.lit("key:"), "canonical_key")).otherwise(F.concat(F.lit("org:"), "organisation")))


def blocks(notices: DataFrame, entities: DataFrame, cut: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """notices and entities with block. Only labels that share a value with another label go through the components."""
    none = F.array().cast("array<string>")
    # A citation counts only within an organisation, which is a label of its own, unless there is none.
    refs = F.when(F.col("organisation") == "", F.array_union("references", "cited")).otherwise(F.col("references"))
    item = lambda x: F.concat(F.lit("i:"), x["source"], F.lit("\0"), x["external_id"])
    named = lambda p, c: F.transform(F.coalesce(c, none), lambda x: F.concat(F.lit(p), x))
    key = F.array(F.concat(F.lit("k:"), "canonical_key"))
    mine = notices.select(_label().alias("label"), F.explode(F.concat(F.array(item({c: F.col(c) for c in ("source", "external_id")})), named("r:", refs), key)).alias("value"))
    theirs = entities.select(_label().alias("label"), F.explode(F.concat(F.transform(F.coalesce("hits", F.array().cast("array<struct<source:string,external_id:string>>")), item), named("r:", F.col("references")), key, F.array(F.concat(F.lit("a:"), F.coalesce("canonical", "id"))))).alias("value"))
    met = mine.unionByName(theirs).select("label", F.xxhash64("value").alias("value"))
    lead = cut(met.groupBy("value").agg(F.min("label").alias("a"), F.max("label").alias("z")).where("a <> z").select("value", "a"), "lead")
    found = components(met.join(lead, "value").select("a", F.col("label").alias("b")).distinct(), cut)

    def with_block(df):
        return df.withColumn("label", _label()).join(found, "label", "left").withColumn("block", F.coalesce("component", "label")).drop("label", "component")

    return with_block(notices), with_block(entities)


@lru_cache(maxsize=1 << 16)
def _score(a: str, b: str) -> float:
    return identity.token_set_similarity(a, b) / 100


def _fits(n: dict, e: dict) -> bool:
    """The guards of a similar title, on values that are known on both sides; posts aside."""
    year, own = n["published"] or n["titled"], e["published"] or e["titled"]
    open_access = rules.UNKNOWN_ACCESS in (n["access"], e["access"]) or n["access"] == e["access"]
    return (not year or not own or year == own) and (not n["group"] or not e["group"] or n["group"] == e["group"]) and open_access and n["organisation"] == e["organisation"]


def _other_posts(n: dict, e: dict) -> bool:
    return n["positions"] is not None and e["positions"] is not None and n["positions"] != e["positions"]


class Block:
    """Entities of one block while its notices go by."""

    def __init__(self, tag: str) -> None:
        self.tag, self.entities, self.by_item, self.by_reference, self.by_key = tag, {}, {}, {}, {}
        #: Of an organisation, its entities in the order in which they were last seen.
        self.seen: dict[str, dict] = {}

    def know(self, e: dict) -> None:
        """An entity of the state; they come in the order of last_seen."""
        own = {c: e[c] for c in SHARED} | {"canonical": e["canonical"] or e["id"], "born": (0, e["first_seen"], e["id"]), "spans": {s["source"]: (s["low"], s["high"]) for s in e["spans"] or ()}}
        self.entities[e["id"]] = own
        self.by_item |= {(x["source"], x["external_id"]): e["id"] for x in e["hits"] or ()}
        self.by_reference |= dict.fromkeys(e["references"] or (), e["id"])
        first = self.by_key.get(e["canonical_key"])
        if first is None or own["born"] < self.entities[first]["born"]:
            self.by_key[e["canonical_key"]] = e["id"]
        self.seen.setdefault(e["organisation"], {})[e["id"]] = None

    def _apart(self, n: dict, e: dict) -> bool:
        """Another id of the same source, or other posts: only an item or a reference may join them."""
        low, high = e["spans"].get(n["source"], (n["external_id"],) * 2)
        return low != n["external_id"] or high != n["external_id"] or _other_posts(n, e)

    def find(self, n: dict) -> tuple[str | None, str | None]:
        hit = self.by_item.get((n["source"], n["external_id"]))
        if hit:
            return hit, "item"
        hits = [self.by_reference[r] for r in n["references"] if r in self.by_reference]
        if hits:
            return min(hits, key=lambda i: self.entities[i]["born"]), "reference"
        for r in n["cited"]:
            hit = self.by_reference.get(r)
            if hit and _fits(n, self.entities[hit]) and _score(n["signature"], self.entities[hit]["signature"]) >= resolve.LEAST_SCORE:
                return hit, "citation"
        hit = self.by_key.get(n["canonical_key"])
        if hit and not self._apart(n, self.entities[hit]):
            return hit, "key"
        if not n["organisation"]:
            return None, None
        best = (0.0, None)
        for i in islice(reversed(self.seen.get(n["organisation"], {})), resolve.NEWEST):
            e = self.entities[i]
            if _fits(n, e) and not self._apart(n, e):
                score = _score(n["signature"], e["signature"])
                if score >= resolve.LEAST_SCORE and score > best[0]:
                    best = (score, i)
        return (best[1], "title") if best[1] else (None, None)

    def take(self, n: dict) -> tuple[int, str | None, str | None, int | None]:
        """seq, entity and stage of a notice, and the seq of the one that made the entity, if that was in this run; no entity if it isn't kept."""
        n["references"], n["cited"] = n["references"] or [], n["cited"] or []
        i, stage = self.find(n)
        if not (n["keep_tracked"] if i else n["keep_new"]):
            return n["seq"], None, stage, None
        if i is None:
            i, stage = hashlib.sha256(f"{self.tag}:{n['seq']}".encode()).hexdigest()[:32], "new"
            self.entities[i] = {c: n[c] for c in SHARED} | {"canonical": i, "born": (1, n["seq"], i), "spans": {}}
            self.by_key.setdefault(n["canonical_key"], i)
        e = self.entities[i]
        self.seen.get(e["organisation"], {}).pop(i, None)
        for c in ("group", "published"):
            e[c] = n[c] or e[c]
        e["organisation"] = e["organisation"] or n["organisation"]
        e["positions"] = e["positions"] if n["positions"] is None else n["positions"]
        e["access"] = e["access"] if n["access"] == rules.UNKNOWN_ACCESS else n["access"]
        self.seen.setdefault(e["organisation"], {})[i] = None
        if (n["source"], n["external_id"]) not in self.by_item:
            self.by_item[n["source"], n["external_id"]] = e["canonical"]
            low, high = e["spans"].get(n["source"], (n["external_id"],) * 2)
            e["spans"][n["source"]] = (min(low, n["external_id"]), max(high, n["external_id"]))
        for r in n["references"]:
            self.by_reference.setdefault(r, i)
        return n["seq"], i, stage, e["born"][1] if e["born"][0] else None


def _listed(column: pa.Array) -> list:
    """A column's values, a null list as an empty one. Each distinct text is made once, and numbers all at once, as values one by one cost more than settling them."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        column = column.dictionary_encode()
        values = [*column.dictionary.to_pylist(), None]
        return [values[i] for i in column.indices.fill_null(len(values) - 1).to_numpy().tolist()]
    if pa.types.is_list(kind):
        column = column.fill_null([]) if column.null_count else column
        values, ends = _listed(column.values), column.offsets.to_numpy().tolist()
        return [values[i:j] for i, j in zip(ends[:-1], ends[1:])]
    if not pa.types.is_integer(kind) and not pa.types.is_boolean(kind):
        return column.to_pylist()
    values = column.fill_null(False if pa.types.is_boolean(kind) else 0).to_numpy(zero_copy_only=False).tolist()
    return [x if there else None for x, there in zip(values, column.is_valid().to_numpy(zero_copy_only=False).tolist())] if column.null_count else values


def settle(notices: DataFrame, entities: DataFrame, cut: Callable[[DataFrame, str], DataFrame], tag: str) -> DataFrame:
    """seq, entity (null: not kept) and stage of every notice, and made, the seq of the notice that made the entity (null: the state has it); entities are those of known(). tag makes new ids the run's own.

    Cases: texts that are null count as blank; seq must be unique. Rows with equal
    values each count. Entities that the run has touched are newer than all others,
    the last one touched first. An empty batch gives an empty result.
    """
    blank = lambda df: df.withColumns({c: F.coalesce(c, F.lit("")) for c in ("source", "external_id", "canonical_key", "organisation", "signature", "group", "published", "titled") if c in df.columns})
    mine, theirs = blocks(blank(notices), blank(entities), cut)
    # What is known of an entity is one value, which notices don't have.
    theirs = theirs.select("block", F.struct(*(c for c in theirs.columns if c != "block")).alias("known"))
    both = mine.select("block", *_NAMES).unionByName(theirs, allowMissingColumns=True)
    order = ["block", F.col("known").isNull(), "known.last_seen", F.desc("known.id"), "seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            out, told = [], batch.column("known")
            entities = iter(told.filter(told.is_valid()).to_pylist())
            for block, known, *row in zip(_listed(batch.column("block")), _listed(told.is_valid()), *(_listed(batch.column(c)) for c in _NAMES)):
                if block != now:
                    now, own = block, Block(tag)
                if known:
                    own.know(next(entities))
                else:
                    out.append(own.take(dict(zip(_NAMES, row))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["seq", "entity", "stage", "made"])

    return both.repartition("block").sortWithinPartitions(*order).mapInArrow(run, SETTLED)
