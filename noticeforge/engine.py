"""The engine: collect, deliver, follow, list and check, over a versioned state."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeforge.functions import classify, extract, identity, render, rules, text
from noticeforge.operators import collect, fold, merge, outbox, resolve, settle, upsert, views
from noticeforge.sources import official
from noticeforge.state import TABLES, State

#: Fields of an entity that its events' payloads hold: what messages show, and what dispatch judges again.
STORED = ("source", "title", "organisation", "locality", "province", "status", "positions", "publication_date", "deadline", "deadline_confirmed", "exam_date", "exam_time", "exam_place", "group", "access", "compatibility", "priority", "qualification", "summary", "special_process")
#: What a repair may change, and the reference of an official folder (a fixed value).
REPAIRED = ("organisation", "group", "positions", "access", "compatibility", "publication_date", "deadline", "deadline_confirmed", "status", "snapshot")
FOLDER_REFERENCE = "MARTOS-CATEGORY-"
RELATIVE = "struct<days:int,kind:string,starts_after:string>"

#: What an observation has when it comes in.
OBSERVATION = "seq long, source string, external_id string, title string, organisation string, summary string, full_text string, reference string, url string, locality string, province string, `group` string, publication_date date"


class Retry(Exception):
    """A send that certainly failed; after may say how many seconds to wait."""

    def __init__(self, after: float = 0) -> None:
        super().__init__("retry")
        self.after = after


class Engine:
    def __init__(self, spark: SparkSession, root: str, profile: classify.Profile | None = None, only_enrollable_new: bool = False, show_review: bool = True, explicit_follow_only: bool = False) -> None:
        self.spark, self.state, self.profile = spark, State(spark, root), profile or classify.Profile()
        self.only_enrollable_new, self.show_review, self.explicit_follow_only = only_enrollable_new, show_review, explicit_follow_only

    # --- collecting ---

    def enrich(self, observed: DataFrame) -> DataFrame:
        """Observations with extracted fields, decision, identity fields and snapshot."""
        everything = text.clean(F.concat_ws(" ", "title", "summary", "full_text"))
        df = observed.withColumn("_all", everything)
        described = text.clean(F.concat_ws(" ", "summary", "full_text"))
        df = df.withColumns({"qualification_text": extract.qualification(described), "group": F.coalesce(F.nullif("group", F.lit("")), extract.group(F.col("_all"))), "positions": extract.positions(F.col("_all")), "_deadline": extract.deadline(F.col("_all"))})
        df = df.withColumns({"relative": F.when(F.col("_deadline.date").isNull(), extract.relative_deadline(F.col("_all"))), "exam_date": extract.exam_date(F.col("_all")), "exam_time": extract.exam_time(F.col("_all")), "exam_place": extract.exam_place(F.col("_all")), "cited": extract.references(F.col("_all"))})
        df = df.withColumns({"deadline": F.col("_deadline.date"), "deadline_confirmed": F.col("_deadline.confirmed"), "provisional": F.when(F.col("exam_date").isNotNull(), extract.exam_is_provisional(F.col("_all"))), "access": F.lit(None).cast("string"), "special_process": F.lit(""), "milestone_text": F.lit(""), "link_labels": F.lit("")})
        df = classify.evaluate(df.drop("_all", "_deadline"), self.profile)
        columns = {k: F.col(k) for k in ("access", "compatibility", "deadline", "deadline_confirmed", "exam_date", "exam_place", "exam_time", "group", "locality", "positions", "priority", "province", "status")} | {"qualification": F.col("qualification_text")}
        reference = text.normalize_reference(F.col("reference"))
        year = F.coalesce(F.nullif(text.extract_year(F.col("publication_date").cast("string")), F.lit("")), text.extract_year(F.col("title")))
        return df.withColumns(
            {
                "snapshot": identity.snapshot(columns, F.col("provisional")),
                "canonical_key": identity.canonical_key(F.col("organisation"), F.col("title"), F.col("publication_date"), F.col("access"), F.col("group")),
                "references": F.when(reference == "", F.array().cast("array<string>")).otherwise(F.array(reference)),
                "signature": text.title_signature(F.col("title")),
                "year": year,
                "raw_organisation": F.col("organisation"),
            }
        )

    def plan(self, today: date, sources: list[str], lookback: int = 10, overlap: int = 2, most: int = 45) -> DataFrame:
        """source, days and gap: the window to ask each source for, back to its checkpoint and overlap days, and the days beyond the longest window. A source without a checkpoint starts from its last run that ended well."""
        asked = self.spark.createDataFrame([(s,) for s in sources], "source string")
        runs = self.state.read("source_runs").where("status = 'OK'").groupBy("source").agg(F.to_date(F.max("finished_at")).alias("ran"))
        known = asked.join(self.state.read("source_checkpoints"), "source", "left").join(runs, "source", "left")
        return known.select("source", views.lookback(F.coalesce("covered_through", "ran"), F.lit(today), overlap, lookback, most).alias("x")).select("source", "x.*")

    def run(self, observed: DataFrame, today: date, now: datetime, dry_run: bool = False, reports: dict[str, dict] | None = None) -> dict:
        """One collection: every observation is judged and resolved; what is kept is merged in order and published with its events.

        reports has, by source, what its reader says: covered_through and failed (dates or None), warning and error
        (texts). A source that has no observations but a report ran as well; one without a report ran without a
        warning. Observations take effect in the order of seq, which must be unique: each one meets the entities that
        those before it in the run made or changed. Work follows the observations and the entities that they touch,
        not the length of any entity's history.
        """
        base = self.state.version()
        read = lambda t: self.state.read(t, base)
        cut, stamp, day = self.state.cut, F.lit(now).cast("timestamp"), F.lit(today)
        processes, items, references = read("processes"), read("source_items"), read("official_references")
        first_run = processes.isEmpty()
        judged = self.enrich(observed).withColumn("organisation", text.normalize(F.col("organisation")))
        rel = F.col("relative")
        applicable = classify.can_apply(F.col("status"), F.col("access"), F.col("deadline_confirmed"), F.col("deadline"), F.col("publication_date"), day)
        may = classify.window_open(F.col("source"), F.col("status"), F.col("access"), F.col("deadline_confirmed"), F.col("publication_date"), rel["days"], rel["kind"], rel["starts_after"], day)
        first = classify.notify_at_first(F.col("deadline"), F.col("deadline_confirmed"), F.col("exam_date"), F.col("publication_date"), F.col("special_process"), day, 30)
        judged = judged.withColumns({"enrollable": applicable, "may_be_open": may, "first_notify": first})
        decide = lambda df, tracked: collect.decide(df.withColumn("tracked", tracked), self.only_enrollable_new, self.show_review, first_run)
        for name, tracked in (("keep_new", False), ("keep_tracked", True)):
            judged = decide(judged, F.lit(tracked)).withColumn(name, F.col("kept")).select(*judged.columns, name)
        judged = cut(judged, "judged")
        settled = cut(self._settled(judged, processes, items, references, read("process_aliases"), base), "settled")
        found = judged.join(settled, "seq")
        decided = cut(decide(found, F.col("stage").isNotNull() & (F.col("stage") != "new")), "decided")
        report = {r["source"]: r.asDict() | {"created": 0, "updated": 0} for r in collect.counters(decided, "source").collect()}
        kept = decided.where("entity IS NOT NULL")
        box = read("notification_outbox")
        acted = cut(self._folded(kept, processes, items, box, now), "acted")
        for r in acted.groupBy("reported").agg(F.count_if("is_new").alias("created"), F.count_if(~F.col("is_new") & (F.col("is_changed") | F.col("action").isin("EXTEND", "INSERT_UPDATE"))).alias("updated")).collect():
            report[r["reported"]] |= {"created": r["created"], "updated": r["updated"]}
        for r in report.values():
            r["unchanged"] = r["included"] - r["created"] - r["updated"]
        ended = self._ended(report, reports or {}, today)
        summary = {"version": base, "sources": report, "status": self._status(ended), "warnings": {e[0]: e[5] for e in ended if e[1] == "PARTIAL"}, "errors": {e[0]: e[5] for e in ended if e[1] == "ERROR"}}
        if not dry_run:
            seen = kept.select("source", "external_id", F.col("entity").alias("process_id"), stamp.alias("first_seen"), stamp.alias("last_seen")).dropDuplicates(["source", "external_id"])
            refs = kept.select("seq", F.explode("references").alias("reference"), F.col("entity").alias("process_id"), stamp.alias("first_seen"))
            urls = kept.where("url <> ''").select("seq", F.col("entity").alias("process_id"), "source", "url", F.lit("").alias("label"), stamp.alias("first_seen"))
            runs = self.spark.createDataFrame([(base + 1, s, status, count, now, now, covered, message) for s, status, count, covered, _, message in ended], TABLES["source_runs"])
            summary["version"] = self.state.commit(
                {
                    "processes": self._entities(acted, processes, now),
                    "notification_outbox": self._events(acted, box, base + 1, now),
                    "source_items": upsert.upsert(items, seen, ["source", "external_id"], ["process_id", "first_seen"]),
                    "official_references": upsert.insert_ignore(references, refs, ["reference"], ["seq"]),
                    "process_urls": upsert.insert_ignore(read("process_urls"), urls, ["process_id", "source", "url"], ["seq"]),
                    "source_runs": read("source_runs").unionByName(runs),
                    "source_checkpoints": upsert.checkpoint_max(read("source_checkpoints"), runs),
                },
                base,
            )
        self.state.forget()
        return summary

    def _settled(self, judged: DataFrame, processes: DataFrame, items: DataFrame, references: DataFrame, aliases: DataFrame, base: int) -> DataFrame:
        """seq, entity and stage of every observation."""
        published = text.extract_year(F.col("publication_date").cast("string"))
        titled = text.extract_year(F.col("title"))
        group = F.when(F.col("group") == "", "").otherwise(F.concat(F.lit("="), text.normalize(F.col("group")))).alias("group")
        notices = judged.select("seq", "source", "external_id", "references", "cited", "canonical_key", "organisation", "signature", group, "access", "positions", published.alias("published"), titled.alias("titled"), "keep_new", "keep_tracked")
        old = processes.select("id", "canonical_key", F.col("normalised_organisation").alias("organisation"), F.col("title_signature").alias("signature"), group, "access", "positions", published.alias("published"), titled.alias("titled"), "first_seen", "last_seen")
        entities = self.state.cut(settle.known(notices, old, items, references, aliases), "known")
        return settle.settle(notices, entities, self.state.cut, str(base + 1)).drop("made")

    def _folded(self, kept: DataFrame, processes: DataFrame, items: DataFrame, box: DataFrame, now: datetime) -> DataFrame:
        """A row for each kept observation: its entity as merged up to it, what that changed, and the action on the entity's events."""
        known = items.select("source", "external_id", F.lit(True).alias("_known"))
        first = F.row_number().over(Window.partitionBy("source", "external_id").orderBy("seq")) == 1
        new = kept.join(known, ["source", "external_id"], "left").withColumn("new_item", F.col("_known").isNull() & first)
        new = new.select(
            "entity", "seq", "canonical_key", F.col("signature").alias("title_signature"), "source", "title", F.col("raw_organisation").alias("organisation"), "locality", "province", F.lit("").alias("scope"), "group",
            F.col("qualification_text").alias("qualification"), "summary", "exam_place", "positions", "publication_date", "deadline", "deadline_confirmed", "exam_date", "provisional", "exam_time", "access", "compatibility", "status", "priority", "special_process",
            F.lit(False).alias("structured"), F.lit(None).cast("string").alias("stored"), F.col("source").alias("reported"), "included", "notify", "force_review", "new_item", "url", "relative",
            F.coalesce(F.nullif("reference", F.lit("")), F.col("external_id")).alias("said_by"), F.lit(now.isoformat()).alias("observed_at"), classify.material_notice(F.col("title"), F.col("summary")).alias("notice"), F.col("compatibility").alias("own_compatibility"),
        )
        touched = new.select("entity").distinct()
        old = processes.withColumn("entity", F.col("id")).join(touched, "entity", "left_semi")
        old = old.withColumns({"seq": F.lit(fold.BEFORE).cast("long"), "stored": F.col("snapshot"), "provisional": F.get_json_object("snapshot", "$.exam_date_provisional").cast("boolean"), "scope": F.lit(""), "structured": F.lit(False)})
        rows = new.unionByName(old.select("entity", "seq", *fold.FIXED, *fold.RUNNING, "structured", "stored"), allowMissingColumns=True)
        changed = fold.changes(fold.running(rows))
        pending = box.where("status = 'PENDING'").withColumn("entity", F.col("process_id")).join(touched, "entity", "left_semi")
        one = lambda *kinds: F.min_by(F.when(F.col("kind").isin(*kinds), F.col("event_id")), F.when(F.col("kind").isin(*kinds), F.struct("created_at", "event_id")))
        had = pending.groupBy("entity").agg(one("NEW", "REVIEW").alias("initial_id"), one("UPDATE").alias("update_id"))
        sent = box.where("status = 'SENT'").select(F.col("process_id").alias("entity"), F.lit(True).alias("ever_sent")).distinct()
        with_events = changed.join(had, "entity", "left").join(sent, "entity", "left")
        return fold.actions(with_events.withColumns({"had_initial": F.col("initial_id").isNotNull(), "had_update": F.col("update_id").isNotNull()}))

    @staticmethod
    def _entities(acted: DataFrame, processes: DataFrame, now: datetime) -> DataFrame:
        """All entities after the run; only touched ones are computed."""
        stamp = F.lit(now).cast("timestamp")
        own = [c for c in (*fold.FIXED, *fold.RUNNING, "snapshot") if c in processes.columns]
        last = acted.groupBy(F.col("entity").alias("id")).agg(F.max_by(F.struct(*own), "seq").alias("x"), F.bool_or(F.col("is_changed") | F.col("action").isin("EXTEND", "INSERT_UPDATE")).alias("_moved"))
        was = processes.select("id", F.col("first_seen").alias("_first"), F.col("last_changed").alias("_changed"))
        now_is = last.join(was, "id", "left").select("id", "x.*", "_moved", "_first", "_changed")
        now_is = now_is.withColumns({"normalised_organisation": text.normalize(F.col("organisation")), "semantic_hash": text.stable_hash(F.col("snapshot")), "first_seen": F.coalesce("_first", stamp), "last_seen": stamp, "last_changed": F.when(F.col("_moved"), stamp).otherwise(F.coalesce("_changed", stamp))})
        return processes.join(last.select("id"), "id", "left_anti").unionByName(now_is.select(*processes.columns))

    def _events(self, acted: DataFrame, box: DataFrame, version: int, now: datetime) -> DataFrame:
        """The outbox after the run: pending events rewritten, extended or suppressed, new ones inserted once."""
        keys = ["entity", "target"]
        moved = acted.where("action <> 'TOUCH'")
        ids = moved.select(*keys, F.when(F.col("target") == "INITIAL", F.col("initial_id")).otherwise(F.col("update_id")).alias("event_id")).distinct()
        before = ids.join(box.select("event_id", F.from_json("payload", f"changes array<string>, change_details {merge.DETAILS}").alias("p")), "event_id")
        none, empty = F.array().cast("array<string>"), F.array().cast(merge.DETAILS)
        earlier = before.select(*keys, F.coalesce("p.changes", none).alias("changes"), F.coalesce("p.change_details", empty).alias("change_details"))
        kind = F.when(F.col("target") == "UPDATE", "UPDATE").when((F.col("own_compatibility") == rules.REVIEW) | F.col("force_review"), "REVIEW").otherwise("NEW")
        inserts = F.col("action").isin("INSERT_NEW", "INSERT_UPDATE")
        ends = moved.withColumn("kind", kind).groupBy(*keys).agg(
            F.max_by(F.struct(*STORED, F.array(F.struct(F.col("url"), F.lit("").alias("label"))).alias("links"), "relative"), F.when(F.col("action") != "SUPPRESS", F.col("seq"))).alias("x"),
            F.min_by(F.struct("kind", "seq"), F.when(inserts, F.col("seq"))).alias("made"),
            F.bool_or(F.col("action") == "SUPPRESS").alias("suppressed"),
        )
        whole = ends.join(fold.event_contents(moved, earlier), keys, "left").join(ids, keys).withColumn("id", F.col("entity"))
        whole = self.state.cut(whole.select("*", "x.*").withColumn("payload", F.when(F.col("x").isNotNull(), self._payload(F.col("changes"), F.col("change_details"), F.col("links"), F.col("relative")))).select("event_id", "entity", "made", "suppressed", "payload"), "events")
        key = merge.event_key(F.col("made.kind"), F.col("entity"), F.concat(F.lit(f"{version}-"), F.col("made.seq")))
        fresh = whole.where("made IS NOT NULL").select(merge.event_id(key).alias("event_id"), key.alias("event_key"), F.col("entity").alias("process_id"), F.col("made.kind").alias("kind"), F.when(F.col("suppressed"), "SUPPRESSED").otherwise("PENDING").alias("status"), F.lit(0).alias("attempts"), "payload", F.lit(now).cast("timestamp").alias("created_at"), *(F.lit(None).cast(t).alias(c) for c, t in (("claimed_at", "timestamp"), ("sent_at", "timestamp"), ("message_id", "string"))))
        kept = box.join(whole.where("made IS NULL AND event_id IS NOT NULL").select("event_id", "suppressed", F.col("payload").alias("_payload")), "event_id", "left")
        kept = kept.withColumns({"status": F.when(F.col("suppressed"), "SUPPRESSED").otherwise(F.col("status")), "payload": F.coalesce("_payload", "payload")})
        return upsert.insert_ignore(kept.select(*box.columns), fresh, ["event_key"], ["event_id"])

    def _ended(self, counted: dict, reports: dict[str, dict], today: date) -> list[tuple]:
        """source, status, found, covered_through, warning and message of each source that ran."""
        names = sorted({*counted, *reports})
        if not names:
            return []
        said = [reports.get(s, {}) for s in names]
        df = self.spark.createDataFrame([(s, r.get("covered_through"), r.get("warning") or "", r.get("failed"), r.get("error") or "") for s, r in zip(names, said)], "source string, covered date, warning string, failed date, error string")
        out = df.select("source", "warning", "error", views.coverage(F.col("covered"), F.col("warning"), F.col("failed"), F.lit(today)).alias("x")).collect()
        return [(r["source"], "ERROR", counted.get(r["source"], {}).get("fetched", 0), None, r["warning"], str(text.redacted(r["error"]))) if r["error"] else (r["source"], r["x"]["status"], counted.get(r["source"], {}).get("fetched", 0), r["x"]["covered_through"], r["warning"], r["warning"] or ("" if r["x"]["status"] == "OK" else f"covered through {r['x']['covered_through']}")) for r in out]

    @staticmethod
    def _status(ended: list[tuple]) -> str:
        errors, warnings = (sum(e[1] == s for e in ended) for s in ("ERROR", "PARTIAL"))
        return "MISSING" if not ended else "NO_SOURCES" if errors >= len(ended) else "PARTIAL" if errors or warnings else "OK"

    @staticmethod
    def _payload(*more: Column) -> Column:
        return F.to_json(F.struct(F.col("id").alias("process_id"), *STORED, *more))

    def consolidate(self, source: str, now: datetime) -> int:
        """Make the entities whose documents share an official folder aliases of one: the folder's owner, else the first seen. Followed aliases pass their follower on."""
        base = self.state.version()
        read = lambda t: self.state.read(t, base)
        urls = read("process_urls").where(F.col("source") == source).withColumn("folder", text.folder_of(F.col("url"))).where("folder IS NOT NULL")
        docs = urls.join(read("processes").select(F.col("id").alias("process_id"), F.col("first_seen").alias("_seen")), "process_id")
        docs = docs.select(F.col("process_id").alias("id"), F.col("folder.id").alias("folder_id"), F.col("_seen").alias("first_seen")).distinct()
        named = F.concat(F.lit(FOLDER_REFERENCE), "folder_id")
        owners = docs.select("folder_id", "id", named.alias("reference")).join(read("official_references").select("reference", F.col("process_id").alias("id")), ["reference", "id"]).select("folder_id", "id")
        new = self.state.cut(views.folder_aliases(docs, owners).dropDuplicates(["alias_id"]), "aliases")
        heads = docs.groupBy("folder_id").agg(F.min_by("id", F.struct("first_seen", "id")).alias("oldest")).join(owners.withColumnRenamed("id", "owner"), "folder_id", "left")
        stamp = F.lit(now).cast("timestamp")
        refs = heads.select(named.alias("reference"), F.coalesce("owner", "oldest").alias("process_id"), stamp.alias("first_seen"))
        passed = read("followed_processes").join(new.withColumnRenamed("process_id", "to"), F.col("process_id") == F.col("alias_id")).select(F.col("to").alias("process_id"), stamp.alias("followed_at")).distinct()
        aliases = read("process_aliases")
        out = self.state.commit(
            {
                "process_aliases": aliases.join(new, "alias_id", "left_anti").unionByName(new),
                "official_references": upsert.insert_ignore(read("official_references"), refs, ["reference"], ["process_id"]),
                "followed_processes": upsert.insert_ignore(read("followed_processes"), passed, ["process_id"], ["followed_at"]),
            },
            base,
        )
        self.state.forget()
        return out

    def repair(self, evidence: DataFrame, now: datetime, owner: str = "") -> DataFrame:
        """Apply fields of captured official pages to the entities that have their addresses, as a new version; the one before stays as it is.

        evidence has url and html. Every page must have the heading of just one entity and
        an access field, else nothing is done. owner, if given, becomes the organisation.
        The result is the audit: id, url, before and after (JSON), changed. Repeating a
        repair changes nothing and publishes no version.
        """
        base = self.state.version()
        processes = self.state.read("processes", base)
        fields = official.structured(evidence, "url", "html").withColumnsRenamed({"positions": "_positions", "deadline": "_deadline", "state": "milestone_text"})
        known = self.state.read("process_urls", base).select("url", F.col("process_id").alias("id")).distinct()
        met = self.state.cut(evidence.select("url").distinct().join(fields, "url", "left").join(known, "url", "left").join(processes, "id", "left"), "evidence")
        fits = F.coalesce((text.normalize(F.col("heading")) == text.normalize(F.col("title"))) & F.col("access_text").isNotNull(), F.lit(False))
        wrong = met.groupBy("url").agg(F.count_if(fits).alias("n"), F.count("*").alias("all")).where("n <> 1 OR `all` <> 1")
        if not wrong.isEmpty():
            raise ValueError(f"{wrong.count()} pages aren't evidence for one entity, such as {wrong.orderBy('url').first()['url']}")
        own = met.drop("positions", "deadline").withColumnsRenamed({"_positions": "positions", "_deadline": "deadline"})
        own = own.withColumns({"organisation": F.lit(owner) if owner else F.col("organisation"), "group": extract.group(F.col("title")), "publication_date": F.lit(None).cast("date"), "deadline_confirmed": F.col("deadline").isNotNull(), "access": classify.access(text.normalize(F.col("access_text"))), "full_text": F.lit(""), "qualification_text": F.coalesce("qualification", F.lit("")), "link_labels": F.lit("")})
        own = classify.evaluate(own, self.profile)
        own = own.withColumns({"normalised_organisation": text.normalize(F.col("organisation")), "snapshot": identity.snapshot({k: F.col(k) for k in identity.SNAPSHOT}, F.get_json_object("snapshot", "$.exam_date_provisional").cast("boolean"))})
        own = own.withColumn("semantic_hash", text.stable_hash(F.col("snapshot")))
        before = processes.select("id", F.to_json(F.struct(*REPAIRED)).alias("before"))
        audit = own.withColumn("after", F.to_json(F.struct(*REPAIRED))).join(before, "id").withColumn("changed", F.col("before") != F.col("after"))
        audit = self.state.cut(audit.withColumn("last_changed", F.when(F.col("changed"), F.lit(now).cast("timestamp")).otherwise(F.col("last_changed"))), "audit")
        if not audit.where("changed").isEmpty():
            self.state.commit({"processes": processes.join(audit.select("id"), "id", "left_anti").unionByName(audit.select(*processes.columns))}, base)
        return audit.select("id", "url", "before", "after", "changed")

    # --- delivery ---

    def claim(self, n: int, now: datetime) -> list[str]:
        """Claim the oldest events that may be sent. Published before any send, so a crash leaves them uncertain, never sent twice."""
        base = self.state.version()
        box = self.state.read("notification_outbox", base)
        claimed = outbox.claim(box, n).withColumn("claimed_at", F.lit(now).cast("timestamp"))
        ids = [r["event_id"] for r in claimed.select("event_id").collect()]
        if ids:
            self.state.commit({"notification_outbox": outbox.apply_claim(box, box.where(F.col("event_id").isin(ids)).withColumns({"status": F.lit("SENDING"), "attempts": F.col("attempts") + 1, "claimed_at": F.lit(now).cast("timestamp")}))}, base)
        return ids

    def dispatch(self, ids: list[str], send: Callable[[str], str], now: datetime, pause: float = 1.0) -> dict[str, int]:
        """Send claimed events, one at a time from the driver. send returns a message id; Retry is a certain failure, other errors leave the outcome uncertain."""
        base = self.state.version()
        box = self.state.read("notification_outbox", base)
        claimed = box.where(F.col("event_id").isin(ids) & (F.col("status") == "SENDING"))
        if self.only_enrollable_new:
            claimed = self._judged_again(claimed, now.date())
        else:
            claimed = claimed.withColumns({"decision_now": F.lit("SEND"), "as_review": F.lit(False)})
        rows = claimed.orderBy("created_at", "event_id").collect()
        done = [(r["event_id"], "SUPPRESSED", None, None) for r in rows if r["decision_now"] == "SUPPRESS"]
        rows, stop = [r for r in rows if r["decision_now"] != "SUPPRESS"], False
        for k, r in enumerate(rows):
            if stop:
                break
            if k and pause:
                time.sleep(pause)
            try:
                kind = "REVIEW" if r["decision_now"] == "SEND_AS_REVIEW" else r["kind"]
                payload = json.dumps(json.loads(r["payload"]) | {"compatibility": rules.REVIEW}, ensure_ascii=False) if r["as_review"] else r["payload"]
                done.append((r["event_id"], "SENT", now, str(send(render.message(kind, payload)))))
            except Retry as e:
                done.append((r["event_id"], "RETRYABLE", None, None))
                stop = e.after > 0
            except Exception:
                done.append((r["event_id"], "UNCERTAIN", None, None))
        results = self.spark.createDataFrame(done, "event_id string, new_status string, sent_at timestamp, message_id string")
        left = [i for i in ids if i not in {d[0] for d in done}]
        self.state.commit({"notification_outbox": outbox.release(outbox.mark(box, results), F.col("event_id").isin(left) if left else F.lit(False))}, base)
        return {s: sum(d[1] == s for d in done) for s in ("SENT", "RETRYABLE", "UNCERTAIN", "SUPPRESSED")} | {"RELEASED": len(left)}

    def _judged_again(self, claimed: DataFrame, today: date) -> DataFrame:
        """Claimed events with decision_now: what their stored snapshots say today, and whether their entities are followed."""
        kinds = {f.name: f.dataType.simpleString() for f in self.state.read("processes").schema.fields}
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in STORED) + f", relative {RELATIVE}"
        read = F.from_json("payload", schema)
        own = claimed.withColumn("_p", read).select("event_id", "kind", "process_id", *(F.col(f"_p.{c}").alias(c) for c in (*STORED, "relative")))
        own = own.withColumns({"full_text": F.lit(""), "qualification_text": F.coalesce("qualification", F.lit("")), "milestone_text": F.lit(""), "link_labels": F.lit(""), "_status": F.col("status")})
        judged = classify.evaluate(own, self.profile).withColumn("status", F.col("_status"))
        followed = resolve.follow_alias(judged, self.state.read("process_aliases"), "process_id").join(self.state.read("followed_processes").select("process_id", F.lit(True).alias("_followed")), "process_id", "left")
        day, rel = F.lit(today), F.col("relative")
        open_now = classify.can_apply(F.col("status"), F.col("access"), F.col("deadline_confirmed"), F.col("deadline"), F.col("publication_date"), day)
        may = classify.window_open(F.col("source"), F.col("status"), F.col("access"), F.col("deadline_confirmed"), F.col("publication_date"), rel["days"], rel["kind"], rel["starts_after"], day)
        review = F.lit(self.show_review) & F.col("decision.reviewable")
        action = outbox.dispatch_decision(F.col("kind"), F.col("decision.include"), review, F.coalesce("_followed", F.lit(False)), open_now, may, self.explicit_follow_only)
        return claimed.join(followed.select("event_id", action.alias("decision_now"), (~F.col("decision.include") & review).alias("as_review")), "event_id")

    def _move(self, change: Callable[[DataFrame], DataFrame]) -> int:
        base = self.state.version()
        return self.state.commit({"notification_outbox": change(self.state.read("notification_outbox", base))}, base)

    def recover(self, now: datetime) -> int:
        return self._move(lambda b: outbox.recover_stale(b, F.lit(now).cast("timestamp")))

    def release(self, ids: list[str]) -> int:
        """Claims that weren't sent become pending again."""
        return self._move(lambda b: outbox.release(b, F.col("event_id").isin(ids)))

    def retry(self, event_id: str) -> int:
        return self._move(lambda b: outbox.retry(b, F.col("event_id") == event_id))

    def suppress(self, event_id: str) -> int:
        return self._move(lambda b: outbox.suppress(b, F.col("event_id") == event_id))

    def remind(self, today: date, days_before: list[int], now: datetime) -> int:
        """Events for confirmed deadlines that are so many days off, each made once."""
        base = self.state.version()
        processes, made, box = (self.state.read(t, base) for t in ("processes", "reminders", "notification_outbox"))
        due = outbox.reminders(processes, made, F.lit(today), days_before)
        stamp = F.lit(now).cast("timestamp")
        payload = processes.select(F.col("id").alias("process_id"), self._payload(F.lit(None).cast(RELATIVE).alias("relative")).alias("payload"))
        new = due.join(payload, "process_id").select(merge.event_id(F.col("event_key")).alias("event_id"), "event_key", "process_id", F.lit("REMINDER").alias("kind"), F.lit("PENDING").alias("status"), F.lit(0).alias("attempts"), "payload", stamp.alias("created_at"), *(F.lit(None).cast(t).alias(c) for c, t in (("claimed_at", "timestamp"), ("sent_at", "timestamp"), ("message_id", "string"))))
        rows = due.select("process_id", "deadline", "days_before", stamp.alias("created_at"))
        return self.state.commit({"notification_outbox": upsert.insert_ignore(box, new, ["event_key"], ["event_id"]), "reminders": made.unionByName(rows)}, base)

    # --- following and views ---

    def follow(self, prefix: str, now: datetime, on: bool = True) -> str:
        """Follow or leave the one entity whose id has the prefix (8 to 36 hexadecimal digits or hyphens)."""
        base = self.state.version()
        if not (8 <= len(prefix) <= 36 and set(prefix) <= set("0123456789abcdef-")):
            raise ValueError("not an id")
        hit = [r["id"] for r in resolve.by_prefix(self.spark.createDataFrame([(prefix,)], "prefix string"), self.state.read("processes", base)).collect()]
        if len(hit) != 1:
            raise ValueError("no single entity has this id")
        aliases, own = self.state.read("process_aliases", base), self.state.read("followed_processes", base)
        target = ([r["process_id"] for r in aliases.where(F.col("alias_id") == hit[0]).collect()] or hit)[0]
        if on:
            new = self.spark.createDataFrame([(target, now)], "process_id string, followed_at timestamp")
            out = upsert.insert_ignore(own, new, ["process_id"], ["followed_at"])
        else:
            gone = aliases.where(F.col("process_id") == target).select(F.col("alias_id").alias("process_id")).unionByName(self.spark.createDataFrame([(target,)], "process_id string"))
            out = own.join(gone, "process_id", "left_anti")
        self.state.commit({"followed_processes": out}, base)
        return target

    def is_followed(self, process_id: str) -> bool:
        """Whether an entity, led to its canonical one, is followed."""
        one = resolve.follow_alias(self.spark.createDataFrame([(process_id,)], "process_id string"), self.state.read("process_aliases"), "process_id")
        return not one.join(self.state.read("followed_processes"), "process_id", "left_semi").isEmpty()

    def source_status(self) -> DataFrame:
        """The latest run of each source with its checkpoint."""
        return views.source_status(self.state.read("source_runs"), self.state.read("source_checkpoints"))

    def events(self, statuses: list[str] | None = None) -> DataFrame:
        """Events of the outbox, oldest first."""
        box = self.state.read("notification_outbox")
        return (box.where(F.col("status").isin(statuses)) if statuses else box).orderBy("created_at", "event_id")

    def catalog(self, today: date) -> DataFrame:
        """Canonical entities with category, aliases, links and history; raw texts aren't in it. Excluded ones only if they are followed."""
        read = self.state.read
        p = read("processes").join(read("process_aliases").select(F.col("alias_id").alias("id")), "id", "left_anti")
        followed = read("followed_processes").select(F.col("process_id").alias("id"), F.lit(True).alias("followed"))
        p = p.join(followed, "id", "left").withColumn("followed", F.coalesce("followed", F.lit(False)))
        judged = classify.evaluate(p.withColumns({"full_text": F.lit(""), "qualification_text": F.col("qualification"), "milestone_text": F.lit(""), "link_labels": F.lit(""), "_status": F.col("status"), "_compatibility": F.col("compatibility")}), self.profile)
        judged = judged.withColumns({"status": F.col("_status"), "compatibility": F.col("_compatibility")})
        include, review = F.col("decision.include"), F.col("decision.reviewable")
        applicable = classify.can_apply(F.col("status"), F.col("access"), F.col("deadline_confirmed"), F.col("deadline"), F.col("publication_date"), F.lit(today))
        shown = judged.where(include | review | F.col("followed")).withColumn("category", views.category(include, applicable, F.col("deadline_confirmed"), F.col("status"), ~include & ~review))
        shown = shown.withColumns({"compatibility": F.when(~include & (F.col("compatibility") != "NO_COMPATIBLE"), "REVISAR").otherwise(F.col("compatibility")), "review_reason": F.when(include, "").otherwise(F.col("decision.reason"))})
        aliases = read("process_aliases")
        groups = views.alias_groups(read("processes").select("id", "last_seen", "last_changed"), aliases)
        shown = shown.drop("last_seen", "last_changed").join(groups, "id")
        # Links and history are those of the whole group of aliases.
        urls = resolve.follow_alias(read("process_urls"), aliases, "process_id")
        links = urls.groupBy("process_id").agg(F.array_sort(F.collect_list(F.struct("first_seen", "url", "label"))).alias("links"))
        events = resolve.follow_alias(read("notification_outbox"), aliases, "process_id").withColumn("changes", F.from_json(F.get_json_object("payload", "$.changes"), "array<string>"))
        history = views.latest(events, ["process_id"], [F.desc("created_at"), F.desc("event_id")], 10)
        history = history.groupBy("process_id").agg(F.array_sort(F.collect_list(F.struct("rank", "kind", "status", "created_at", "changes"))).alias("history"))
        out = shown.join(links, shown["id"] == links["process_id"], "left").drop("process_id").join(history, shown["id"] == history["process_id"], "left").drop("process_id")
        return out.drop("full_text", "qualification_text", "milestone_text", "link_labels", "_status", "_compatibility", "decision", "snapshot").orderBy(F.desc("last_changed"), "id")

    def card(self, prefix: str, today: date) -> str:
        """The detail of the one shown entity whose id has the prefix, as an escaped text within a message's budget."""
        found = resolve.by_prefix(self.spark.createDataFrame([(prefix,)], "prefix string"), self.state.read("processes")).collect()
        rows = self.catalog(today).where(F.col("id") == found[0]["id"]).toJSON().collect() if found else []
        if not rows:
            raise ValueError("no single entity has this id")
        own = json.loads(rows[0])
        details = [{"label": "Último cambio", "old": "", "new": c} for h in own.get("history", [])[:1] for c in h.get("changes") or []]
        return render.message("CARD", json.dumps(own | {"change_details": details}))

    def stats(self) -> dict[str, int]:
        out = {"processes": self.state.read("processes").count()}
        return out | {r["key"]: r["n"] for r in views.status_counts(self.state.read("notification_outbox"), "outbox").collect()}

    def check(self) -> DataFrame:
        """Repeated keys and orphans of the state."""
        processes = self.state.read("processes")
        out = upsert.integrity(processes, ["id"], {})
        for name, keys in (("source_items", ["source", "external_id"]), ("notification_outbox", ["event_key"]), ("process_urls", ["process_id", "source", "url"])):
            own = upsert.integrity(self.state.read(name), keys, {"process_id": (processes, "id")})
            out = out.unionByName(own.withColumn("check", F.concat(F.lit(f"{name}_"), "check")))
        return out

    def export(self, today: date) -> str:
        """The catalogue and the sources' states as JSON text, for a bounded number of entities."""
        rows, sources = ([json.loads(x) for x in df.toJSON().collect()] for df in (self.catalog(today), self.source_status()))
        return json.dumps({"version": 2, "processes": rows, "sources": sources}, ensure_ascii=False, indent=2, sort_keys=True) + "\n"
