"""Identity within a run and the ordered fold, against plain models that take one notice after the other."""

import random

import pytest
from pyspark.sql import functions as F

from noticeforge.functions import identity, rules
from noticeforge.operators import components, fold, merge, settle

UNKNOWN = rules.UNKNOWN_ACCESS
TITLES = ["tecnico auxiliar", "tecnico auxiliar informatica", "programador", "programadora", "analista de sistemas", "conserje", ""]


class PlainStore:
    """Lists that are searched from end to end for every notice."""

    def __init__(self, entities, items, references, aliases):
        self.entities, self.items, self.references, self.aliases = entities, items, references, aliases
        self.clock = 0

    def find(self, n):
        for s, e, p in self.items:
            if (s, e) == (n["source"], n["external_id"]):
                return next(x for x in self.entities if x["id"] == self.aliases.get(p, p)), "item"
        owners = [p for r, p in self.references if r in n["references"]]
        if owners:
            return min((x for x in self.entities if x["id"] in owners), key=lambda x: x["first"]), "reference"
        for c in n["cited"]:
            for r, p in self.references:
                x = next(x for x in self.entities if x["id"] == p)
                if r == c and self.score(n, x, posts=False) >= 0.92:
                    return x, "citation"
        same = [x for x in self.entities if x["canonical_key"] == n["canonical_key"]]
        if same and not self.conflict(n, first := min(same, key=lambda x: x["first"])):
            return first, "key"
        if not n["organisation"]:
            return None, None
        best = (0.0, None)
        for x in sorted((x for x in self.entities if x["organisation"] == n["organisation"]), key=lambda x: (x["last"], [-ord(c) for c in x["id"]]), reverse=True)[:100]:
            if not self.conflict(n, x) and (s := self.score(n, x, posts=True)) >= 0.92 and s > best[0]:
                best = (s, x)
        return (best[1], "title") if best[1] else (None, None)

    def conflict(self, n, x):
        if any(p == x["id"] and s == n["source"] and e != n["external_id"] for s, e, p in self.items):
            return True
        return n["positions"] is not None and x["positions"] is not None and n["positions"] != x["positions"]

    @staticmethod
    def score(n, x, posts):
        years = [a["published"] or a["titled"] for a in (n, x)]
        if all(years) and years[0] != years[1] or n["organisation"] != x["organisation"]:
            return 0
        if n["group"] and x["group"] and n["group"] != x["group"]:
            return 0
        if posts and n["positions"] is not None and x["positions"] is not None and n["positions"] != x["positions"]:
            return 0
        if n["access"] not in (UNKNOWN, x["access"]) and x["access"] != UNKNOWN:
            return 0
        return identity.token_set_similarity(n["signature"], x["signature"]) / 100

    def take(self, n):
        x, stage = self.find(n)
        if not (n["keep_tracked"] if x else n["keep_new"]):
            return None
        self.clock += 1
        if x is None:
            stage = "new"
            x = {c: n[c] for c in settle.SHARED} | {"id": f"new{n['seq']}", "first": (1, self.clock)}
            self.entities.append(x)
        x["last"] = (1, self.clock)
        for c in ("group", "published"):
            x[c] = n[c] or x[c]
        x["organisation"] = x["organisation"] or n["organisation"]
        x["positions"] = x["positions"] if n["positions"] is None else n["positions"]
        x["access"] = x["access"] if n["access"] == UNKNOWN else n["access"]
        if not any((s, e) == (n["source"], n["external_id"]) for s, e, _ in self.items):
            self.items.append((n["source"], n["external_id"], x["id"]))
        for r in n["references"]:
            if not any(r == o for o, _ in self.references):
                self.references.append((r, x["id"]))
        return x["id"], stage


def random_batch(r, b, seq):
    """A batch with a state of its own; every value is the batch's own, so that batches don't meet."""
    tag = f"#{b}"
    fields = lambda: {"organisation": r.choice(["", f"{tag} uno", f"{tag} uno", f"{tag} dos"]), "signature": r.choice(TITLES), "group": r.choice(["", "c1", "b"]), "access": r.choice([UNKNOWN, UNKNOWN, "LIBRE", "MIXTO"]), "positions": r.choice([None, None, 1, 2]), "published": r.choice(["", "2025", "2026"]), "titled": r.choice(["", "2026"])}
    key = lambda f: "|".join([tag, f["organisation"], f["signature"], f["published"] or f["titled"], f["access"], f["group"]])
    ref = lambda: f"{tag}r{r.randrange(5)}"
    entities = []
    for i in range(r.randrange(4) if b % 3 else 0):
        f = fields()
        entities.append(f | {"id": f"{tag}e{i}", "canonical_key": key(f), "first": (0, r.randrange(3), f"{tag}e{i}"), "last": (0, r.randrange(3))})
    items = list({(s, e): (s, e, r.choice(entities)["id"]) for s, e in ((r.choice("xyz"), f"{tag}{r.randrange(4)}") for _ in range(4))}.values()) if entities else []
    references = list({x: (x, r.choice(entities)["id"]) for x in (ref() for _ in range(2))}.values()) if entities else []
    aliases = {entities[-1]["id"]: entities[0]["id"]} if len(entities) > 1 and r.random() < 0.4 else {}
    notices = []
    for _ in range(r.randrange(1, 14)):
        f = fields()
        seq += 1
        notices.append(f | {"seq": seq, "source": r.choice("xyz"), "external_id": f"{tag}{r.randrange(7)}", "references": [ref()] if r.random() < 0.2 else [], "cited": [ref() for _ in range(r.randrange(3))], "canonical_key": key(f), "keep_tracked": r.random() < 0.95, "keep_new": r.random() < 0.85})
    return entities, items, references, aliases, notices, seq


def test_settling_equals_one_after_the_other(spark, tmp_path):
    r, seq = random.Random(17), 0
    entities, items, references, aliases, notices, want = [], [], [], [], [], {}
    for b in range(500):
        e, i, refs, a, n, seq = random_batch(r, b, seq)
        entities += [dict(x) for x in e]
        items += i
        references += refs
        aliases += a.items()
        notices += n
        plain = PlainStore([dict(x) for x in e], list(i), list(refs), a)
        for x in n:
            want[x["seq"]] = plain.take(x)
    order = [x.split()[0].strip("`") for x in settle.NOTICE.split(", ")]
    r.shuffle(notices)
    new = spark.createDataFrame([tuple(x[c] for c in order) for x in notices], settle.NOTICE).repartition(5)
    old = spark.createDataFrame([(x["id"], x["first"][1], x["last"][1], *(x[c] for c in settle.SHARED)) for x in entities], "id string, first_seen long, last_seen long, canonical_key string, organisation string, signature string, `group` string, access string, positions int, published string, titled string")
    its = spark.createDataFrame(items, "source string, external_id string, process_id string")
    refs = spark.createDataFrame(references, "reference string, process_id string")
    als = spark.createDataFrame(aliases, "alias_id string, process_id string")
    cut = lambda df, name: spark.createDataFrame(df.collect(), df.schema)
    got = settle.settle(new, settle.known(new, old, its, refs, als), cut, "t").collect()
    # New entities have hashed ids: each goes by the first of its notices.
    names = {}
    for g in sorted(got):
        if g.entity and not g.entity.startswith("#"):
            names.setdefault(g.entity, f"new{g.seq}")
    found = {g.seq: (names.get(g.entity, g.entity), g.stage) if g.entity else None for g in got}
    assert not [(s, found.get(s), x) for s, x in want.items() if found.get(s) != x] and len(found) == len(want)
    assert {s for x in want.values() if x for s in x[1:]} == {"item", "reference", "citation", "key", "title", "new"}
    assert settle.settle(new.limit(0), settle.known(new.limit(0), old, its, refs, als), cut, "t").count() == 0


def test_only_the_newest_are_compared():
    block = settle.Block("t")
    notice = {"references": [], "cited": [], "group": "", "access": UNKNOWN, "positions": None, "published": "", "titled": "", "organisation": "o", "keep_new": True, "keep_tracked": True}
    words = [f"{a}{b}{c}" * 3 for a in "abcdef" for b in "ghijkl" for c in "mnopq"]
    for i, w in enumerate(words[:101]):
        block.take(notice | {"seq": i, "source": "s", "external_id": str(i), "canonical_key": f"k{i}", "signature": w})
    late = lambda i, w: block.take(notice | {"seq": 1000 + i, "source": "z", "external_id": str(i), "canonical_key": f"z{i}", "signature": w, "keep_new": False})[2]
    assert late(0, words[1]) == "title" and late(1, words[0]) is None


def test_components(spark):
    r = random.Random(2)
    links = [(f"{r.randrange(300):03d}", f"{r.randrange(300):03d}") for _ in range(200)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(120)] + [(None, "x"), ("x", None), ("y", "y")]
    cut = lambda df, name: spark.createDataFrame(df.collect(), df.schema)
    got = {x.label: x.component for x in components.components(spark.createDataFrame(links, "a string, b string"), cut).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a and b and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    assert got == {x: root(x) for x in up}


# --- the fold ---------------------------------------------------------------------

STATUSES = [*rules.STATUS_RANK, "ANULADA", "SUSPENDIDA", "REABIERTA", "PROPUESTA_NOMBRAMIENTO"]
ROW = "entity string, seq long, canonical_key string, title_signature string, source string, title string, organisation string, locality string, province string, scope string, `group` string, qualification string, summary string, exam_place string, positions int, publication_date date, deadline date, deadline_confirmed boolean, exam_date date, provisional boolean, exam_time string, access string, compatibility string, status string, priority int, special_process string, structured boolean, stored string, included boolean, notify boolean, force_review boolean, new_item boolean, url string, said_by string, observed_at string, notice string, ever_sent boolean, had_initial boolean, had_update boolean"
NAMES = [x.split()[0].strip("`") for x in ROW.split(", ")]


def prefer(old, new):
    if new in rules.EXCEPTIONAL_STATUSES:
        return new
    if old in rules.EXCEPTIONAL_STATUSES and new not in rules.LEAVING_STATUSES:
        return old
    return new if rules.STATUS_RANK.get(new, 0) >= rules.STATUS_RANK.get(old, 0) or old in rules.EXCEPTIONAL_STATUSES else old


def merge_row(old, new):
    m = dict(new)
    m["title"], m["organisation"] = old["title"] or new["title"], old["organisation"] or new["organisation"]
    for c in ("locality", "province", "scope", "group", "qualification", "summary", "exam_place", "special_process"):
        m[c] = new[c] or old[c]
    for c in ("positions", "publication_date", "exam_time"):
        m[c] = old[c] if new[c] is None else new[c]
    if new["access"] == UNKNOWN:
        m["access"] = old["access"]
    if new["compatibility"] == rules.REVIEW:
        m["compatibility"] = old["compatibility"]
    if new["deadline"] is None:
        m["deadline"], m["deadline_confirmed"] = old["deadline"], old["deadline_confirmed"]
    if new["exam_date"] is None:
        m["exam_date"], m["provisional"] = old["exam_date"], old["provisional"]
    m["status"], m["priority"] = prefer(old["status"], new["status"]), max(old["priority"], new["priority"])
    if new["structured"]:
        for c in ("positions", "publication_date", "deadline", "deadline_confirmed", "organisation"):
            m[c] = new[c]
    for c in fold.FIXED:
        m[c] = old[c]
    return m


def plain_snapshot(m):
    own = {k: m[k] for k in identity.SNAPSHOT} | ({} if m["provisional"] is None else {"exam_date_provisional": m["provisional"]})
    return {k: None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for k, v in own.items()}


def plain_fold(old, rows, pending):
    """State after each row, actions, and the events' contents, by one loop."""
    initial, update = (list(x) if x else None for x in (pending.get("INITIAL"), pending.get("UPDATE")))
    was, out, touched = (plain_snapshot(old), [], set()) if old else (None, [], set())
    m = old
    for n in rows:
        founder = m is None
        m = merge_row(m, n) if m else dict(n)
        now = plain_snapshot(m)
        labels = [] if founder else [rules.CHANGE_LABELS[k] for k in rules.CHANGE_LABELS if k in now and was.get(k) != now[k]]
        details = [] if founder else [(k, was.get(k), now[k]) for k in rules.DETAIL_FIELDS if k in now and was.get(k) != now[k]]
        changed, target = founder or now != was, "INITIAL" if founder or initial is not None else "UPDATE"
        if founder:
            action = "INSERT_NEW" if n["notify"] else "TOUCH"
            if n["notify"]:
                initial = [[], []]
                touched.add("INITIAL")
        elif changed and initial is not None:
            action = "REWRITE" if n["included"] else "SUPPRESS"
            if n["included"]:
                initial[:] = [labels, details]
                touched.add("INITIAL")
            else:
                gone, initial = initial, None
                pending = pending | {"gone": gone}
        elif changed and update is not None:
            action = "EXTEND"
            touched.add("UPDATE")
            update[0] = list(dict.fromkeys([*update[0], *labels]))
            update[1] = join_details(update[1], details)
        elif changed and n["notify"] and (n["included"] or n["ever_sent"]):
            action, update = "INSERT_UPDATE", [labels, details]
            touched.add("UPDATE")
        elif not changed and n["new_item"] and n["notice"] and n["notify"]:
            if initial is not None or update is not None:
                action, event = "EXTEND", update if initial is None else initial
                event[:] = [list(dict.fromkeys([*event[0], n["notice"]])), []]
            else:
                action, update = "INSERT_UPDATE", [[n["notice"]], []]
            touched.add("INITIAL" if initial is not None else "UPDATE")
        else:
            action = "TOUCH"
        was = now
        out.append((dict(m), action, target))
    events = {"INITIAL": initial if initial is not None else pending.get("gone"), "UPDATE": update}
    return out, {k: v for k, v in events.items() if k in touched}


def join_details(before, now):
    out = [next(((k, o, n) for f, _, n in now if f == k), (k, o, x)) for k, o, x in before]
    out += [d for d in now if d[0] not in {b[0] for b in before}]
    return [d for d in out if d[1] != d[2]]


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_one_after_the_other(spark, seed):
    import datetime as dt

    r = random.Random(seed)
    day = lambda *none: r.choice([*none, dt.date(2026, 1, 1), dt.date(2026, 2, 1)])

    def row(entity, seq):
        exam = day(None, None)
        base = dict.fromkeys(NAMES) | {"entity": entity, "seq": seq, "canonical_key": f"k{seq}", "title_signature": f"t{seq}", "source": r.choice("xy"), "observed_at": "now", "url": "u", "said_by": "s", "scope": ""}
        base |= {c: r.choice(["", "", "a", "b"]) for c in ("title", "organisation", "locality", "province", "group", "qualification", "summary", "exam_place", "special_process")}
        base |= {"positions": r.choice([None, 1, 2]), "publication_date": day(None), "deadline": day(None, None), "deadline_confirmed": r.random() < 0.5, "exam_date": exam, "provisional": r.choice([True, False, *[None] * (seq < 0)]) if exam else None, "exam_time": r.choice([None, None, "09:30"])}
        base |= {"access": r.choice([UNKNOWN, "LIBRE", "MIXTO"]), "compatibility": r.choice([rules.REVIEW, rules.COMPATIBLE, rules.NOT_COMPATIBLE]), "status": r.choice(STATUSES), "priority": r.randrange(4), "structured": r.random() < 0.1}
        if seq > 0 and r.random() < 0.45:  # says nothing new
            base |= dict.fromkeys(("locality", "province", "group", "qualification", "summary", "exam_place", "special_process"), "") | dict.fromkeys(("positions", "publication_date", "deadline", "exam_date", "provisional", "exam_time")) | {"access": UNKNOWN, "compatibility": rules.REVIEW, "status": "DESCONOCIDA", "priority": 0, "structured": False}
        return base | {"included": r.random() < 0.8, "notify": r.random() < 0.8, "force_review": False, "new_item": r.random() < 0.5, "notice": r.choice([None, *(n for _, n in rules.NOTICE_CHANGES)])}

    rows, olds, earlier, want = [], [], [], {}
    for k in range(250):
        entity, sent = f"e{k}", r.random() < 0.5
        old = row(entity, -1) if k % 2 else None
        pending = {t: [[r.choice(["old label", "numero de plazas"])], [("positions", "7", "8")] * r.randrange(2)] for t in ("INITIAL", "UPDATE") if old and r.random() < 0.4}
        # What a pending update said last is what the entity is now.
        for said in pending.values():
            said[1] = [(f, o, plain_snapshot(old)["positions"]) for f, o, _ in said[1] if o != plain_snapshot(old)["positions"]]
        own = [row(entity, i) | {"ever_sent": sent, "had_initial": "INITIAL" in pending, "had_update": "UPDATE" in pending} for i in range(r.randrange(1, 12))]
        want[entity] = plain_fold(old, own, pending)
        rows += own
        olds += [old] if old else []
        earlier += [(entity, t, c, d) for t, (c, d) in pending.items()]
    new = spark.createDataFrame([tuple(x[c] for c in NAMES) for x in r.sample(rows, len(rows))], ROW)
    was = spark.createDataFrame([tuple(x[c] for c in NAMES) for x in olds], ROW)
    snapshot = identity.snapshot({k: F.col(k) for k in identity.SNAPSHOT}, F.col("provisional"))
    was = was.withColumn("stored", snapshot)
    acted = fold.actions(fold.changes(fold.running(new.unionByName(was))))
    got = {}
    for x in acted.collect():
        got.setdefault(x.entity, {})[x.seq] = x
    for entity, (steps, _) in want.items():
        for i, (m, action, target) in enumerate(steps):
            x = got[entity][i]
            for c in (*fold.RUNNING, *fold.FIXED):
                assert x[c] == m[c], (entity, i, c, x[c], m[c])
            assert x.action == action and (action == "TOUCH" or x.target == target), (entity, i, x.action, action, x.target, target)
    before = spark.createDataFrame([(e, t, c, [(f, "l", o, n, "u", "s", "now") for f, o, n in d]) for e, t, c, d in earlier], f"entity string, target string, changes array<string>, change_details {merge.DETAILS}")
    contents = {(x.entity, x.target): (list(x.changes), [(d.field, d.old, d.new) for d in x.change_details]) for x in fold.event_contents(acted, before).collect()}
    assert contents == {(e, t): (list(c), list(d)) for e, (_, events) in want.items() for t, (c, d) in events.items()}
    assert len({a for s, _ in want.values() for _, a, _ in s}) == 6
