"""Importance resampling, conversation repair and exact top-k search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeforge.llm import balltree, repair, resample, shards

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def plain_resampling(raw, target):
    s, t = Counter(), Counter()
    for totals, texts in ((s, [x for _, x in raw]), (t, target)):
        for x in texts:
            totals.update(map(bucket, features(x)[1]))
    low, high = sum(s.values()) + 10000, sum(t.values()) + 10000
    out = []
    for i, x in raw:
        w, f = features(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * low / ((s[b] + 1) * high))) for b in map(bucket, f))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((o for o in out if o[1] >= 20), key=lambda o: (-o[4], o[0] is not None, o[0] or 0, o[2], o[3]))
    most = 5 * len(fit) // 100
    ranks = {}
    for n, o in enumerate(fit[:most], 1):
        ranks.setdefault(o, []).append(n)
    return [(o, ranks.get(o, [])) for o in out]


def test_resampling_equals_brute_force(spark):
    r = random.Random(3)
    words = ["Alpha", "beta", "Ünïté", "d4ta", "x", "lorem", "ipsum", "q" * 60, "w" * 900, "東京"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", ", ", "\n", "-", "\x7f"]) for _ in range(n))
    raw = [(i, text(r.randrange(60))) for i in range(300)]
    raw += [(500, None), (501, ""), (502, "..."), (503, "one"), (504, text(200_000)), (None, text(30)), (7, raw[7][1]), (505, text(19)), (506, "ß" * 500_000)]
    target = [text(40) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame([(i, x, "a", 1) for i, x in raw], "doc_id long, text string, weight string, rank int").repartition(5)
    goal = spark.createDataFrame([(x, "b") for x in target], "text string, score string")
    gains = resample.fit(df, goal)
    got = resample.draw(resample.weigh(df, gains)).collect()
    want = plain_resampling(raw, target)
    assert sorted((str(g.doc_id), g.n_words, g.n_features, g.weight, g.score) for g in got) == sorted((str(o[0]), *o[1:]) for o, _ in want)
    ranks = {(g.doc_id, g["rank"]) for g in got if g["rank"]}
    assert ranks == {(o[0], n) for o, own in want for n in own} and len(ranks) == 5 * sum(o[1] >= 20 for o, _ in want) // 100 > 5
    drawn = resample.resample(df.where("doc_id <> 7"), goal)
    assert drawn.columns == df.columns and 5 < drawn.count() < 20


def test_resampling_prefers_the_target_and_takes_empty_tables(spark):
    raw = [(i, ("sea ship sail " if i % 10 == 0 else "tax form law ") * 10) for i in range(400)]
    df = spark.createDataFrame(raw, "doc_id long, text string")
    drawn = resample.resample(df, spark.createDataFrame([("a ship will sail the sea",)], "text string"))
    assert drawn.count() == 20 and {r.doc_id % 10 for r in drawn.collect()} == {0}
    none = df.limit(0)
    assert resample.draw(resample.weigh(none, resample.fit(none, none))).count() == 0
    gains = resample.fit(df, none)
    assert resample.draw(resample.weigh(df, gains)).where("rank IS NOT NULL").count() == 20
    assert resample.weigh(df.withColumn("doc_id", F.concat(F.lit("k"), "doc_id")), gains).count() == 400


def plain_edits(rows):
    """All edit sequences by exhaustive recursion over (row, state, insertions since a row): least cost, then least initials."""
    takes = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    full = {"u": "user", "a": "assistant"}

    @cache
    def best(i, state, inserted):
        out = []
        if i == len(rows) and state in ("", "a"):
            out.append((0, "", ()))
        if inserted < 3:
            for to in takes[state].values():
                if to != "s":
                    c, a, o = best(i, to, inserted + 1)
                    out.append((c + 5, "I" + a, (f"{full[to]}:", *o)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, o = best(i + 1, state, 0)
            out.append((c + 2, "D" + a, o))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                for first, to in takes[state].items():
                    c, a, o = best(i + 1, to, 0)
                    if role[:1] == first:
                        out.append((c + more, "K" + a, (f"{role}:{text}", *o)))
                    if to != "s":
                        out.append((c + 1 + more, "R" + a, (f"{full[to]}:{text}", *o)))
        return min(out) if out else (10**9, "", ())

    return best(0, "", 0)


def plain_repair(turns):
    """(role, text, turn) in any order to gaps, blank, duplicate, truncated, illegal, cost, audit, hash."""
    turns = sorted(turns, key=lambda x: (x[2] is not None, x[2] or 0, x[0].encode(), x[1].encode()))
    seen, rows = set(), []
    for role, text, _ in turns:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated"
        seen.add((role, text))
        rows.append((role, text, fault))
    numbers = [t for _, _, t in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    count = Counter(f for _, _, f in rows)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = plain_edits(tuple(rows))
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_repair_equals_exhaustive_search(spark):
    r = random.Random(11)
    rows = []
    for conv in range(400):
        for _ in range(r.randrange(1, 9)):
            role = r.choice(["system", "user", "user", "assistant", "assistant", "uzer", "tool", "", None, "User"])
            rows.append((conv, r.choice([None, *range(9)]), role, r.choice(["", " \t", "Yes.", "No", "Why? ", "Si!\n", None, "\xa0", "a\nb."])))
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (900, None, "user", None)]
    df = spark.createDataFrame([(*x, "a", 1) for x in rows], "conv_id long, turn long, role string, text string, audit string, kind int").repartition(4)
    planned = repair.plans(repair.turns(df))
    hashes = {x.conv_id: x.repaired_sha256 for x in repair.digests(repair.turns(df), planned).collect()}
    got = {x.conv_id: (x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit, hashes[x.conv_id]) for x in planned.collect()}
    for conv in {x[0] for x in rows}:
        own = [(" " if x[2] is None else x[2], " " if x[3] is None else x[3], x[1]) for x in rows if x[0] == conv]
        assert got[conv] == plain_repair(own), (conv, own, got[conv])
    assert len(got) == len({x[0] for x in rows})
    again = repair.repaired(repair.turns(df), planned).orderBy("place").collect()
    by_conv = {}
    for x in again:
        by_conv.setdefault(x.conv_id, []).append(x)
        assert (x.edit == "I") <= (x.turn is None and x.text == "")
    for conv, out in by_conv.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[:1] for x in out)) and [x.place for x in out] == list(range(1, len(out) + 1))
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in out).encode()).hexdigest() == hashes[conv]


def test_damage_and_conversations_that_lose_all(spark):
    rows = [(c, t, r, x) for c in range(200) for t, r, x in ((0, "user", "Well? Yes!"), (1, "assistant", "No."))] + [(c, 0, "user", "Alone.") for c in range(1000, 1100)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = [] if kind == 0 else [("user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text, t)] * (2 if kind == 3 else 1)
        want[c] = want.get(c, []) + own
    damaged = repair.damaged(df)
    planned = repair.plans(damaged)
    hashes = {x.conv_id: x.repaired_sha256 for x in repair.digests(damaged, planned).collect()}
    got = {x.conv_id: (x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit, hashes[x.conv_id]) for x in planned.collect()}
    assert got == {c: plain_repair(own) for c, own in want.items()} and any(not own for own in want.values())
    assert repair.plans(repair.damaged(df.limit(0))).count() == 0


def test_long_conversations_and_texts(spark):
    turns = [(1, i, "user" if i % 3 else "assistant", f"Text {i}.") for i in range(5000)] + [(2, 0, "user", "x" * 3_000_000 + "."), (2, 1, "assistant", "ok.")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    planned = repair.plans(repair.turns(df))
    got = {x.conv_id: x for x in planned.collect()}
    hashes = {x.conv_id: x.repaired_sha256 for x in repair.digests(repair.turns(df), planned).collect()}
    assert len(got[1].audit.replace("I", "")) == 5000 and got[2].audit == "KK" and got[2].cost == 0
    assert hashes[2] == hashlib.sha256(("user:" + "x" * 3_000_000 + ".\nassistant:ok.").encode()).hexdigest()


def plain_topk(rows, asked, k=5):
    scaled = [(i, [math.floor(256.0 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, w in scaled:
        if asked(q):
            best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, v in scaled if i != q and len(v) == len(w))[:k]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("kind", ["plain", "clustered", "ties", "huge"])
def test_topk_equals_brute_force(spark, monkeypatch, kind):
    r = np.random.default_rng(4)
    x = r.normal(size=(700, 6))
    if kind == "clustered":
        x = np.repeat(r.normal(size=(20, 6)) * 3, 35, axis=0) + x * 0.05
    if kind == "ties":
        x = r.integers(-1, 2, size=(700, 6)) / 256.0
    if kind == "huge":
        x[::9] *= 1e15
        x[::50] *= 1e3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1050, [0.0] * 6), (1002, [1.0, None] + [0.0] * 4), (1003, [float("inf")] * 6), (1100, [1.0, 2.0]), (1101, [1.0, 3.0]), (None, [9.0] * 6), (50, rows[50][1]), (51, rows[51][1]), (1150, []), (1151, [])]
    df = spark.createDataFrame([(*x, "a") for x in rows], "vec_id long, embedding array<double>, score string").repartition(4)
    monkeypatch.setattr(balltree, "LEAST_ROWS", 150)
    monkeypatch.setattr(balltree, "LEAF", 16)
    got = balltree.largest(df, F.col("vec_id") % 50 == 0).collect()
    want = plain_topk(rows, lambda i: i % 50 == 0)
    assert {tuple(g) for g in got} == want and len(got) == len({(g.query_id, g["rank"]) for g in got})
    assert balltree.largest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_prunes_and_shares_bounds():
    """Subtrees under the bound aren't opened, and a given bound leaves fewer rows."""
    r = np.random.default_rng(9)
    x = np.repeat(r.normal(size=(40, 8)) * 4, 200, axis=0) + r.normal(size=(8000, 8)) * 0.02
    tree = balltree.Tree(np.arange(8000), x)
    opened = []
    products = tree.products
    tree.products = lambda asked, lo, hi: opened.append(lo) or products(asked, lo, hi)
    asked = balltree.scaled(x[:1])
    query, score, found = tree.best(asked, np.array([0]), np.array([-np.inf]))
    assert len(found) == 5 and len(opened) < 12 < sum(not c for c in tree.children)
    n = len(opened)
    _, some, _ = tree.best(asked, np.array([0]), np.array([float(score.max())]))
    assert len(some) >= 1 and len(opened) - n <= n
    assert shards.shard_count(0) == 1 and shards.shard_count(10**9) == -(-(10**9) // shards.SHARD_ROWS)


def test_draws_add_up_and_counts_keep_short_segments_only():
    from noticeforge.llm import counts, mixing

    for slots, shards in ((0, 5), (3, 1000), (999, 1000), (5000, 7)):
        at, n = mixing.draw(slots, shards, 5)
        assert n.sum() == slots and len(set(at.tolist())) == len(at) and (n > 0).all() and (at < shards).all()
    at, n = mixing.draw(400, 401, 9)
    assert 200 < len(at) < 300  # as multinomial draws fall: some shards get several
    counter = counts.Counter(counts.default_path())
    texts = ["x" * 20_000 + " short words here", "漢字" * 5000, "short words here", ""]
    want = [len(counter.model.encode(t)) for t in texts]
    assert counter.counts(texts) == want == counter.counts(texts)
    assert max(map(len, counter.known)) <= counts.CACHE_CHARS
