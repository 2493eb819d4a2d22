"""Toxicity, mixing, line dedup, URL filter and nearest neighbours on small fixtures."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeforge.llm import annforest, entry, linededup, mixing, shards, toxicity, urlfilter

SF = "/root/testdata/sf0.01"


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    r = random.Random(1)
    terms = ["loser", "worthless", "scum", "disgusting", "moron"]
    lex = toxicity.Lexicon(tuple(toxicity.Entry(t, False, 5.0, 2.0) for t in terms) + (toxicity.Entry("vequ", True, 3.0),))
    auto = toxicity.Automaton(lex)
    for _ in range(4000):
        w = list(r.choice(terms + ["vequta", "plain"]))
        for _ in range(r.randrange(4)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randrange(2)] = [r.choice("abelrst")] * r.randrange(2)
        w = "".join(w)
        want = min(((d, i) for i, e in enumerate(lex.entries[:-1]) if (d := edit_distance(w, e.term)) <= e.edits), default=None)
        if w.startswith("vequ"):
            want = (0, len(terms))
        got = auto.match(w)
        assert (got is None) == (want is None) and (want is None or got[0] == want[0]), (w, got, want)


def test_scores_context_and_odd_texts(spark):
    lex = toxicity.Lexicon(tuple(toxicity.Entry(t, False, 5.0, 2.5) for t in ("idiot", "moron", "worthless")))
    own = toxicity.Scorer(lex)
    score = lambda t: own.score(t)[0]
    assert score("You are an IDIOT.") > 0.5 > score('He said "idiot" once, the word was quoted.')
    assert score("you wurthless thing") > 0.5 and score("1d10t") > 0.5 and score("m0ron") > 0.5
    assert score("plain words") < 0.1 and score("") == score(None) < 0.1
    assert score('an "idiot" and a moron') > 0.5
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "idiot " * 30000, "c"), (3, "idiot", "c")], "doc_id long, text string, score string")
    got = toxicity.score_documents(df, lex).collect()
    assert sorted((r.doc_id, r.predicted) for r in got) == [(1, 0), (2, 0), (3, 1), (3, 1)]
    assert toxicity.keep_clean(df, lex).columns == df.columns and toxicity.keep_clean(df, lex).count() == 2
    assert toxicity.score_documents(df.limit(0), lex).count() == 0


def plain_score(text, lexicon):
    """The score by its definition: the nearest entry of each word by edit distance, context by the words around."""
    tokens = re.findall(r"[a-z]+|[\"]", text.lower())
    words = [t for t in tokens if t != '"']
    spots, inside, n = [], [], 0
    for k, t in enumerate(tokens):
        if t != '"':
            # Quoted: a mark that opens before it and one that closes after it, both within the window.
            marks = {}
            for step in (-1, 1):
                j, met = k + step, 0
                while 0 <= j < len(tokens) and met <= toxicity.WINDOW:
                    if tokens[j] == '"':
                        marks.setdefault(step, met)
                    else:
                        met += 1
                    j += step
            spots.append(n)
            inside.append(marks.get(-1, 99) <= toxicity.WINDOW and marks.get(1, 99) <= toxicity.WINDOW)
            n += 1
    own, quoted = {}, []
    for i, word in enumerate(words):
        found = []
        for k, e in enumerate(lexicon.entries):
            d = 0 if e.stem and word.startswith(e.term) else edit_distance(word, e.term) if not e.stem else 99
            if d <= e.edits:
                found.append((d, k))
        if not found:
            continue
        d, k = min(found)
        weight = dict(lexicon.known).get(word, lexicon.entries[k].fuzzy if d else lexicon.entries[k].weight)
        if not weight or weight <= 0:
            continue
        around = set(words[max(0, i - toxicity.WINDOW) : i + toxicity.WINDOW + 1])
        if inside[i]:
            quoted.append(weight * (toxicity.QUOTED_AND_REPORTED if around & toxicity.REPORTING else toxicity.QUOTED))
        else:
            own[word] = max(own.get(word, 0), weight * (toxicity.ADDRESSED if around & toxicity.ADDRESS else 1))
    if not own and not quoted:
        return 1 / (1 + math.exp(toxicity.NO_HITS - lexicon.prior))
    return 1 / (1 + math.exp(-min(30, lexicon.prior + sum(own.values()) + max(quoted, default=0))))


def test_scores_equal_their_definition():
    r = random.Random(8)
    entries = (toxicity.Entry("scumbag", False, 3.0, 1.5), toxicity.Entry("worthless", False, 2.5, 0.7), toxicity.Entry("vequ", True, 2.0), toxicity.Entry("idiot", False, 4.0, -1.0))
    lexicon = toxicity.Lexicon(entries, -2.0, (("scumbaq", 0.0), ("vequta", 5.0)))
    own, seen = toxicity.Scorer(lexicon), set()
    bad = ["scumbag", "scumbaq", "skumbag", "worthless", "wurthles", "vequ", "vequta", "vequmo", "idiot", "idiat"]
    for _ in range(3000):
        words = [r.choice(bad) if r.random() < 0.12 else r.choice(["the", "you", "said", "house", "river", "calls", "blue", "stone"]) for _ in range(r.randrange(30))]
        if len(words) > 3 and r.random() < 0.6:  # one passage in quotes
            a = r.randrange(len(words) - 1)
            b = r.randrange(a, len(words))
            words[a], words[b] = '"' + words[a], words[b] + '"'
        text = " ".join(words).title() if r.random() < 0.3 else " ".join(words)
        want = plain_score(text, lexicon)
        assert abs(own.score(text)[0] - want) < 1e-12, (text, own.score(text), want)
        seen.add(round(want, 6))
    assert len(seen) > 40


def test_recall_on_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("embedding IS NOT NULL").collect()
    x = np.array([v.embedding for v in rows], dtype=np.float64)
    ids, unit = np.array([v.vec_id for v in rows]), x / np.linalg.norm(x, axis=1, keepdims=True)
    got = annforest.nearest(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), F.col("vec_id") % 50 == 0).collect()
    hit = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[q]
        s[q] = -9
        best = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        hit += len(best & {g.vec_id for g in got if g.query_id == ids[q]})
    assert hit / (5 * (ids % 50 == 0).sum()) >= 0.9


def test_toxicity_held_out(spark):
    got = entry.op1_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r.held_out]
    pairs = [(a.score, b.score) for a in out if a.toxic for b in out if not b.toxic]
    assert sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs) > 0.9


def test_fit_without_labels(spark):
    docs = spark.createDataFrame([(1, "idiot"), (None, None)], "doc_id long, text string")
    for labels in ([], [(None, 1), (1, None)], [(2, 1), (2, 1), (3, 0)]):
        lex = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert lex.entries == ()
    assert [r.predicted for r in toxicity.score_documents(docs, lex).collect()] == [0, 0]


def test_unlabelled_words_are_unknown(spark):
    """What the lexicon knows comes from training rows alone: the most common words of held-out toxic texts aren't in it if no other row has them."""
    rows = [(i, " ".join(f"f{(i * 7 + k) % 50} zorbanikel" for k in range(9)) if i % 3 == 0 else " ".join(f"g{(i * 5 + k) % 50}" for k in range(9))) for i in range(300)]
    out = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    rows = [(i, t.replace("zorbanikel", "vexulamin") if i in out else t) for i, t in rows]
    lex = toxicity.fit(spark.createDataFrame(rows + rows[:9], "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    assert "zorbanikel" in {e.term for e in lex.entries} and not any(e.term.startswith("vexu") for e in lex.entries)


def test_misspelled_words_under_a_stem(spark):
    r, docs, labels = random.Random(3), [], []
    fill = lambda n: ["p" + "".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n)]
    terms = ["zorbanikel", "zorbelutan", "zorbitamos"]
    for i in range(240):
        toxic = i % 3 == 0
        words = fill(12)
        for t in terms if toxic else []:
            words.insert(r.randrange(1, len(words)), t)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    lex = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    by = {(e.term, e.stem): e for e in lex.entries}
    assert ("zorb", True) in by and all(by[t, False].edits == 2 for t in terms)
    own = toxicity.Scorer(lex)
    score = lambda t: own.score(f"some {t} text")[0]
    assert all(score(w) > 0.5 for w in ("zorbanikel", "zxrbanikel", "zobelutan", "sorvitamos"))
    assert all(score(w) < 0.5 for w in ("zxrvenikel", "plain"))
    assert toxicity.choose({"idio*": 90, "idiot": 40, "idioma": 50}) == [("idio", True), ("idiot", False), ("idioma", False)]
    assert toxicity.choose({"idio*": 90, "idiot": 89}) == [("idiot", False)]


def targets(sizes, weights=(1, 2, 3), most=3):
    """Round by round, as the contract words it."""
    w, out, free = [weights[i % 3] for i in range(len(sizes))], [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = sum(sizes) - sum(out[i] for i in range(len(sizes)) if i not in free)
        for i in free:
            out[i] = left * w[i] / sum(w[j] for j in free)
        above = {i for i in free if out[i] > most * sizes[i]}
        if not above:
            break
        for i in above:
            out[i] = float(most * sizes[i])
        free -= above
    return out


def test_targets(spark):
    assert targets([10, 10, 10]) == [5.0, 10.0, 15.0] and targets([100, 1, 1]) == [96.0, 3.0, 3.0]
    r = random.Random(3)
    for sizes in ([], [0, 0], [10, 10, 10], [100, 1, 1], [r.choice([0, 1, 5, 90, 4000]) for _ in range(300)]):
        names = [None if i == len(sizes) - 1 else chr(0xE000 + i) if i % 2 else f"{chr(0x1F300 + i)}" for i in range(len(sizes))]
        order = sorted(range(len(sizes)), key=lambda i: (names[i] is None, names[i] or ""))
        df = spark.createDataFrame(list(zip(names, sizes)), "source string, size long").repartition(3)
        got = {x.source: (x.ix, x.target) for x in mixing.with_targets(mixing.numbered(df)).collect()}
        want = targets([sizes[i] for i in order])
        assert all(got[names[i]][0] == k and abs(got[names[i]][1] - want[k]) < 1e-6 for k, i in enumerate(order)) and len(got) == len(sizes)


def test_permutations_and_draws():
    for n in (1, 2, 5, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 3).tolist()) == list(range(n))
    _, d = mixing.draw(70_010, 17, 3)
    assert d.sum() == 70_010 and len(d) == 17 and abs(d - 70_010 / 17).max() < 400


def taken_by_hand(rows, slots, sources):
    """Words that slots take of each row: blocks of each source's stream, rows in the order of their keys' buckets."""
    times = {}
    for s in slots:
        times[s.ix, s.block] = times.get((s.ix, s.block), 0) + 1
    ix, n, out = {s.source: s.ix for s in sources}, max(1, int(len(rows) ** 0.5)), []
    for name in ix:
        at = 0
        for r in sorted((r for r in rows if r.source == name), key=lambda r: (r.k1 % n, r.k1, r.k2)):
            out.append((r.doc_id, r.size, sum(times.get((ix[name], w // mixing.BLOCK_WORDS), 0) for w in range(at, at + r.size))))
            at += r.size
    return out


def test_mix(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" * r.randrange(1, 4) for _ in range(r.choice([0, 3, 200, 900]))), r.choice(["a", "b", "b", "b", None]), "x", 7) for i in range(60)]
    rows += [(100, None, "a", "x", 0), (None, "some words here", "é", "x", 0), rows[3], rows[3], (101, "x y " * 20000, "b", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string, n_chars long").repartition(4)
    got = mixing.Mix(df).taken().collect()
    again = mixing.Mix(df.repartition(7)).taken().collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    for t in {(r.source_size, r.target) for r in got}:
        taken = sum(r.taken for r in got if (r.source_size, r.target) == t)
        assert abs(taken - t[1]) <= mixing.BLOCK_WORDS
    own = mixing.Mix(df)
    slots, sources = own.slots().collect(), own.sources.collect()
    assert sorted(map(str, taken_by_hand(own.rows.collect(), slots, sources))) == sorted(str((r.doc_id, r.size, r.taken)) for r in got)
    for s in sources:
        blocks = [x.block for x in slots if x.ix == s.ix]
        assert len(blocks) == s.slots and all(0 <= b < s.blocks for b in blocks) and max((blocks.count(b) for b in set(blocks)), default=0) <= 3
    for shard in {s.shard for s in slots}:
        assert sorted(s.slot for s in slots if s.shard == shard) == list(range(sum(s.shard == shard for s in slots)))
    mixed = mixing.mix(df).collect()
    words = lambda t: len((t or "").split())
    assert sum(words(r.text) for r in mixed) == sum(r.taken for r in got) and all(r.n_chars == len(r.text) for r in mixed)
    assert mixing.Mix(df.limit(0)).taken().count() == 0


def test_line_dedup(spark):
    common = "all rights reserved everywhere"
    rows = [(i, f"own line number {i} is here and it is long enough\n {common} \nok {i}", f"s{i % 7}", "x") for i in range(21)]
    rows += [(50, None, "s1", "x"), (51, "", None, "x"), (52, common, "s2", "x"), (53, "two words\n" + common, None, "x"), rows[0], (54, f"{common}\n \n{common}", "s3", "x")]
    rows += [(60 + i, f"x{i}\nIbid.\n{common}", f"t{i % 9}", "x") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_removed string")
    got = linededup.remove_lines(df, min_sites=7, details=True).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[3].text == "own line number 3 is here and it is long enough\nok 3" and by[3].n_removed == 1
    assert by[50].text is None and by[51].text == "" and by[52].text == common and by[52].n_removed == 0
    assert by[53].text == "two words" and by[54].text == f"{common}\n \n{common}" and (by[64].text, by[64].n_removed) == ("x4", 2)
    kept = linededup.remove_lines(df, min_sites=18)
    assert kept.columns == df.columns and sorted(str(r.text) for r in kept.collect()) == sorted(str(r[1]) for r in rows)
    assert linededup.remove_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("gap", ["\t", "\u00a0", "", " "])
def test_line_dedup_removes_lines_whatever_their_words_and_share(spark, gap):
    passage = gap.join(f"shared{k}" for k in range(60))
    own = "words that only this text has and nobody else wrote "
    df = spark.createDataFrame([(i, f"{own}{i}\n{passage}\nIbid. {i}", f"s{i}") for i in range(8)], "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in linededup.remove_lines(df).collect()}
    assert got == {i: f"{own}{i}\nIbid. {i}" for i in range(8)}


def test_line_dedup_equals_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = c.execute(linededup.sql()).fetchall()
    got = entry.op5_line_dedup(spark, SF).select("doc_id", "n_lines", "n_removed", "text_md5").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_url_parts_and_rules(spark):
    urls = [None, "", "nohost", "http://A.Example.NET/en/x?q#f", "x://net", "x://b.net/", "https://example.com/de/1", "https://m.org/fr/?a", "https://org/fr", "https://badexample.net/en/", "a://h?x/y", "a://h#x", "y://" + "p" * 3000 + ".net/q"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urlfilter.judge(df, (-1.0, {})).collect()}
    parts = [("", ""), ("", ""), ("", ""), ("a.example.net", "/en/x"), ("net", ""), ("b.net", "/"), ("example.com", "/de/1"), ("m.org", "/fr/"), ("org", "/fr"), ("badexample.net", "/en/"), ("h", ""), ("h", ""), ("p" * 3000 + ".net", "/q")]
    rule = [None, None, None, "example.net/en/", None, "net/", "example.com/de/", "org/fr/", None, "net/", None, None, "net/"]
    for i in range(len(urls)):
        assert (got[i].host, got[i].path, got[i].rule) == (*parts[i], rule[i]), urls[i]
    assert got[3].verdict == "allow" and got[5].verdict == "block" and got[0].verdict == "allow"


def url_buckets(host, path):
    import xxhash

    grams = {(m, s[i : i + 4]) for m, s in (("h", f"^{host}$"), ("p", f"^{path}$")) for i in range(max(1, len(s) - 3))}
    h = lambda m, g: xxhash.xxh64(g.encode(), seed=xxhash.xxh64(m.encode(), seed=42).intdigest()).intdigest()
    return {(x - (1 << 64) if x >> 63 else x) % urlfilter.BUCKETS for x in (h(m, g) for m, g in grams)}


def url_model(rows):
    """Logistic regression over bucket weights by plain gradient steps: what training does in its dual form."""
    urls = sorted({u for u, _ in rows})
    y = np.array([np.mean([v for w, v in rows if w == u]) for u in urls])
    x = np.zeros((len(urls), urlfilter.BUCKETS))
    for i, u in enumerate(urls):
        host, slash, path = u.partition("://")[2].partition("/")
        own = url_buckets(host.lower(), (slash + path).partition("?")[0].partition("#")[0])
        x[i, list(own)] = 1 / len(own) ** 0.5
    w, c = np.zeros(urlfilter.BUCKETS), 0.0
    for _ in range(urlfilter.STEPS):
        error = y - 1 / (1 + np.exp(-(x @ w + c)))
        w, c = w * (1 - urlfilter.DECAY) + urlfilter.RATE * (x.T @ error), c + urlfilter.RATE * error.sum() / len(urls)
    return c, w


def test_url_model(spark):
    table = urlfilter.labelled(spark)
    model = urlfilter.train(table)
    want = url_model([(r.url, r.label) for r in table.collect()])
    assert abs(model[0] - want[0]) < 1e-9 and all(abs(want[1][b] - model[1].get(b, 0.0)) < 1e-9 for b in range(urlfilter.BUCKETS))
    df = spark.createDataFrame([(1, "http://poker-room.shop.example/x"), (2, "http://museum.city.example/en/4"), (3, "http://casino-night.example/"), (4, "http://observatory.example/"), (5, None)], "page_id long, url string")
    got = {r.page_id: r for r in urlfilter.judge(df, model, rules=()).collect()}
    assert [got[i].verdict for i in (1, 2, 3, 4)] == ["block", "allow", "block", "allow"]
    intercept, weights = model
    for r in got.values():
        own = url_buckets(r.host, r.path)
        z = intercept + sum(weights.get(b, 0.0) for b in own) / len(own) ** 0.5
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9
    assert urlfilter.judge(df.limit(0), model).count() == 0
    assert urlfilter.train(spark.createDataFrame([], "url string, label int")) == (-1.0, {})


def test_nearest(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(300, 8)))]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [1.0, None] + [0.0] * 6), (1003, [float("nan")] * 8), (1004, [1.0, 2.0]), (None, [1.0] * 8), (7, rows[7][1]), (2000, rows[7][1]), (1050, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(shards, "LEAST_ROWS", 100)
    monkeypatch.setattr(shards, "SHARD_ROWS", 100)
    got = annforest.nearest(df, F.col("vec_id") % 50 == 0).collect()
    ids = np.array([i for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and x == x for x in v) and any(v)])
    x = np.array([v for i, v in rows if i is not None and v and len(v) == 8 and all(y is not None and y == y for y in v) and any(v)])
    for q in range(0, 300, 50):
        v = np.array(rows[q][1])
        s = x @ v / np.linalg.norm(x, axis=1) / np.linalg.norm(v)
        best = sorted(((-a, b) for a, b in zip(s, ids) if b != q))[:5]
        own = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q)
        assert [o[1] for o in own] == [b for _, b in best] and np.allclose([o[2] for o in own], [-a for a, _ in best], atol=1e-12)
    assert {g.query_id for g in got} == {*range(0, 300, 50), 2000}
    assert annforest.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("n", [1000, 6000])
def test_recall(n):
    """Vectors without any structure; far fewer rows are met than there are."""
    r = np.random.default_rng(6)
    x = r.normal(size=(n, 64)).astype(np.float32)
    ids = np.arange(len(x))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q, found, _ in annforest.Index(ids, x, 5).best(ids[:100], x[:100]):
        s = unit @ unit[q]
        s[q] = -9
        hit += len(set(found) & set(np.argsort(-s)[:5]))
    assert hit / 500 >= 0.9
    assert annforest.LEAST + annforest.SHARE * 6000 < 2400


def test_nearest_whatever_the_order_of_rows(spark):
    """Vectors for which not every neighbour is found: another order and other partitions give the same ones."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    one = annforest.nearest(df.orderBy(F.rand(1)).repartition(5), F.col("vec_id") % 50 == 0).collect()
    other = annforest.nearest(df.orderBy(F.rand(2)).repartition(2), F.col("vec_id") % 50 == 0).collect()
    assert sorted(one) == sorted(other) and len(one) == 200
    with pytest.raises(TypeError):
        annforest.nearest(df.withColumn("vec_id", F.col("vec_id").cast("string")), F.lit(True))


def test_nearest_of_integers(spark):
    df = spark.createDataFrame([(0, [1, 0]), (1, [2, 0]), (2, [0, 1])], "vec_id long, embedding array<int>")
    got = annforest.nearest(df, F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1, 1.0), (2, 2, 0.0)]


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_take_an_empty_table(spark, stage):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.STAGES[stage][1](spark, docs.limit(0), SF)
    assert out.count() == 0 and (stage == 4 or out.columns == docs.columns)
