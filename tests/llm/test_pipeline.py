"""The pipeline against plain stages, on made-up documents with every odd row."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from noticeforge.llm import bpe, common, mixing, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, line string, _text string"


def documents():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randrange(3, 8)))
    passage = " ".join(word() for _ in range(60))
    texts = ["\n".join(" ".join(word() for _ in range(r.choice([4, 12, 40]))) for _ in range(r.randrange(1, 5))) for _ in range(40)]
    texts += [f"{t}\n{passage}" for t in texts[:8]]
    texts += [texts[20], texts[20], texts[21] + " more", "Short line\n" + texts[22].upper()]
    texts += [" ".join(f"{word()} vexulamin" for _ in range(6)) for _ in range(30)]
    texts += [None, "", " \n\t", "x " * 9000, "ñ🙂 ok", passage, passage]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 6}" if i % 9 else None, len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "a null id alone", None, None, None, None, None)]


def plain_dedup(rows, sites=5):
    norm = lambda x: x.strip(" \t\r")
    where = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if norm(line):
                where.setdefault(norm(line), set()).add(r[3])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        rest = [x for x in lines if len(where.get(norm(x), ())) < sites]
        text = "\n".join(rest) if r[1] is not None and any(map(norm, rest)) else r[1]
        out.append((r[0], text, *r[2:4], None if text is None else len(text), *r[5:]))
    return out


def plain_groups(rows):
    sets = []
    for r in rows:
        w = [x for x in (r[1] or "").lower().replace("\n", " ").replace("\t", " ").split(" ") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    return [g if s else None for g, s in zip(group, sets)]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """Rows after each stage, and the folder of the tables."""
    sf, rows = str(tmp_path_factory.mktemp("sf")), documents()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{sf}/documents.parquet")
    labels = [(r[0], int("vexulamin" in (r[1] or ""))) for r in rows if r[0] is not None and r[0] % 2] + [(None, 1), (3, None)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, out = common.table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = common.cut(stage(spark, docs, sf), "test")
        assert name == corpus_pipeline.STAGES[-1][0] or after.schema == docs.schema
        out.append([tuple(r) for r in after.collect()])
        docs = after
    return rows, out, sf


def same(a, b):
    return Counter(map(str, a)) == Counter(map(str, b))


def test_toxic_documents_go(spark, run):
    rows, out, sf = run
    lexicon = toxicity.fit(common.table(spark, sf, "documents"), common.table(spark, sf, "labels"))
    score = toxicity.Scorer(lexicon).score
    assert same(out[0], [r for r in rows if score(r[1])[0] < 0.5])
    assert sum("vexulamin" in (r[1] or "") for r in out[0]) == 0 and len(out[0]) >= len(rows) - 31


def test_lines_go(run):
    _, out, _ = run
    assert same(out[1], plain_dedup(out[0]))
    assert any(a != b for a, b in zip(sorted(map(str, out[0])), sorted(map(str, out[1]))))


def test_one_of_each_group_stays(run):
    _, out, _ = run
    groups = plain_groups(out[1])
    assert same([r for r in out[2] if not (r[1] or "").split()], [r for r, g in zip(out[1], groups) if g is None])
    kept = [r for r in out[2] if (r[1] or "").split()]
    assert len(kept) == len({g for g in groups if g is not None}) and all(r in out[1] for r in kept)
    for r in kept:
        (own,) = {g for x, g in zip(out[1], groups) if x == r}
        ids = [x[0] for x, g in zip(out[1], groups) if g == own and x[0] is not None]
        assert r[0] == min(ids, default=None)


def test_the_mix_takes_its_words(spark, run):
    _, out, _ = run
    taken = {r.doc_id: r.taken for r in mixing.Mix(spark.createDataFrame(out[2], COLUMNS)).taken().collect()}
    got, text = Counter(), {r[0]: r[1] for r in out[2]}
    for r in out[3]:
        words, at = (r[1] or "").split(), 0
        got[r[0]] += len(words)
        own = text[r[0]].split()
        for w in words:  # in the order of the document
            at = own.index(w, at) + 1
        assert r[4] == len(r[1])
    assert {k: v for k, v in taken.items() if v} == dict(got)


def test_texts_are_encoded(spark, run):
    import public_tokenizers
    import tiktoken

    _, out, sf = run
    vocab = bpe.vocabulary(bpe.default_path())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    want = Counter((r[0], r[3], tuple(enc.encode_ordinary(r[1]))) for r in out[3])
    whole = corpus_pipeline.run(spark, sf)
    assert whole.columns == ["doc_id", "source", "ids", "piece_offsets", "n_tokens"]
    assert Counter((r.doc_id, r.source, tuple(r.ids)) for r in whole.collect()) == want
    assert whole.where(F.col("n_tokens") != F.size("ids")).isEmpty()
