"""Toxicity: Levenshtein automata intersected with a lexicon trie, then context windows.

The lexicon is learned from labelled documents, and from nothing else: words, and
stems (prefixes of 4 to 7 letters), whose distinct left neighbours speak for the
label far beyond chance. Counting left neighbours rather than documents keeps the
words of a much-copied document out.

Every distinct word runs through one automaton that accepts what lies within the
allowed edits of a lexicon word, or starts with a lexicon stem (learned words under
a stem are lexicon words as well); its states are sets of trie nodes with edits so far, made when first needed. A word of 5 to 8
letters may differ by one edit, a longer one by two, a shorter one by none.

A hit's weight is a log-likelihood ratio from training: of the word itself where
training had it often enough, else of its stem, or of misspellings of its entry.
A hit inside quotation marks counts less, still less near a word of reporting;
one near an address to the reader counts more. A text's distinct unquoted words
add up as independent evidence on top of the label's prior odds; of quoted ones
only the strongest counts, so quoting alone doesn't make a text abusive.

Cases: null and empty texts have no hits and the base score; repeated rows give
repeated rows; without labels of both kinds the lexicon is empty, and all texts have
the base score; whole texts are read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeforge.llm import common

#: Bounds of the sample that the lexicon is learned from, by hash order of doc_id.
MAX_TOXIC_ROWS, MAX_CLEAN_ROWS = 3000, 6000
#: Least number of distinct left neighbours in toxic texts that a lexicon term has.
LEAST_NEIGHBOURS = 5
#: Weight (log-likelihood ratio) of an entry that training saw in misspellings only.
UNSEEN_WEIGHT = 4.3
#: Prior odds (logarithm) without labels, and what a text without hits has less than the prior.
PRIOR, NO_HITS = -2.2, 2.0
#: Least precision of a lexicon entry, and the chance allowed for any wrong one.
PRECISION, ALPHA = 0.6, 0.01
#: Probability that a misspelling whose kind training didn't show is toxic, and how many cases that counts as.
FUZZY_PRIOR, FUZZY_CASES = 0.6, 2.0
#: Times that training must have had a word for its own weight to count, beside its stem's.
OWN_CASES = 3
#: Words around a hit that its context is made of.
WINDOW = 8
QUOTED, QUOTED_AND_REPORTED, ADDRESSED = 0.5, 0.25, 1.2
REPORTING = frozenset("said says saying called calls wrote writes quoted quote quotes word words term terms dit écrit sagte schrieb wort dijo escribió palabra".split())
ADDRESS = frozenset("you your yours yourself dich dein toi vous votre usted".split())
_WORD = re.compile(r"[^\W_]+")
_LEET = str.maketrans("013457", "oieast")
_OPEN, _CLOSE = "\"“«„‘", "\"”»“’"


@dataclass(frozen=True)
class Entry:
    term: str
    stem: bool
    #: Log-likelihood ratio of the entry, or of a word of the stem that training didn't have.
    weight: float
    #: The same of a misspelling; None where misspellings don't count.
    fuzzy: float | None = None

    @property
    def edits(self) -> int:
        return 0 if self.fuzzy is None or len(self.term) < 5 else 1 if len(self.term) < 9 else 2


@dataclass(frozen=True)
class Lexicon:
    entries: tuple[Entry, ...]
    #: Logarithm of the prior odds.
    prior: float = PRIOR
    #: Weights of words that training had; for misspelling-like words that it shows to be innocent, 0.
    known: tuple[tuple[str, float], ...] = ()


class Automaton:
    """Union of the entries' Levenshtein automata, determinised as words come by."""

    MOST_STATES = 20_000

    def __init__(self, lexicon: Lexicon) -> None:
        self.entries = lexicon.entries
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.most: list[int] = [0]
        for k, e in enumerate(self.entries):
            node = 0
            self.most[0] = max(self.most[0], e.edits)
            for ch in e.term:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.word.append(-1)
                    self.stem.append(-1)
                    self.most.append(0)
                node = self.children[node][ch]
                self.most[node] = max(self.most[node], e.edits)
            (self.stem if e.stem else self.word)[node] = k
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[dict[int, int]] = [{}]
        self.next: list[dict[str, int]] = [{}]
        self.accepts: list[tuple[int, int] | None] = [None]
        self.start = self._state(self._closure({0: 0}))

    def _closure(self, nodes: dict[int, int]) -> dict[int, int]:
        """Also the nodes that are reached by leaving out letters of an entry."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            e = nodes[node] + 1
            for child in self.children[node].values():
                if e <= self.most[child] and e < nodes.get(child, 9):
                    nodes[child] = e
                    todo.append(child)
        return nodes

    def _state(self, nodes: dict[int, int]) -> int:
        """Id of a set of nodes; 0 is the dead state, -1 - k the acceptance of the stem of entry k."""
        for node, e in nodes.items():
            if not e and self.stem[node] >= 0:
                return -1 - self.stem[node]
        if not nodes:
            return 0
        key = tuple(sorted(nodes.items()))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(nodes)
            self.next.append({})
            ends = [(e, self.word[n]) for n, e in nodes.items() if self.word[n] >= 0 and e <= self.entries[self.word[n]].edits]
            self.accepts.append(min(ends) if ends else None)
        return self.ids[key]

    def _grow(self, state: int, ch: str) -> int:
        out: dict[int, int] = {}

        def add(node: int, e: int) -> None:
            if e <= self.most[node] and e < out.get(node, 9):
                out[node] = e

        for node, e in self.sets[state].items():
            if (child := self.children[node].get(ch)) is not None and e < out.get(child, 9):
                out[child] = e
            if e < 2:
                add(node, e + 1)
                for child in self.children[node].values():
                    add(child, e + 1)
        self.next[state][ch] = found = self._state(self._closure(out))
        return found

    def match(self, word: str) -> tuple[int, int] | None:
        """The nearest entry, as (edits, index), or None."""
        if len(self.sets) > self.MOST_STATES:
            self._reset()
        state = self.start
        for ch in word:
            found = self.next[state].get(ch)
            if found is None:
                found = self._grow(state, ch)
            if found <= 0:
                return (0, -1 - found) if found else None
            state = found
        return self.accepts[state]


class Scorer:
    """Scores texts; keeps what it knows about words, within bounds."""

    MOST_WORDS = 100_000
    #: ASCII letters to lower case, other ASCII but digits to spaces.
    TABLE = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.automaton, self.known = lexicon, Automaton(lexicon), dict(lexicon.known)
        self.clean: set[bytes] = set()
        self.bad: set[bytes] = set()

    def weight(self, word: str) -> tuple[float, int, int] | None:
        """Weight, edits and entry of a lower-case word."""
        found = self.automaton.match(word)
        if found is None and not word.isalpha() and not word.isdigit():
            found = self.automaton.match(word.translate(_LEET))
            found = found and (max(1, found[0]), found[1])
        if found is None:
            return None
        entry = self.lexicon.entries[found[1]]
        weight = self.known.get(word, entry.fuzzy if found[0] else entry.weight)
        return (weight, *found) if weight and weight > 0 else None

    def _suspect(self, raw: bytes) -> bool:
        word = raw.decode("utf-8", "replace").lower()
        return any(self.weight(w) for w in ([word] if word.isalnum() else _WORD.findall(word)))

    def hits(self, text: str) -> list[tuple[int, int, int, int, float, bool]]:
        """Of each hit: start and stop in the lower-case text, entry, edits, weight in its context, whether it is quoted, the word."""
        words = text.encode("utf-8", "replace").translate(self.TABLE).split()
        distinct = set(words)
        new = distinct - self.clean - self.bad
        if new:
            if len(self.clean) + len(self.bad) > self.MOST_WORDS:
                self.clean.clear()
                self.bad.clear()
                new = distinct
            found = {w for w in new if self._suspect(w)}
            self.bad |= found
            self.clean |= new - found
        if distinct.isdisjoint(self.bad):
            return []
        low = text.lower()
        tokens = [(m[0], m.start(), m.end()) for m in _WORD.finditer(low)]
        out = []
        for i, (word, a, b) in enumerate(tokens):
            found = self.weight(word)
            if not found:
                continue
            left, right = max(0, i - WINDOW), min(len(tokens), i + WINDOW + 1)
            around = {w for w, _, _ in tokens[left:right]}
            quoted = self._quoted(low, tokens[left][1] - 1, a, b, tokens[right - 1][2] + 1)
            weight = found[0]
            if quoted:
                weight *= QUOTED_AND_REPORTED if around & REPORTING else QUOTED
            elif around & ADDRESS:
                weight *= ADDRESSED
            out.append((a, b, found[2], found[1], weight, quoted, word))
        return out

    @staticmethod
    def _quoted(low: str, first: int, a: int, b: int, last: int) -> bool:
        """Whether an opening mark before and a closing one after enclose the hit, both within the window."""
        before, after = low[max(0, first) : a], low[b:last]
        i = max(before.rfind(q) for q in _OPEN)
        j = min((k for q in _CLOSE if (k := after.find(q)) >= 0), default=-1)
        if i < 0 or j < 0:
            return False
        opens = i == 0 or not before[i - 1].isalnum()
        closes = j + 1 >= len(after) or not after[j + 1].isalnum()
        return opens and closes and (i + 1 >= len(before) or not before[i + 1].isspace())

    def score(self, text: str | None) -> tuple[float, list]:
        hits = self.hits(text) if text else []
        if not hits:
            return 1 / (1 + math.exp(NO_HITS - self.lexicon.prior)), hits
        own: dict[str, float] = {}
        for *_, weight, quoted, word in hits:
            if not quoted:
                own[word] = max(weight, own.get(word, 0.0))
        total = self.lexicon.prior + sum(own.values()) + max((h[4] for h in hits if h[5]), default=0.0)
        return 1 / (1 + math.exp(-min(30.0, total))), hits


@lru_cache(1)
def scorer(lexicon: Lexicon) -> Scorer:
    return Scorer(lexicon)


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(documents: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> Lexicon:
    """Learn the lexicon from a bounded sample of the labelled documents that aren't held out.

    Null ids and labels take no part. A document with several labels counts as toxic if one says so.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_toxic")).dropna()
    known = known.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    order = [F.xxhash64("_id"), F.col("_id")]
    sample = known.where("_toxic = 1").orderBy(*order).limit(MAX_TOXIC_ROWS).unionByName(known.where("_toxic = 0").orderBy(*order).limit(MAX_CLEAN_ROWS))
    texts = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    words = texts.select("_toxic", F.split(F.trim(F.regexp_replace(F.lower("_text"), r"[^\p{L}\p{N}]+", " ")), " ").alias("_words"))
    pair = F.explode(F.transform("_words", lambda w, i: F.struct(w.alias("w"), F.when(i > 0, F.get("_words", i - 1)).otherwise("").alias("left"))))
    pairs = common.cut(words.select("_toxic", pair.alias("p")).select("_toxic", "p.w", "p.left").where("w <> ''").distinct(), "toxicity-pairs")

    def terms(df: DataFrame) -> DataFrame:
        each = [F.col("w")] + [F.when(F.length("w") > k, F.concat(F.substring("w", 1, k), F.lit("*"))) for k in range(4, 8)]
        return df.select("left", F.explode(F.array_compact(F.array(*each))).alias("term"))

    count = lambda df: {r["_toxic"]: r["n"] for r in df.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    total, labels_of = count(pairs), count(known)
    prior = math.log((labels_of.get(1, 0) + 1) / (labels_of.get(0, 0) + 9))
    good: dict[str, int] = {}
    if total.get(1) and total.get(0):
        toxic = terms(pairs.where("_toxic = 1")).distinct().groupBy("term").agg(F.count("*").alias("t")).where(F.col("t") >= LEAST_NEIGHBOURS)
        toxic = common.cut(toxic, "toxicity-terms")
        clean = terms(pairs.where("_toxic = 0")).join(toxic.select("term"), "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("c"))
        spoken = toxic.join(clean, "term", "left").withColumn("c", F.coalesce("c", F.lit(0)))
        good = {r["term"]: r["t"] for r in spoken.where(speaks(F.col("t"), F.col("c"), total[1] / (total[1] + total[0]), max(1, toxic.count()))).collect()}
        common.drop_scratch(toxic)
    lexicon = weighted(pairs, choose(good), total.get(1, 0), total.get(0, 0), prior)
    common.drop_scratch(pairs)
    return lexicon


def speaks(t, c, base: float, terms: int) -> F.Column:
    """Whether t distinct neighbours in toxic texts and c in clean ones speak for the label beyond the chance that one of so many terms does."""
    p = t / (t + c)
    bits = p * F.log(p / base) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - base))).otherwise(0.0)
    return (p >= PRECISION) & (p > base) & ((t + c) * bits >= math.log(terms / ALPHA))


def choose(good: dict[str, int]) -> list[tuple[str, bool]]:
    """Of terms that speak for the label, with their numbers of neighbours: entries, and whether they are stems.

    A stem stands for longer stems that it covers, unless one longer term covers nearly all of that. Words stay entries under a stem too, for their misspellings.
    """
    stems: list[str] = []
    kept: list[tuple[str, bool]] = []
    for term in sorted(good, key=lambda x: (len(x.rstrip("*")), not x.endswith("*"), x)):
        body = term.rstrip("*")
        if term.endswith("*"):
            if any(body.startswith(s) for s in stems):
                continue
            if max((good[x] for x in good if x != term and x.startswith(body)), default=0) >= 0.95 * good[term]:
                continue
            stems.append(body)
        kept.append((body, term.endswith("*")))
    return kept


def weighted(pairs: DataFrame, terms: list[tuple[str, bool]], n_toxic: int, n_clean: int, prior: float) -> Lexicon:
    """Weights of the entries, of their misspellings, and of the words of training that they match. n_toxic, n_clean: all pairs of a label, the unit of the counts."""
    plain = Lexicon(tuple(Entry(t, stem, UNSEEN_WEIGHT, None if stem else 1.0) for t, stem in terms), prior)
    fuzzy = math.log(FUZZY_PRIOR / (1 - FUZZY_PRIOR)) - prior
    if not n_toxic or not n_clean:
        return Lexicon(tuple(Entry(e.term, e.stem, e.weight, fuzzy) for e in plain.entries), prior)

    def run(batches):
        automaton = Automaton(plain)
        for batch in batches:
            found = [automaton.match(w) for w in batch.column(0).to_pylist()]
            keep = [i for i, x in enumerate(found) if x]
            picked = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, *(pa.array([found[i][k] for i in keep], pa.int64()) for k in (0, 1))], names=["w", "n_toxic", "n_clean", "edits", "entry"])

    counts = pairs.groupBy("w").agg(F.count_if(F.col("_toxic") == 1).alias("n_toxic"), F.count_if(F.col("_toxic") == 0).alias("n_clean"))
    near = common.map_arrow(counts, run, "w string, n_toxic long, n_clean long, edits long, entry long").collect()

    def ratio(t: float, c: float) -> float:
        return math.log((t + 0.5) / (c + 1.0)) + math.log(n_clean / n_toxic)

    # A word under a stem is matched as the stem's, so its own counts are found by the word.
    seen = {r.w: (r.n_toxic, r.n_clean) for r in near if not r.edits}
    entries, known = [], {}
    for k, e in enumerate(plain.entries):
        exact = [r for r in near if r.entry == k and not r.edits]
        others = [r for r in near if r.entry == k and r.edits]
        t, c = seen.get(e.term, (0, 0))
        if e.stem:
            # The stem alone is often a common word; words that training hadn't get half of what the others have.
            rest = [r for r in exact if r.w != e.term]
            weight = 0.5 * ratio(sum(r.n_toxic for r in rest), sum(r.n_clean for r in rest))
        else:
            weight = ratio(t, c) if t + c else UNSEEN_WEIGHT
        known |= {r.w: max(0.0, ratio(r.n_toxic, r.n_clean)) for r in exact if r.n_toxic + r.n_clean >= OWN_CASES}
        known |= {r.w: 0.0 for r in others if r.n_clean}
        more = max(0.0, sum(r.n_toxic for r in others) - sum(r.n_clean for r in others) * n_toxic / n_clean)
        p = (FUZZY_PRIOR * FUZZY_CASES + more) / (FUZZY_CASES + more + sum(r.n_clean for r in others))
        entries.append(Entry(e.term, e.stem, weight, None if e.stem else min(weight, math.log(p / (1 - p)) - prior)))
    return Lexicon(tuple(entries), prior, tuple(sorted(known.items())))


def score_documents(df: DataFrame, lexicon: Lexicon, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, score, predicted and hits: the spans (in the lower-case text), the terms, and whether they are quoted."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_())]))

    def run(batches):
        own = scorer(lexicon)
        for part in common.rows(batches):
            found = [own.score(t) for t in part.column(0).to_pylist()]
            hits = [[{"start": a, "stop": b, "term": lexicon.entries[k].term, "edits": e, "quoted": q} for a, b, k, e, _, q, _ in h] for _, h in found]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= 0.5) for s, _ in found], pa.int32()), pa.array(hits, kind)],
                names=[*keep, "score", "predicted", "hits"],
            )

    kept = df.select(F.col(text_col).alias("_text"), *keep)
    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)
    return common.map_arrow(kept, run, f"{schema}, score double, predicted int, hits array<struct<start:int,stop:int,term:string,edits:int,quoted:boolean>>")


def keep_clean(df: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is under one half."""
    at = df.columns.index(text_col)

    def run(batches):
        own = scorer(lexicon)
        for part in common.rows(batches, at):
            yield part.filter(pa.array([own.score(t)[0] < 0.5 for t in part.column(at).to_pylist()], pa.bool_()))

    return common.map_arrow(df, run, df.schema)
