"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows that tell quotation from abuse."""

from __future__ import annotations

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, release
from .langid import held_out

#: Labelled rows that lexicon and weights are learned from, at most: those with the smallest hash of their id.
LABELLED_ROWS = 20_000
#: Odds of a term among toxic documents against clean ones that each half of the labelled rows must show by itself.
CONFIRMED = 4
#: Share of the toxic documents that a term needs, and of those without a strong term that a weak one does.
TERM_SHARE, REST_SHARE = 0.02, 0.2
#: Lengths of stems.
PREFIXES = range(3, 9)
#: Least length of a word, and of a stem, that may be met with one edit.
FUZZY_WORD, FUZZY_STEM = 4, 4
#: Length of a word and of a stem, and share of the toxic documents, from which an edit costs no more; below, the power by which it does.
FULL_WORD, FULL_STEM, FULL_SHARE, COST = 5, 8, 0.05, 3
WINDOW = 8
STATES = 50_000
KNOWN_CLEAN = 100_000

_EDGE = "\"'`.,;:!?()[]{}<>|*#$%&~_-+=/\\«»„“”‚‘’…¡¿–—"
_QUOTES = set("\"“”„«»‹›")
#: Words that report speech, and words that address a person, in the languages of the corpus.
_REPORT = set("said says wrote writes quote quoted quotes term word phrase called reported according cited sagte schrieb zitat wort begriff dit écrit mot terme cité dijo escribió cita palabra término".split())
_ADDRESS = set("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes vosotros".split())

EXACT, FUZZY, WEAK = 1, 2, 3
FEATURES = 4
#: What each further term of a text, other than the first, adds to what all count: one chance hit is common, several are not.
APART = 0.25
#: What a term met with an edit counts.
NEAR = 0.8
#: Clean documents where an edit costs no more, and share of the rate among toxic ones, from which a word near a term counts as an ordinary word.
NEIGHBOUR_DOCUMENTS, NEIGHBOUR_RATE = 2, 0.5
#: Ordinary words near a term, above which an edit of it tells nothing, and near all terms of equal first letters, from which an edit counts half.
CROWD = 20


class FuzzyLexicon:
    """A trie of words and stems walked by a Levenshtein automaton of one edit.

    A state of the product is a set of (trie node, edits, pending letter); the pending letter is the second half
    of a swap. States are made when first met and kept as a deterministic automaton, so a word costs one table
    look-up per letter and most words end in the dead state after a few. A stem accepts whatever follows it.
    With `fuzzy`, only those entries are met with an edit. `near` has what an entry met so counts, NEAR if it is missing.
    """

    def __init__(self, words: list[str], stems: list[str], fuzzy: list[str] | None = None, near: dict[str, float] | None = None):
        fuzzy, near = fuzzy if fuzzy is None else {*fuzzy}, near or {}
        self.child: list[dict[str, int]] = [{}]
        self.word_len: dict[int, int] = {}
        self.stem_len: dict[int, int] = {}
        self.near: dict[int, tuple[float, str]] = {}
        self.entry = ""  # the entry that the last word was near to
        for entries, ends in ((words, self.word_len), (stems, self.stem_len)):
            for entry in entries:
                node = 0
                for c in entry:
                    nxt = self.child[node].get(c)
                    if nxt is None:
                        nxt = len(self.child)
                        self.child.append({})
                        self.child[node][c] = nxt
                    node = nxt
                ends[node] = len(entry) if fuzzy is None or entry in fuzzy else 0
                self.near[node] = max(self.near.get(node, (0.0, "")), (near.get(entry, NEAR), entry))
        self._reset()

    def _reset(self) -> None:
        self.number: dict[frozenset, int] = {frozenset(): 0}
        self.states: list[frozenset] = [frozenset()]
        self.moves: list[dict[str, int]] = [{}]
        self.accept: list[int] = [0]
        self.always: list[int] = [0]
        self.accept_near: list[tuple[float, str]] = [(0.0, "")]
        self.always_near: list[tuple[float, str]] = [(0.0, "")]
        self.start = self._state({(0, 0, "")})

    def _state(self, items: set) -> int:
        items = set(items)
        for node, edits, pending in [*items]:
            if edits == 0 and not pending:
                items.update((x, 1, "") for x in self.child[node].values())  # a letter left out
        # what is reached with no edit needs no copy with one
        key = frozenset(i for i in items if not (i[1] == 1 and not i[2] and (i[0], 0, "") in items))
        got = self.number.get(key)
        if got is None:
            got = self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            word = stem = 0
            word_near = stem_near = (0.0, "")
            for node, edits, pending in key:
                if pending:
                    continue
                if node in self.word_len and (edits == 0 or self.word_len[node] >= FUZZY_WORD):
                    word = EXACT if edits == 0 or word == EXACT else FUZZY
                    word_near = max(word_near, self.near[node])
                if node in self.stem_len and (edits == 0 or self.stem_len[node] >= FUZZY_STEM):
                    stem = EXACT if edits == 0 or stem == EXACT else FUZZY
                    stem_near = max(stem_near, self.near[node])
            self.always.append(stem)
            self.always_near.append(stem_near)
            self.accept_near.append(max(word_near, stem_near))
            self.accept.append(EXACT if EXACT in (word, stem) else word or stem)
        return got

    def _move(self, state: int, c: str) -> int:
        nxt = set()
        for node, edits, pending in self.states[state]:
            if pending:
                if c == pending:
                    nxt.add((node, edits, ""))
                continue
            down = self.child[node]
            if c in down:
                nxt.add((down[c], edits, ""))
            if edits == 0:
                nxt.add((node, 1, ""))  # a letter too many
                for a, x in down.items():
                    if a != c:
                        nxt.add((x, 1, ""))  # another letter
                        if c in self.child[x]:
                            nxt.add((self.child[x][c], 1, a))  # two letters swapped
        got = self.moves[state][c] = self._state(nxt) if nxt else 0
        return got

    def match(self, word: str) -> int:
        """0, EXACT or FUZZY."""
        return self.meet(word)[0]

    def meet(self, word: str) -> tuple[int, float]:
        """0, EXACT or FUZZY, and what the hit counts."""
        if len(self.states) > STATES:
            self._reset()
        state, moves, best, near = self.start, self.moves, 0, (0.0, "")
        for c in word:
            nxt = moves[state].get(c)
            state = self._move(state, c) if nxt is None else nxt
            if not state:
                break
            if self.always[state]:
                if self.always[state] == EXACT:
                    return EXACT, 1.0
                best, near = FUZZY, max(near, self.always_near[state])
        got = self.accept[state]
        if got == EXACT:
            return EXACT, 1.0
        if got:
            best, near = FUZZY, max(near, self.accept_near[state])
        self.entry = near[1]
        return best, near[0]


class Scorer:
    """Features and scores of whole texts under a model."""

    def __init__(self, model: dict):
        self.model = model
        self.lexicon = FuzzyLexicon(model["words"], model["stems"], model["fuzzy"], model.get("near"))
        self.weak = FuzzyLexicon(model["weak_words"], model["weak_stems"], model.get("weak_fuzzy"), model.get("near"))
        self.neighbours = set(model["neighbours"])
        self.clean: set[str] = set()
        self.hits: dict[str, tuple[int, float]] = {}

    def meet(self, word: str) -> tuple[int, float]:
        """0, EXACT, FUZZY, or WEAK for a term that toxic documents only share with many clean ones, and what the hit counts: 1 if exact."""
        got, near = self.lexicon.meet(word)
        if got == EXACT:
            return got, near
        weak, weak_near = self.weak.meet(word)
        if weak == EXACT:
            return WEAK, weak_near
        if not (got or weak) or word in self.neighbours:
            return 0, 0.0
        self.entry = self.lexicon.entry if got else self.weak.entry
        return (got, near) if got else (WEAK, weak_near)

    def features(self, text: str | None) -> list[float]:
        """Logarithms of the abuse found, quoted, and by weak terms, and the share of hits among words.

        A hit counts 1, with an edit NEAR, or less for a short or rare term. Inside quotation marks, or with a reporting word near it, it counts as quoted unless the
        window also addresses someone; a second hit, an exclamation or an address in the window raises it, and so does every other term in the text.
        """
        if not text:
            return [0.0] * FEATURES
        tokens = text.lower().split()
        new = set(tokens)
        new -= self.clean
        found = {}
        for t in new:
            hit = self.hits.get(t)
            if hit is None:
                bare = t.strip(_EDGE)
                hit = self.meet(bare) if bare else (0, 0.0)
                if hit[0]:
                    self.hits[t] = hit
                else:
                    self.clean.add(t)
                    continue
            found[t] = hit
        if len(self.clean) > KNOWN_CLEAN:
            self.clean.clear()
        if len(self.hits) > KNOWN_CLEAN:
            self.hits.clear()
        if not found:
            return [0.0] * FEATURES
        at = [k for k, t in enumerate(tokens) if t in found]
        places, opened, inside = set(at), False, set()
        for k, t in enumerate(tokens if not _QUOTES.isdisjoint(text) else ()):
            marks = sum(c in _QUOTES for c in t)
            if k in places and (opened or marks):
                inside.add(k)
            if marks % 2:
                opened = not opened
        sums, apart = [0.0, 0.0, 0.0], len({tokens[k].strip(_EDGE) for k in at})
        for k in at:
            near = [x.strip(_EDGE) for x in tokens[max(0, k - WINDOW) : k + WINDOW + 1]]
            addressed = not _ADDRESS.isdisjoint(near)
            quoted = (k in inside or not _REPORT.isdisjoint(near)) and not addressed
            others = any(max(0, k - WINDOW) <= j <= k + WINDOW and j != k for j in (k - 1, k + 1) if j in places)
            weight = 1.0 + 0.25 * addressed + 0.25 * others + 0.1 * ("!" in tokens[k])
            kind, counts = found[tokens[k]]
            sums[1 if quoted else 2 if kind == WEAK else 0] += weight * counts
        return [*(math.log1p(x * (1 + APART * (apart - 1))) for x in sums), min(1.0, 10 * len(at) / len(tokens))]

    def score(self, text: str | None) -> float:
        z = self.model["bias"] + sum(w * x for w, x in zip(self.model["weights"], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _terms(text: str) -> set[str]:
    """W:word and S:prefix for the words of a text."""
    words = {w for t in set(text.lower().split()) if (w := t.strip(_EDGE))}
    out = {"W:" + w for w in words}
    out.update("S:" + w[:n] for w in words for n in PREFIXES if n < len(w))
    return out


def _narrow(good: dict[str, int]) -> tuple[list[str], list[str]]:
    """Words and stems among good terms. Of a stem and its longer forms with nearly the same support, the longest stays; a word that a stem covers goes."""
    stems = {t[2:]: n for t, n in good.items() if t[0] == "S"}
    words = {t[2:]: n for t, n in good.items() if t[0] == "W"}
    longer: dict[str, int] = {}
    for s, n in [*stems.items(), *words.items()]:
        for k in range(PREFIXES.start, len(s)):
            longer[s[:k]] = max(longer.get(s[:k], 0), n)
    kept: list[str] = []
    for s in sorted((s for s, n in stems.items() if longer.get(s, 0) < 0.9 * n), key=lambda s: (len(s), s)):
        if not any(s.startswith(k) for k in kept):
            kept.append(s)
    best = lambda xs, of: sorted(xs, key=lambda x: (-of[x], x))
    return best([w for w in words if not any(w.startswith(s) for s in kept)], words), best(kept, stems)


def _odds(pos: int, neg: int, n_toxic: int, n_clean: int) -> float:
    return ((pos + 0.5) / (n_toxic + 1)) / ((neg + 0.5) / (n_clean + 1))


def _marking(counts: list[tuple], n_toxic: int, n_clean: int, share: float, level: bool = True) -> tuple[dict[str, int], dict[str, int]]:
    """(strong, weak) terms with their toxic documents, from (term, toxic documents, clean documents) for all rows and, if more follow, one half of them.

    A term needs 3 toxic documents and a share of them, so that the number of terms is bounded by that of a toxic document divided by the
    share. It is strong if at least four in five of its documents are toxic and its smoothed odds are 20 times those of clean documents, and weak
    with 8 times, and one in two if `level`. Each half of the rows must show CONFIRMED times the odds.
    """
    strong, weak = {}, {}
    for term, pos, neg, *half in counts:
        if pos < max(3, share * n_toxic) or level and pos < neg or (odds := _odds(pos, neg, n_toxic, n_clean)) < 8:
            continue
        if half and any(_odds(p, n, n_toxic / 2, n_clean / 2) < CONFIRMED for p, n in (half, (pos - half[0], neg - half[1]))):
            continue
        (strong if odds >= 20 and pos >= 4 * neg else weak)[term] = pos
    return strong, weak


def choose_lexicon(counts: list[tuple], n_toxic: int, n_clean: int, rest: tuple[list[tuple], int, int] | None = None) -> dict[str, list[str]]:
    """Terms that mark toxic documents. With `rest`, the counts in documents without a strong term, weak terms are those that REST_SHARE of the toxic ones among these have.

    Strong and weak terms of four letters or more may be met with an edit; `near` has what they count then, less for short and rare
    ones, as these are near too many other words.
    """
    strong, weak = _marking(counts, n_toxic, n_clean, TERM_SHARE)
    if rest is not None:
        more, weak = _marking(*rest, REST_SHARE, False)
        weak = {t: n for t, n in {**more, **weak}.items() if t not in strong}
    words, stems = _narrow(strong)
    weak_words, weak_stems = _narrow(weak)
    near: dict[str, float] = {}
    for kind, full, entries in (("W:", FULL_WORD, words + weak_words), ("S:", FULL_STEM, stems + weak_stems)):
        for x in entries:
            share = (strong.get(kind + x) or weak[kind + x]) / max(1, n_toxic)
            near[x] = max(near.get(x, 0.0), NEAR * (min(1.0, len(x) / full) * min(1.0, share / FULL_SHARE)) ** COST)
    return {"words": words, "stems": stems, "fuzzy": words + stems, "weak_fuzzy": weak_words + weak_stems, "near": near, "weak_words": weak_words, "weak_stems": weak_stems}


def fit_weights(x: np.ndarray, y: np.ndarray, prior: tuple = (2.0, 0.4, 1.0, 1.0), rounds: int = 30) -> tuple[float, list[float]]:
    """Logistic regression by Newton steps, drawn towards `prior`, so that a kind of hit no example shows keeps a sensible weight."""
    a = np.c_[np.ones(len(x)), x]
    w0 = np.r_[0.0, prior]
    pull = np.diag([1e-3, *[2.0] * len(prior)])
    w = w0.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        h = (a * (p * (1 - p))[:, None]).T @ a + pull
        step = np.linalg.solve(h, a.T @ (p - y) + pull @ (w - w0))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), [float(max(0.0, v)) for v in w[1:]]


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> dict:
    """A model from documents (doc_id, text) and labels (doc_id, toxic).

    At most `most` labelled ids are used, those with the smallest hash; their table is so bounded and is sent to the
    executors, where the texts are turned into term counts and features. An id that is labelled twice is
    toxic if any label says so; null labels and null texts are left out, and so are rows without an id. Other columns are not looked at, whatever
    their names. Without toxic examples the lexicon is empty and every score is the same low value.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    ids = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    def counting(strong: dict | None):
        def count(batches):
            scorer = None if strong is None else Scorer(strong)
            seen: dict[tuple, Counter] = {}
            for batch in batches:
                for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                    if scorer is not None and any(scorer.lexicon.match(w) == EXACT for t in set(text.lower().split()) if (w := t.strip(_EDGE))):
                        continue
                    seen.setdefault((toxic > 0, crc32(text.encode("utf-8", "replace")) & 1), Counter()).update({"", *_terms(text)})
            kinds = [seen.get(k, {}) for k in ((True, 0), (True, 1), (False, 0), (False, 1))]
            terms = [*{t: 0 for k in kinds for t in k}]
            p0, p1, n0, n1 = (np.array([k.get(t, 0) for t in terms], np.int64) for k in kinds)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *map(pa.array, (p0 + p1, n0 + n1, p0, n0))], ["term", *sums])

        sums = ["pos", "neg", "pos_half", "neg_half"]
        found = sample.mapInArrow(count, "term string, " + ", ".join(f"{c} long" for c in sums)).groupBy("term").agg(*[F.sum(c).alias(c) for c in sums])
        rows = found.where((F.col("term") == "") | (F.col("pos") >= 3) & (20 * F.col("pos") >= F.col("neg"))).collect()
        n_pos, n_neg = next(((r["pos"], r["neg"]) for r in rows if r["term"] == ""), (0, 0))
        return [tuple(r) for r in rows if r["term"]], n_pos, n_neg

    counts, n_pos, n_neg = counting(None)
    lexicon = choose_lexicon(counts, n_pos, n_neg)
    # weak terms are looked for where no strong one stands, as beside strong ones anything is as toxic
    strong = {**lexicon, "weak_words": [], "weak_stems": [], "fuzzy": [], "weak_fuzzy": [], "neighbours": []}
    lexicon = choose_lexicon(counts, n_pos, n_neg, counting(strong)) if lexicon["words"] or lexicon["stems"] else lexicon
    lexicon["neighbours"] = []
    model = {**lexicon, "bias": -3.0, "weights": [2.0, 0.4, 1.0, 1.0]}
    if not n_pos or not n_neg:
        return model

    def near(batches):
        scorer, found = Scorer(model), {False: Counter(), True: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found[toxic > 0].update({(w, scorer.entry, n) for t in set(text.lower().split()) if (w := t.strip(_EDGE)) and 0 < (n := scorer.meet(w)[1]) < 1})
        met = sorted({**found[True], **found[False]})
        cols = [*(pa.array([x[k] for x in met], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))), *(pa.array([found[k][x] for x in met], pa.int64()) for k in (True, False))]
        yield pa.RecordBatch.from_arrays(cols, ["word", "term", "counts", "pos", "neg"])

    # ordinary words that happen to be one edit from a term: those that are about as common in clean documents as in toxic ones,
    # and in more than one of them unless the term is short or rare; a term in a crowd of such words is met as it is written only
    ordinary = (
        sample.mapInArrow(near, "word string, term string, counts double, pos long, neg long").groupBy("word", "term", "counts").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where((F.col("neg") >= F.when(F.col("counts") < NEAR, 1).otherwise(NEIGHBOUR_DOCUMENTS)) & (F.col("neg") / n_neg >= NEIGHBOUR_RATE * F.col("pos") / n_pos))
    )
    # their number is bounded by the words of the labelled rows
    ordinary = ordinary.orderBy("word", "term").collect()
    crowd, family = Counter(r["term"] for r in ordinary), {}
    for r in ordinary:
        family.setdefault(r["term"][: PREFIXES.start], set()).add(r["word"])
    crowded = {t for t, n in crowd.items() if n > CROWD}
    for kind in ("fuzzy", "weak_fuzzy"):
        lexicon[kind] = model[kind] = [x for x in lexicon[kind] if x not in crowded]
    for x in lexicon["near"]:  # the more ordinary words there are near terms of its kind, the more there are that no labelled row has
        lexicon["near"][x] /= 1 + len(family.get(x[: PREFIXES.start], ())) / CROWD
    lexicon["neighbours"] = model["neighbours"] = sorted({r["word"] for r in ordinary if r["term"] not in crowded})

    def featurise(batches):
        scorer = Scorer(model)
        for batch in batches:
            got = [scorer.features(t) for t in batch.column("text").to_pylist()]
            cols = [pa.array([g[k] for g in got], pa.float64()) for k in range(FEATURES)]
            yield pa.RecordBatch.from_arrays([*cols, batch.column("toxic").cast(pa.int32())], [*names, "y"])

    names = [f"x{k}" for k in range(FEATURES)]
    seen = sample.mapInArrow(featurise, ", ".join(f"{n} double" for n in names) + ", y int").groupBy(*names, "y").count().orderBy(*names, "y").collect()
    times = [r["count"] for r in seen]
    x = np.repeat(np.array([[r[n] for n in names] for r in seen]), times, axis=0)
    bias, weights = fit_weights(x, np.repeat(np.array([float(r["y"] > 0) for r in seen]), times))
    return {**lexicon, "bias": bias, "weights": weights}


def score(model: dict, spark, text: Column) -> Column:
    """The score, 0 to 1, of each whole text; a null or empty text has the score of a text without hits. Equal texts have equal scores. The model is bounded by the labelled rows."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        own = shared.value
        if "scorer" not in own:
            own["scorer"] = Scorer(own)
        out = pa.array([own["scorer"].score(t) for t in texts.to_pylist()], pa.float64())
        release()
        return out

    return run(text.cast("string"))


THRESHOLD = 0.3


def model_of(spark, sf_dir: str) -> dict:
    """The model that the query and the pipeline use: learned from the labelled documents outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return learn(docs.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(model_of(spark, sf_dir), spark, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
