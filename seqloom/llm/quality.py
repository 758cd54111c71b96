"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them. DataFrame functions only.

Good documents are one latent class. Bad ones are a mixture of kinds, as a page of symbols and one of repeated lines break
different rules: rules that break together belong to one kind, so their correlation is explained by it and not counted twice. All rates, of
good documents and of every kind, are estimated from the votes; a weak prior only says which class is which.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, col, fresh, others, settled, words

SYMBOLS = "#*$%&|<>"
SIGNS = "!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"
WINDOW = 5
ROUNDS = 40
#: Kinds of bad documents: symbols, shouting, repetition. Each rule belongs to one, or to none (0).
KINDS = 3
#: The weak prior, worth PSEUDO documents a class: the share of good documents, and how often a rule votes bad on good documents,
#: on bad ones of its kind, and on other bad ones.
PSEUDO, SHARE_GOOD, RATE_GOOD, RATE_OWN, RATE_OTHER = 10.0, 0.85, 0.05, 0.8, 0.1
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stopped_lines", "n_capitals", "n_bangs", "n_signs", "n_distinct_words")
VERDICT = ("base_failed", "posterior", "kept")
#: Capital letters of Latin-1 besides A-Z.
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _removed(text: Column, chars: str) -> Column:
    """How many of the characters a text has."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeated_words(w: Column) -> Column:
    """Words that lie in five-word windows found twice or more in an array of words, the first occurrence included.

    Windows are hashed to 64 bits; the top bits of a hash and the window's position share one long, so sorting
    longs brings equal windows together. Neighbours are compared by their whole hashes.
    """
    n = F.size(w)
    last = n - WINDOW

    def flagged(win: Column) -> Column:
        bits = F.when(F.size(win) < (1 << 24), F.lit(24)).otherwise(F.lit(31))
        low = lambda x, b: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1)

        def at_bits(b: Column) -> Column:
            packed = F.sort_array(F.transform(win, lambda x, i: (x - low(x, b)).bitwiseOR(i.cast("long"))))

            def marks(s: Column) -> Column:
                here = lambda k: F.get(win, low(F.get(s, k), b).cast("int"))
                hit = lambda x, k: (F.coalesce(here(k - 1) == here(k), F.lit(False))) | (F.coalesce(here(k + 1) == here(k), F.lit(False)))
                place = F.transform(s, lambda x, k: F.when(hit(x, k), low(x, b).cast("int")).otherwise(F.lit(-1)))
                return F.sort_array(F.filter(place, lambda p: p >= 0))

            return let(packed, marks)

        return let(bits, at_bits)

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(win: Column) -> Column:
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(let(flagged(win), covered))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    full = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(windows(h), count))
    return F.when(n < WINDOW + 1, F.lit(0).cast("long")).otherwise(full)


def features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df without its text, with the counts that the rules use (COUNTS); columns of df with their names, or those of VERDICT, in any case of letters, are replaced.

    A null text counts as empty: all counts are 0. A text counts whole, however long. Rows with a null id or one that repeats are rows like all others.
    """
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    kept = others(df, text_col, *COUNTS, *VERDICT)
    t, w, lines = (fresh(df, x) for x in ("__text", "__words", "__lines"))
    filled = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    rows = df.select(*map(col, kept), text.alias(t), words(text).alias(w), filled.alias(lines))
    stop = F.filter(lines, lambda x: F.substring(F.btrim(x, F.lit(SPACES)), -1, 1).isin(*".!?:;\"'”»…"))
    counts = (
        F.size(w), F.length(F.translate(t, SPACES, "")), _removed(F.col(t), SYMBOLS), F.size(lines) - F.size(F.array_distinct(lines)), repeated_words(F.col(w)),
        F.size(lines), F.size(stop), _removed(F.col(t), CAPITALS), _removed(F.col(t), "!"), _removed(F.col(t), SIGNS), F.size(F.array_distinct(w)),
    )
    return rows.select(*map(col, kept), *[c.cast("long").alias(name) for name, c in zip(COUNTS, counts, strict=True)])


def rules() -> dict[str, tuple[int, Column, Column]]:
    """name -> (kind, votes bad, votes good); a rule for which neither holds abstains. No rule is a veto."""
    n, lines, chars = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1)), F.greatest("word_chars", F.lit(1))
    symbols, signs, capitals, bangs = F.col("n_symbols") / n, F.col("n_signs") / chars, F.col("n_capitals") / chars, F.col("n_bangs") / n
    dup, repeat, mean, stopped = F.col("n_dup_lines") / lines, F.col("n_repeat_words") / n, F.col("word_chars") / n, F.col("n_stopped_lines") / lines
    variety = F.col("n_distinct_words") / F.sqrt(n)
    return {
        "symbols": (1, symbols > 0.1, symbols < 0.02),
        "signs": (1, signs > 0.12, signs < 0.08),
        "capitals": (2, capitals > 0.3, capitals < 0.1),
        "exclamations": (2, bangs > 0.1, bangs < 0.02),
        "repeated lines": (3, dup > 0.3, (F.col("n_dup_lines") == 0) & (F.col("n_lines") > 1)),
        "repeated words": (3, repeat > 0.3, repeat < 0.1),
        "variety": (3, (variety < 4) & (F.col("n_words") >= 20), variety >= 5),
        "length": (0, F.col("n_words") < 20, F.col("n_words") >= 50),
        "word length": (0, (mean < 3.5) | (mean > 7), mean.between(4, 6)),
        "line ends": (0, stopped < 0.5, stopped > 0.8),
    }


def estimate(patterns: DataFrame, kinds: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(code, posterior) from (code, votes, n): the probability that a document with these votes is good.

    kinds has the kind of bad documents that each rule belongs to, or 0. Expectation-maximisation runs over the vote patterns, of
    which there are 3 to the power of the number of rules at most, whatever the number of documents. It estimates the share of each class and how
    often each rule, where it votes, votes bad on it; abstentions say nothing. All rounds are one aggregate over the array of
    patterns. Without patterns there are no rows.
    """
    literal = lambda xs: F.array(*map(F.lit, xs))
    shares = literal([SHARE_GOOD, *[(1 - SHARE_GOOD) / KINDS] * KINDS])
    seeds = F.array(*[literal([RATE_GOOD if not c else RATE_OWN if k == c else RATE_OTHER for k in kinds]) for c in range(KINDS + 1)])
    classes, places = F.sequence(F.lit(0), F.lit(KINDS)), F.sequence(F.lit(0), F.lit(len(kinds) - 1))
    # in a fixed order, so that sums and with them the last digits don't depend on the order of arrival
    one = patterns.groupBy().agg(F.sort_array(F.collect_list(F.struct("code", "votes", F.col("n").cast("double").alias("n")))).alias("p"))
    start = F.struct(shares.alias("share"), seeds.alias("bad"))

    def total(xs: Column, f: Callable[[Column], Column]) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))

    def belief(votes: Column, s: Column) -> Column:
        """The probability of each class."""

        def log_odds(c: Column) -> Column:
            vote = lambda v, bad: F.when(v < 0, F.log(bad)).when(v > 0, F.log1p(-bad)).otherwise(F.lit(0.0))
            return F.aggregate(F.zip_with(votes, F.get(s["bad"], c), vote), F.log(F.get(s["share"], c)), lambda a, x: a + x)

        def normal(odds: Column) -> Column:
            return let(F.transform(odds, lambda x: F.exp(x - F.array_max(odds))), lambda e: F.transform(e, lambda x: x / total(e, lambda y: y)))

        return let(F.transform(classes, log_odds), normal)

    def again(s: Column, _: Column) -> Column:
        scored = F.transform("p", lambda x: F.struct(x["votes"].alias("v"), x["n"].alias("n"), belief(x["votes"], s).alias("b")))

        def update(q: Column) -> Column:
            def rates(c: Column) -> Column:
                def rate(j: Column) -> Column:
                    mass = lambda hit: total(q, lambda x: F.when(hit(F.get(x["v"], j)), x["n"] * F.get(x["b"], c)).otherwise(F.lit(0.0)))
                    return (mass(lambda v: v < 0) + PSEUDO * F.get(F.get(seeds, c), j)) / (mass(lambda v: v != 0) + PSEUDO)

                return F.transform(places, rate)

            share = lambda c: (total(q, lambda x: x["n"] * F.get(x["b"], c)) + PSEUDO * F.get(shares, c)) / (total(q, lambda x: x["n"]) + PSEUDO)
            return F.struct(F.transform(classes, share).alias("share"), F.transform(classes, rates).alias("bad"))

        return let(scored, update)

    fitted = one.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, again))
    return fitted.select("s", F.explode("p").alias("x")).select(F.col("x.code").alias("code"), belief(F.col("x.votes"), F.col("s"))[0].alias("posterior"))


def weigh(df: DataFrame, least: float = 0.5) -> DataFrame:
    """df, which has the columns of features(), with base_failed, posterior and kept; columns of those names in any case of letters are replaced.

    kept: the base rules hold and the posterior probability of good quality is at least `least`. df is read
    twice, so it should be settled. The table of posteriors has one row per vote pattern; that is its size bound. Equal counts have equal
    results, so rows that repeat do too. An empty table gives an empty one.
    """
    checks = rules()
    df = df.select(*map(col, others(df, *VERDICT)))
    votes, code = fresh(df, "__votes"), fresh(df, "__code")
    vote = F.array(*[F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)) for _, bad, good in checks.values()])
    voted = df.withColumn(votes, vote).withColumn(code, F.aggregate(votes, F.lit(0), lambda a, v: a * 3 + v + 1))
    patterns = voted.groupBy(F.col(code).alias("code")).agg(F.first(votes).alias("votes"), F.count("*").alias("n"))
    posts = estimate(patterns, [k for k, _, _ in checks.values()]).withColumnRenamed("code", code)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = voted.join(F.broadcast(posts), code).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least)).drop(votes, code)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return weigh(settled(features(docs))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )
