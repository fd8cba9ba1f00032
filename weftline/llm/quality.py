"""Operator 7: quality by weak supervision.

Rules look at a text and vote for good, vote for bad, or abstain. Expectation-maximisation
over the counts of the vote patterns (at most 3 to the number of rules, whatever the corpus)
estimates how often each rule casts each vote on good and on bad documents, and so gives each
pattern a posterior probability of being good; documents that the base rules reject take no part. A document is kept if that is at least one half
and the base rules hold.

Nulls and ties: a null text has no words and fails; a null doc_id stays null; repeated rows give
repeated rows; an empty table gives none. A very long text is one row's work, in time n log n of its
words. Other columns, whatever their names, are kept by `kept_documents` and ignored by `judged`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .let import let, total, upto
from .scratch import stored

SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: A word of letters, with one mark at its end at most.
FORMED = r"(?<![^\x20\x09-\x0D])[\"'(«¿¡]?[\p{L}\p{M}]++(?:['’-][\p{L}\p{M}]++)?[.,;:!?)\"'»]?(?![^\x20\x09-\x0D])"
BAD, ABSTAIN, GOOD = 0, 1, 2


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(words: Column, n: Column, window: int = 5) -> Column:
    """Words that lie in a window of five which the text has twice or more."""
    hashes = F.transform(upto(n - (window - 1)), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))

    def covered(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def repeats(s):
            same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
            at = F.filter(F.transform(upto(F.size(s)), lambda i: F.when(F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), F.get(s, i)["p"])), lambda p: p.isNotNull())
            return let(F.sort_array(at), lambda p: total(F.transform(upto(F.size(p)), lambda i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - F.get(p, i), F.lit(window))))))

        return let(pairs, repeats)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def features(docs: DataFrame, whole: bool = False) -> DataFrame:
    """The counts that the rules look at; docs needs doc_id and text. One pass over the texts, no shuffle. whole: the row of docs too, as a struct `row`."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    kept = ["row"] if whole else []
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("t"), *[row] * whole)
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.length(without(x, SPACE)) > 0)
    t = t.select(*kept, "doc_id", "t", F.array_remove(F.split("t", SPACES, -1), "").alias("w"), lines.alias("l"), without(F.col("t"), SPACE).alias("solid"))
    n = F.size("w")
    return t.select(
        *kept,
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length("solid").cast("long").alias("word_chars"),
        (F.length("solid") - F.length(without(F.col("solid"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("l").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w"), n).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        (F.length("solid") - F.length(without(F.col("solid"), "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÉÈÊËÍÎÏÑÓÔÖÙÚÛÜŒ"))).alias("n_upper"),
        (F.length("solid") - F.length(without(F.col("solid"), "0123456789"))).alias("n_digits"),
        (F.length("solid") - F.length(without(F.col("solid"), "!?"))).alias("n_shout"),
        F.regexp_count("t", F.lit(FORMED)).alias("n_formed"),
    )


def rules() -> dict[str, tuple[Column, Column]]:
    """(bad if, good if) for each rule; it abstains otherwise. Conditions on no words are null, and so abstentions."""
    n, chars = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("word_chars"), F.lit(0))
    lines = F.nullif(F.col("n_lines"), F.lit(0))
    share = lambda a, b: F.col(a) / b
    return {
        "form": (share("n_formed", n) < 0.75, share("n_formed", n) > 0.9),
        "length": (F.col("n_words") < 10, F.col("n_words") >= 50),
        "symbols": (share("n_symbols", n) > 0.1, share("n_symbols", n) < 0.02),
        "lines": (share("n_dup_lines", lines) > 0.3, share("n_dup_lines", lines) < 0.05),
        "repeats": (share("n_repeat_words", n) > 0.2, share("n_repeat_words", n) < 0.05),
        "word length": ((chars / n < 2) | (chars / n > 14), (chars / n >= 3) & (chars / n <= 10)),
        "capitals": (share("n_upper", chars) > 0.4, share("n_upper", chars) < 0.15),
        "shouting": (share("n_shout", n) > 0.2, share("n_shout", n) < 0.05),
        "digits": (share("n_digits", chars) > 0.3, share("n_digits", chars) < 0.1),
        "variety": (F.col("n_distinct") / n < F.when(n >= 50, 0.1), F.col("n_distinct") / n > F.when(n < 2000, 0.3).otherwise(0.1)),
    }


def votes() -> Column:
    vote = lambda bad, good: F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)
    return F.array(*[vote(*x) for x in rules().values()])


#: What EM starts from and leans to: chances of (bad, abstain, good) votes on a good and on a bad document, counted as so many documents in 100.
ON_GOOD, ON_BAD, WEIGHT, BAD_SHARE = (0.01, 0.14, 0.85), (0.35, 0.2, 0.45), 2.0, 0.1

#: A rule is written so that it seldom votes bad on good documents, and now and then on bad ones; EM keeps to that.
FALSE_ALARMS, HITS = 0.03, 0.1


def fitted(feats: DataFrame, rounds: int = 25) -> tuple[float, list[float], list[float]]:
    """The share of bad documents and, for each rule and vote, the chance on good and on bad ones.

    EM runs as one expression over one row that holds the counts of the vote patterns.
    """
    r = len(rules())
    counts = feats.groupBy(votes().alias("v")).agg(F.count("*").alias("n"))
    table = counts.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("p"), F.sum("n").alias("all"))
    lit = lambda xs: F.array(*[F.lit(float(x)) for x in xs])

    def ll(v, chances):
        return total(F.transform(v, lambda x, i: F.log(F.get(chances, i * 3 + x))), "double")

    def step(state, _):
        bad = F.transform("p", lambda p: let(ll(p["v"], state["bad"]) + F.log(state["share"]) - ll(p["v"], state["good"]) - F.log(1 - state["share"]), lambda d: p["n"] / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), d))))))

        def again(post):
            lean = F.col("all") * (WEIGHT / 100)

            def chances(weight, of, start, low, high):
                part = F.transform(F.sequence(F.lit(0), F.lit(3 * r - 1)), lambda k: (total(F.zip_with("p", post, lambda p, b: F.when(F.get(p["v"], F.floor(k / 3).cast("int")) == k % 3, weight(p, b)).otherwise(0.0)), "double") + lean * F.get(lit(start), (k % 3).cast("int"))) / (of + lean))
                return F.transform(part, lambda c, k: F.when(k % 3 == BAD, F.greatest(F.lit(low), F.least(F.lit(high), c))).otherwise(c))

            n_bad = total(post, "double")
            return F.struct(
                ((n_bad + lean * BAD_SHARE) / (F.col("all") + lean)).alias("share"),
                chances(lambda p, b: p["n"] - b, F.col("all") - n_bad, ON_GOOD, 0.0, FALSE_ALARMS).alias("good"),
                chances(lambda p, b: b, n_bad, ON_BAD, HITS, 1.0).alias("bad"),
            )

        return let(bad, again)

    start = F.struct(F.lit(BAD_SHARE).alias("share"), lit(ON_GOOD * r).alias("good"), lit(ON_BAD * r).alias("bad"))
    got = table.filter("all > 0").select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("m")).select("m.*").first()
    return (got.share, got.good, got.bad) if got else (BAD_SHARE, list(ON_GOOD * r), list(ON_BAD * r))


def posterior(model: tuple[float, list[float], list[float]]) -> Column:
    """The probability that a document with these features is good."""
    share, good, bad = model
    weight = None
    for i, (b, g) in enumerate(rules().values()):
        logs = [float(math.log(good[3 * i + v] / bad[3 * i + v])) for v in (BAD, ABSTAIN, GOOD)]
        one = F.when(b, logs[BAD]).when(g, logs[GOOD]).otherwise(logs[ABSTAIN])
        weight = one if weight is None else weight + one
    odds = float(math.log((1 - share) / share))
    return 1 / (1 + F.exp(-(weight + odds)))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(docs: DataFrame, least: float = 0.5, whole: bool = False) -> DataFrame:
    """doc_id, the counts, base_failed, p_good, kept; with whole also the row of docs, as a struct `row`."""
    feats = stored(features(docs, whole).withColumn("base_failed", base_failed()), "features")
    out = feats.withColumn("p_good", posterior(fitted(feats.filter("not base_failed"))))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))


def kept_documents(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, with all their columns: they are stored once, beside their counts, and filtered."""
    return judged(docs, least, whole=True).filter("kept").select("row.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
