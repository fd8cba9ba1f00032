"""Operator 4: personal data by fixed patterns, and more of it by bootstrapped contexts.

Four kinds have fixed patterns (email, ip, card, phone). Words that hold a digit or @ are
candidates, and so are runs of short groups of digits with one blank between them. The word to
the left of a candidate (its cue) is a lexical pattern; the cue with the candidate's shape is
another one, scored apart. Candidates at which a fixed pattern found something are the seeds;
their instance is the whole span found. Long literals of letters and digits that are assigned
(`token = "04deb..."`) are seeds of their own, and become spans of the kind `context`. In each round a pattern's confidence is the share of its
distinct instances that are known. An instance becomes known by one confident pattern if the cue
is specific (candidates follow at least one in twenty of its occurrences in the texts; words like
"of" are not), else by confident patterns with a shape of two cues. Rounds go on until no instance is new.
Known instances that no fixed pattern found are added as spans of the kind `context`; one that
lies in another is left out.

Spans count code points, ends exclusive. Only candidates leave the texts' rows, and the graph
is summed by pattern and by instance, so that no group's rows come together in one task.

Nulls and ties: a null text is empty; a null doc_id stays null; repeated rows give repeated rows
(an instance counts once); an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .let import let, total, upto
from .scratch import stored

# The contract's patterns, written so that matching takes linear time and no recursion:
# a match starts where its leftmost start is, and groups that repeat take one character each.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:(?=\.?[A-Za-z0-9-])[A-Za-z0-9.-])*+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:(?=[\x20-]?[0-9])[0-9\x20-])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
GROUP = r"(?![0-9]++\.[0-9]++\.[0-9]++\.[0-9])(?:[0-9][().+/-]{0,2}+){1,10}+(?=[^\s0-9\p{L}@]*+(?:\s|$))"
RUN = rf"(?<!\S)[^\s0-9@\p{{L}}+(]*+[+(]*+{GROUP}(?:\x20\(*+{GROUP})++"
#: A long literal in quotes; where letters and digits mix in it and a sign of assignment stands before it, it is a seed as well.
ASSIGNED = r"""^["'][0-9A-Za-z_/+=.-]{20,}+["']"""
KINDS = ("email", "ip", "card", "phone", "context")


def luhn(x: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(x)

    def part(i):
        d = x.substr(n - i, F.lit(1)).cast("int") * (i % 2 + 1)
        return F.when(d > 9, d - 9).otherwise(d)

    return total(F.transform(upto(n), part), "int") % 10 == 0


def holding(kind: str):
    """The test that a match of the kind has to pass; the struct has what and digits."""

    def holds(s):
        if kind == "ip":
            return s["what"].rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})(?:\.(?=[0-9])|$)){4}$")
        if kind == "card":
            return F.length(s["digits"]).between(13, 19) & luhn(F.substring(s["digits"], 1, 19))
        if kind == "phone":
            return F.length(s["digits"]).between(9, 15)
        return F.lit(True)

    return holds


def with_matches(df: DataFrame, patterns: dict[str, str], may: dict[str, Column], block: int = 256) -> DataFrame:
    """For each name a column of (start, end, what, digits, left): the matches in t, in order; left: the end of the text between a match and the one before.

    The steps are columns of their own: each is computed once, and the plan stays flat. Positions
    are sums over blocks, so that a text with very many matches takes little more than linear time.
    """
    empty = F.array().cast("array<string>")
    add = lambda df, f: df.withColumns({f"{c}_{k}": v for k in patterns for c, v in f(k).items()})
    col = lambda c, k: F.col(f"{c}_{k}")
    df = add(df, lambda k: {"m": F.when(may[k], F.regexp_extract_all("t", F.lit(patterns[k]), F.lit(0))).otherwise(empty)})
    df = add(df, lambda k: {"g": F.when(F.size(col("m", k)) > 0, F.split("t", patterns[k], -1)).otherwise(empty)})

    def starts(k):
        # the lengths and the sums of blocks are bound by let: as columns they could be moved into the loop that reads them
        steps = F.transform(upto(F.size(col("m", k))), lambda i: F.length(F.get(col("g", k), i)) + F.length(F.get(col("m", k), i)))
        blocks = lambda s: F.transform(upto(F.ceil(F.size(s) / block)), lambda b: total(F.slice(s, b * block + 1, block)))
        before = lambda s, b, i: total(F.slice(b, F.lit(1), F.floor(i / block).cast("int"))) + total(F.slice(s, (F.floor(i / block) * block + 1).cast("int"), i % block))
        return let(steps, lambda s: let(blocks(s), lambda b: F.transform(s, lambda _, i: before(s, b, i) + F.length(F.get(col("g", k), i)))))

    df = add(df, lambda k: {"a": starts(k)})

    def row(k):
        def one(at, i):
            what = F.get(col("m", k), i)
            return F.struct(at.alias("start"), (at + F.length(what)).alias("end"), what.alias("what"), F.regexp_replace(what, "[^0-9]+", "").alias("digits"), F.right(F.get(col("g", k), i), F.lit(64)).alias("left"))

        return one

    df = df.withColumns({k: F.transform(col("a", k), row(k)) for k in patterns})
    return df.drop(*[f"{c}_{k}" for c in "mga" for k in patterns])


def scanned(docs: DataFrame, whole: bool = False) -> DataFrame:
    """rid, doc_id, the base spans by kind, and the candidates (start, end, instance, cue, pattern, context, long); stored. whole: the row of docs too, as a struct `row`."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    kept = ["row"] if whole else []
    t = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("t"), *[row] * whole)
    text = F.col("t")
    may = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][0-9\x20-]"), "phone": F.contains(text, F.lit("+")), "cand": text.rlike("[0-9@]"), "run": text.rlike(r"[0-9().+/-]\x20\(*+[0-9]")}
    t = with_matches(t, {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "cand": CANDIDATE, "run": RUN}, may)
    t = t.withColumns({k: F.transform(F.filter(k, holding(k)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.xxhash64(x["what"]).alias("instance"))) for k in KINDS[:4]})
    t = t.withColumn("every", F.flatten(F.array(*[F.col(k) for k in KINDS[:4]])))
    t = t.withColumns({k: F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for k in KINDS[:4]})

    def trimmed(x):
        rest = F.regexp_replace(x["what"], r"^[^\p{L}0-9+(@]++", "")
        word = F.lower(F.regexp_extract(x["left"], r"(?<!\S)(\S++)\s*+$", 1))
        assigned = x["what"].rlike(ASSIGNED) & x["what"].rlike("[0-9]") & x["what"].rlike("[A-Za-z]") & word.rlike("[=:]$")
        return F.struct((x["end"] - F.length(rest)).alias("start"), F.regexp_replace(rest, r"(?<=[\p{L}0-9)])[^\p{L}0-9)]++$", "").alias("core"), word.alias("word"), assigned.alias("assigned"))

    def shaped(c):
        shape = F.when(c["core"].rlike(r"^[0-9a-f]{16,}+$"), F.lit("hex")).otherwise(F.substring(F.regexp_replace(F.regexp_replace(c["core"], r"[0-9]++", "9"), r"\p{L}++", "a"), 1, 12))
        long = F.length(F.regexp_replace(c["core"], r"[^\p{L}0-9]++", "")) >= 6
        return F.struct(c["start"].alias("start"), (c["start"] + F.length(c["core"])).alias("end"), F.xxhash64(c["core"]).alias("instance"), F.xxhash64(c["word"]).alias("cue"), F.xxhash64(c["word"], shape).alias("pattern"), (c["word"] != "").alias("context"), long.alias("long"), c["assigned"].alias("assigned"))

    t = t.withColumns({k: F.transform(k, trimmed) for k in ("cand", "run")}).withColumns({k: F.transform(k, shaped) for k in ("cand", "run")})
    # where a run starts, the cue is the run's, not that of its first word
    t = t.withColumn("heads", F.transform("run", lambda c: c["start"]))
    t = t.withColumn("cand", F.transform("cand", lambda c: c.withField("context", c["context"] & ~F.array_contains("heads", c["start"]))))
    return stored(t.select(*kept, "rid", "doc_id", *KINDS[:4], "every", F.concat("cand", "run").alias("cands")), "scanned")


def candidates(scan: DataFrame) -> DataFrame:
    """A row for each candidate; seed: a base span starts there, whose text is the instance then; inside: one covers part of it."""
    c = scan.filter(F.size("cands") > 0).select("rid", "every", F.explode("cands").alias("c")).select("rid", "every", "c.*")
    over = lambda s: (s["start"] < F.col("end")) & (F.col("start") < s["end"])
    c = c.withColumn("base", F.get(F.filter("every", lambda s: over(s) & (F.col("start") <= s["start"] + 1)), F.lit(0))["instance"])
    return c.select("rid", "start", "end", F.coalesce("base", "instance").alias("instance"), "cue", "pattern", "context", "long", (F.col("base").isNotNull() | F.col("assigned")).alias("seed"), F.exists("every", over).alias("inside"))


def specific_cues(c: DataFrame, texts: DataFrame, least: int, specific: float) -> DataFrame:
    """cue of those with at least so many distinct instances, which follow at least the given share of the word's occurrences in text."""
    cues = c.groupBy("cue", "instance").agg(F.count("*").alias("k")).groupBy("cue").agg(F.count("*").alias("n"), F.sum("k").alias("hits")).filter(F.col("n") >= least)
    words = texts.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).select(F.xxhash64("word").alias("cue"))
    occurs = words.groupBy("cue").agg(F.count("*").alias("occurs"))  # summed before the join, so that each part sends a word once
    return cues.join(occurs, "cue").filter(F.col("hits") >= specific * F.col("occurs")).select("cue")


def discovered(scan: DataFrame, texts: DataFrame, least_known: int = 3, confidence: float = 0.8, specific: float = 0.05, backing: int = 2) -> DataFrame:
    """rid, start, end of candidates outside the base spans whose instance became known.

    A pattern is confident with least_known distinct known instances that make up the given
    share of its distinct instances. An instance becomes known if a confident pattern with a
    specific cue has it, or confident patterns with a shape of that many cues (backing). texts: text of all rows.
    """
    c = stored(candidates(scan), "candidates")
    used = c.filter("context and (seed or not inside)")
    sure = stored(specific_cues(used, texts, least_known, specific).withColumn("sure", F.lit(True)), "cues")
    edges = used.select("cue", F.explode(F.array("cue", "pattern")).alias("pattern"), "instance", "seed", "long").groupBy("cue", "pattern", "instance").agg(F.max("seed").alias("known"), F.max("long").alias("long"))
    # an instance that is a seed anywhere is known everywhere
    seeds = edges.groupBy("instance").agg(F.max("known").alias("known"), F.max("long").alias("long"))
    edges = stored(edges.select("cue", "pattern", "instance").join(seeds, "instance"), "edges")
    while True:
        good = edges.groupBy("cue", "pattern").agg(F.sum(F.col("known").cast("long")).alias("f"), F.count("*").alias("n")).filter((F.col("f") >= least_known) & (F.col("f") >= confidence * F.col("n")))
        good = good.join(sure, "cue", "left").filter("sure or pattern != cue").select("pattern", F.coalesce("sure", F.lit(False)).alias("sure"))
        backed = edges.filter("not known and long").join(good, "pattern").groupBy("instance", "cue").agg(F.max("sure").alias("sure"))
        new = backed.groupBy("instance").agg(F.max("sure").alias("sure"), F.count("*").alias("k")).filter(F.col("sure") | (F.col("k") >= backing)).select("instance", F.lit(True).alias("new"))
        new = stored(new, "new")
        if new.isEmpty():
            break
        edges = stored(edges.join(new, "instance", "left").select("cue", "pattern", "instance", (F.col("known") | F.coalesce("new", F.lit(False))).alias("known"), "long"), "edges")
    known = edges.filter("known and long").select("instance").distinct()
    return c.filter("not inside and long").select("rid", "start", "end", "instance").join(known, "instance", "left_semi").select("rid", "start", "end")


def detected(docs: DataFrame, whole: bool = False) -> DataFrame:
    """rid, doc_id, and for each kind an array of (start, end) in order; with whole also the row of docs, as a struct `row`."""
    scan = scanned(docs, whole)
    more = discovered(scan, docs.select("text")).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("c"))
    within = lambda s, o: (o["start"] <= s["start"]) & (s["end"] <= o["end"]) & (o["end"] - o["start"] > s["end"] - s["start"])
    # stored, so that Spark sees its size and moves the scanned rows only if it has to
    more = stored(more.select("rid", F.filter("c", lambda s: ~F.exists("c", lambda o: within(s, o))).alias("context")), "context")
    return scan.drop("cands", "every").join(more, "rid", "left").withColumn("context", F.coalesce("context", F.array()))


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans by kind, then start, joined by commas."""
    named = lambda k: lambda s: F.concat(F.lit(f"{k}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    return F.concat_ws(",", F.flatten(F.array(*[F.transform(k, named(k)) for k in kinds])))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span of its texts replaced by its kind in brackets; overlapping spans are joined under the first one's kind."""
    named = lambda k: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind"))
    every = F.array_sort(F.flatten(F.array(*[F.transform(k, named(k)) for k in KINDS])))
    rows = detected(docs, whole=True).select("row", every.alias("spans"))
    text = F.col("row.text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state, s):
        gap = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        fresh = F.struct(s["end"].alias("at"), F.concat(state["parts"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("parts"))
        inside = F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["parts"].alias("parts"))
        return F.when(s["start"] >= state["at"], fresh).otherwise(inside)

    done = F.aggregate("spans", start, step, lambda s: F.concat(F.concat_ws("", s["parts"]), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
    found = F.size("spans") > 0
    rows = rows.select("row", F.when(found, done).otherwise(text).alias("text"), found.alias("found"))
    made = {"text": F.col("text"), "n_chars": F.when(F.col("found"), F.length("text").cast("long")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(0))}
    return rows.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = detected(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    every = sum((F.size(k) for k in KINDS[1:]), F.size(KINDS[0])).cast("long").alias("n_spans")
    return got.select("doc_id", *counts, every, F.sha2(listed(KINDS[:4]), 256).alias("base_sha256"), listed(KINDS).alias("spans"))
