"""Quality rules combined by weak supervision.

Each rule votes good (1), bad (0) or abstains (null). Expectation-maximisation over the counts of the
vote patterns estimates, for either class, how often each rule votes bad when it votes, and the share of bad
documents; the posterior probability of quality then replaces the demand that all rules pass.
There are at most 3 ** rules patterns however many documents are scored, and only sums over patterns reach the driver.
No Python runs on the executors, and no row is shuffled but the pattern counts.

Nulls and ties: a null text counts as empty; a text without words makes every rule abstain and fails the base test. Equal rows get equal
verdicts. An empty table returns an empty one. Input columns named like result columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placehull.llm.base import table
from placehull.session import stage

SPACE = r"[\x20\x09-\x0D]+"
#: Frequent words of the languages served.
STOP_WORDS = (
    "the of and to in is that it was for on are as with be at by this from or an "
    "le la les de des du et un une que qui dans pour pas sur est en au "
    "der die das und ist von den mit zu ein eine nicht auf für im "
    "el los las una y del se con por su al es"
).split()
#: name -> (value below which the vote is good, value above which it is bad)
RULES = {
    "symbols": (0.02, 0.10),  # symbols per word
    "dense_symbols": (0.01, 0.05),  # symbols per character of words
    "capitals": (0.20, 0.50),  # capital letters per character of words
    "shouting": (0.10, 0.30),  # exclamation and question marks per word
    "repeats": (0.10, 0.30),  # words in repeated three-word windows per word
    "lines": (0.10, 0.30),  # repeated lines per line
    "long_words": (8.5, 12.0),  # characters per word
    "few_stops": (-2.5, -0.5),  # different words of the stop list, negated
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULTS = (*COUNTS, "base_failed", "quality", "kept")
ROUNDS = 10
START = (0.2, 0.5, 0.05)  # share of bad documents; chance of a bad vote in bad and in good documents


def with_counts(docs: DataFrame) -> DataFrame:
    """Append n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and helper counts (__*)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = docs.withColumn("__trimmed", F.btrim(text, F.lit(" \t\n\x0b\f\r")))
    words = F.when(F.col("__trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("__trimmed", SPACE))
    squeezed = trimmed.withColumn("__words", words).drop("__trimmed")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    squeezed = squeezed.withColumn("__lines", lines)
    words = F.col("__words")
    n = F.size(words)
    joined = F.array_join(words, "")
    hashes = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = squeezed.withColumns(
        {
            "__n": n,
            "word_chars": F.length(joined).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__n_lines": F.size("__lines"),
            "__capitals": F.length(F.regexp_replace(joined, r"[^\p{Lu}]+", "")),
            "__shouts": F.length(F.regexp_replace(text, r"[^!?]+", "")),
            "__stops": F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in STOP_WORDS]))),
            "__hashes": hashes,
        }
    )
    # Only texts in which a window's hash comes twice sort their windows; equality is then tested on the words.
    some = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    windows = F.array_sort(
        F.transform(
            F.col("__hashes"),
            lambda h, i: F.struct(
                h.alias("h"), F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i")
            ),
        )
    )
    counted = counted.withColumn("__windows", F.when(some, windows))
    sorted_windows = F.col("__windows")

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x.h == y.h) & (x.a == y.a) & (x.b == y.b) & (x.c == y.c), F.lit(False))

    twice = F.filter(
        sorted_windows, lambda x, i: same(x, F.get(sorted_windows, i - 1)) | same(x, F.get(sorted_windows, i + 1))
    )
    counted = counted.withColumn("__starts", F.sort_array(F.transform(twice, lambda x: x.i)))
    starts = F.col("__starts")
    covered = F.aggregate(
        F.transform(starts, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - x, F.lit(3)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return counted.withColumns(
        {"n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"), "n_words": F.col("__n").cast("long")}
    ).drop("__words", "__lines", "__hashes", "__windows", "__starts", "__n")


def rule_values() -> dict[str, Column]:
    words = F.col("n_words")
    return {
        "symbols": F.col("n_symbols") / words,
        "dense_symbols": F.col("n_symbols") / F.col("word_chars"),
        "capitals": F.col("__capitals") / F.col("word_chars"),
        "shouting": F.col("__shouts") / words,
        "repeats": F.col("n_repeat_words") / words,
        "lines": F.col("n_dup_lines") / F.col("__n_lines"),
        "long_words": F.col("word_chars") / words,
        "few_stops": F.when((F.col("__stops") > 0) | (words >= 150), -F.col("__stops")),
    }


def vote(value: Column, good: float, bad: float) -> Column:
    return F.when(value < good, 1).when(value > bad, 0)


def with_votes(counted: DataFrame) -> DataFrame:
    """Append base_failed and one vote per rule as ``__vote_<rule>``."""
    has = F.col("n_words") > 0
    votes = {f"__vote_{k}": F.when(has, vote(v, *RULES[k])) for k, v in rule_values().items()}
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumns({**votes, "base_failed": failed})


def posterior(model: dict) -> Column:
    """Probability of quality given the votes.

    The accuracies form one array literal, so each round runs the code that the first round compiled.
    """
    values = F.array(*[F.lit(x) for x in (model["bad"], *(x for pair in model["rules"].values() for x in pair))])
    odds = F.lit(1.0)
    for i, rule in enumerate(model["rules"]):
        v = F.col(f"__vote_{rule}")
        in_bad, in_good = F.get(values, F.lit(2 * i + 1)), F.get(values, F.lit(2 * i + 2))
        odds = odds * F.when(v == 0, in_bad / in_good).when(v == 1, (1 - in_bad) / (1 - in_good)).otherwise(1.0)
    bad = F.get(values, F.lit(0))
    return F.lit(1.0) / (F.lit(1.0) + odds * bad / (1 - bad))


def estimate(voted: DataFrame, rounds: int = ROUNDS) -> dict:
    """Expectation-maximisation over the vote patterns.

    Each round is one sum over the pattern table. One pseudo-count per cell keeps every chance inside (0, 1).
    """
    names = [f"__vote_{k}" for k in RULES]
    patterns = voted.select(*names).groupBy(*names).count()
    patterns = stage(patterns.coalesce(1).sortWithinPartitions(*names), "patterns")
    model = {"bad": START[0], "rules": {k: START[1:] for k in RULES}}
    for _ in range(rounds):
        weighed = patterns.withColumn("good", posterior(model)).select(
            *names, "count", (F.col("count") * F.col("good")).alias("g"), (F.col("count") * (1 - F.col("good"))).alias("b")
        )
        sums = [F.sum("b").alias("bad"), F.sum("count").alias("all")]
        for k, name in zip(RULES, names):
            v = F.col(name)
            for side in ("b", "g"):
                sums += [
                    F.sum(F.when(v == 0, F.col(side))).alias(f"{k}_b{side}"),
                    F.sum(F.when(v.isNotNull(), F.col(side))).alias(f"{k}_{side}"),
                ]
        row = {k: v or 0 for k, v in weighed.agg(*sums).first().asDict().items()}
        model = {
            "bad": (row["bad"] + 1) / (row["all"] + 2),
            "rules": {
                k: ((row[f"{k}_bb"] + 1) / (row[f"{k}_b"] + 2), (row[f"{k}_bg"] + 1) / (row[f"{k}_g"] + 2)) for k in RULES
            },
        }
    return model


def score_quality(docs: DataFrame, columns: list[str] | None = None, rounds: int = ROUNDS, threshold: float = 0.5) -> DataFrame:
    """``columns`` of ``docs`` (all by default) with counts, base_failed, quality (posterior probability) and kept.

    Texts are read and counted once: rows and votes are written to the scratch folder, the patterns are counted there
    and the verdicts are given on reading it again.
    """
    counted = with_votes(with_counts(docs))
    votes = [f"__vote_{k}" for k in RULES]
    columns = [c for c in (columns or docs.columns) if c not in RESULTS]
    voted = stage(counted.select(*columns, *COUNTS, "base_failed", *votes), "votes")
    model = estimate(voted, rounds)
    scored = voted.withColumn("quality", posterior(model)).drop(*votes)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the verdict keeps, with the columns of ``docs``."""
    whole = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    return score_quality(whole, ["__row"]).filter("kept").select("__row.*")


def op9_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, ["doc_id"]).select("doc_id", *COUNTS, "base_failed", "kept")


def _oracle(rounds: int = ROUNDS) -> str:
    """The same estimate in SQL: a parameter row per round, each made from the one before."""
    rules = list(RULES)
    values = {
        "symbols": "n_symbols / n_words",
        "dense_symbols": "n_symbols / word_chars",
        "capitals": "capitals / word_chars",
        "shouting": "shouts / n_words",
        "repeats": "n_repeat_words / n_words",
        "lines": "n_dup_lines / n_lines",
        "long_words": "word_chars / n_words",
        "few_stops": "case when stops > 0 or n_words >= 150 then -stops end",
    }
    votes = ", ".join(
        f"case when n_words = 0 then null when ({values[k]}) < {RULES[k][0]} then 1 when ({values[k]}) > {RULES[k][1]} then 0 end as v_{k}"
        for k in rules
    )
    odds = " * ".join(
        f"(case when v_{k} = 0 then p.{k}_1 / p.{k}_0 when v_{k} = 1 then (1 - p.{k}_1) / (1 - p.{k}_0) else 1 end)" for k in rules
    )
    good = f"1 / (1 + {odds} * p.bad / (1 - p.bad))"
    first = ", ".join(f"{START[1]}::double as {k}_1, {START[2]}::double as {k}_0" for k in rules)
    steps = [f"p0 as materialized (select {START[0]}::double as bad, {first})"]
    for r in range(rounds):
        sums = ", ".join(
            f"(coalesce(sum(case when v_{k} = 0 then n * (1 - g) end), 0) + 1) / (coalesce(sum(case when v_{k} is not null then n * (1 - g) end), 0) + 2) as {k}_1, "
            f"(coalesce(sum(case when v_{k} = 0 then n * g end), 0) + 1) / (coalesce(sum(case when v_{k} is not null then n * g end), 0) + 2) as {k}_0"
            for k in rules
        )
        steps.append(
            f"p{r + 1} as materialized (select (sum(n * (1 - g)) + 1) / (sum(n) + 2) as bad, {sums} "
            f"from (select t.*, {good} as g from patterns t, p{r} p))"
        )
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    names = ", ".join(f"v_{k}" for k in rules)
    return rf"""
with base as materialized (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents
), grams as (
  select rid, i, struct_pack(a := words[i], b := words[i + 1], c := words[i + 2]) as w
  from base, unnest(range(1, len(words) - 1)) as r(i) where len(words) >= 3
), twice as (
  select rid, i from (select rid, i, count(*) over (partition by rid, w) as n from grams) where n > 1
), covered as (
  select rid, count(distinct j) as n_repeat_words from (select rid, unnest([i, i + 1, i + 2]) as j from twice) group by rid
), counts as (
  select b.rid, doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(c.n_repeat_words, 0)::bigint as n_repeat_words, len(lines) as n_lines,
    length(regexp_replace(array_to_string(words, ''), '[^\p{{Lu}}]+', '', 'g')) as capitals,
    length(regexp_replace(text, '[^!?]+', '', 'g')) as shouts,
    len(list_distinct(list_filter(words, lambda w: w in ({stops})))) as stops
  from base b left join covered c using (rid)
), voted as materialized (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {votes} from counts
), patterns as materialized (
  select {names}, count(*) as n from voted group by all
), {", ".join(steps)}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and {good} >= 0.5 as kept
from voted, p{rounds} p
"""


ORACLE = _oracle()
