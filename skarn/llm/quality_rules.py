"""Quality by weak supervision: rules vote good or bad or abstain, expectation-maximisation estimates how far each can be
trusted, and the posterior probability of good quality decides.

Everything is DataFrame functions. Document statistics are array functions over the document's own words, so no document is
exploded or shuffled. The corpus enters the estimate as counts of vote patterns (at most 3 ** number of rules rows, summed
before the shuffle), and all EM steps run inside one expression over that bounded table; the model is one row of numbers.
For each rule it holds the chance of a good vote among its votes on good and on bad documents, so a rule that finds one kind
of junk is not taken to clear all others.

Defined cases: a null text has no words; a text without words gets no vote and fails the base rules; repeated documents count
and are judged each; a text of any length is measured whole, in one row; a posterior of just the limit is kept; other columns are
carried only inside the column `doc` when asked for, so names cannot clash, whatever dots are in them; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialise, quoted

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WORD = r"[^\x20\x09-\x0D]"
MIN_WORDS = 50
ITERATIONS = 30
#: A document goes only where bad quality is at least 0.95 sure.
KEEP = 0.05
#: Weight of the first guess in each estimate, in documents.
PRIOR_WEIGHT = 2.0
#: First guesses: the chance of a good vote on a good and on a bad document. One bad vote must weigh more than all other rules' good votes, as a
#: document has one kind of junk as a rule.
FIRST_GOOD, FIRST_BAD = 0.998, 0.8

#: Each rule: a measure, when it votes bad and when good (SQL over the statistics); otherwise it abstains.
RULES = {
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "exclamations": ("5 * n_exclamations > n_words", "20 * n_exclamations <= n_words"),
    "capitals": ("10 * n_capitals > 4 * word_chars", "10 * n_capitals <= word_chars"),
    "repeated_lines": ("n_lines >= 5 and 10 * n_dup_lines > 3 * n_lines", "10 * n_dup_lines <= n_lines"),
    "repeated_words": ("10 * n_repeat_words > 4 * n_words", "10 * n_repeat_words <= n_words"),
    "same_word_again": ("5 * n_same_next > n_words", "20 * n_same_next <= n_words"),
    "distinct_words": ("n_words between 50 and 5000 and 10 * n_distinct < 3 * n_words", "10 * n_distinct >= 5 * n_words"),
    "sentence_ends": ("n_words >= 50 and (50 * n_ends < n_words or 2 * n_ends > n_words)", "25 * n_ends >= n_words and 4 * n_ends <= n_words"),
    "letters": ("10 * n_letters < 9 * word_chars", "100 * n_letters >= 95 * word_chars"),
    "bare_words": ("10 * n_bare > n_words", "50 * n_bare <= n_words"),
    "marks_in_row": ("20 * n_runs > n_words", "100 * n_runs <= n_words"),
    "word_length": ("word_chars < 3 * n_words or word_chars > 10 * n_words", "word_chars between 4 * n_words and 7 * n_words"),
}


def statistics(docs: DataFrame, carry: list[str]) -> DataFrame:
    """doc (struct of the carried columns) with the statistics of the whole text.

    Arrays that a later step reads inside a lambda are columns of a select of their own, used there more than once, so that
    they are computed once a row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    step = docs.select(F.struct(*[quoted(c).alias(c) for c in carry]).alias("doc"), text.alias("text"))
    step = step.select("doc", "text", F.array_remove(F.split("text", SPACE), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    at = lambda k: F.get("words", k)
    window = lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("i"))
    windows = F.when(F.size("words") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("words") - 3), window))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    step = step.select(
        "doc",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size(F.filter("words", lambda w, i: F.coalesce(w == at(i - 1), F.lit(False)))).cast("long").alias("n_same_next"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_exclamations"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit(r"[.!?](?=[\x20\x09-\x0D]|\z)")).cast("long").alias("n_ends"),
        F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.regexp_count("text", F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])")).cast("long").alias("n_bare"),
        F.regexp_count("text", F.lit(r"[^\p{L}\p{N}\x20\x09-\x0D]{3,}")).cast("long").alias("n_runs"),
        "words",
        windows.alias("windows"),
    )
    # Windows of equal hash stand together; their words are compared.
    equal = lambda x, y, k: at(x["i"] + k) == at(y["i"] + k)
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & equal(x, y, 0) & equal(x, y, 1) & equal(x, y, 2), F.lit(False))
    again = F.filter("windows", lambda x, i: same(x, F.get("windows", i - 1)) | same(x, F.get("windows", i + 1)))
    plain = [c for c in step.columns if c not in ("words", "windows")]
    step = step.select(*plain, F.sort_array(F.transform(again, lambda x: x["i"])).alias("places"))
    # A window covers three words, fewer where the next one starts earlier.
    covered = F.aggregate(F.transform("places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("places", i + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x)
    return step.select(*plain, covered.alias("n_repeat_words"))


def votes() -> Column:
    """Array of 1 (good), -1 (bad) and 0 (abstains), in the order of RULES; texts without words get no vote."""
    return F.expr("array(" + ", ".join(f"case when n_words = 0 then 0 when {bad} then -1 when {good} then 1 else 0 end" for bad, good in RULES.values()) + ")")


def _posterior(state: str, pattern: str) -> str:
    """Chance of good quality under a model, for an array of votes (SQL)."""
    weight = f"zip_with({pattern}, zip_with({state}.good, {state}.bad, (g, b) -> struct(g, b)), (v, m) -> case v when 1 then ln(m.g / m.b) when -1 then ln((1 - m.g) / (1 - m.b)) else 0D end)"
    return f"1 / (1 + exp(-aggregate({weight}, ln({state}.prior / (1 - {state}.prior)), (s, x) -> s + x)))"


def fit(voted: DataFrame, iterations: int = ITERATIONS) -> dict:
    """prior, and for each rule the chance of a good vote on good and on bad documents."""
    n = len(RULES)
    start = f"named_struct('prior', 0.8D, 'good', array_repeat({FIRST_GOOD}D, {n}), 'bad', array_repeat({FIRST_BAD}D, {n}))"
    table = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n")).groupBy().agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    scored = f"transform(patterns, x -> named_struct('votes', x.votes, 'n', x.n, 'p', {_posterior('s', 'x.votes')}))"

    def share(weight: str, first: str) -> str:
        total = lambda test: f"aggregate(e, 0D, (t, x) -> t + if({test}, {weight}, 0D))"
        return f"transform(sequence(0, {n - 1}), j -> ({total('get(x.votes, j) = 1')} + {PRIOR_WEIGHT} * {first}) / ({total('get(x.votes, j) <> 0')} + {PRIOR_WEIGHT}))"

    prior = "(aggregate(e, 0D, (t, x) -> t + x.n * x.p) + 0.8D) / (aggregate(e, 0D, (t, x) -> t + x.n) + 1)"
    step = f"element_at(transform(array({scored}), e -> named_struct('prior', {prior}, 'good', {share('x.n * x.p', f'{FIRST_GOOD}D')}, 'bad', {share('x.n * (1 - x.p)', f'{FIRST_BAD}D')})), 1)"
    row = table.select(F.expr(f"aggregate(sequence(1, {iterations}), {start}, (s, i) -> {step})").alias("model")).first()["model"]
    return {"prior": row["prior"], "rules": {k: (g, b) for k, g, b in zip(RULES, row["good"], row["bad"], strict=True)}}


def posterior(model: dict) -> Column:
    """Chance of good quality of a row with votes."""
    array = lambda k: "array(" + ", ".join(f"{x[k]!r}D" for x in model["rules"].values()) + ")"
    state = f"named_struct('prior', {model['prior']!r}D, 'good', {array(0)}, 'bad', {array(1)})"
    return F.expr(_posterior("m", "votes").replace("m.good", f"{state}.good").replace("m.bad", f"{state}.bad").replace("m.prior", f"{state}.prior"))


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words")


def judged(docs: DataFrame, carry: list[str], keep: float = KEEP) -> DataFrame:
    """doc, the statistics, votes, base_failed, probability and kept of every document."""
    voted = materialise(statistics(docs, carry).withColumn("votes", votes()), "votes")
    model = fit(voted)
    return voted.withColumns({"base_failed": base_failed(), "probability": posterior(model)}).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= keep))


def kept_documents(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """The documents that are kept, with their own columns."""
    return judged(docs, docs.columns, keep).where("kept").select("doc.*")


