"""Personal data: base patterns, and identifiers found by contexts that the base finds induce.

Base spans (email, ip, card, phone) are regular expressions with checks, leftmost and without overlap for each kind. From them
as seeds, lexical patterns are induced: the two words before a find, known or accepted in a round before. A bipartite graph of patterns and instances (values) is
scored in rounds: a pattern's confidence is its share of known instances among all places in the corpus where its words
stand; an unknown value (whole tokens with digits, or an address, that no base span touches) of a loose shape that seeds of
the kind have is accepted when confident patterns speak for it enough, and is then known in the next round. Accepted values in confident
contexts become spans.

Loose shapes: for a phone, how many digits it has, where country and area may be missing; for a card, how many digits; for an ip,
four numbers with dots; for an email, an at sign (@, (at) or [at], also between blanks) with any host. What can be found beyond the base
is so: phones without +, cards in any groups or with a wrong check digit, ips of numbers beyond 255, emails whose host has no dot or
whose at sign is spelt.

Everything is DataFrame functions. Texts are split at matches, which gives the places without any user code. The graph has
one row for each distinct pattern and value, summed before the shuffle, so a value or context that a third of all rows hold is
one row. Contexts are counted over all words of all texts.

Defined cases: a null text is empty; spans are in code points, the end exclusive; a failing match is dropped without another
try; repeated documents are each read; a text of any length is read whole; of runs of tokens from one place on, that of the closest
shape is taken, then the longest; the carried columns travel inside `doc`, so names cannot clash, whatever dots are in them; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, discard, materialise, quoted

KINDS = ("email", "ip", "card", "phone")
#: For each kind: what a text must hold at all, the match, and what it must pass. A match can begin inside a run of its first characters only where
#: the match before it ended, so a run is read once.
FIRST = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){13}",
    "phone": r"\+[0-9]",
}
MATCH = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: The first digits of a number that may be an identifier, where a token starts; the group holds it with what digit groups follow, to the last token's end.
NUMBER = r"(?<![A-Za-z0-9])(?<![A-Za-z0-9@][._+/()-]{1,3})[+(]{0,2}+(?=[0-9](?:[\x20().0-9/-]{0,3}?[0-9]){4})(?=([0-9]++(?:[\x20()./-]{1,3}[0-9]++){0,18}+[A-Za-z0-9._@:+/()-]*+))[0-9]++"
#: What a text with such a number has, and the whole form of one.
NUMBERS = r"[0-9](?:[\x20()./-]{0,3}[0-9]){4}"
GROUPS = r"\A[0-9]+(?:[\x20()./-]{1,3}[0-9]+)*\z"
#: An address whose host has no dot, whose at sign is spelt or stands between blanks, or whose letters are not of ASCII.
ADDRESS = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*+"
ADDRESSES = r"@|\(at\)|\[at\]"
#: Least and most digits of a number, and of a phone; so many digits of country and area may be left out of a phone.
DIGITS = (5, 19)
PHONE_DIGITS = 7
LEFT_OUT = 4
#: The words before a span are looked for in so many characters before it, then, where these hold no two whole words, in more, at last in all.
LOOK_BACK = (80, 1_000, 20_000)
#: Least distinct known or accepted values of a pattern, least confidence, and least score of an instance (sum of confidence times log of the values).
MIN_VALUES = 5
MIN_CONFIDENCE = 0.6
MIN_SCORE = 1.5
MIN_SHAPE = 3
BROADCAST_ROWS = 100_000
#: So many contexts are looked for inside each text; more are joined with all word pairs.
LISTED = 5_000


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _places(text: Column, pattern: str) -> Column:
    """Array of (start, stop, value) of all matches: what stands between them gives the places."""
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint,value:string>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        stop = begin + F.length(x["value"])
        return F.struct(stop.alias("at"), F.concat(state["out"], F.array(F.struct(begin.alias("start"), stop.alias("stop"), x["value"].alias("value")))).alias("out"))

    pairs = F.zip_with(values, F.slice(gaps, F.lit(1), F.size(values)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    return F.aggregate(pairs, start, step, lambda s: s["out"])


def _base(kind: str) -> Column:
    found = F.filter(_places(F.col("text"), MATCH[kind]), lambda x: _passes(kind, x["value"]))
    typed = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["stop"].alias("stop"), x["value"].alias("value")))
    return F.when(F.col("text").rlike(FIRST[kind]), typed).otherwise(F.array().cast("array<struct<start:bigint,kind:int,stop:bigint,value:string>>"))


def _last_two(before: Column, first: str) -> Column:
    """The last two whole words of a text, behind its last white space; a word begins behind `first`. Reads the text once."""
    whole = F.regexp_replace(before, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]++\z", "")
    return F.regexp_extract(whole, first + r"([^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)[\x20\x09-\x0D]++\z", 1)


def _context(start: Column) -> Column:
    """The two words before the token in which a span starts, in lower case; empty if there are fewer."""
    blank, begin = r"[\x20\x09-\x0D]", r"(?:\A|[\x20\x09-\x0D])"
    words = _last_two(F.substring(F.col("text"), F.lit(1), start.cast("int")), begin)
    for size in reversed(LOOK_BACK):
        near = F.substring(F.col("text"), F.greatest(start - size, F.lit(0)).cast("int") + 1, F.least(start, F.lit(size)).cast("int"))
        cut = _last_two(near, blank)
        words = F.when(start <= size, _last_two(near, begin)).when(cut != "", cut).otherwise(words)
    return F.lower(F.regexp_replace(words, SPACE, " "))


def _layout(value: Column) -> Column:
    """The digit groups of a number: 999 999 9999."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[^9]+", " "))


def _count(digits: Column) -> Column:
    return F.concat(F.lit("#"), digits.cast("string"))


def _shapes(value: Column) -> Column:
    """Loose shapes of an unknown value, the closest first: its at sign, or its groups and dots, and how many digits it has."""
    dotted = F.regexp_replace(F.regexp_replace(value, r"\x20", ""), "[0-9]+", "9")
    number = F.array(F.when(dotted == "9.9.9.9", dotted).otherwise(_layout(value)), _count(F.length(_digits(value))))
    return F.when(value.rlike(ADDRESSES), F.array(F.lit("@"))).otherwise(number)


def _seed_shapes(kind: Column, value: Column) -> Column:
    """The loose shapes that a known value lets others have. A phone may lack its country and area."""
    layout, digits = _layout(value), F.length(_digits(value))
    groups = F.split(layout, " ")
    ends = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda k: F.array_join(F.slice(groups, k, F.size(groups)), " "))
    ends = F.filter(ends, lambda x: F.length(F.regexp_replace(x, " ", "")) >= F.greatest(F.lit(PHONE_DIGITS), digits - LEFT_OUT))
    counts = F.transform(F.sequence(F.greatest(F.lit(PHONE_DIGITS), digits - LEFT_OUT), digits), _count)
    of = lambda name: kind == KINDS.index(name)
    return F.when(of("email"), F.array(F.lit("@"))).when(of("ip"), F.array(F.lit("9.9.9.9"))).when(of("card"), F.array(layout, _count(digits))).otherwise(F.array_union(ends, counts))


def _numbers(text: Column) -> Column:
    """Array of (start, stop, value) of unknown numbers: from each token with digits on, every run of whole tokens that has few enough digits."""
    gaps, heads, tails = F.split(text, NUMBER, -1), F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,head:string,tail:string>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        return F.struct((begin + F.length(x["head"])).alias("at"), F.concat(state["out"], F.array(F.struct(begin.alias("start"), x["head"].alias("head"), x["tail"].alias("tail")))).alias("out"))

    def runs(x: Column) -> Column:
        signs = F.regexp_extract(x["head"], r"\A[+(]*", 0)
        tokens = F.split(x["tail"], " ")
        some = F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda k: F.regexp_replace(F.array_join(F.slice(tokens, F.lit(1), k), " "), r"[^A-Za-z0-9]+\z", ""))
        whole = F.filter(F.array_distinct(some), lambda v: v.rlike(GROUPS) & F.length(_digits(v)).between(*DIGITS))
        return F.transform(whole, lambda v: F.struct(x["start"].alias("start"), (x["start"] + F.length(signs) + F.length(v)).alias("stop"), F.concat(signs, v).alias("value")))

    pairs = F.zip_with(F.arrays_zip(heads.alias("head"), tails.alias("tail")), F.slice(gaps, F.lit(1), F.size(heads)), lambda v, g: F.struct(v["head"].alias("head"), v["tail"].alias("tail"), g.alias("gap")))
    return F.flatten(F.transform(F.aggregate(pairs, start, step, lambda s: s["out"]), runs))


def base_spans(docs: DataFrame, carry: list[str]) -> DataFrame:
    """doc, absent (the text is null), text, base (spans by start, then kind), seeds and others (spans with value and context)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    step = docs.select(F.struct(*[quoted(c).alias(c) for c in carry]).alias("doc"), F.col("text").isNull().alias("absent"), text.alias("text"))
    step = step.withColumn("base", F.sort_array(F.concat(*[_base(k) for k in KINDS])))
    none = F.array().cast("array<struct<start:bigint,stop:bigint,value:string>>")
    numbers = F.when(F.col("text").rlike(NUMBERS), _numbers(F.col("text"))).otherwise(none)
    addresses = F.when(F.col("text").rlike(ADDRESSES), _places(F.col("text"), ADDRESS)).otherwise(none)
    step = step.withColumn("apart", F.filter(F.concat(numbers, addresses), lambda x: ~F.exists("base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"]))))
    seeds = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["value"].alias("value"), _context(b["start"]).alias("context")))
    others = F.transform("apart", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value"), _context(x["start"]).alias("context")))
    return step.select("doc", "absent", "text", "base", seeds.alias("seeds"), others.alias("others"))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _context_counts(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """How often the words of each context (a written table) stand in all texts."""
    words = docs.select(F.array_remove(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), SPACE), "").alias("words"))
    pairs = F.zip_with("words", F.slice("words", F.lit(2), F.size("words")), lambda a, b: F.concat_ws(" ", a, b))
    if contexts.count() <= LISTED:
        wanted = [r["context"] for r in contexts.collect()]
        found = words.select(F.explode(F.filter(pairs, lambda x: x.isin(wanted))).alias("context"))
    else:
        found = words.select(F.explode(pairs).alias("context")).join(contexts, "context", "left_semi")
    return found.groupBy("context").agg(F.count("*").alias("places"))


def _fitting(found: DataFrame) -> DataFrame:
    """row, start, stop, value, context and kind of the unknown values whose loose shape known ones of the kind have; one a place and kind.

    Of the runs of tokens from one place on, that of the closest shape is taken, then the longest.
    """
    seeds = found.select(F.explode("seeds").alias("x")).select("x.kind", "x.value").distinct()
    shapes = seeds.select("kind", F.explode(F.array_distinct(_seed_shapes(F.col("kind"), F.col("value")))).alias("shape"))
    shapes = materialise(shapes.groupBy("kind", "shape").agg(F.count("*").alias("n")).where(f"n >= {MIN_SHAPE}").select("kind", "shape"), "shapes")
    others = found.select("row", F.explode("others").alias("x")).select("row", "x.*").where("context <> ''")
    shaped = others.select("*", F.posexplode(_shapes(F.col("value"))).alias("far", "shape")).join(_few(shapes), "shape")
    best = F.min(F.struct("far", (-F.col("stop")).alias("less"), "stop", "value", "context")).alias("x")
    fitting = materialise(shaped.groupBy("row", "start", "kind").agg(best).select("row", "start", "kind", "x.stop", "x.value", "x.context"), "fitting")
    discard(shapes)
    return fitting


def induced(found: DataFrame, docs: DataFrame, rounds: int | None = None) -> DataFrame | None:
    """Accepted places (row, start, kind, stop) of unknown values, or None; found is written by personal_data().

    Without a number of rounds they go on until one accepts nothing new. They end, as known values only ever become more.
    """
    fitting = _fitting(found)
    seeds = found.select(F.explode("seeds").alias("x")).select("x.kind", "x.value", "x.context", F.lit(True).alias("known"))
    others = fitting.select("kind", "value", "context", F.lit(False).alias("known"))
    graph = materialise(seeds.unionByName(others).where("context <> ''").groupBy("kind", "value", "context", "known").agg(F.count("*").alias("n")), "graph")
    if graph.where("not known").isEmpty():
        return None
    # In no round has a pattern more values, or more instances, than known and unknown ones of its kind together; and it has no fewer places
    # than in the texts that have any. So few contexts are left to be counted in all texts, and none that could become a pattern is lost.
    held = graph.groupBy("context", "kind").agg(F.countDistinct("value").alias("values"), F.sum("n").alias("held")).where(f"values >= {MIN_VALUES}")
    held = materialise(held.groupBy("context").agg(F.max("held").alias("held")), "held")
    near = _context_counts(found.where("size(seeds) + size(others) > 0").select("text"), held.select("context"))
    contexts = materialise(near.join(held, "context").where(F.col("held") >= MIN_CONFIDENCE * F.col("places")).select("context"), "contexts")
    if contexts.isEmpty():
        return None
    places = materialise(_context_counts(docs, contexts), "places")
    linked = materialise(graph.join(places, "context"), "linked")
    unknown = linked.where("not known")
    accepted, done = None, 0
    while rounds is None or done < rounds:
        everywhere = linked.where("known")
        if accepted is not None:
            everywhere = everywhere.unionByName(unknown.join(accepted.select("value", "kind").distinct(), ["value", "kind"]).select(*linked.columns))
        patterns = everywhere.groupBy("context", "kind").agg(F.countDistinct("value").alias("values"), (F.sum("n") / F.max("places")).alias("confidence")).where(f"values >= {MIN_VALUES} and confidence >= {MIN_CONFIDENCE}")
        support = unknown.join(materialise(patterns, "patterns"), ["context", "kind"])
        scored = support.withColumn("score", F.sum(F.expr("confidence * ln(values + 1)")).over(Window.partitionBy("kind", "value")))
        now = materialise(scored.where(f"score >= {MIN_SCORE}").select("context", "value", "kind"), "accepted")
        count, before = now.count(), accepted.count() if accepted is not None else 0
        accepted, done = now, done + 1
        if count == before:
            break
    for old in (graph, held, contexts, places):
        discard(old)
    return fitting.join(_few(accepted), ["context", "value", "kind"]).select("row", "start", "kind", "stop") if count else None


def personal_data(docs: DataFrame, carry: list[str], rounds: int | None = None) -> DataFrame:
    """doc, absent, text, base and spans (start, kind, stop) of every document."""
    found = materialise(base_spans(docs, [*carry]).withColumn("row", F.monotonically_increasing_id()), "pii")
    plain = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["stop"].alias("stop")))
    result = found.select("row", "doc", "absent", "text", "base", plain.alias("spans"))
    if (accepted := induced(found, docs, rounds)) is not None:
        more = accepted.groupBy("row").agg(F.collect_set(F.struct("start", "kind", "stop")).alias("more"))
        result = result.join(more, "row", "left").withColumn("spans", F.sort_array(F.concat("spans", F.coalesce("more", F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")))))
    return result.select("doc", "absent", "text", "base", "spans")


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind, base_sha256 and spans of every document."""
    found = personal_data(docs, ["doc_id"])
    of_kind = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc.doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with each span (overlapping ones united) replaced by its first kind in angle brackets, and n_chars anew."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        between = F.substring(F.col("text"), (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        fresh = F.struct(s["stop"].alias("at"), F.concat(state["out"], F.array(between, F.get(names, s["kind"]))).alias("out"))
        return F.when(s["start"] >= state["at"], fresh).otherwise(F.struct(F.greatest(state["at"], s["stop"]).alias("at"), state["out"].alias("out")))

    def finish(state: Column) -> Column:
        return F.concat(F.array_join(state["out"], ""), F.substring(F.col("text"), (state["at"] + 1).cast("int"), F.length("text")))

    found = personal_data(docs, [c for c in docs.columns if c != "text"])
    clean = F.when(F.col("absent"), F.lit(None).cast("string")).when(F.size("spans") > 0, F.aggregate("spans", start, step, finish)).otherwise(F.col("text"))
    rows = found.select("doc", clean.alias("clean"))
    return rows.select(*[F.col("clean").alias(c) if c == "text" else F.coalesce(F.length("clean").cast("long"), F.col("doc")[c]).alias(c) if c == "n_chars" else F.col("doc")[c].alias(c) for c in docs.columns])
