"""Personal data: base patterns, and contextual extraction bootstrapped from what they find.

Only DataFrame functions run here.  The base patterns find e-mail addresses, IP addresses, card and phone numbers.
Those seeds induce lexical patterns: the word or the two words before them, the word behind, the words on both sides,
in lower case and with digits alike.  Spark scores the graph of patterns and instances in turns until no further
pattern is trusted: a pattern is as reliable as its instances, an instance as its patterns.  Reliable patterns then mark
identifier-like tokens that no base pattern takes.

All trusted patterns are kept, as rows: identifier-like tokens are joined with them by their contexts, and what they
mark goes back to the texts by two hashes of the text.  Few patterns are broadcast; many are joined in SALTS parts, so
that a word that stands before many tokens is spread.  Instances and patterns stay distributed.

The expressions are written so that no input makes the matcher recurse: repetitions of groups are possessive or
bounded, and a match starts only where none before it could go on.

Results by case: null and empty texts have no spans; repeated rows are alike; a null id is kept; places count code
points; an empty table gives an empty result; further columns are ignored.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

# Kinds in their order, and the patterns, equal to the plain ones named beside them.
KINDS = ("email", "ip", "card", "phone")
SALTS = 16
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
# [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# [0-9]([\x20-]?[0-9])+ with 14 to 19 digits
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])"
# \+[0-9][\x20().0-9-]+[0-9]
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# a token with a digit or an at sign
SLOT = r"(?<!\S)\S*[@0-9]\S*"
# What an unseen identifier of a kind must look like, without the marks around it.
SHAPES = {"email": r"^[^@\s]+@[^@\s]+$", "ip": r"^[0-9]{1,3}(?:[.:_-][0-9]{1,3}){3}$", "card": r"^[0-9](?:-?[0-9]){11,18}$", "phone": r"^\+?\(?[0-9](?:[().-]{0,2}[0-9]){6,14}$"}


def found(text, pattern):
    """Spans (start, end, value) of a pattern: the text is split at the matches, and lengths are added up."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), values, lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def add(state, x):
        start = state["at"] + x["gap"]
        end = start + F.length(x["value"])
        spans = F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))))
        return F.when(x["value"].isNull(), state).otherwise(F.struct(end.alias("at"), spans.alias("spans")))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("spans")), add, lambda s: s["spans"])


def digits(value):
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number):
    def add(total, i):
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def low_part(part):
    plain = F.regexp_replace(part, "^0+", "")
    return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))


def base_columns(text):
    """One column of spans for each kind."""
    some = lambda test, pattern: F.when(test, found(text, pattern)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
    digit = text.rlike("[0-9]")
    return {
        "email": some(F.contains(text, F.lit("@")), EMAIL),
        "ip": F.filter(some(digit & F.contains(text, F.lit(".")), IP), lambda s: F.forall(F.split(s["value"], r"\."), low_part)),
        "card": F.filter(some(digit, CARD), lambda s: luhn(digits(s["value"]))),
        "phone": F.filter(some(F.contains(text, F.lit("+")), PHONE), lambda s: F.length(digits(s["value"])).between(10, 15)),
    }


def numbered(spans, k):
    """(start, kind number, end) of spans of the k-th kind."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))


def written(spans):
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def plain_words(words):
    """In lower case, digits alike: the class of a context."""
    return F.regexp_replace(F.lower(words), "[0-9]", "0")


def words_before(text, start, number):
    """The words before a place, one space between them; empty where there are fewer.  Short stretches are tried first."""
    word, blank = r"(\S++)\s++", r"\s"

    def found_in(stretch, first):
        parts = [F.regexp_extract(stretch, first + word * number + "$", i + 1) for i in range(number)]
        return F.when(parts[0] != "", F.concat_ws(" ", *parts)).otherwise("")

    def near(n):
        return found_in(F.substring(text, F.greatest(start - (n - 1), F.lit(1)), F.least(start, F.lit(n))), blank)

    whole = found_in(F.substring(text, F.lit(1), start), r"(?<!\S)")
    out = F.when(near(64) != "", near(64)).when((start > 64) & (near(4096) != ""), near(4096)).otherwise(whole)
    return F.when((start > 0) & F.substring(text, start, F.lit(1)).rlike(blank), out).otherwise("")


def word_after(text, end):
    """The word behind the one that a place ends in; empty where there is none."""
    near = lambda n: F.regexp_extract(F.substring(text, end + 1, F.lit(n)), r"^\S*+\s++(\S++)\s", 1)
    whole = F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"^\S*+\s++(\S++)", 1)
    return F.when(near(64) != "", near(64)).when(near(4096) != "", near(4096)).otherwise(whole)


def contexts(text, start, end):
    """Patterns that a place stands in: the word before, the two words before, the word behind, the words on both sides."""
    one, two, behind = plain_words(words_before(text, start, 1)), plain_words(words_before(text, start, 2)), plain_words(word_after(text, end))
    told = lambda sign, test, *parts: F.when(test, F.concat_ws(" ", F.lit(sign), *parts))
    return F.array_compact(F.array(told("<1", one != "", one), told("<2", two != "", two), told(">1", behind != "", behind), told("<>", (one != "") & (behind != ""), one, behind)))


def candidates(text, base):
    """Identifier-like tokens apart from the base spans: (start, end, value, before), marks around them cut off."""
    after = lambda v: F.regexp_replace(v, r"""^[("'<\[{]+""", "")
    bare = lambda v: F.regexp_replace(after(v), r"""(?<![)"'>\]}.,;:!?])[)"'>\]}.,;:!?]++$""", "")
    lead = lambda v: F.length(v) - F.length(after(v))
    slots = F.when(text.rlike("[@0-9]"), found(text, SLOT)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
    slots = F.filter(slots, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    def trimmed(s):
        start, value = s["start"] + lead(s["value"]), bare(s["value"])
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), contexts(text, s["start"], s["end"]).alias("patterns"))

    return F.filter(F.transform(slots, trimmed), lambda s: reduce(lambda a, b: a | b, (s["value"].rlike(SHAPES[k]) for k in KINDS)))


def with_base(docs, key, text, *others):
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *others)
    rows = rows.withColumns(base_columns(F.col("text")))
    return rows.withColumn("base", F.array_sort(F.concat(*(numbered(F.col(kind), k) for k, kind in enumerate(KINDS)))))


def occurrences(rows):
    """(pattern, value, kind or null), distinct: seeds with their kind, other identifier-like tokens without."""
    def seeds(kind):
        return F.transform(F.col(kind), lambda s: F.struct(contexts(F.col("text"), s["start"], s["end"]).alias("patterns"), F.lower(s["value"]).alias("value"), F.lit(kind).alias("kind")))

    unseen = F.transform(candidates(F.col("text"), F.col("base")), lambda s: F.struct(s["patterns"].alias("patterns"), F.lower(s["value"]).alias("value"), F.lit(None).cast("string").alias("kind")))
    each = rows.select(F.explode(F.concat(*map(seeds, KINDS), unseen)).alias("o")).select(F.explode("o.patterns").alias("pattern"), "o.value", "o.kind")
    return each.groupBy("pattern", "value", "kind").agg(F.count("*").alias("times")).drop("times")


def score_patterns(seeds, unseen, before, scores):
    """(pattern, kind, support, all, reliability) after one more turn over the graph.

    A pattern's reliability for a kind is the mean score of the distinct instances in it; a seed scores 1 for its kind
    and 0 for others, an unseen instance the mean reliability of its patterns, for kinds whose shape it has.
    """
    met = unseen.join(scores.select("pattern", "kind", "reliability"), "pattern")
    met = met.where(reduce(lambda a, b: a | b, ((F.col("kind") == k) & F.col("value").rlike(SHAPES[k]) for k in KINDS)))
    values = met.groupBy("value", "kind").agg(F.sum("reliability").alias("sum")).join(before, "value")
    values = values.select("value", "kind", (F.col("sum") / F.col("patterns")).alias("score"))
    gained = unseen.join(values, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("gain"))
    out = seeds.join(gained, ["pattern", "kind"], "left")
    return out.select("pattern", "kind", "support", "all", ((F.col("support") + F.coalesce("gain", F.lit(0.0))) / F.col("all")).alias("reliability"))


def learn_patterns(rows, least_support=5, least_reliability=0.8):
    """(pattern, kind, reliability) of all that are trusted: the turns end when one trusts no further pattern.

    Reliabilities only grow from turn to turn, so that trusted patterns stay trusted and the turns come to an end.
    """
    graph = checkpointed(occurrences(rows))
    unseen = graph.where("kind is null").select("pattern", "value")
    instances = graph.groupBy("pattern").agg(F.count("*").alias("all"))
    seeds = graph.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("support")).where(F.col("support") >= least_support)
    seeds = checkpointed(seeds.join(instances, "pattern"))
    before = unseen.groupBy("value").agg(F.count("*").alias("patterns"))
    good = lambda scores: scores.where(F.col("reliability") >= least_reliability).select("pattern", "kind", "reliability")
    scores = seeds.withColumn("reliability", F.col("support") / F.col("all"))
    if unseen.isEmpty():  # nothing that a pattern could mark
        return good(scores).limit(0)
    trusted = good(scores).count()
    while True:
        scores = checkpointed(score_patterns(seeds, unseen, before, scores))
        now = good(scores).count()
        if now == trusted:
            return good(scores)
        trusted = now


def with_marks(rows):
    return rows.withColumns({"mark": F.xxhash64("text"), "mark2": F.xxhash64(F.lit(1), "text")})


def marked_tokens(rows, trusted, broadcast):
    """(mark, mark2, more) for each text with tokens behind trusted patterns; more: their (start, kind number, end)."""
    tokens = with_marks(rows).select("mark", "mark2", F.explode(candidates(F.col("text"), F.col("base"))).alias("s"))
    tokens = tokens.select("mark", "mark2", "s.start", "s.end", "s.value", F.explode("s.patterns").alias("pattern"))
    if broadcast:
        met = tokens.join(F.broadcast(trusted), "pattern")
    else:
        salted = trusted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = tokens.withColumn("salt", F.pmod(F.xxhash64("mark", "start"), F.lit(SALTS)).cast("int")).join(salted, ["pattern", "salt"])
    met = met.where(reduce(lambda a, b: a | b, ((F.col("kind") == k) & F.col("value").rlike(SHAPES[k]) for k in KINDS)))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    # a token that patterns of several kinds mark is of the most reliable one, and of the first kind among equals
    best = met.groupBy("mark", "mark2", "start", "end").agg(F.max(F.struct("reliability", (-number).alias("kind"))).alias("best"))
    return best.groupBy("mark", "mark2").agg(F.collect_set(F.struct("start", (-F.col("best.kind")).cast("int").alias("kind"), "end")).alias("more"))


def find_pii(docs: DataFrame, key="doc_id", text="text", most_broadcast=100_000, **how) -> DataFrame:
    """(key, text, email, ip, card, phone, base, spans) for each row of docs.

    The kinds' columns and base hold what the base patterns find; spans also what trusted patterns mark, as structs
    (start, kind number, end).  A marked token never overlaps a base span.  Up to `most_broadcast` trusted patterns,
    of 32 characters on average, are broadcast; more are joined by shuffles, to the same end.
    """
    rows = with_base(docs, key, text)
    trusted = learn_patterns(rows, **how)
    number, length = trusted.agg(F.count("*"), F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()
    if not number:
        return rows.withColumn("spans", F.col("base")).withColumnRenamed("key", key)
    told = marked_tokens(rows, trusted, number <= most_broadcast and length <= 32 * most_broadcast)
    plain = with_marks(docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")))
    out = with_base(plain.join(told, ["mark", "mark2"], "left"), "key", "text", "more")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return out.withColumn("spans", spans).drop("more").withColumnRenamed("key", key)


def redacted(text, spans):
    """The text with a mark like [EMAIL] for each span; of overlapping spans the first one counts."""
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def add(state, s):
        parts = F.concat(state["parts"], F.array(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.get(marks, s["kind"])))
        return F.when(s["start"] < state["at"], state).otherwise(F.struct(s["end"].alias("at"), parts.alias("parts")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    rest = lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, add, rest)).otherwise(text)


def redact_documents(docs: DataFrame, **how) -> DataFrame:
    """docs, with marks in place of personal data; a null text becomes empty."""
    carried = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))
    out = find_pii(carried, key="row", **how)
    return out.select(*((redacted(F.col("text"), F.col("spans")).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c)) for c in docs.columns))


def op1_pii(spark, sf_dir):
    out = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
