"""Personal data by rules, and by contexts that the rules' finds teach, in DataFrame operations alone.

Rules find emails, IP addresses, card and phone numbers: leftmost matches that don't overlap, each then judged (parts up to 255, Luhn's
sum, number of digits). Positions are code points, from the lengths of what lies between matches.

What rules find are seeds. A unit is a phone or card written with spaces, or a word with a digit or an @; one of enough digits, or with an
@, may be an identifier. A pattern is the two words before a unit, an instance the unit itself; edges of their graph are counted over all documents,
and each pattern's occurrences before any word whatever, so that a pattern is only as good as the share of them that identifiers follow.
In each of ``ROUNDS`` rounds a pattern with at least ``SUPPORT`` different known instances of a kind scores the share of its occurrences that
they make up; an instance that isn't known gets 1 - prod(1 - score) over the patterns of a kind from ``PATTERN`` on, and is known from ``ACCEPT`` on,
with that confidence, in the next. An identifier so found is one wherever it stands, unless a rule's span overlaps it.

Copies weigh nothing in the support, which counts different instances. Only patterns that ``SUPPORT`` different units follow are counted in the
texts. Spans come back to their documents by a row number of a written table, so no group of copies meets in one key. Tables are broadcast
by a checked size alone.

Edge cases: a null or empty text has no span; repeated rows have their spans each; null ids are ids; texts of any length, with any number of
spans (positions take time in proportion); ties between kinds go to the kind listed first; an empty table gives no row. Only the id and text
columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import let, shingles, words
from .session import cut

#: Kinds in order, and what a match of each looks like. Repetitions are possessive and start where a run starts (or where a match ended):
#: the same matches as with greedy ones, in linear time and without recursion.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be sought.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_WORD = r"[^\x20\x09-\x0D]"
UNIT = rf"(?<!{_WORD})(?:\+[0-9][\x20().0-9-]+[0-9]|[0-9](?:[\x20-]?[0-9]){{12,}}+|[^\x20\x09-\x0D0-9@]*+[0-9@]{_WORD}*+)"
#: ASCII punctuation that may surround a unit; digits and code points that a unit needs and may have.
AROUND = "!\"#$%&'()*,-./:;<=>?@[\\]^_`{|}~"
DIGITS, LONGEST = 4, 64
SUPPORT, PATTERN, ACCEPT, ROUNDS = 3, 0.6, 0.8, 3
#: Code points before a unit in which its two words are sought.
BEFORE = 96
#: Bytes of a table that is broadcast at most, about.
MAX_BROADCAST = 32 << 20
STEP = 256
NONE = "array<struct<start:bigint,end:bigint,match:string>>"


def running(sizes: Column) -> Column:
    """Sums of the numbers before each one: by runs of STEP, so that the work isn't the square of an array's length."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + x)
    whole = lambda n: F.sequence(F.lit(0), F.floor((n - 1) / STEP).cast("int"))

    def of(l: Column) -> Column:
        def by_run(sums: Column) -> Column:
            one = lambda c: let(F.slice(l, c * STEP + 1, STEP), lambda part: let(total(F.slice(sums, F.lit(1), c)), lambda base: F.transform(part, lambda x, i: base + total(F.slice(part, F.lit(1), i)))))
            return F.flatten(F.transform(whole(F.size(l)), one))

        return let(F.transform(whole(F.size(l)), lambda c: total(F.slice(l, c * STEP + 1, STEP))), by_run)

    return let(sizes, lambda l: F.when(F.size(l) > 0, of(l)).otherwise(F.array().cast("array<bigint>")))


def matches(text: Column, pattern: str, where: Column, extra: Callable[[Column, Column], dict[str, Column]] = lambda match, before: {}, kind: str = NONE) -> Column:
    """(start, end, match, ..) of a pattern's matches. ``extra`` makes more fields of a match and the text before it since the last one."""

    def of(x: Column) -> Column:
        found, parts = x["found"], x["parts"]

        def placed(before: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                start = F.get(before, i) + F.length(F.get(parts, i))
                more = extra(m, F.get(parts, i))
                return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match"), *(c.alias(k) for k, c in more.items()))

            return F.transform(found, one)

        return let(running(F.zip_with(found, F.slice(parts, F.lit(1), F.size(found)), lambda m, p: (F.length(m) + F.length(p)).cast("long"))), placed)

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("parts"))
    return F.when(where, let(both, of)).otherwise(F.array().cast(kind))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether Luhn's sum of a string of digits is divisible by ten."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    at = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    return F.aggregate(F.transform(at, lambda d, i: F.when(i % 2 == 1, doubled(d.cast("int"))).otherwise(d.cast("int"))), F.lit(0), lambda s, d: s + d) % 10 == 0


def judged(kind: str, m: Column) -> Column:
    """Whether a match of a kind's pattern stands."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def rules(text: Column) -> Column:
    """(k, start, end) of the rules' spans, by kind as listed, then place; ``k`` is the kind's number."""
    digit = text.rlike("[0-9]")

    def of(k: int, kind: str) -> Column:
        where = (F.lit(True) if kind == "email" else digit) & F.contains(text, F.lit(NEEDS[kind]))
        good = F.filter(matches(text, PATTERNS[kind], where), lambda m: judged(kind, m["match"]))
        return F.transform(good, lambda m: F.struct(F.lit(k).alias("k"), m["start"].alias("start"), m["end"].alias("end")))

    return F.concat(*(of(k, kind) for k, kind in enumerate(KINDS)))


def _known(core: Column) -> Column:
    """The number of the kind that a unit as a whole is, by the rules."""
    out = F.lit(None).cast("int")
    for k, kind in reversed(list(enumerate(KINDS))):
        out = F.when(core.rlike(f"^(?:{PATTERNS[kind]})$") & judged(kind, core), F.lit(k)).otherwise(out)
    return out


def _context(before: Column) -> Column:
    """The two words before a unit as one hash, null where there aren't two."""
    tail = words(F.substring(before, -BEFORE, BEFORE))
    enough = lambda w: (F.size(w) > 2) | ((F.size(w) == 2) & (F.length(before) <= BEFORE))
    return let(tail, lambda w: F.when(enough(w), F.element_at(shingles(F.slice(w, -2, 2), 2), 1)))


def units(text: Column) -> Column:
    """(start, end, instance, kind, context) of the units that are or may be identifiers."""

    def fields(m: Column, before: Column) -> dict[str, Column]:
        core = F.rtrim(F.ltrim(m, F.lit(AROUND)), F.lit(AROUND))
        return {"lead": F.length(m) - F.length(F.ltrim(m, F.lit(AROUND))), "core": core, "context": _context(before)}

    kind = "array<struct<start:bigint,end:bigint,match:string,lead:int,core:string,context:bigint>>"
    found = matches(text, UNIT, text.rlike("[0-9@]"), fields, kind)
    able = F.filter(found, lambda u: F.length(u["core"]).between(DIGITS, LONGEST) & ((F.length(_digits(u["core"])) >= DIGITS) | F.contains(u["core"], F.lit("@"))))
    made = lambda u: F.struct((u["start"] + u["lead"]).alias("start"), (u["start"] + u["lead"] + F.length(u["core"])).alias("end"), F.lower(u["core"]).alias("instance"), _known(u["core"]).alias("kind"), u["context"].alias("context"))
    return F.transform(able, made)


def _small(df: DataFrame, size: int) -> DataFrame:
    """``df``, marked for broadcast where so many rows of at most two numbers and an identifier are small."""
    return F.broadcast(df) if size * (48 + LONGEST) <= MAX_BROADCAST else df


def contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(context, total): how often each wanted pair of words stands before any word. Pairs are counted before they meet the wanted ones."""
    pairs = let(shingles(words(F.col("text")), 2), lambda s: F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))))
    return texts.select(F.explode(pairs).alias("context")).groupBy("context").agg(F.count("*").alias("total")).join(wanted, "context", "left_semi")


def patterns(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(context, kind, score) of the patterns that count, from edges (context, instance, n, total) and what is known (instance, kind, confidence)."""
    met = edges.join(known, "instance").groupBy("context", "kind").agg(F.sum(F.col("n") * F.col("confidence")).alias("hits"), F.count("*").alias("support"), F.max("total").alias("total"))
    good = met.where(F.col("support") >= SUPPORT).withColumn("score", F.col("hits") / F.greatest("total", "hits")).where(F.col("score") >= PATTERN)
    return good.groupBy("context").agg(F.max_by(F.struct("kind", "score"), F.struct("score", -F.col("kind"))).alias("p")).select("context", "p.kind", "p.score")


def discover(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(instance, kind, confidence) of what the graph adds to the seeds (instance, kind)."""
    known, found = seeds.withColumn("confidence", F.lit(1.0)), None
    for _ in range(ROUNDS):
        good = patterns(edges, known)
        rest = edges.join(known.select("instance"), "instance", "left_anti").join(good, "context")
        doubt = F.sum(F.log(1 - F.least("score", F.lit(0.999))))
        scored = rest.groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("confidence")).where(F.col("confidence") >= ACCEPT)
        new = cut(scored.groupBy("instance").agg(F.max_by(F.struct("kind", "confidence"), F.struct("confidence", -F.col("kind"))).alias("b")).select("instance", "b.kind", "b.confidence"))
        if new.isEmpty():
            break
        found = new if found is None else found.unionByName(new)
        known = known.unionByName(new)
    return found if found is not None else known.limit(0)


def find(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a document: id, base (k, start, end) by the rules, and found (k, start, end, confidence) by contexts."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = cut(texts.select("id", rules(F.col("text")).alias("base"), units(F.col("text")).alias("units"))).withColumn("row", F.monotonically_increasing_id())
    seen = held.select("row", F.inline("units"))
    counted = cut(seen.where("context is not null").groupBy("context", "instance").agg(F.count("*").alias("n"), F.max("kind").alias("kind")))
    wanted = cut(counted.groupBy("context").agg(F.count("*").alias("instances")).where(F.col("instances") >= SUPPORT).select("context"))
    edges = cut(counted.join(contexts(texts, wanted), "context"))
    seeds = edges.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind"))
    new = discover(edges.drop("kind"), seeds)
    added = seen.where("kind is null").join(_small(new.withColumnRenamed("kind", "k"), new.count()), "instance")
    added = added.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "start", "end", "confidence"))).alias("added"))
    apart = lambda a: F.forall("base", lambda b: (b["start"] >= a["end"]) | (a["start"] >= b["end"]))
    found = F.filter(F.coalesce("added", F.array().cast("array<struct<k:int,start:bigint,end:bigint,confidence:double>>")), apart)
    return held.drop("units").join(added, "row", "left").select(F.col("id").alias(id_col), "base", found.alias("found"))


def _lines(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``find``'s rows as counts and lines of ``kind:start:end``: the rules' spans by their SHA-256, and all spans."""
    every = F.array_sort(F.concat("base", F.transform("found", lambda f: F.struct(f["k"].alias("k"), f["start"].alias("start"), f["end"].alias("end")))))
    count = lambda k: F.size(F.filter("base", lambda b: b["k"] == k)).cast("long")
    return found.select(id_col, *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(_lines(F.col("base")), 256).alias("base_sha256"), _lines(every).alias("spans"), F.size("found").cast("long").alias("n_found"))
