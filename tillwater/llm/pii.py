"""Personal data by bootstrapped contextual extraction, in column expressions only.

Seeds are the entities that fixed rules find (BASE: mail addresses, IP
addresses, payment cards, phone numbers). A seed's surroundings induce lexical
patterns: the three and the two words before it, the words on either side, and
its shape. Other identifier-like strings of the text (digit groups, tokens with
digits or @) are candidates, and have patterns of the same kinds. Patterns and
the strings they hold are the two sides of a graph, which is scored in ROUNDS
rounds of joins:

- A pattern's confidence for a kind is the sum of its strings' scores over the
  number of its strings plus one. Patterns below GATE, or with fewer than
  LEAST strings of that kind to start from, say nothing.
- A string's score for a kind that its form allows is 1 less the product of
  (1 - confidence) over its patterns. Seeds score 1. Long hexadecimal tokens
  start at PRIOR as secrets: shape alone doesn't make one.

Strings that reach ACCEPT are spans too, wherever they stand. So a card number
with a wrong digit is found where most numbers of its shape are cards, and
digits of other uses are left alone.

The base rules are column expressions over one row. Positions count code
points; they come from the lengths of what lies between matches. Only found
strings with 64 characters of context on either side leave a text, once for
each distinct text, so copies don't add to the evidence. Tables of the graph
hold hashes; hot patterns are summed before the shuffle.

Results for odd rows: a null text counts as empty and has no spans; an empty
text has none either. Texts are judged whole, whatever their length; no pattern
rescans a run of characters, so time grows with the length. Rows are independent:
repeated rows and doc_ids each keep their result, and so does a null doc_id.
Ties: a string that is accepted for two kinds takes the one with the larger
score, then the first of KINDS. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwater.llm.common import text_or_empty
from tillwater.session import stored

#: Kinds of the base rules, in the order of spans with one start; the method adds secrets.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
ROUNDS, GATE, ACCEPT, LEAST, PRIOR = 4, 0.3, 0.8, 4, 0.6
CONTEXT = 64
#: So many matches are added up together on the way to positions.
RUN = 256

# Every match begins where a run of its first characters begins, or where the match before ended, so runs are read once.
_RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_BYTE = "0*+(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5]|(?<=0))"
_IP = rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"
_CANDIDATE = (
    r"(?<![A-Za-z0-9_.@-])\(?[0-9]++\)?(?:[ .-]{1,2}+\(?[0-9]++\)?)++"
    r"|(?<![A-Za-z0-9_.@-])(?=[A-Za-z_.-]*+[0-9@])[A-Za-z0-9_.@-]++"
)
#: Stands for each character of a base span in what candidates are looked for in.
_FILL = "\x01"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(_IP)
    if kind == "card":
        return let(digits(match), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits(match)).between(10, 15)
    return F.lit(True)


def _ends(lengths: Column) -> Column:
    """Running sums of an array: those of runs first, then within a run."""

    def within(sums: Column) -> Column:
        def end(_: Column, i: Column) -> Column:
            run = F.floor(i / RUN).cast("int")
            before = F.aggregate(F.slice(sums, F.lit(1), run), F.lit(0), lambda a, x: a + x)
            return before + F.aggregate(F.slice(lengths, run * RUN + 1, i % RUN + 1), F.lit(0), lambda a, x: a + x)

        return F.transform(lengths, end)

    runs = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int"))
    sums = F.transform(runs, lambda b: F.aggregate(F.slice(lengths, b * RUN + 1, F.lit(RUN)), F.lit(0), lambda a, x: a + x))
    return let(sums, within)


_MATCH = "array<struct<kind:string,start:int,end:int,text:string,left:string,right:string>>"


def _matches(text: Column, rule: str, kind: Column, passes: Callable[[Column], Column]) -> Column:
    """Matches of a rule that pass, as structs of _MATCH."""

    def located(hits: Column, gaps: Column) -> Column:
        lengths = F.transform(hits, lambda x, i: F.length(F.get(gaps, i)) + F.length(x))

        def spans(ends: Column) -> Column:
            made = F.transform(hits, lambda x, i: F.struct(
                kind.alias("kind"), (F.get(ends, i) - F.length(x)).alias("start"), F.get(ends, i).alias("end"), x.alias("text"),
                F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("right"),
            ))
            return F.filter(made, lambda s: passes(s["text"]))

        return let(let(lengths, _ends), spans)

    none = F.array().cast(_MATCH)
    hits = F.regexp_extract_all(text, F.lit(rule), F.lit(0))
    return let(hits, lambda h: F.when(F.size(h) == 0, none).otherwise(
        let(F.split(text, rule, -1), lambda g: located(h, g)).cast(_MATCH)
    ))


def _hidden(text: Column, rule: str, passes: Callable[[Column], Column]) -> Column:
    """The text with passing matches of a rule blotted out."""

    def joined(hits: Column, gaps: Column) -> Column:
        seen = F.transform(hits, lambda x, i: F.concat(
            F.get(gaps, i), F.when(passes(x), F.repeat(F.lit(_FILL), F.length(x))).otherwise(x)
        ))
        return F.concat(F.array_join(seen, ""), F.element_at(gaps, -1))

    hits = F.regexp_extract_all(text, F.lit(rule), F.lit(0))
    return let(hits, lambda h: F.when(F.size(h) == 0, text).otherwise(let(F.split(text, rule, -1), lambda g: joined(h, g))))


def base_spans(text: Column) -> Column:
    """What the base rules find in a text (not null), as structs of _MATCH, ordered by kind and start."""
    by_kind = [_matches(text, _RULES[k], F.lit(k), lambda x, k=k: _passes(k, x)) for k in BASE]
    by_kind[0] = F.when(F.contains(text, F.lit("@")), by_kind[0]).otherwise(F.array().cast(_MATCH))
    by_kind[3] = F.when(F.contains(text, F.lit("+")), by_kind[3]).otherwise(F.array().cast(_MATCH))
    return F.concat(*by_kind)


def candidates(text: Column) -> Column:
    """Identifier-like strings outside the base spans, less dots and hyphens at their ends."""

    def trimmed(s: Column) -> Column:
        front = F.length(s["text"]) - F.length(F.ltrim(s["text"], F.lit(".-")))
        core = F.btrim(s["text"], F.lit(".-"))
        start = s["start"] + front
        return F.struct(
            s["kind"].alias("kind"), start.alias("start"), (start + F.length(core)).alias("end"), core.alias("text"),
            F.right(F.concat(s["left"], F.substring(s["text"], F.lit(1), front)), F.lit(CONTEXT)).alias("left"),
            F.left(F.concat(F.substring(s["text"], front + F.length(core) + 1, F.length(s["text"])), s["right"]), F.lit(CONTEXT)).alias("right"),
        )

    hidden = reduce(
        lambda t, k: let(t, lambda x: _hidden(x, _RULES[k], lambda m: _passes(k, m))), ("phone", "email", "card", "ip"), text
    )
    found = let(hidden, lambda t: _matches(t, _CANDIDATE, F.lit(None).cast("string"), lambda x: F.length(F.btrim(x, F.lit(".-"))) > 0))
    return F.transform(found, trimmed)


def forms(text: Column) -> Column:
    """The kinds that a candidate's form allows."""
    numeric, n = text.rlike(r"^[0-9 ().-]+$"), F.length(digits(text))
    token = ~numeric & text.rlike("[0-9]") & text.rlike("[A-Za-z]") & ~text.rlike("[@.]")
    allowed = [
        (text.rlike("^[^@]+@[^@]+$"), "email"), (text.rlike(r"^[0-9]{1,4}(\.[0-9]{1,4}){3}$"), "ip"),
        (numeric & n.between(13, 19) & ~F.contains(text, F.lit(".")), "card"), (numeric & n.between(7, 15), "phone"),
        (token & (F.length(text) >= 16), "secret"),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(k)) for c, k in allowed]), lambda k: k.isNotNull())


def patterns(text: Column, left: Column, right: Column) -> Column:
    """The lexical patterns that hold a string: words before it, words on either side, shape."""
    words = lambda side: F.transform(
        F.filter(F.split(F.lower(side), r"\s+"), lambda w: w != ""), lambda w: F.when(w.rlike(f"[0-9@{_FILL}]"), F.lit("#")).otherwise(w)
    )
    glued = F.when(left.rlike(r"\s$"), F.lit(" ")).otherwise(F.lit(""))
    after = F.coalesce(F.get(words(right), F.lit(0)), F.lit("$"))
    shape = F.when(text.rlike("^[0-9 ().-]+$"), F.translate(text, "012345678", "999999999"))
    shape = shape.when(text.rlike("^[0-9A-Fa-f]+$"), F.concat(F.lit("x"), F.length(text)))
    shape = shape.otherwise(F.regexp_replace(F.regexp_replace(text, "[A-Za-z]+", "a"), "[0-9]+", "9"))

    def made(before: Column) -> Column:
        last = lambda n: F.array_join(F.slice(before, -n, n), " ")
        some = F.size(before)
        return F.filter(F.array(
            F.when(some >= 3, F.concat(F.lit("3|"), last(3), glued)), F.when(some >= 2, F.concat(F.lit("2|"), last(2), glued)),
            F.when(some >= 1, F.concat(F.lit("1|"), last(1), glued, F.lit("_ "), after)), F.concat(F.lit("s|"), shape),
        ), lambda p: p.isNotNull())

    return F.transform(let(words(left), made), lambda p: F.unhex(F.md5(p.cast("binary"))))


def scored_strings(seen: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``string``, ``kind`` and ``score`` of strings that reach ACCEPT without being seeds.

    ``seen``: ``string`` (hash), ``seed`` (kind or null), ``forms``, ``prior``, ``patterns`` of every find in a distinct text.
    """
    edges = stored(seen.select("string", F.explode("patterns").alias("pattern")).distinct())
    seeds = seen.filter("seed is not null").select("string", F.col("seed").alias("kind"), F.lit(1.0).alias("start"))
    maybe = seen.filter("seed is null").select("string", F.explode("forms").alias("kind"), "prior")
    maybe = maybe.select("string", "kind", F.when(F.col("kind") == "secret", F.col("prior")).otherwise(F.lit(0.0)).alias("start"))
    nodes = stored(seeds.union(maybe).groupBy("string", "kind").agg(F.max("start").alias("start")))
    # Only patterns with enough strings to start from ever count.
    begun = edges.join(nodes.filter("start > 0"), "string").groupBy("pattern", "kind").count().filter(F.col("count") >= LEAST)
    useful = begun.select("pattern").distinct()
    sizes = edges.join(useful, "pattern").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    useful = stored(begun.select("pattern", "kind").join(sizes, "pattern"))
    live = stored(edges.join(useful.select("pattern").distinct(), "pattern", "left_semi"))
    scores = nodes.withColumn("score", F.col("start"))
    for _ in range(rounds):
        held = live.join(scores.filter("score > 0").select("string", "kind", "score"), "string")
        trust = held.groupBy("pattern", "kind").agg(F.sum("score").alias("sum")).join(useful, ["pattern", "kind"])
        # Rounded, so that the order of a sum doesn't decide.
        trust = trust.select("pattern", "kind", F.round(F.col("sum") / (F.col("n") + 1), 9).alias("trust")).filter(F.col("trust") >= GATE)
        heard = live.join(trust, "pattern").groupBy("string", "kind").agg(F.sum(F.log(1 - F.col("trust"))).alias("doubt"))
        doubt = F.exp(F.coalesce("doubt", F.lit(0.0)))
        scores = stored(nodes.join(heard, ["string", "kind"], "left").select(
            "string", "kind", "start", F.round(1 - (1 - F.col("start")) * doubt, 9).alias("score")
        ))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    best = F.max_by(F.struct("kind", "score"), F.struct("score", (-rank).alias("first")))
    found = scores.filter((F.col("start") < 1) & (F.col("score") >= ACCEPT)).groupBy("string").agg(best.alias("best"))
    return found.select("string", "best.kind", "best.score")


def find(docs: DataFrame) -> DataFrame:
    """Spans of every row of ``docs``: ``doc_id``, ``base`` and ``added`` (arrays of kind, start, end).

    Both are ordered by start, then by the order of KINDS; ``end`` is exclusive. Added spans lie outside the base spans'
    characters.
    """
    text = text_or_empty()
    scan = docs.select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))
    rank = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind)
    interesting = F.col("text").rlike("[0-9@]")
    none = F.array().cast(_MATCH)
    found = stored(scan.select(
        "doc_id", "key",
        F.when(interesting, base_spans(F.col("text"))).otherwise(none).alias("seeds"),
        F.when(interesting, candidates(F.col("text"))).otherwise(none).alias("others"),
    ))
    # One row a distinct text: its finds are the same in all copies.
    once = found.filter("size(seeds) + size(others) > 0").withColumn("n", F.row_number().over(W.partitionBy("key").orderBy(F.lit(1))))
    places = once.filter("n = 1").select("key", F.explode(F.concat("seeds", "others")).alias("s")).select("key", "s.*")
    plain = F.regexp_replace(F.lower("text"), "[ ()-]", "")
    hexadecimal = F.col("text").rlike("^[0-9A-Fa-f]{32,}$") & F.col("text").rlike("[A-Fa-f]") & F.col("text").rlike("[0-9]")
    seen = stored(places.select(
        "key", "start", "end", F.unhex(F.md5(plain.cast("binary"))).alias("string"), F.col("kind").alias("seed"),
        F.when(F.col("kind").isNull(), forms(F.col("text"))).alias("forms"),
        F.when(hexadecimal, F.lit(PRIOR)).otherwise(F.lit(0.0)).alias("prior"),
        patterns(F.col("text"), F.col("left"), F.col("right")).alias("patterns"),
    ))
    accepted = scored_strings(seen.select("string", "seed", "forms", "prior", "patterns"))
    hits = seen.filter("seed is null").join(accepted, "string").filter(F.array_contains("forms", F.col("kind")))
    spans = F.array_sort(F.collect_list(F.struct("start", rank(F.col("kind")).alias("rank"), "kind", "end")))
    more = hits.groupBy("key").agg(spans.alias("spans"))
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    based = F.array_sort(F.transform("seeds", lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
    kind = "array<struct<kind:string,start:int,end:int>>"
    return found.select("doc_id", "key", based.alias("seeds")).join(more, "key", "left").select(
        "doc_id", bare(F.col("seeds")).cast(kind).alias("base"),
        F.coalesce(bare(F.col("spans")).cast(kind), F.array().cast(kind)).alias("added"),
    )


def merged(*spans: Column) -> Column:
    """Arrays of spans as one, in the order of starts and KINDS."""
    rank = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind)
    keyed = F.transform(F.concat(*spans), lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda x: x["span"])


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
