"""Line-first quality rules.

Every line of a document is tried by punctuation, navigation and boilerplate
rules. Lines that fail are removed, and a document that loses too much of its
text, or breaks a rule on the whole text, is rejected. All of it is column
expressions over the one row, without a shuffle: a document's cost grows as
n log n with its length, and no rule looks at other documents.

A null text has no lines and no words; it counts as rejected, as an empty
text does, since both have fewer words than the least. Very long texts are judged whole. Rows are judged one by
one, so repeated rows and doc_ids each keep their result. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwater.llm.common import text_or_empty, unused, without_spaces, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8
#: A document may have this percentage of its words in repeated windows.
MAX_REPEATED = 30
#: A document must keep this share of its word characters after cleaning.
MIN_KEPT = 0.7
#: Phrases that mark a line as boilerplate, compared in lower case.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "use cookies", "cookie policy",
    "enable javascript", "javascript is disabled", "click here", "subscribe to our", "sign up for our",
    "add to cart", "lorem ipsum", "skip to content", "back to top",
)


def _held(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` refers to it from within a lambda."""
    return F.transform(F.array(value), use)[0]


def _symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def line_fails(line: Column, words: Column) -> Column:
    """Whether a line with words breaks a rule.

    Punctuation: more than 3 symbols for every 10 words, or more than 3
    exclamation or question marks for every 10 words beyond the first two;
    shouting, where at least 20 letters have no lower case but for a tenth;
    stuttering, where over 3 of 10 words equal the next one.
    Navigation: two or more menu separators in a line of short items.
    Boilerplate: a listed phrase.
    """
    n = F.size(words)
    symbols = _symbols(line)
    marks = F.length(line) - F.length(F.translate(line, "!?", ""))
    upper = F.length(F.regexp_replace(line, r"[^\p{Lu}]", ""))
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    repeats = F.size(F.filter(words, lambda w, i: w == F.get(words, i + 1)))
    separators = F.size(F.filter(words, lambda w: w.isin("|", "»", "›", "·", "•", ">")))
    lowered = F.lower(line)
    phrase = F.lit(False)
    for text in BOILERPLATE:
        phrase = phrase | F.contains(lowered, F.lit(text))
    return (
        (symbols * 10 > n * 3)
        | ((marks - 2) * 10 > n * 3)
        | ((letters >= 20) & (upper * 10 > letters * 9))
        | (repeats * 10 > n * 3)
        | ((separators >= 2) & (separators * 8 > n))
        | phrase
    )


def judged_lines(text: Column) -> Column:
    """Array of (line, chars, fails) over the \\n-split lines; a line without words never fails."""

    def judge(line):
        return _held(
            words_of(line),
            lambda words: F.struct(
                line.alias("line"),
                F.length(without_spaces(line)).alias("chars"),
                F.when(F.size(words) > 0, line_fails(line, words)).otherwise(F.lit(False)).alias("fails"),
            ),
        )

    return F.transform(F.split(text, "\n"), judge)


def repeated_words(words: Column) -> Column:
    """Number of words inside windows of WINDOW words that occur at least twice in the text.

    Windows are compared by 64-bit hashes, doubled up from word hashes.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    pairs = lambda a: F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + 1)))
    fours = lambda a: F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + 2)))
    eights = lambda a: F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + 4)))

    def count(windows):
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = _held(
            placed,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        s,
                        lambda x, i: (x["h"] == F.get(s, i + 1)["h"])
                        | ((i > 0) & (x["h"] == F.get(s, F.greatest(i - 1, F.lit(0)))["h"])),
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        covered = lambda s: F.aggregate(
            F.transform(s, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - p, F.lit(WINDOW)))),
            F.lit(0).cast("long"), lambda total, x: total + x,
        )
        distinct = F.size(F.array_distinct(windows))
        return F.when(distinct == F.size(windows), F.lit(0).cast("long")).otherwise(_held(starts, covered))

    whole = _held(_held(_held(hashes, pairs), fours), eights)
    windows = F.slice(whole, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    return F.when(F.size(words) > WINDOW, _held(windows, count)).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Counts, cleaned text and verdict of every document.

    Returns ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``n_lines_removed``,
    ``kept_share`` (word characters left by the line rules, 1 for no words),
    ``cleaned`` (text without failed lines) and ``kept``; with ``extra``, those
    columns of ``docs`` first. Repeated rows are judged one by one.
    """
    extra = extra or []
    t, ws, ls = unused(docs, "_text", "_words", "_lines")
    base = docs.select("doc_id", *[f"`{c}`" for c in extra if c != "doc_id"], text_or_empty().alias(t))
    base = base.withColumn(ws, words_of(F.col(t))).withColumn(ls, judged_lines(F.col(t)))
    text, words, lines = F.col(t), F.col(ws), F.col(ls)
    with_word = F.filter(lines, lambda x: x["chars"] > 0)
    with_word = F.transform(with_word, lambda x: x["line"])
    dup = _held(with_word, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x["chars"])
    good = F.filter(lines, lambda x: ~x["fails"])
    out = base.select(
        "doc_id", *[f"`{c}`" for c in extra if c != "doc_id"],
        F.size(words).cast("long").alias("n_words"),
        F.length(without_spaces(text)).cast("long").alias("word_chars"),
        _symbols(text).cast("long").alias("n_symbols"),
        dup.alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        (F.size(lines) - F.size(good)).cast("long").alias("n_lines_removed"),
        F.when(total(lines) > 0, total(good) / total(lines)).otherwise(F.lit(1.0)).alias("kept_share"),
        F.array_join(F.transform(good, lambda x: x["line"]), "\n").alias("cleaned"),
    )
    out = out.withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    )
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("kept_share") >= MIN_KEPT))


def keep_good(docs: DataFrame) -> DataFrame:
    """Documents that the rules keep, with the columns of ``docs``; ``text`` is the cleaned text.

    ``n_chars``, where there is one, is the cleaned text's length.
    """
    (row,) = unused(docs, "_row")
    packed = docs.withColumn(row, F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("doc_id", "text", row)
    judged = measures(packed, [row])
    # Generated and then filtered: a filter on the verdict itself would be pushed below and evaluate every rule again.
    verdict = F.filter(F.array(F.struct("kept", "cleaned")), lambda x: x["kept"])
    judged = judged.select(row, F.explode_outer(verdict).alias("good")).filter(F.col("good").isNotNull())
    new = {"text": F.col("good.cleaned"), "n_chars": F.length("good.cleaned").cast("long")}
    return judged.select(*[(new[c] if c in new else F.col(row)[c]).alias(c) for c in docs.columns])
