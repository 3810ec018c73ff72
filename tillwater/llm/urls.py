"""URL filter: site rules, and gradient-boosted trees on lexical features.

The longest rule that fits a URL decides. All other URLs are judged by trees
that were trained on labelled URLs. Features are lengths, depth, digit ratio,
character entropy, parameter counts, and statistics of the host's suffixes
(how many labelled URLs share its last one and last two labels, and what part
of them is blocked; a URL's own label is left out in training).

Main path: column expressions, joins on suffixes, Spark's boosted trees, whose
result is compiled to column expressions again. Training takes at most SAMPLE
different labelled URLs, those with the smallest hashes, so copies of one URL don't fill the sample;
a URL with both labels counts once with each. Suffix statistics cover all labelled rows.

A null URL or one without ``://`` has an empty host and path; no rule fits it,
and the trees judge its features. Repeated rows get the same verdict. Without labelled
URLs of both kinds the verdict is that of the only kind, or else allow. Very long URLs are judged whole. Of
rules as long as each other the one that comes first counts. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled URLs for the trees, at most.
SAMPLE = 20_000
#: Rules are one expression each; a list as long as this needs a join instead.
MAX_RULES = 1_000
TREES, DEPTH = 20, 4
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: How strongly a suffix's block rate leans to the overall one, in URLs.
PRIOR = 20.0

FEATURES = (
    "url_length", "host_length", "path_length", "query_length", "depth", "host_labels", "digit_ratio", "path_digit_ratio",
    "entropy", "parameters", "hyphens", "escapes", "fragment", "secure", "suffix1_rate", "suffix1_count",
    "suffix2_rate", "suffix2_count",
)


@dataclass(frozen=True)
class Rule:
    """``site`` is a host and a path, ``allow`` what follows if a URL's host is it or below it and its path starts so."""

    site: str
    allow: bool

    @property
    def host(self) -> str:
        return self.site.partition("/")[0]

    @property
    def path(self) -> str:
        return self.site[len(self.host) :]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as (site, allow); null if none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r.site), r.site)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        value = F.struct(F.lit(rule.site).alias("site"), F.lit(rule.allow).alias("allow"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<site:string,allow:boolean>")


def _held(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def _entropy(text: Column) -> Column:
    """Bits per character of the text's character counts; 0 for an empty one."""
    n = F.length(text)

    def of(chars):
        total = F.aggregate(
            F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double")),
            F.lit(0.0), lambda s, k: s - k / n * F.log2(k / n),
        )
        return F.when(n > 0, total).otherwise(F.lit(0.0))

    return _held(F.filter(F.split(text, ""), lambda c: c != ""), of)


def _digits(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "0123456789", ""))


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.translate(text, sign, ""))


def lexical(urls: DataFrame) -> DataFrame:
    """``id``, ``url`` with ``host``, ``path``, the lexical features, and the suffixes ``s1`` and ``s2``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    out = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    as_double = {
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path),
        "query_length": F.length(query), "depth": _count(F.regexp_replace(path, "/+$", ""), "/"),
        "host_labels": F.size(F.split(host, r"\.")),
        "digit_ratio": _digits(url) / F.greatest(F.length(url), F.lit(1)),
        "path_digit_ratio": _digits(path) / F.greatest(F.length(path), F.lit(1)),
        "entropy": _entropy(url),
        "parameters": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
        "hyphens": _count(host, "-"), "escapes": _count(url, "%"),
        "fragment": F.contains(url, F.lit("#")), "secure": F.startswith(F.lower(url), F.lit("https:")),
    }
    out = out.withColumns({k: v.cast("double") for k, v in as_double.items()})
    return out.withColumns({
        "s1": F.substring_index(host, ".", -1), "s2": F.substring_index(host, ".", -2),
    })


def _statistics(labelled: DataFrame, suffix: str) -> DataFrame:
    """A row for each suffix: labelled URLs and blocked ones. Counts combine before the shuffle."""
    return labelled.groupBy(suffix).agg(F.count(F.lit(1)).alias(f"{suffix}_n"), F.sum("blocked").alias(f"{suffix}_b"))


@dataclass
class Model:
    s1: DataFrame | None
    s2: DataFrame | None
    share: float
    trees: list[tuple[float, object]]

    def features(self, rows: DataFrame, own: Column | None = None) -> DataFrame:
        """Lexical rows with the suffix features; ``own`` is the row's own label, which is left out."""
        for i, table in (("1", self.s1), ("2", self.s2)):
            rows = rows.join(table, f"s{i}", "left")
            n = F.coalesce(F.col(f"s{i}_n"), F.lit(0)).cast("double") - (0.0 if own is None else 1.0)
            b = F.coalesce(F.col(f"s{i}_b"), F.lit(0)).cast("double") - (0.0 if own is None else own)
            rows = rows.withColumn(f"suffix{i}_rate", (b + PRIOR * self.share) / (n + PRIOR))
            rows = rows.withColumn(f"suffix{i}_count", F.log1p(n))
        return rows

    def blocks(self) -> Column:
        """Whether the trees block a row of ``features``."""
        if not self.trees:
            return F.lit(self.share > 0.5)
        margin = F.lit(0.0)
        for weight, tree in self.trees:
            margin = margin + F.lit(weight) * _compiled(tree)
        return margin > 0


def _compiled(node) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    feature, threshold, left, right = node
    return F.when(F.col(FEATURES[feature]) <= threshold, _compiled(left)).otherwise(_compiled(right))


def _tree(node):
    """Spark's tree as nested tuples."""
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return (split.featureIndex(), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild()))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Model of labelled URLs: columns ``url`` and ``blocked`` (0 or 1; other rows don't count)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = lexical(labelled.select("url", F.col("blocked").cast("double").alias("blocked")).filter("blocked in (0, 1)"))
    counts = {int(k): n for k, n in rows.groupBy("blocked").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    if len(counts) < 2:
        return Model(*(_statistics(rows, s) for s in ("s1", "s2")), share, [])
    model = Model(*(_statistics(rows, s) for s in ("s1", "s2")), share, [])
    # Equal URLs have equal features, so one row a URL and label is taken.
    once = rows.groupBy("url", "blocked").agg(*[F.first(c).alias(c) for c in rows.columns if c not in ("url", "blocked")])
    chosen = once.orderBy(F.xxhash64("url"), "url", "blocked").limit(sample)
    training = model.features(chosen, F.col("blocked")).select(*FEATURES, "blocked")
    # A few stored rows: the trees pass over them once for each level.
    from tillwater.session import stored

    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="v").transform(stored(training)).select("v", "blocked")
    trees = GBTClassifier(
        featuresCol="v", labelCol="blocked", maxIter=TREES, maxDepth=DEPTH, maxBins=64, seed=7, stepSize=0.2
    ).fit(vectors)
    model.trees = [(float(w), _tree(t._java_obj.rootNode())) for w, t in zip(trees.treeWeights, trees.trees, strict=True)]
    return model


def judge(pages: DataFrame, rules: list[Rule], model: Model | None = None) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every page.

    Without a model, one is trained on the pages that rules decide: their
    verdicts are the labels.
    """
    rows = lexical(pages.select("page_id", "url")).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    if model is None:
        known = rows.filter(F.col("_rule").isNotNull())
        model = fit(known.select("url", F.when(F.col("_rule.allow"), 0).otherwise(1).alias("blocked")))
    with_features = model.features(rows)
    blocked = F.when(F.col("_rule").isNotNull(), ~F.col("_rule.allow")).otherwise(model.blocks())
    return with_features.select(
        "page_id", "host", "path", F.col("_rule.site").alias("rule"),
        F.when(blocked, "block").otherwise("allow").alias("verdict"),
    )
