"""Merkle manifest of a dataset, with a proof for every row, by butterfly exchange.

A row is a leaf: the SHA-256 of its columns. The leaves of a source are in
doc_id order; while several nodes are left, every FANOUT consecutive ones (the
last run may have fewer, even one) become the hash of their digests. What is
left is the source's subroot, and the subroots, in the order of sources, make
the root in the same way.

The leaves of a tree are dealt to partitions of FANOUT ** HEIGHT consecutive
ones, aligned with the tree, so a partition's root is a node of the tree. Then
partitions exchange roots as in a butterfly network: in round r, the FANOUT
aligned groups of FANOUT ** r partitions below one node swap their roots,
partition by partition, and every partition hashes the common ancestor for
itself. After each round a partition has one more level of its upper proof, and
after the last one the tree's root: no pass goes back down. A group that is cut
short at the end of a tree answers with the partitions it has, in turn. The
subroots are the leaves of one more tree, which goes the same way.

A partition is a bounded number of rows (digests and ids, no texts), so a
source of any size spreads over many tasks; a round moves one row a partition
and partner. A leaf's siblings are never written down: a partition meets its
upper proof once, and digests every proof there.

Results for odd rows: a null column counts as ``-``, a null source sorts first
and is a source of its own, a null doc_id sorts first within its source and has
no checksum, so it is never tampered with. Rows with the same doc_id are in the
order of their leaves; repeated rows are leaves of their own. Texts are hashed
whole, whatever their length; an empty one is not a null one. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwater.functions.ranking import full_rank
from tillwater.session import stored

FANOUT, HEIGHT = 3, 7
#: Partitions or subroots in one file of an exchange.
FILE_ROWS = 20_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(columns: list[Column]) -> Column:
    """SHA-256 of columns: each ``-`` if null, else its bytes in UTF-8, a colon, and the value."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _hash(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode("ascii")).hexdigest()


def levels(digests: list[str], fanout: int, height: int | None) -> list[list[str]]:
    """The nodes of each level above ``digests``, ``height`` levels or until one node is left."""
    out = [digests]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([_hash(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return out


def _partition_roots(leaves: DataFrame, fanout: int, height: int) -> DataFrame:
    """``tree``, ``part``, ``parts`` (of its tree), ``root`` of every partition of ``leaves`` (tree, part, pos, digest)."""
    schema = "tree string, part long, alone string, lifted string"

    def climb(rows: pd.DataFrame) -> pd.DataFrame:
        digests = rows.sort_values("pos")["digest"].tolist()
        # A tree of one partition ends where one node is left; a partition among others is a node HEIGHT levels up.
        return pd.DataFrame({
            "tree": rows["tree"].iloc[:1], "part": rows["part"].iloc[:1], "alone": levels(digests, fanout, None)[-1],
            "lifted": levels(digests, fanout, height)[-1],
        })

    made = stored(leaves.select("tree", "part", "pos", "digest").groupBy("tree", "part").applyInPandas(climb, schema))
    counts = made.groupBy("tree").agg(F.count(F.lit(1)).alias("parts"))
    return made.join(counts, "tree").select("tree", "part", "parts", F.when(F.col("parts") == 1, F.col("alone")).otherwise(F.col("lifted")).alias("root"))


def _exchange(roots: DataFrame, fanout: int) -> DataFrame:
    """``tree``, ``part``, ``parts``, ``root`` (the tree's) and ``upper``: digests left and right of the path, level by level."""
    none = F.array().cast("array<struct<left:string,right:string>>")
    rows, most = roots.agg(F.count(F.lit(1)), F.coalesce(F.max("parts"), F.lit(0))).first()
    # A row a partition: a file takes many of them, however many tasks the leaves need.
    files = max(1, math.ceil(rows / FILE_ROWS))
    state = stored(roots.withColumn("upper", none).coalesce(files))
    width = 1  # partitions below a node of this level
    while width < most:
        own = F.floor(F.col("part") / width).cast("long")
        first = (F.floor(F.col("part") / (width * fanout)) * fanout).cast("long")
        going = F.col("parts") > width
        asked = state.filter(going).select(
            "tree", "part", "parts", own.alias("own"), F.explode(F.sequence(first, first + (fanout - 1))).alias("node")
        ).filter((F.col("node") != F.col("own")) & (F.col("node") * width < F.col("parts")))
        # The partner stands where this partition stands in its group; a short last group answers in turn.
        there = F.least(F.lit(width), F.col("parts") - F.col("node") * width)
        partner = F.col("node") * width + (F.col("part") % width) % there
        answers = asked.withColumn("partner", partner).join(
            state.select("tree", F.col("part").alias("partner"), F.col("root").alias("digest")), ["tree", "partner"]
        )
        side = lambda test: F.array_join(F.transform(
            F.array_sort(F.collect_list(F.when(test, F.struct("node", "digest")))), lambda x: x["digest"]
        ), "")
        got = answers.groupBy("tree", "part").agg(
            side(F.col("node") < F.col("own")).alias("left"), side(F.col("node") > F.col("own")).alias("right")
        )
        left, right = F.coalesce("left", F.lit("")), F.coalesce("right", F.lit(""))
        state = stored(state.join(got, ["tree", "part"], "left").select(
            "tree", "part", "parts",
            F.when(going, F.sha2(F.concat(left, F.col("root"), right), 256)).otherwise(F.col("root")).alias("root"),
            F.when(going, F.concat("upper", F.array(F.struct(left.alias("left"), right.alias("right"))))).otherwise(F.col("upper")).alias("upper"),
        ).coalesce(files))
        width *= fanout
    return state


def _paths(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    """Full proofs of the leaves of few trees: ``tree``, ``pos``, ``root``, ``path`` (as ``upper`` above)."""
    schema = "tree string, pos long, root string, path array<struct<left:string,right:string>>"
    parted = nodes.withColumn("part", F.floor(F.col("pos") / fanout**height).cast("long"))
    tops = _exchange(_partition_roots(parted, fanout, height), fanout)

    def proofs(rows: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        rows, top = rows.sort_values("pos"), top.iloc[0]
        own = _siblings(levels(rows["digest"].tolist(), fanout, None if top["parts"] == 1 else height), fanout)
        upper = [(x["left"], x["right"]) for x in top["upper"]]
        return pd.DataFrame({
            "tree": rows["tree"], "pos": rows["pos"], "root": top["root"],
            "path": [[{"left": a, "right": b} for a, b in [*path, *upper]] for path in own],
        })

    out = parted.groupBy("tree", "part").cogroup(tops.groupBy("tree", "part")).applyInPandas(proofs, schema)
    return stored(out)


def _siblings(made: list[list[str]], fanout: int) -> list[list[tuple[str, str]]]:
    """For each leaf, the digests left and right of its path in every run below the top of ``made``."""
    out = []
    for at in range(len(made[0])):
        path = []
        for level in made[:-1]:
            first = at - at % fanout
            path.append(("".join(level[first:at]), "".join(level[at + 1 : first + fanout])))
            at //= fanout
        out.append(path)
    return out


def manifest(docs: DataFrame, changed: Column | None = None, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """Proofs of all rows: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    ``proof_sha256`` is the hash of a leaf's siblings, level by level via the subroot to the root, left to right.
    ``changed`` is what a row's text is now, if that isn't the text that the manifest is made from: ``folded_root`` is
    the root that the leaf of the changed row and the original siblings lead to, and ``verified`` is whether it is the
    root.
    """
    columns = [F.col(c) for c in COLUMNS]
    now = columns if changed is None else [*columns[:-1], changed]
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))
    rows = docs.select("doc_id", tree.alias("tree"), leaf(columns).alias("digest"), leaf(now).alias("now"))
    # Only what differs is kept. Ids travel as text, since a column with nulls would come as floating-point numbers.
    rows = rows.withColumn("now", F.when(F.col("now") != F.col("digest"), F.col("now")))
    ranked = full_rank(rows, ["tree"], [F.col("doc_id"), F.col("digest"), F.col("now")], "_rank")
    leaves = ranked.select(F.col("doc_id").cast("string").alias("doc_id"), "tree", (F.col("_rank") - 1).alias("pos"), "digest", "now").withColumn(
        "part", F.floor(F.col("pos") / fanout**height).cast("long")
    )
    tops = _exchange(_partition_roots(leaves, fanout, height), fanout)
    # The subroots are the leaves of one more tree.
    subroots = tops.filter("part = 0").select("tree", F.col("root").alias("digest"))
    ordered = full_rank(subroots, [], [F.col("tree")], "_rank").select(F.lit("").alias("tree"), "digest", (F.col("_rank") - 1).alias("pos"), F.col("tree").alias("of"))
    ordered = stored(ordered.coalesce(max(1, math.ceil(subroots.count() / FILE_ROWS))))
    paths = _paths(ordered.drop("of"), fanout, height).join(ordered.select("pos", "of"), "pos")
    paths = paths.select(F.col("of").alias("tree"), F.col("root").alias("top"), "path")
    files = max(1, math.ceil(tops.count() / FILE_ROWS))
    tops = stored(tops.join(paths, "tree").coalesce(files).select("tree", "part", "parts", F.col("root").alias("subroot"), "top", F.concat("upper", "path").alias("upper")))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def proofs(rows: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        rows, top = rows.sort_values("pos"), top.iloc[0]
        own = _siblings(levels(rows["digest"].tolist(), fanout, None if top["parts"] == 1 else height), fanout)
        upper = [(x["left"], x["right"]) for x in top["upper"]]
        tail = "".join(a + b for a, b in upper)
        proof, folded = [], []
        for path, now in zip(own, rows["now"].fillna(rows["digest"]), strict=True):
            proof.append(_hash([a + b for a, b in path] + [tail]))
            for a, b in [*path, *upper]:
                now = _hash([a, now, b])
            folded.append(now)
        return pd.DataFrame({
            "doc_id": rows["doc_id"], "leaf": rows["digest"], "subroot": top["subroot"], "root": top["top"], "proof_sha256": proof,
            "folded_root": folded, "verified": [x == top["top"] for x in folded],
        })

    out = leaves.groupBy("tree", "part").cogroup(tops.groupBy("tree", "part")).applyInPandas(proofs, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))
