"""Placement of documents by a hierarchical weighted hash tree.

A tree has regions, racks and shards. A row descends it: at each level every
child makes a draw from a hash of the row's key and the child's name, divided
by the weight of the subtree below the child, and the smallest draw wins
(-ln(u) / weight, so a child wins in proportion to its weight). A draw depends
on nothing but key, child and weight. If a subtree's weight changes, a row
therefore moves only into or out of that subtree, and inside it only where
weights changed too. A new shard joins as a region of its own, so that rows
move into it and nowhere else (law ``key``).

A very long text is a row like any other; equal draws go to the child that comes first; an empty table gives no rows.

Everything is column expressions over a tree that the driver holds (it has as
many entries as there are shards, not rows).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwater.functions.ranking import full_rank
from tillwater.llm.common import text_or_empty

#: Bytes that a row takes besides its text.
ROW_BYTES = 16


@dataclass(frozen=True)
class Tree:
    """regions -> racks -> (shard, weight). Names of regions and racks are their paths, so they never change."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @classmethod
    def regular(cls, shards: int, racks: int = 2, per_rack: int = 4) -> Tree:
        """Shards 0 to ``shards`` - 1 of weight 1 in racks of ``per_rack``, ``racks`` to a region."""
        if shards < 1:
            raise ValueError("a tree needs a shard")
        rows = [tuple((s, 1.0) for s in range(a, min(a + per_rack, shards))) for a in range(0, shards, per_rack)]
        return cls(tuple(tuple(rows[a : a + racks]) for a in range(0, len(rows), racks)))

    def grown(self, weight: float = 1.0) -> Tree:
        """The tree with one more shard, which is a region of its own."""
        last = max(s for region in self.regions for rack in region for s, _ in rack)
        return Tree((*self.regions, (((last + 1, weight),),)))

    def reweighted(self, shard: int, weight: float) -> Tree:
        """The tree with another weight for one shard; 0 empties it."""
        return Tree(
            tuple(
                tuple(tuple((s, weight if s == shard else w) for s, w in rack) for rack in region)
                for region in self.regions
            )
        )


def _winner(key: Column, names: list[str], weights: list[float]) -> Column:
    """Position of the child with the smallest weighted draw; children of weight 0 don't take part."""
    draws = []
    for i, (name, weight) in enumerate(zip(names, weights, strict=True)):
        if weight > 0:
            bits = F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11).cast("double")
            draws.append(F.struct((-F.log((bits + 0.5) / float(1 << 53)) / F.lit(weight)).alias("d"), F.lit(i).alias("i")))
    if not draws:
        return F.lit(0)
    return draws[0]["i"] if len(draws) == 1 else F.least(*draws)["i"]


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key. Null is a key like any other."""
    key = F.coalesce(key.cast("string"), F.lit("null key"))
    weight = lambda part: sum(w if isinstance(w, float) else weight(w) for w in _weights(part))
    region_at = _winner(key, [f"region {r}" for r in range(len(tree.regions))], [weight(x) for x in tree.regions])
    out = None
    for r, region in enumerate(tree.regions):
        rack_at = _winner(key, [f"rack {r}/{k}" for k in range(len(region))], [weight(x) for x in region])
        in_region = None
        for k, rack in enumerate(region):
            at = _winner(key, [f"shard {s}" for s, _ in rack], [w for _, w in rack])
            shard = F.get(F.array(*[F.lit(s) for s, _ in rack]), at)
            in_region = F.when(rack_at == k, shard) if in_region is None else in_region.when(rack_at == k, shard)
        out = F.when(region_at == r, in_region) if out is None else out.when(region_at == r, in_region)
    return out.cast("int")


def _weights(part) -> list:
    return [x[1] if isinstance(x[0], int) else x for x in part]


def place(docs: DataFrame, tree: Tree, grown: Tree | None = None) -> DataFrame:
    """Shard and slot of every document: ``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot``, ``grown_shard``.

    ``size`` is the text's UTF-8 bytes (a null has none) plus ROW_BYTES. ``slot``
    counts from 0 without gaps within a shard, by doc_id, then size, then
    checksum; it is a prefix sum over range slices, so a shard of any size
    spreads over many tasks. Rows with the same doc_id (null too) share a shard.
    """
    text = text_or_empty()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(F.col("doc_id"), tree).alias("shard"),
        shard_of(F.col("doc_id"), grown or tree.grown()).alias("grown_shard"),
    )
    ranked = full_rank(rows, ["shard"], [F.col("doc_id"), F.col("size"), F.col("text_crc32")], "_rank")
    return ranked.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_rank") - 1).alias("slot"), "grown_shard"
    )
