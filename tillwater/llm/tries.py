"""Shared prefixes of conversations, from double-array tries.

A conversation is a sequence of turns (role and text); every distinct prefix is
a node, from the textless root on. Equal conversations are counted together
first. The distinct ones are dealt to shards by their first LEAD turns; a lead
with more turns than a shard takes is dealt on by whole sequences, so a very
common first turn spreads over many shards. In a shard, turns get dense ids and
the sequences are packed into a double array: state s goes on with turn c to
t = BASE[s] + c, if CHECK[t] is s. Walking every sequence through the arrays
gives the shard's nodes, with members and least conversation.

Upper nodes stand in several shards. Nodes are named by a hash chained along
their turns, and what shards found is merged by that name: members add up, the
least conversation is the least of all, children are counted once. Sums over
subtrees need the merged figures: each node counts in one shard only, that of
its least conversation, where all its ancestors are too, so the shards' sums
over their subtrees add up as well.

Conversations travel as 16-byte turn hashes and sizes, without texts, and one
conversation is one record, however long. A shard holds about SHARD turns, or
one longer conversation. The digest of a node's ending conversations is taken in
one sorted pass, id by id: a group of any size needs no memory.

Results for odd rows: a null conv_id is no conversation; a null turn sorts
first; a null role or text counts as empty, and empty texts are turns of 0
bytes; turns with the same number are in the order of role, then text; repeated
rows are turns of their own. Very long texts count whole, as hash and size.
Other columns are ignored. An empty table gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwater.session import stored

LEAD, SHARD = 2, 32_768
#: Places tried for a state's children before they go to the end of the arrays.
TRIES = 64
_ROOT = bytes(16)


# Double arrays


def pack(sequences: list[tuple[int, ...]]) -> tuple[array, array]:
    """BASE and CHECK of the trie of sequences (distinct, sorted) over codes; state 0 is the root, -1 marks a free place."""
    base, check = array("q", [0]), array("q", [0])
    free, todo = 1, [(0, 0, len(sequences), 0)]
    while todo:
        state, low, high, depth = todo.pop()
        while low < high and len(sequences[low]) == depth:  # sequences that end here
            low += 1
        if low == high:
            continue
        codes, starts = [sequences[low][depth]], [low]
        for i in range(low + 1, high):
            code = sequences[i][depth]
            if code != codes[-1]:
                codes.append(code), starts.append(i)
        while free < len(check) and check[free] >= 0:
            free += 1
        at = free
        for _ in range(TRIES):
            while at < len(check) and check[at] >= 0:
                at += 1
            offset = at - codes[0]
            if at >= len(check) or all(offset + c >= len(check) or check[offset + c] < 0 for c in codes):
                break
            at += 1
        else:
            offset = len(check) - codes[0]
        grow = offset + codes[-1] + 1 - len(check)
        if grow > 0:
            base.extend([0] * grow), check.extend([-1] * grow)
        base[state] = offset
        for code, start, end in zip(codes, starts, [*starts[1:], high], strict=True):
            check[offset + code] = state
            todo.append((offset + code, start, end, depth + 1))
    return base, check


def step(base: array, check: array, state: int, code: int) -> int:
    """The state after ``code``, or -1."""
    to = base[state] + code
    return to if 0 < to < len(check) and check[to] == state else -1


def _dense(keys: list) -> tuple[list[tuple[int, ...]], list[bytes]]:
    """Sequences of turn hashes as sequences of dense ids, and the hash of each id."""
    known: dict[bytes, int] = {}
    coded = [tuple([known.setdefault(bytes(k), len(known)) for k in own]) for own in keys]
    return coded, list(known)


_NODES = "shard string, node binary, parent binary, depth int, conv_id long, members long, bytes long, sequence binary"


def _nodes(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of a shard, from walking its sequences through its double array."""
    coded, names = _dense(rows["keys"].tolist())
    base, check = pack(sorted(coded))
    members, least = np.zeros(len(check), np.int64), np.full(len(check), np.iinfo(np.int64).max)
    size, depth = np.zeros(len(check), np.int64), np.zeros(len(check), np.int32)
    name: list = [None] * len(check)
    end: list = [None] * len(check)
    name[0] = _ROOT
    for codes, sizes, sequence, first, n in zip(coded, rows["sizes"], rows["sequence"], rows["first"], rows["n"], strict=True):
        path, state = [0], 0
        for at, code in enumerate(codes):
            to = step(base, check, state, code)
            if name[to] is None:
                name[to] = hashlib.blake2b(name[state] + names[code], digest_size=16).digest()
                size[to], depth[to] = sizes[at], at + 1
            path.append(to)
            state = to
        members[path] += n
        least[path] = np.minimum(least[path], first)
        end[state] = bytes(sequence)
    states = [s for s, x in enumerate(name) if x is not None]
    return pd.DataFrame({
        "shard": rows["shard"].iloc[0], "node": [name[s] for s in states], "parent": [name[check[s]] if s else None for s in states],
        "depth": depth[states], "conv_id": least[states], "members": members[states], "bytes": size[states],
        "sequence": [end[s] for s in states],
    })


_SUMS = "node binary, n_leaves long, saved long"


def _subtree_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of ``leaf`` and ``own`` over subtrees of a shard's trie."""
    rows = rows.sort_values("depth", ascending=False, ignore_index=True)
    at = {bytes(x): i for i, x in enumerate(rows["node"])}
    above = np.array([at[bytes(p)] if p is not None else -1 for p in rows["parent"]], np.int64)
    sums = rows[["leaf", "own"]].to_numpy(np.int64).copy()
    depth = rows["depth"].to_numpy()
    borders = [0, *(np.flatnonzero(np.diff(depth)) + 1).tolist(), len(depth)]
    for a, b in zip(borders, borders[1:]):
        if depth[a]:
            np.add.at(sums, above[a:b], sums[a:b])
    return pd.DataFrame({"node": rows["node"], "n_leaves": sums[:, 0], "saved": sums[:, 1]})


# Sequences


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``place`` (from 1), ``key`` (hash of role and text) and ``bytes`` of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), role.alias("_role"), text.alias("_text")
    )
    order = W.partitionBy("conv_id").orderBy(F.col("_turn").asc_nulls_first(), "_role", "_text")
    whole = F.concat(F.octet_length("_role").cast("string"), F.lit(":"), F.col("_role"), F.col("_text"))
    return rows.select(
        "conv_id", F.row_number().over(order).alias("place"), F.unhex(F.md5(whole.cast("binary"))).alias("key"),
        F.octet_length("_text").cast("long").alias("bytes"),
    )


def rebuilt(own: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Conversations with the first ``head`` (at most ``most``) turns of another one, ``base``, in place of their own.

    ``own`` are turns as of :func:`turns`; ``base`` and ``head`` are expressions of ``conv_id``. Returns ``conv_id``, ``keys`` and
    ``sizes`` of every conversation, turnless ones too. A conversation is asked by those whose base it is: keep them few.
    """
    named = own.select("conv_id").distinct().select("conv_id", base.alias("base"), head.alias("head"))
    first = own.filter(F.col("place") <= most).select(F.col("conv_id").alias("base"), "place", "key", "bytes")
    taken = named.filter(F.col("base") != F.col("conv_id")).join(first, "base").filter(F.col("place") <= F.col("head"))
    taken = taken.select("conv_id", F.lit(0).alias("part"), "place", "key", "bytes")
    rest = own.filter((base == F.col("conv_id")) | (F.col("place") > head)).select("conv_id", F.lit(1).alias("part"), "place", "key", "bytes")
    all_turns = F.array_sort(F.collect_list(F.struct("part", "place", "key", "bytes")))
    joined = taken.union(rest).groupBy("conv_id").agg(all_turns.alias("t"))
    out = named.select("conv_id").join(joined, "conv_id", "left")
    return out.select(
        "conv_id", F.coalesce("t.key", F.array().cast("array<binary>")).alias("keys"),
        F.coalesce("t.bytes", F.array().cast("array<bigint>")).alias("sizes"),
    )


def _ends(members: DataFrame) -> DataFrame:
    """``sequence`` and ``ends``: digest of the conv_ids of each sequence, ascending, joined by commas. Groups stream through."""
    spread = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, running = None, None
        for batch in batches:
            done = []
            for sequence, ids in batch.groupby("sequence", sort=False)["conv_id"]:
                joined = ",".join(map(str, ids)).encode()
                if sequence == current:
                    running.update(b"," + joined)
                    continue
                if current is not None:
                    done.append((current, running.hexdigest()))
                current, running = sequence, hashlib.sha256(joined)
            yield pd.DataFrame(done, columns=["sequence", "ends"])
        if current is not None:
            yield pd.DataFrame([(current, running.hexdigest())], columns=["sequence", "ends"])

    ordered = members.select("sequence", "conv_id").repartition(spread, "sequence").sortWithinPartitions("sequence", "conv_id")
    return ordered.mapInPandas(digest, "sequence binary, ends string")


def _sharded(sequences: DataFrame, lead: int, shard: int) -> DataFrame:
    """The sequences with ``shard``: by their first turns, and where those are too common, by the whole sequence."""
    (weight,) = [F.size("keys") + 1]
    led = sequences.withColumn("lead", F.xxhash64(F.slice("keys", 1, lead)))
    leads = stored(led.groupBy("lead").agg(F.sum(weight).alias("weight")))
    buckets = leads.agg(F.ceil(F.coalesce(F.sum("weight"), F.lit(1)) / shard)).first()[0]
    heavy = leads.filter(F.col("weight") > shard).select("lead", F.ceil(F.col("weight") / shard).alias("split"))
    usual = F.concat(F.lit("b"), F.pmod("lead", F.lit(int(buckets))).cast("string"))
    split = F.concat(F.lit("l"), F.col("lead").cast("string"), F.lit("/"), F.pmod(F.xxhash64("sequence"), F.col("split")).cast("string"))
    dealt = led.join(heavy, "lead", "left")
    return dealt.withColumn("shard", F.when(F.col("split").isNull(), usual).otherwise(split)).drop("lead", "split")


def prefixes(conversations: DataFrame, lead: int = LEAD, shard: int = SHARD) -> DataFrame:
    """All nodes of the conversations' trie.

    ``conversations``: ``conv_id``, ``keys``, ``sizes``, as of :func:`rebuilt`. Returns ``conv_id`` (least member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    """
    hexed = F.array_join(F.transform("keys", lambda k: F.hex(k)), "")
    members = stored(conversations.withColumn("sequence", F.unhex(F.md5(hexed.cast("binary")))))
    sequences = members.groupBy("sequence").agg(
        F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys"), F.first("sizes").alias("sizes")
    )
    sequences = stored(_sharded(stored(sequences), lead, shard))
    local = stored(sequences.groupBy("shard").applyInPandas(_nodes, _NODES))
    merged = local.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.sum("members").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("depth").alias("depth"),
        F.max("parent").alias("parent"), F.max("sequence").alias("sequence"),
    )
    merged = stored(merged)
    children = merged.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    merged = stored(merged.join(children, "node", "left").na.fill(0, ["n_children"]))
    # A node counts where its least conversation is.
    counted = merged.select(
        "node", F.col("conv_id").alias("owner"), F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"),
    )
    here = local.join(counted, "node")
    mine = F.col("conv_id") == F.col("owner")
    here = here.select("shard", "node", "parent", "depth", *[F.when(mine, F.col(c)).otherwise(0).cast("long").alias(c) for c in ("leaf", "own")])
    sums = here.groupBy("shard").applyInPandas(_subtree_sums, _SUMS).groupBy("node")
    sums = sums.agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    above = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = merged.join(sums, "node").join(above, "parent", "left").join(_ends(members), "sequence", "left")
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
