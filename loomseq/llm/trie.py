"""Prefix trie of conversations, by rolling fingerprints.

Every prefix of a conversation gets a polynomial fingerprint: the sum of its turns' hashes, each times a power of
a base by its place, modulo two primes. Numpy scans the sorted turns of a range; ranges (scan.py) cut long
conversations, and what stands before a range is added to it. Prefixes of equal depth and fingerprint are
candidates for one node. Each group is then verified turn by turn: all members must have the last turn, and the
fingerprint before it, of its representative, the member with the smallest id; by induction over the depth their
whole prefixes are equal. A member that differs takes a digest of where and how from there on, along all its
longer prefixes, so a collision is split into its true nodes.

Roll-up. Going down a conversation, the smallest member of its prefixes only grows, so each node lies on the way
of its smallest member, which owns it, and which owns every longer prefix of its own as well. A member other than
the smallest one owns nodes below only. So a sum over a subtree is what its members own, less what the smallest
one owns above: one aggregation, whatever the depth, instead of a round for each level.

Skew: a node may have any share of the conversations. Groups are added up before they are shuffled; a look-up of
a hot key (the root, a greeting that a third of all conversations share, a conversation with a third of all
turns) takes the broadcast way of skew.py. A node's ids are joined in blocks of BLOCK ids before one task
passes a node's blocks through SHA-256, which has to see them in order; it holds one block at a time.

Defined results: rows without a conversation's id belong to none and are left out. Turns are ordered by number,
null first, ties by the MD5 of role and text; turns that are repeated stay. A null role or text is empty, and
an empty turn is a turn. Without conversations there is no node, not even the root. Other columns are ignored, whatever
their names."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomseq.operators import scan, skew
from loomseq.plans.scratch import fixed

#: Ids that are joined at most before they go to the task that hashes a node.
BLOCK_BITS = 12
NODE = ["d", "fp", "split"]


@dataclass(frozen=True)
class Modulus:
    """Primes below 2**31, so that products of two remainders fit into 64 bits, and a base for each."""

    primes: tuple[int, int] = (2_147_483_647, 2_147_483_629)
    bases: tuple[int, int] = (1_103_515_245, 1_220_703_125)


def numbered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, i, role, text): turns numbered from 0 within their conversation. Written once."""
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("c"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )
    tie = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = rows.withColumns({"tie": tie, "one": F.lit(1)})
    return scan.prefix_sums(rows, ["turn", "tie"], {"i": "one"}, by=["c"]).select("c", "i", "role", "text")


def rebuilt(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and sizes of rebuilt conversations: the first h turns of conversation c - c % group, then c's own
    after its first h, where h is the CRC-32 of c in decimal, modulo heads.

    turns is what numbered() gives. Returns (c, pos, size, role, text) and (c, size); the latter has every c,
    also one without turns."""
    h = F.crc32(F.col("c").cast("string").cast("binary")) % heads
    n = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    each = n.withColumns({"h": h, "base": F.col("c") - F.col("c") % group}).join(n.select(F.col("c").alias("base"), F.col("n").alias("n_base")), "base", "left")
    each = each.withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0))))
    each = fixed(each.select("c", "base", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")))
    own = skew.lookup(turns.where(F.col("i") >= h), each.select("c", "head", "size"), ["c"], "inner")
    own = own.select("c", (F.col("i") - h + F.col("head")).alias("pos"), "size", "role", "text")
    # A base gives fewer than `heads` turns to fewer than 2 * group conversations.
    first = turns.where((F.col("c") % group == 0) & (F.col("i") < heads - 1)).withColumnRenamed("c", "base")
    lent = first.join(each, "base").where("i < h").select("c", F.col("i").alias("pos"), "size", "role", "text")
    return own.unionByName(lent), each.select("c", "size")


def _power(base: int, exponent: np.ndarray, prime: int) -> np.ndarray:
    out, b = np.ones(len(exponent), np.int64), base % prime
    left = exponent.copy()
    while left.any():
        out = np.where(left & 1, out * b % prime, out)
        b, left = b * b % prime, left >> 1
    return out


def fingerprints(turns: DataFrame, modulus: Modulus = Modulus()) -> DataFrame:
    """(c, d, size, role, text, fp, prev): each prefix by its last turn, with its fingerprint and that of the prefix
    before it. turns: (c, pos, size, role, text) with each pos from 0 to size - 1."""
    primes, bases = modulus.primes, modulus.bases
    sorted_ranges = (
        turns.withColumn("x", F.xxhash64("role", "text")).repartitionByRange("c", "pos").sortWithinPartitions("c", "pos")
        .withColumn(scan.SHARD, F.spark_partition_id())
    )

    def run(batches):
        last, carry = None, [0, 0]
        for b in batches:
            if not b.num_rows:
                continue
            c, pos, x = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("c", "pos", "x"))
            starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            segment = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(c))))
            cols = {}
            for k in (0, 1):
                term = x % primes[k] * _power(bases[k], pos, primes[k]) % primes[k]
                total = np.cumsum(term)
                before = np.concatenate([[0], total])[starts]
                if last == c[0]:
                    before[0] -= carry[k]
                local = (total - before[segment]) % primes[k]
                carry[k] = int(local[-1])
                cols |= {f"t{k}": term, f"f{k}": local}
            last = c[-1]
            arrays = [b.column(n) for n in kept] + [pa.array(v) for v in cols.values()]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *cols])

    kept = ["c", "pos", "size", "role", "text", scan.SHARD]
    kinds = dict(sorted_ranges.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in kept) + ", t0 bigint, f0 bigint, t1 bigint, f1 bigint"
    table = fixed(sorted_ranges.mapInArrow(run, schema))
    sums = {"t0": "t0", "t1": "t1"}
    whole = scan.with_bases(table, scan.bases(table, ["c"], sums), ["c"], list(sums))
    full = [(F.col(f"f{k}") + F.col(f"_base_t{k}")) % primes[k] for k in (0, 1)]
    past = [F.pmod(f - F.col(f"t{k}"), F.lit(primes[k])) for k, f in enumerate(full)]
    packed = lambda a, b: F.shiftleft(a.cast("bigint"), 31) + b
    return whole.select("c", (F.col("pos") + 1).alias("d"), "size", "role", "text", packed(*full).alias("fp"), packed(*past).alias("prev"))


def _groups(prefixes: DataFrame) -> DataFrame:
    """A row for each (depth, fingerprint, split). one: the least and the greatest of its members' last turns
    and fingerprints before them are the same, so all are its representative's."""
    turn = F.struct("prev", "role", "text")
    return prefixes.groupBy(*NODE).agg(
        F.min("c").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("size").alias("longest"), F.min(turn).alias("lo"), F.max(turn).alias("hi"), F.min("prev_split").alias("prev_split")
    ).select(
        *NODE, "rep", "n", "longest", F.octet_length("lo.text").cast("bigint").alias("bytes"), F.col("lo.prev").alias("prev"), "prev_split", (F.col("lo") == F.col("hi")).alias("one")
    )


def _split(prefixes: DataFrame, mixed: DataFrame) -> DataFrame:
    """prefixes with split set apart from each representative's. Only conversations that differ from a representative
    somewhere are touched; the chance of one is about prefixes squared over 2**62."""
    turn = F.struct("prev", "role", "text")
    reps = prefixes.join(mixed.select("d", "fp", F.col("rep").alias("c")), ["d", "fp", "c"]).select("d", "fp", turn.alias("turn"))
    said = F.sha2(F.concat_ws(":", "d", "prev", F.length("role"), F.concat("role", "text")), 256)
    other = prefixes.join(reps, ["d", "fp"]).where(turn != F.col("turn")).select("c", "d", said.alias("said"))
    sofar = Window.partitionBy("c").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    chain = other.select("c", F.struct("d", F.sha2(F.array_join(F.collect_list("said").over(sofar), ","), 256).alias("split")).alias("at"))
    marks = chain.groupBy("c").agg(F.array_sort(F.collect_list("at")).alias("marks"))
    upto = lambda d: F.coalesce(F.get(F.filter("marks", lambda m: m["d"] <= d), F.size(F.filter("marks", lambda m: m["d"] <= d)) - 1)["split"], F.lit(""))
    return skew.lookup(prefixes.drop("split", "prev_split"), marks, ["c"]).withColumns({"split": upto(F.col("d")), "prev_split": upto(F.col("d") - 1)}).drop("marks")


def _digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, c): the ids in numeric order, comma-joined."""
    ids = F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string"))
    blocks = ends.groupBy(*NODE, F.shiftright("c", BLOCK_BITS).alias("block")).agg(F.array_join(ids, ",").alias("ids"))

    def run(batches):
        node, sha = None, None
        for b in batches:
            out = []
            for row in zip(*[b.column(c).to_pylist() for c in (*NODE, "ids")]):
                if row[:3] == node:
                    sha.update(b"," + row[3].encode())
                    continue
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = row[:3], hashlib.sha256(row[3].encode())
            yield pa.RecordBatch.from_pylist([dict(zip(names, o)) for o in out], schema=shape)
        if node:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*node, sha.hexdigest())))], schema=shape)

    names = [*NODE, "ends_sha256"]
    shape = pa.schema([("d", pa.int64()), ("fp", pa.int64()), ("split", pa.string()), ("ends_sha256", pa.string())])
    dealt = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(F.col("d").cast("bigint").alias("d"), "fp", "split", "ids")
    return dealt.mapInArrow(run, "d bigint, fp bigint, split string, ends_sha256 string")


def nodes(turns: DataFrame, sizes: DataFrame, modulus: Modulus = Modulus()) -> DataFrame:
    """The trie's nodes: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    turns: (c, pos, size, role, text); sizes: (c, size) of every conversation."""
    none = F.lit("")
    prefixes = fingerprints(turns, modulus).withColumns({"split": none, "prev_split": none})
    found = fixed(_groups(prefixes))
    mixed = found.where("not one")
    if not mixed.isEmpty():
        prefixes = fixed(_split(prefixes, mixed))
        found = fixed(_groups(prefixes))
    zero = F.lit(0).cast("bigint")
    top = sizes.agg(F.min("c").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("size").alias("longest")).where("n > 0")
    root = top.select(zero.alias("d"), zero.alias("fp"), none.alias("split"), "rep", "n", "longest", zero.alias("bytes"), F.lit(None).cast("bigint").alias("prev"), F.lit(None).cast("string").alias("prev_split"))
    all_nodes = found.drop("one").withColumn("d", F.col("d").cast("bigint")).unionByName(root)
    all_nodes = all_nodes.withColumns({"saved": (F.col("n") - 1) * F.col("bytes"), "leaf": (F.col("longest") == F.col("d")).cast("bigint")})
    own = scan.prefix_sums(all_nodes, ["d"], {"saved_above": "saved", "leaf_above": "leaf"}, by=["rep"])
    own = fixed(own)

    up = {"d": F.col("d") - 1, "fp": F.col("prev"), "split": F.col("prev_split")}
    children = own.where("d > 0").select(*[v.alias(k) for k, v in up.items()]).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    parents = own.select((F.col("d") + 1).alias("d"), F.col("fp").alias("prev"), F.col("split").alias("prev_split"), F.col("rep").alias("parent"))
    linked = skew.lookup(own, parents, ["d", "prev", "prev_split"])

    members = prefixes.select("c", F.col("d").cast("bigint").alias("d"), "fp", "split", "size")
    members = fixed(members.unionByName(sizes.select("c", zero.alias("d"), zero.alias("fp"), none.alias("split"), "size")))
    owned = own.groupBy(F.col("rep").alias("c")).agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    below = skew.lookup(members, owned, ["c"], "inner").groupBy(*NODE).agg(F.sum("saved").alias("saved_all"), F.sum("leaf").alias("leaf_all"))
    ends = _digests(members.where(F.col("size") == F.col("d")))

    out = linked.join(children, NODE, "left").join(below, NODE, "left").join(ends, NODE, "left")
    return out.select(
        F.col("rep").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.coalesce("n_children", zero).alias("n_children"), (F.col("leaf_all") - F.col("leaf_above")).alias("n_leaves"),
        (F.col("saved_all") - F.col("saved_above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(none.cast("binary"), 256)).alias("ends_sha256"),
    )
