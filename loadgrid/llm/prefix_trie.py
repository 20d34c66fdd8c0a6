"""Operator 11: the prefix trie of conversations by vertical bitmaps.

Conversations are cut into shards of neighbouring ids. A shard indexes every
(position, turn) with the bitset of its conversations that have that turn
there; a depth-first walk intersects a node's bitset with the postings of the
next position, which yields its children, their numbers of conversations and
the conversations that end there. A node's key is a digest of its turns, so
shards agree on it.

What Spark does: the rows, as digests of 16 bytes, are range-partitioned by
conversation id and sorted; every task cuts its rows into shards. Nodes are
added up over shards by key. Which conversation stands for a node, and which
nodes have no child, is joined back, and a second pass over each shard sums up
its subtrees. A subtree's sums are sums over shards: a node of ``n``
conversations saves ``n - 1`` times its words, so each shard counts its
conversations there and the shard of the smallest one takes off 1; a childless
node and a child count where their smallest conversation is. Lists of ends are
digested in a stream, shard by shard, in order of the ids.

Rows without a conversation id take no part; null roles and texts are empty.
Turns go by ``turn``, nulls first, equal ones by their digest; repeated rows
are repeated turns. Other columns are ignored. An empty table gives an empty
result. A shard ends at ``SHARD_CONVS`` conversations or ``SHARD_TURNS`` turns,
but not inside a conversation: a single one is held by one task, at some 100
bytes a turn, whatever its texts.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, prepare, staged

SHARD_CONVS, SHARD_TURNS = 4096, 1 << 16
WORD = r"[^\x20\x09-\x0D]+"

_NODE = pa.schema([("shard", pa.int64()), ("idx", pa.int32()), ("parent", pa.int32()), ("depth", pa.int64()), ("key", pa.binary()),
                   ("n", pa.int64()), ("first", pa.int64()), ("words", pa.int64()), ("kids", pa.int64()), ("ends", pa.string())])
_NODE_DDL = "shard long, idx int, parent int, depth long, key binary, n long, first long, words long, kids long, ends string"


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes that tell (role, text) apart."""
    return F.substring(F.unhex(F.sha2(F.concat(F.sha2(role, 256), F.sha2(text, 256)), 256)), 1, 16)


def turns_of(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, digest, words)`` of the rows with an id."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_digest(role, text).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def with_shared_heads(turns: DataFrame, group: int = 20, longest: int = 4) -> DataFrame:
    """Turns of the rebuilt conversations: ``(conv_id, part, skip, turn, digest, words)``.

    Conversation c starts with the first h turns of conversation c - c % group
    (part 0), h = crc32(c) % longest, and goes on with its own turns (part 1)
    after its first ``skip`` = h. A row of part -1 stands for each
    conversation, so one without turns is there too."""
    own = turns.select("conv_id", F.lit(1).alias("part"), (F.crc32(F.col("conv_id").cast("string")) % longest).cast("int").alias("skip"),
                       "turn", "digest", "words")
    top = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    heads = turns.where(F.col("conv_id") % group == 0).withColumn("rank", F.row_number().over(top)).where(F.col("rank") < longest) \
        .withColumnRenamed("conv_id", "base")
    ids = own.select("conv_id", "skip").distinct()
    shared = ids.where("skip > 0").withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(heads, "base").where("rank <= skip") \
        .select("conv_id", F.lit(0).alias("part"), "skip", F.col("rank").cast("long").alias("turn"), "digest", "words")
    mark = ids.select("conv_id", F.lit(-1).alias("part"), "skip", F.lit(None).cast("long").alias("turn"),
                      F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return own.unionByName(shared).unionByName(mark)


def shard_nodes(ids: list[int], turns: list[list[int]], digests: list[bytes], words: list[int]):
    """Nodes of the trie of one shard in depth-first order: (parent, depth,
    key, conversations, smallest, words, children, ids that end there).
    ``ids`` ascend; ``turns`` are numbers into ``digests`` and ``words``."""
    posting: dict[tuple[int, int], int] = defaultdict(int)
    longer: dict[int, int] = defaultdict(int)            # conversations with more than d turns
    for i, own in enumerate(turns):
        bit = 1 << i
        for d, t in enumerate(own):
            posting[d, t] |= bit
            longer[d] |= bit
    nodes = []
    stack = [((1 << len(ids)) - 1, 0, -1, hashlib.sha256(b"root").digest()[:16], 0)] if ids else []
    while stack:
        bits, depth, parent, key, n_words = stack.pop()
        me, rest = len(nodes), bits & longer[depth]
        ends, kids = bits & ~rest, []
        while rest:
            t = turns[(rest & -rest).bit_length() - 1][depth]
            child = bits & posting[depth, t]
            rest &= ~child
            kids.append((child, depth + 1, me, hashlib.sha256(key + digests[t]).digest()[:16], words[t]))
        over = []
        while ends:
            low = ends & -ends
            over.append(ids[low.bit_length() - 1])
            ends ^= low
        nodes.append((parent, depth, key, bits.bit_count(), ids[(bits & -bits).bit_length() - 1], n_words, len(kids), over))
        stack.extend(reversed(kids))
    return nodes


def _shards(shard_convs: int, shard_turns: int):
    """Rows sorted by conversation, part and turn -> nodes, shard by shard."""
    def emit(number, ids, turns, digests, words):
        nodes = shard_nodes(ids, turns, digests, words)
        for a in range(0, len(nodes), 4096):
            part = nodes[a: a + 4096]
            parent, depth, key, n, first, n_words, kids, over = zip(*part)
            yield batch(_NODE, [number] * len(part), list(range(a, a + len(part))), list(parent), list(depth), list(key), list(n), list(first),
                        list(n_words), list(kids), [",".join(map(str, x)) if x else None for x in over])

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, turns, seen, digests, words, size, left = [], [], {}, [], [], 0, 0
        for b in batches:
            for conv, part, skip, digest, n in zip(*(c.to_pylist() for c in b.columns)):
                if part < 0:
                    if len(ids) >= shard_convs or size >= shard_turns:
                        yield from emit(number, ids, turns, digests, words)
                        number += 1
                        ids, turns, seen, digests, words, size = [], [], {}, [], [], 0
                    ids.append(conv)
                    turns.append([])
                    left = skip
                elif part == 1 and left > 0:
                    left -= 1
                else:
                    t = seen.setdefault((digest, n), len(digests))
                    if t == len(digests):
                        digests.append(digest)
                        words.append(n)
                    turns[-1].append(t)
                    size += 1
        if ids:
            yield from emit(number, ids, turns, digests, words)
    return run


def _subtrees(rows: pa.Table) -> pa.Table:
    """Sums over the subtrees of one shard, a row for each of its nodes."""
    rows = rows.sort_by("idx")
    parent, n, words = (rows[c].to_pylist() for c in ("parent", "n", "words"))
    first, smallest, kids_all = (rows[c].to_pylist() for c in ("first", "smallest", "kids_all"))
    own = [a == b for a, b in zip(first, smallest)]
    saved = [(x - o) * w for x, o, w in zip(n, own, words)]
    leaves = [int(o and not k) for o, k in zip(own, kids_all)]
    kids, above = [0] * len(n), [None] * len(n)
    for i in range(len(n) - 1, 0, -1):           # children stand behind their parent
        p = parent[i]
        saved[p] += saved[i]
        leaves[p] += leaves[i]
        kids[p] += own[i]
        above[i] = smallest[p]
    return pa.table({"key": rows["key"], "depth": rows["depth"], "n": rows["n"], "smallest": rows["smallest"], "above": pa.array(above, pa.int64()),
                     "children": pa.array(kids, pa.int64()), "leaves": pa.array(leaves, pa.int64()), "saved": pa.array(saved, pa.int64())})


_ENDS = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])


def _digest_ends(batches):
    """Rows by key and shard -> the digest of each key's joined lists."""
    key, state = None, None
    for b in batches:
        out = []
        for k, ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if k == key:
                state.update(b"," + ends.encode())
                continue
            if key is not None:
                out.append((key, state.hexdigest()))
            key, state = k, hashlib.sha256(ends.encode())
        if out:
            yield batch(_ENDS, *zip(*out))
    if key is not None:
        yield batch(_ENDS, [key], [state.hexdigest()])


def trie(turns: DataFrame, shard_convs: int = SHARD_CONVS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """``turns`` as :func:`with_shared_heads` gives them -> one row for each
    node: conv_id (the smallest member; with depth it names the node's last
    turn), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    prepare(turns.sparkSession)
    local = staged(turns.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "part", F.col("turn").asc_nulls_first(), "digest")
                   .select("conv_id", "part", "skip", "digest", "words").mapInArrow(_shards(shard_convs, shard_turns), _NODE_DDL), "trie-shards")
    whole = staged(local.groupBy("key").agg(F.min("first").alias("smallest"), F.sum("kids").alias("kids_all")), "trie-nodes")
    sums = local.drop("ends", "kids").join(whole, "key").groupBy("shard").applyInArrow(
        _subtrees, "key binary, depth long, n long, smallest long, above long, children long, leaves long, saved long")
    nodes = sums.groupBy("key").agg(
        F.min("smallest").alias("conv_id"), F.min("depth").alias("depth"), F.min("above").alias("parent_conv_id"), F.sum("n").alias("n_convs"),
        F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = local.where("ends IS NOT NULL").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard") \
        .select("key", "ends").mapInArrow(_digest_ends, "key binary, ends_sha256 string")
    return nodes.join(ends, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def node_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` of the trie of plain conversations (not rebuilt) with the role
    and text of their last turn; the root has none."""
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    t = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"), turn_digest(role, text).alias("digest"))
    return nodes.join(t.select("conv_id", F.row_number().over(order).cast("long").alias("depth"), "role", "text"), ["conv_id", "depth"], "left")


# DuckDB: CRC-32 of the ids by table, nodes by the digest of their turns
ORACLE = r"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
         lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, '')))) AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda a, x: xor(t[CAST(xor(a, x) & 255 AS INT) + 1], a >> 8)), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM o), tab),
r AS (SELECT c.conv_id, 0 AS part, o.p, role, text FROM c JOIN o ON o.conv_id = c.base AND o.p <= c.h
      UNION ALL SELECT c.conv_id, 1, o.p, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.p > c.h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS d,
             sha256(sha256(role) || sha256(text)) AS g, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r),
k AS (SELECT conv_id, d, words, sha256(string_agg(g, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM s
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT k, min(conv_id) AS conv_id, min(d) AS depth, count(*) AS n_convs, any_value(words) AS words FROM k GROUP BY k),
up AS (SELECT DISTINCT a.k, b.k AS parent FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.d = b.d + 1),
kids AS (SELECT parent AS k, count(*) AS n FROM up GROUP BY parent),
below AS (SELECT DISTINCT a.k, b.k AS sub FROM k a JOIN k b ON a.conv_id = b.conv_id AND b.d >= a.d),
sub AS (SELECT below.k, CAST(sum((n.n_convs - 1) * n.words) AS BIGINT) AS saved, CAST(count(*) FILTER (WHERE kids.n IS NULL) AS BIGINT) AS leaves
        FROM below JOIN n ON n.k = below.sub LEFT JOIN kids ON kids.k = below.sub GROUP BY below.k),
e AS (SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM (SELECT conv_id, arg_max(k, d) AS k FROM k GROUP BY conv_id) GROUP BY k)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, sub.leaves AS n_leaves, sub.saved AS saved_tokens,
       sha256(coalesce(e.ends, '')) AS ends_sha256
FROM n JOIN sub USING (k) LEFT JOIN up USING (k) LEFT JOIN n p ON p.k = up.parent LEFT JOIN kids ON kids.k = n.k LEFT JOIN e ON e.k = n.k
"""
