"""Prefix tries of conversations: one node for each distinct sequence of first turns.

Nothing walks a tree. Every conversation gives one row for each of its prefixes, an occurrence. A node is owned by the
smallest conversation that starts with it; since members only leave on the way down, the nodes that a conversation owns
are a suffix of its path. So a node is one row (owner, depth), and what lies below a node is told by its members: what
they carry below it, less what they own there. One grouping by prefix sums, over the members of a node, the words from
there on, the words of owned nodes from there on, and whether the last node is an owned leaf.

Turns are reduced to digests before the first exchange, so texts do not travel. A prefix is known by two sums of hashes
of its (position, turn digest) pairs and its depth, which a window carries along the conversation. Groupings combine
before the exchange, so the root and a common first turn arrive as one row a task; the owners are joined back by
prefix, where adaptive execution splits a hot prefix. Conversation ids that end at a node are joined into strings of at
most :data:`CHUNK` ids before they meet, and these are hashed one after the other as they stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomcube.llm.common import CRC_SQL, crc32_sql, deal, discard, map_arrow, materialise

#: Conversations of one block take their first turns from its first one.
BLOCK = 20
#: Turns taken over are fewer than this.
HEADS = 4
#: Ids of consecutive conversations that are joined into one string at most.
CHUNK = 4096
WORD = r"[^\x20\x09-\x0D]+"
PREFIX = ("depth", "k1", "k2")


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, position, turn_sha, words``: the turns of each conversation, numbered from 1.

    Turns are ordered by number, null first, then by digest of role and text. A null role or text is empty. Rows
    without conv_id belong to no conversation and are left out; repeated rows are turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sha = F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", sha.alias("turn_sha"), words.alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "turn_sha")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("position"), "turn_sha", "words")


def share_heads(own: DataFrame) -> DataFrame:
    """Turns of the rebuilt conversations; one without turns has a row without position.

    Conversation c begins with the first h turns of conversation c - c % 20, h being its hash modulo 4, and goes on
    with its own turns after the first h. Where that conversation is absent it begins with its own rest.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h")
    ids = own.filter("position = 1").select("conv_id", h, (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("first"))
    first = own.filter((F.col("position") < HEADS) & (F.col("conv_id") % BLOCK == 0)).select(F.col("conv_id").alias("first"), "position", "turn_sha", "words")
    heads = ids.filter("h > 0").join(first, "first").filter("position <= h").select("conv_id", "position", "turn_sha", "words")
    rest = own.select("conv_id", h, "position", "turn_sha", "words").filter("position > h").drop("h")
    every = ids.select("conv_id", F.lit(None).cast("long").alias("position"), F.lit(None).cast("string").alias("turn_sha"), F.lit(0).cast("long").alias("words"))
    return heads.unionByName(rest).unionByName(every)


def occurrences(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, k1, k2, words, n_turns``: every prefix of every conversation, the empty one too.

    ``turns`` has a row without position for each conversation, which becomes its empty prefix, and turns in the
    order of their positions, which may have gaps.
    """
    conv = Window.partitionBy("conv_id")
    upto = conv.orderBy(F.col("position").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.withColumn("depth", F.count("position").over(upto))
    keys = [F.when(F.col("position").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(salt), "depth", "turn_sha")) for salt in ("a", "b")]
    rows = rows.select("conv_id", "depth", "words", keys[0].alias("h1"), keys[1].alias("h2"))
    along = conv.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    whole = conv.orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select("conv_id", "depth", F.bit_xor("h1").over(along).alias("k1"), F.bit_xor("h2").over(along).alias("k2"), "words", F.max("depth").over(whole).alias("n_turns"))


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the strings of each node, in the order in which they come, joined by commas."""
    node, digest = None, None
    done: list[tuple[int, int, str]] = []
    for batch in batches:
        for conv, depth, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
            if node == (conv, depth):
                digest.update(b",")
            else:
                if node:
                    done.append((*node, digest.hexdigest()))
                node, digest = (conv, depth), hashlib.sha256()
            digest.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "ends_sha256"])
            done = []
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([digest.hexdigest()])], ["conv_id", "depth", "ends_sha256"])


def ends(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """``conv_id, depth, ends_sha256`` of nodes at which conversations end: the digest of their ids in ascending order."""
    last = marked.filter("depth = n_turns").select(F.col("owner").alias("conv_id"), "depth", F.col("conv_id").alias("end"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("end")), lambda c: c.cast("string")), ",")
    chunk = F.floor(F.col("end") / CHUNK).alias("chunk")
    chunks = last.groupBy("conv_id", "depth", chunk).agg(ids.alias("ids")).select("conv_id", "depth", "ids", "chunk", F.xxhash64("conv_id", "depth").alias("spot"))
    dealt = deal(chunks, "spot", "conv_id", "depth", "chunk").select("conv_id", "depth", "ids")
    return map_arrow(dealt, _hash_chunks, "conv_id long, depth long, ends_sha256 string")


def build(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (see :func:`occurrences`), one row each.

    ``conv_id`` and ``depth`` name a node by its smallest member; see :func:`op13_prefix_trie` for the columns. No
    rows give no nodes, not even a root.
    """
    seen = materialise(occurrences(turns), "trie-occurrences")
    found = materialise(seen.groupBy(*PREFIX).agg(F.min("conv_id").alias("owner"), F.max("n_turns").alias("deepest")), "trie-owners")
    conv = Window.partitionBy("conv_id")
    by_depth, on = conv.orderBy("depth"), conv.orderBy("depth").rowsBetween(0, Window.unboundedFollowing)
    own = F.col("owner") == F.col("conv_id")
    leaf = own & (F.col("depth") == F.col("n_turns")) & (F.col("deepest") == F.col("depth"))
    marked = seen.join(found, [*PREFIX]).select(
        "conv_id", *PREFIX, "owner", "n_turns",
        F.lag("owner").over(by_depth).alias("parent"),
        F.sum("words").over(on).alias("words_on"),
        F.sum(F.when(own, F.col("words")).otherwise(0)).over(on).alias("owned_on"),
        F.lead(own.cast("long"), 1, 0).over(by_depth).alias("child"),
        F.max(leaf.cast("long")).over(on).alias("leaf"),
    )
    marked = materialise(marked, "trie-marked")
    discard(seen, found)
    nodes = marked.groupBy(*PREFIX).agg(
        F.min("conv_id").alias("conv_id"),
        F.min("parent").alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.sum("child").alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        (F.sum("words_on") - F.sum("owned_on")).alias("saved_tokens"),
    )
    nodes = nodes.drop("k1", "k2").join(ends(nodes, marked), ["conv_id", "depth"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations; see :func:`turns` and :func:`share_heads`. Other columns are ignored."""
    own = materialise(turns(conversations), "trie-turns")
    nodes = build(share_heads(own))
    discard(own)
    return nodes


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per node: members, children, leaves below, words that sharing saves, digest of the conversations that end there."""
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = f"""
WITH {CRC_SQL},
s AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, sha, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha) AS pos
 FROM (SELECT conv_id, turn, sha256(length(r) || ':' || r || ':' || x) AS sha, len(regexp_extract_all(x, '{WORD}')) AS words FROM s)),
ids AS (SELECT conv_id, conv_id - conv_id % {BLOCK} AS first, {crc32_sql("CAST(conv_id AS VARCHAR)")} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM t), tb),
r AS (SELECT ids.conv_id, pos, sha, words FROM ids JOIN t ON t.conv_id = ids.first AND pos <= h
 UNION ALL SELECT ids.conv_id, pos, sha, words FROM ids JOIN t ON t.conv_id = ids.conv_id AND pos > h),
p AS (SELECT conv_id, coalesce(shas, []) AS shas, coalesce(ws, []) AS ws FROM ids
 LEFT JOIN (SELECT conv_id, list(sha ORDER BY pos) AS shas, list(words ORDER BY pos) AS ws FROM r GROUP BY conv_id) USING (conv_id)),
o AS (SELECT conv_id, d, shas[1:d] AS path, coalesce(ws[d], 0) AS w FROM (SELECT *, unnest(range(0, len(shas) + 1)) AS d FROM p)),
n AS (SELECT d, path, min(conv_id) AS owner, count(*) AS n_convs, any_value(w) AS w FROM o GROUP BY d, path),
k AS (SELECT path[1:d - 1] AS up, d - 1 AS at, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.at = n.d AND k.up = n.path),
below AS (SELECT path[1:a] AS top, a, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * w) AS saved
 FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM m) GROUP BY ALL),
e AS (SELECT shas, len(shas) AS l, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM p GROUP BY ALL)
SELECT m.owner AS conv_id, m.d AS depth, u.owner AS parent_conv_id, m.n_convs, m.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
 CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM m JOIN below ON below.a = m.d AND below.top = m.path LEFT JOIN n u ON u.d = m.d - 1 AND u.path = m.path[1:m.d - 1] LEFT JOIN e ON e.l = m.d AND e.shas = m.path"""
