"""A trie of the prefixes that conversations share.

Turns are laid out in blocks of ``WIDTH`` columns, one per place in the block, and one SQL ``ROLLUP`` over these
columns with ``grouping_id`` aggregates all prefixes at once. A long conversation goes on in further blocks of the
same columns, keyed by the node at which its prior block ended, so no row and no group holds a whole conversation.

A turn's id is 128 bits from SHA-256 over its place, role and text, with its text's bytes. A node is
named by its depth and the exclusive-or of the ids on its path, 128 bits in all; that of a prior block is a running
value over blocks, taken in two levels so that one conversation may hold any part of the rows.

Sums over a node's subtree are sums over its members. With Q of a conversation the bytes of its turns before it first
is the smallest member of a node, and P the bytes of the node's path without its last turn, the saved tokens are the
sum of Q over all members but the smallest, less P for each of these; leaves are counted by their smallest members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradegrain.llm.common import store
from tradegrain.operators.ordered import number_rows

WIDTH = 8  # columns of a block
STRETCH = 1024  # blocks of one conversation whose running value one task takes
ID_BITS = 12  # conversation ids alike above these bits are joined into one string before a node's digest
NODE = ["depth", "high", "low"]


def turn_key(role: Column, text: Column) -> Column:
    """The SHA-256 of role and text; the length of the role stands before it, so different turns spell differently."""
    return F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)


def _joined_on_id(rows: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """``rows`` with their conversation's row of ``known``, whose id is called ``name``; null meets null.

    The hash as a second key asks for fresh shuffles, so that adaptive execution may split a long conversation.
    """
    left = rows.withColumn("check", F.xxhash64("conv_id"))
    right = known.withColumn("check_too", F.xxhash64(name))
    return left.join(right, F.expr(f"check = check_too AND conv_id <=> {name}")).drop("check", "check_too", name)


def rebuilt_turns(turns: DataFrame, group: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of the first of their ``group``, and one row for each of them.

    Conversation c takes the first h turns of c - c % group, h being crc32(decimal c) % ``longest``, then its own
    turns after its first h. A null id is a conversation of its own with all its turns. Turns are ordered by turn (null
    first), role, text; repeated rows are turns of their own, and a null role or text is empty. Other columns are not
    read. Returns (conv_id, place, key, bytes) with places from 1, and (conv_id, turns).
    """
    role, text = (F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))
    told = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)
    told = told.withColumns({"key": turn_key(F.col("role"), F.col("text")), "bytes": F.octet_length("text").cast("long")})
    # One order over all rows, so that a conversation of any length is numbered by many tasks.
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    placed = number_rows(told, order, "at").select("conv_id", "at", "key", "bytes")
    convs = placed.groupBy("conv_id").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("own"))
    shared = F.coalesce(F.crc32(F.col("conv_id").cast("string")) % longest, F.lit(0))
    convs = convs.withColumns({"shared": shared, "base": F.col("conv_id") - F.col("conv_id") % group})
    bases = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"), F.col("first").alias("base_first"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("shared", F.coalesce("base_turns", F.lit(0))))
    convs = store(convs.withColumn("turns", F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("shared"))), "convs")
    own = _joined_on_id(placed, convs.select(F.col("conv_id").alias("c"), "first", "shared", "taken"), "c")
    own = own.withColumn("after", F.col("at") - F.col("first") + 1 - F.col("shared")).filter("after > 0")
    own = own.select("conv_id", (F.col("after") + F.col("taken")).alias("place"), "key", "bytes")
    # Of a base at most ``longest`` - 1 turns are asked for, by at most ``group`` conversations.
    asked = convs.filter("taken > 0").select("conv_id", F.explode(F.expr("sequence(1L, taken)")).alias("place"), "base_first")
    asked = asked.withColumn("at", F.col("base_first") + F.col("place") - 1)
    lent = asked.join(placed.select("at", "key", "bytes"), "at").select("conv_id", "place", "key", "bytes")
    return own.union(lent), convs.select("conv_id", "turns")


def _blocks(turns: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """One row per conversation and block: the columns t1.. with turn ids, and depth, high, low, bytes before it."""
    at = F.col("place") - 1
    # The place makes equal turns of one path differ.
    digest = F.sha2(F.concat_ws(":", F.col("place").cast("string"), "key"), 256)
    # 16 hexadecimal digits as a signed number.
    high, low = (F.conv(F.substring(digest, start, 16), 16, -10).cast("long") for start in (1, 17))
    turn = F.struct((at % width).cast("long").alias("slot"), high.alias("high"), low.alias("low"), F.col("bytes").cast("long").alias("bytes"))
    parts = turns.select("conv_id", F.floor(at / width).alias("block"), turn.alias("turn"))
    # Turnless conversations have a first block without turns.
    none = F.lit(None).cast(parts.schema["turn"].dataType)
    empty = convs.filter("turns = 0").select("conv_id", F.lit(0).cast("long").alias("block"), none.alias("turn"))
    # At most ``width`` turns in a group.
    rows = parts.union(empty).groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("turn")).alias("held"))
    zero = F.lit(0).cast("long")
    sums = {f"{c}_of": F.aggregate(F.col(f"held.{c}"), zero, lambda x, y: x.bitwiseXOR(y)) for c in ("high", "low")}
    sums["bytes_of"] = F.aggregate("held.bytes", zero, lambda x, y: x + y)
    rows = store(rows.withColumns(sums).withColumn("stretch", F.floor(F.col("block") / STRETCH)), "blocks")
    # Running values over the blocks before: inside stretches of blocks, and over the stretches before.
    fold = {"high": "bit_xor(high_of)", "low": "bit_xor(low_of)", "bytes": "sum(bytes_of)"}
    totals = rows.groupBy("conv_id", "stretch").agg(*[F.expr(v).alias(f"{c}_of") for c, v in fold.items()])
    earlier = W.partitionBy("c").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumnsRenamed({"conv_id": "c", "stretch": "s"})
    far = totals.select("c", "s", *[F.coalesce(F.expr(v).over(earlier), zero).alias(f"{c}_far") for c, v in fold.items()])
    inside = W.partitionBy("conv_id", "stretch").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    near = rows.withColumns({f"{c}_near": F.coalesce(F.expr(v).over(inside), zero) for c, v in fold.items()})
    held = [F.try_element_at(F.col("held"), F.lit(i + 1)) for i in range(width)]
    ids = [F.struct(*[h[c].alias(c) for c in ("high", "low", "bytes")]) for h in held]
    return near.join(far, F.expr("conv_id <=> c AND stretch = s")).select(
        "conv_id",
        (F.col("block") * width).alias("depth"),
        *[F.col(f"{c}_near").bitwiseXOR(F.col(f"{c}_far")).alias(c) for c in ("high", "low")],
        (F.col("bytes_near") + F.col("bytes_far")).alias("bytes"),
        *[F.when(h.isNotNull(), i).alias(f"t{n}") for n, (h, i) in enumerate(zip(held, ids, strict=True), 1)],
    )


def _rolled(blocks: DataFrame, width: int, figures: str) -> DataFrame:
    """All nodes by one ROLLUP: their key, the key of their parent, the bytes of the path above, and ``figures``."""
    names = [f"t{i + 1}" for i in range(width)]
    # grouping_id has a set bit for every column that is rolled up.
    level = f"{width} - bit_count(grouping_id())"
    rolled = blocks.sparkSession.sql(
        f"SELECT depth, high, low, bytes, {', '.join(names)}, {level} AS level, {figures} FROM {{blocks}} "
        f"GROUP BY depth, high, low, bytes, ROLLUP ({', '.join(names)})",
        blocks=blocks,
    )
    last = F.element_at(F.array(F.lit(None).cast(rolled.schema["t1"].dataType), *names), (F.col("level") + 1).cast("int"))
    # A conversation shorter than the level is no member; a block's level 0 is the last level of the one before.
    rolled = rolled.withColumn("last", last).filter("last IS NOT NULL OR (level = 0 AND depth = 0)")

    def path(part: str, start: str, count: Column) -> Column:
        values = F.array(F.col(start), *[F.coalesce(F.col(f"{n}.{part}"), F.lit(0)) for n in names])
        taken = F.slice(values, F.lit(1), (count + 1).cast("int"))
        if part == "bytes":
            return F.aggregate(taken, F.lit(0).cast("long"), lambda x, y: x + y)
        return F.aggregate(taken, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))

    above = F.greatest(F.lit(0), F.col("level") - 1)
    figures_only = [c for c in rolled.columns if c not in {"depth", "high", "low", "bytes", "level", "last", *names}]
    return rolled.select(
        (F.col("depth") + F.col("level")).alias("depth"),
        *[path(c, c, F.col("level")).alias(c) for c in ("high", "low")],
        *[F.when(F.col("depth") + F.col("level") > 0, path(c, c, above)).alias(f"up_{c}") for c in ("high", "low")],
        path("bytes", "bytes", above).alias("bytes_above"),
        *figures_only,
    )


def _end_digests(blocks: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """The node at which conversations end, and the digest of their ids in order."""
    last = _joined_on_id(blocks, convs.select(F.col("conv_id").alias("c"), "turns"), "c")
    last = last.filter(f"depth = 0 AND turns = 0 OR turns > depth AND turns <= depth + {width}")
    for part in ("high", "low"):
        ids = F.array(F.col(part), *[F.coalesce(F.col(f"t{i + 1}.{part}"), F.lit(0)) for i in range(width)])
        last = last.withColumn(f"end_{part}", F.aggregate(ids, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y)))
    ends = last.filter("conv_id IS NOT NULL").select(
        F.col("turns").alias("depth"), F.col("end_high").alias("high"), F.col("end_low").alias("low"), "conv_id"
    )
    # Ids are unique, so a run has at most 2 ** ID_BITS of them; a node with many members has many runs.
    runs = ends.groupBy(*NODE, F.shiftright("conv_id", ID_BITS).alias("run")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids")
    )
    runs = store(runs, "ends")
    count = runs.groupBy(*NODE).agg(F.count(F.lit(1)).alias("runs"), F.min("ids").alias("ids"))
    small = count.filter("runs = 1").select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))
    # A digest must be taken in order: the runs of one node stream through one task, which holds none of them.
    many = runs.join(count.filter("runs > 1").select(*NODE), NODE, "left_semi")
    sorted_runs = many.repartition(*NODE).sortWithinPartitions(*NODE, "run")
    return small.union(sorted_runs.mapInArrow(_streamed, small.schema))


def _streamed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state, done = None, None, []
    for part in parts:
        for *node, ids in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in (*NODE, "ids")), strict=True):
            if node != key:
                if state is not None:
                    done.append((*key, state.hexdigest()))
                key, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _digests(done)
        done = []
    if state is not None:
        yield _digests([(*key, state.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    types = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*NODE, "ends_sha256"])


def prefix_trie(turns: DataFrame, convs: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    ``turns`` has conv_id, place (from 1, without gaps), key (of ``turn_key``) and bytes of the text; ``convs`` has
    conv_id and turns, their number. A node is a sequence of turns with which conversations begin, the root is the
    empty one. Equal conversations share all their nodes. A conversation with a null id is a member like others, but
    smallest only where no member has an id, and then ``conv_id`` is null; it is not in a digest. Without conversations
    there is no node, not even the root.
    """
    blocks = store(_blocks(turns, convs, width), "prefix-blocks")
    nodes = store(_rolled(blocks, width, "count(1) AS n_convs, min(conv_id) AS conv_id"), "nodes")
    children = nodes.filter("depth > 0").groupBy("depth", "up_high", "up_low").agg(F.count(F.lit(1)).alias("n_children"))
    children = children.select((F.col("depth") - 1).alias("depth"), F.col("up_high").alias("high"), F.col("up_low").alias("low"), "n_children")
    nodes = store(nodes.join(children, NODE, "left").fillna(0, ["n_children"]), "nodes-children")
    # What a conversation adds to the sums of its nodes: bytes before its own part of the trie, and a leaf of its own.
    own = nodes.groupBy(F.col("conv_id").alias("c")).agg(
        F.min_by("bytes_above", "depth").alias("own_bytes"),
        F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"),
    )
    block_bytes = sum((F.coalesce(F.col(f"t{i + 1}.bytes"), F.lit(0)) for i in range(width)), F.lit(0))
    whole = blocks.groupBy("conv_id").agg(F.sum(block_bytes).alias("all_bytes"))
    shares = whole.join(own, F.expr("conv_id <=> c"), "left").select(
        F.col("conv_id").alias("c"), F.coalesce("own_bytes", "all_bytes").alias("q"), F.coalesce("leaf", F.lit(0)).alias("leaf")
    )
    shared = _joined_on_id(blocks, shares, "c")
    sums = _rolled(shared, width, "sum(q) AS q, min_by(q, conv_id) AS q_least, sum(leaf) AS n_leaves")
    full = nodes.join(sums.select(*NODE, "q", "q_least", "n_leaves"), NODE).join(_end_digests(blocks, convs, width), NODE, "left")
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("high").alias("up_high"), F.col("low").alias("up_low"), F.col("conv_id").alias("parent_conv_id")
    )
    # A node may have a great many children: the hash as one more key lets adaptive execution split them.
    keys = ["depth", "up_high", "up_low"]
    full = full.withColumn("check", F.xxhash64(*keys)).join(parents.withColumn("check", F.xxhash64(*keys)), [*keys, "check"], "left")
    saved = F.col("q") - F.coalesce("q_least", "q") - (F.col("n_convs") - 1) * F.col("bytes_above")
    return full.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        F.col("n_children").cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"),
        saved.cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
