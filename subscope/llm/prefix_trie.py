"""The trie of conversations' prefixes, by fixed-length blocks of turns.

A turn is a digest salted with its depth, and a prefix the exclusive-or of its turns' digests (128 bits), so prefixes are
compared by value, without walking down from the root. Identical conversations are one class from the start. Classes are
grouped by blocks of several turns. Where all that come through a node go on with the same block, its inner nodes follow from
the block; only blocks in which siblings diverge or end are taken apart at the boundaries of their turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import common

BLOCK = 4  # turns of a block
SPAN_BITS = 12  # 2**12 turn numbers, blocks or ids are ordered together; longer runs are cut and carried over
GROUP = 100  # conversations that borrow the beginning of the first of them
BORROWED = 6  # and one more than the most turns they borrow
KEY = ["depth", "x", "y"]
_NONE = hashlib.sha256().hexdigest()
NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)


def _along(rows: DataFrame, bucket: Column, order: Sequence[Column | str], sums: Sequence[str], xors: Sequence[str] = ()) -> DataFrame:
    """Add ``upto_`` columns: running sums and exclusive-ors along each conversation.

    A conversation is cut at the buckets, whose totals are carried over, so a very long one is the work of many tasks.
    """
    combine: dict[str, tuple[Callable, Callable]] = {c: (F.sum, lambda a, b: a + b) for c in sums}
    combine |= {c: (F.bit_xor, lambda a, b: a.bitwiseXOR(b)) for c in xors}
    cut = rows.withColumn("bucket", bucket)
    totals = cut.groupBy("conv_id", "bucket").agg(*[add(c).alias(c) for c, (add, _) in combine.items()])
    ahead = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv_id", "bucket", *[F.coalesce(add(c).over(ahead), F.lit(0)).alias(f"ahead_{c}") for c, (add, _) in combine.items()])
    inside = Window.partitionBy("conv_id", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.join(carried, ["conv_id", "bucket"]).select(
        *rows.columns, *[both(F.col(f"ahead_{c}"), add(c).over(inside)).alias(f"upto_{c}") for c, (add, both) in combine.items()]
    )


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, tokens): turns by place, with a digest of role and text instead of the text itself.

    By turn number, null first; equal ones by their digest. Null role or text counts as empty, rows without conv_id are left
    out. Tokens are code points of the text.
    """
    c = {n: conversations[n] for n in ("conv_id", "turn", "role", "text")}
    role, text = (F.coalesce(c[n].cast("string"), F.lit("")) for n in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where(c["conv_id"].isNotNull()).select(
        c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), digest.alias("digest"),
        F.length(text).cast("long").alias("tokens"),
    )
    turns = turns.select(
        "conv_id", "turn", F.xxhash64(F.lit(1), "digest").alias("a"), F.xxhash64(F.lit(2), "digest").alias("b"), "tokens", F.lit(1).alias("one")
    )
    bucket = F.coalesce(F.shiftright("turn", SPAN_BITS), F.lit(-(2**62)))
    placed = _along(turns, bucket, [F.col("turn").asc_nulls_first(), "a", "b"], ["one"])
    return materialize(placed.select("conv_id", (F.col("upto_one") - 1).alias("pos"), "a", "b", "tokens"), "placed")


def rebuilt(turns: DataFrame, group: int = GROUP, borrowed: int = BORROWED) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first h turns of conversation ``c - c % group`` instead of their own, h = crc32(c) % borrowed.

    Fewer turns are borrowed where there are fewer; the remainder of a negative id is negative, as in SQL. Returns turns as ``ordered`` does, and all conv_ids, also of those that
    are left without a turn.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % borrowed
    ids = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), head.alias("h"))
    bases = sizes.select(F.col("conv_id").alias("base"), "n")
    taken = F.least("h", F.coalesce("n", F.lit(0))).alias("taken")
    ids = materialize(ids.join(bases, "base", "left").select("conv_id", "base", "h", taken), "conversations")
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < borrowed)).withColumnRenamed("conv_id", "base")
    first = ids.join(heads, "base").where("pos < taken").select("conv_id", "pos", "a", "b", "tokens")
    own = turns.join(ids, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "a", "b", "tokens")
    return first.unionByName(own), ids.select("conv_id")


def _ends(ends: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256): the SHA-256 of the ascending ids of the conversations that end at a node, joined by commas.

    Ids are joined in chunks of bounded width first; a task then passes once over the chunks of a node, and holds one of them.
    """
    chunk = F.shiftright("conv_id", SPAN_BITS).alias("chunk")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    chunks = ends.groupBy(*KEY, chunk).agg(joined.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            done = []
            for depth, x, y, ids in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if (depth, x, y) == key:
                    sha.update(b",")
                else:
                    if key:
                        done.append((*key, sha.hexdigest()))
                    key, sha = (depth, x, y), hashlib.sha256()
                sha.update(ids.encode())
            yield _hashes(done)
        if key:
            yield _hashes([(*key, sha.hexdigest())])

    dealt = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").select(*KEY, "ids")
    return dealt.mapInArrow(digest, "depth long, x long, y long, ends_sha256 string")


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    types = {"depth": pa.int64(), "x": pa.int64(), "y": pa.int64(), "ends_sha256": pa.string()}
    return common.batch_of(**{n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(types.items())})


def _turns() -> Column:
    """A block's turns with their prefix, the prefix and the tokens before them."""

    def unrolled(i: Column) -> Column:
        turn, before = F.get("turns", i), F.slice("turns", F.lit(1), i)
        x = F.aggregate(before, F.col("from_x"), lambda acc, t: acc.bitwiseXOR(t["x"]))
        y = F.aggregate(before, F.col("from_y"), lambda acc, t: acc.bitwiseXOR(t["y"]))
        ahead = F.aggregate(before, F.col("from_tokens"), lambda acc, t: acc + t["tokens"])
        return F.struct(
            turn["depth"].alias("depth"), x.bitwiseXOR(turn["x"]).alias("x"), y.bitwiseXOR(turn["y"]).alias("y"), x.alias("up_x"),
            y.alias("up_y"), turn["tokens"].alias("tokens"), ahead.alias("ahead"),
        )

    return F.inline(F.transform(F.sequence(F.lit(0), F.size("turns") - 1), unrolled))


def _last_ahead() -> Column:
    """Tokens before the last turn of a block."""
    ahead = F.slice("turns", F.lit(1), F.size("turns") - 1)
    return F.aggregate(ahead, F.col("from_tokens"), lambda acc, t: acc + t["tokens"])


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each distinct beginning of the conversations ``ids``, whose turns are (conv_id, pos, a, b, tokens).

    conv_id is its smallest member, parent_conv_id its parent's (null for the root, which has no turn); n_convs are members,
    n_leaves and saved_tokens are sums over the subtree, ends_sha256 is of the members that end here. Conversations without a
    turn are members of the root. Without conversations there is no node. Repeated ids count once.
    """
    ids = ids.where("conv_id is not null").select("conv_id").distinct()
    deep = turns.withColumn("depth", F.col("pos") + 1)
    x, y = F.xxhash64(F.lit(3), "a", "b", "depth"), F.xxhash64(F.lit(4), "b", "a", "depth")
    rows = materialize(deep.select("conv_id", "depth", x.alias("x"), y.alias("y"), "tokens"), "turns")
    whole = rows.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("tokens").alias("total"))
    ends = materialize(ids.join(whole, "conv_id", "left").na.fill(0), "ends")
    number, least = ends.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    classes = ends.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("w"), F.max("total").alias("total"))
    classes = materialize(classes.join(_ends(ends), KEY), "classes")
    placed = materialize(_placed(rows, classes, number), "blocks")
    nodes = materialize(_nodes(placed, classes), "nodes")

    # the root is a literal: its children, however many, meet in no join
    up = F.col("depth") > 1
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.col("conv_id").alias("parent"))
    from_x = F.when(up, F.col("up_x")).otherwise(F.col("x"))
    children = nodes.where(up).groupBy((F.col("depth") - 1).alias("depth"), F.col("up_x").alias("x"), F.col("up_y").alias("y"))
    children = children.agg(F.count(F.lit(1)).alias("n_children"))
    found = nodes.withColumn("up_x", from_x).join(parents, ["depth", "up_x", "up_y"], "left").join(children, KEY, "left")
    found = found.join(_sums(placed, nodes), ["end_depth", "end_x", "end_y"], "left")
    saved = F.when(F.col("alone"), F.lit(0)).otherwise(F.col("saved")) + (F.col("n") - 1) * F.col("between")
    inner = found.select(
        "conv_id", "depth", F.when(up, F.col("parent")).otherwise(F.lit(least)).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).alias("n_children"), F.when(F.col("alone"), 1).otherwise(F.col("leaves")).alias("n_leaves"),
        saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    ended = classes.where("depth = 0").agg(F.max("ends_sha256")).scalar()
    root = nodes.agg(
        F.lit(least).alias("conv_id"), F.lit(0).alias("depth"), F.lit(None).alias("parent_conv_id"), F.lit(number).alias("n_convs"),
        F.count_if(F.col("depth") == 1).alias("n_children"), F.greatest(F.lit(1), F.count_if(F.col("leaf"))).alias("n_leaves"),
        total((F.col("n") - 1) * F.col("tokens")).alias("saved_tokens"), F.coalesce(ended, F.lit(_NONE)).alias("ends_sha256"),
    )
    cast = [F.col(n).cast(t).alias(n) for n, t in (f.split() for f in NODES.split(", "))]
    return inner.select(*cast).unionByName(root.where(F.lit(number > 0)).select(*cast))


def _placed(rows: DataFrame, classes: DataFrame, number: int) -> DataFrame:
    """Blocks of the classes' first members, each with the members and the first of its group, and whether all that
    come to its beginning go on with it."""
    own = rows.join(classes.where("depth > 0").select("conv_id", "w", "total"), "conv_id")
    own = own.withColumn("block", F.floor((F.col("depth") - 1) / BLOCK))
    turns = F.sort_array(F.collect_list(F.struct("depth", "x", "y", "tokens"))).alias("turns")
    blocks = own.groupBy("conv_id", "block", "w", "total").agg(
        F.max("depth").alias("depth"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("tokens").alias("tokens"), turns
    )
    run = _along(blocks, F.shiftright("block", SPAN_BITS), ["block"], ["tokens"], ["x", "y"])
    before = [F.col(f"upto_{c}").bitwiseXOR(F.col(c)).alias(f"from_{c}") for c in ("x", "y")]
    run = run.select(
        "conv_id", "w", "total", "block", "depth", F.col("upto_x").alias("x"), F.col("upto_y").alias("y"), *before,
        (F.col("upto_tokens") - F.col("tokens")).alias("from_tokens"), "turns",
    )
    run = materialize(run, "blocks")
    at = ["block", *KEY]
    groups = run.groupBy(*at).agg(
        F.sum("w").alias("n"), F.min("conv_id").alias("first"), F.max("from_x").alias("from_x"), F.max("from_y").alias("from_y")
    )
    groups = materialize(groups, "groups")
    full = groups.where(F.col("depth") == (F.col("block") + 1) * BLOCK)
    came = full.select((F.col("block") + 1).alias("block"), F.col("x").alias("from_x"), F.col("y").alias("from_y"), F.col("n").alias("came"))
    later = groups.where("block > 0").join(came, ["block", "from_x", "from_y"])
    both = groups.where("block = 0").withColumn("came", F.lit(number).cast("long")).unionByName(later)
    return run.join(both.select(*at, "n", "first", (F.col("n") == F.col("came")).alias("same")), at)


def _nodes(placed: DataFrame, classes: DataFrame) -> DataFrame:
    """All nodes but the root, with their members; ``end_`` names the node whose sums over the subtree are counted for them,
    ``between`` the tokens from a node to that one, and ``alone`` nodes that one class alone passes through, with its tokens
    to the end. ``leaf``: all members end here.
    """
    alone = F.col("n") == F.col("w")
    same = placed.where("same and conv_id = first").select(
        "conv_id", "n", F.col("depth").alias("end_depth"), F.col("x").alias("end_x"), F.col("y").alias("end_y"), alone.alias("alone"),
        F.when(alone, F.col("total")).otherwise(_last_ahead()).alias("upto"), _turns(),
    )
    same = same.select(*KEY, "up_x", "up_y", "tokens", "ahead", "n", "conv_id", "end_depth", "end_x", "end_y", (F.col("upto") - F.col("ahead")).alias("between"), "alone")
    apart = placed.where("not same").select("conv_id", "w", _turns()).groupBy(*KEY).agg(
        *[F.max(c).alias(c) for c in ("up_x", "up_y", "tokens", "ahead")], F.sum("w").alias("n"), F.min("conv_id").alias("conv_id")
    )
    apart = apart.select(
        *KEY, "up_x", "up_y", "tokens", "ahead", "n", "conv_id", *[F.col(c).alias(f"end_{c}") for c in KEY],
        F.lit(0).cast("long").alias("between"), F.lit(False).alias("alone"),
    )
    ended = classes.where("depth > 0").select(*KEY, "w", "ends_sha256")
    wide = same.unionByName(apart).join(ended, KEY, "left")
    return wide.withColumn("leaf", F.coalesce(F.col("n") == F.col("w"), F.lit(False))).drop("w")


def _sums(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(end_depth, end_x, end_y, leaves, saved): sums over the subtrees of the nodes that several classes pass through.

    A class brings the tokens of its rest for each member. Every node of the subtree is once to be taken off again, and has one
    first member: so a class takes off those of its rest of which it is the first. Its first such node is the highest.
    """
    owners = nodes.groupBy("conv_id").agg(F.min("ahead").alias("own_from"), F.max("leaf").alias("leaf"))
    same = placed.where("same and n > w").select("conv_id", "w", "total", *KEY, _last_ahead().alias("ahead"))
    apart = placed.where("not same").select("conv_id", "w", "total", _turns()).select("conv_id", "w", "total", *KEY, "ahead")
    rows = same.unionByName(apart).join(owners, "conv_id", "left")
    own = F.col("total") - F.greatest(F.col("ahead"), F.coalesce("own_from", "total"))
    return rows.groupBy(*[F.col(c).alias(f"end_{c}") for c in KEY]).agg(
        F.count_if(F.coalesce("leaf", F.lit(False))).alias("leaves"), F.sum(F.col("w") * (F.col("total") - F.col("ahead")) - own).alias("saved")
    )
