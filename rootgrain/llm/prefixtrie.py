"""The trie of conversations that begin alike, by partition refinement.

All conversations start as one class. A round looks at one more turn and splits every active class
by it. A class of one conversation retires: what is left of it is a chain without branches, so that
its nodes need no further round. When no class is active, the counts of subtrees are folded back,
from the deepest level to the root.
"""

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored

#: Turns of a conversation that lie in one row, so that a row stays small however long the conversation.
CHUNK = 32
#: Bytes of conversation ids that are hashed as one piece.
PIECE = 1 << 20


def turn_digest(role: Column, text: Column) -> Column:
    """A SHA-256 of role and text that tells every pair from every other."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def numbered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, pos, n, g, words): the turns in their order.

    A row stands for n equal turns at the places pos + 1 to pos + n of conversation c; g is their
    turn_digest and words counts the runs of characters other than space and the controls 9 to 13.
    Turns come by number, null first, those of one number by g; null role or text is empty. Rows
    without a conversation are left out. Other columns are not read.

    Places come from a range partitioning by conversation and number, so that a conversation of any
    length is spread over tasks; only one row for each partition goes through the driver.
    """
    spark = conversations.sparkSession
    body = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("t"), turn_digest(body(role), body(text)).alias("g"), F.regexp_count(body(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    equal = rows.groupBy("c", "t", "g").agg(F.count(F.lit(1)).alias("n"), F.max("words").alias("words"))
    order = [F.col("c"), F.col("t").asc_nulls_first(), F.col("g")]
    ranged = equal.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "c", "n", "g", "words")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, count = None, 0
        for batch in batches:
            c, n = batch.column("c").to_numpy(), batch.column("n").to_numpy()
            before = np.cumsum(n) - n
            new = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.empty(0, np.int64)
            pos = before - np.repeat(before[new], np.diff(np.append(new, len(c))))
            if len(c):
                if c[0] == own:
                    pos[: new[1] if len(new) > 1 else len(c)] += count
                own, count = c[-1], pos[-1] + n[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos, pa.int64())], [*batch.schema.names, "pos"])

    local = stored(ranged.mapInArrow(places, "part int, c long, n long, g binary, words long, pos long"), "turns")
    ends = local.groupBy("part").agg(F.min("c").alias("first"), F.max("c").alias("last"), F.max(F.struct("c", (F.col("pos") + F.col("n")).alias("end")))["end"].alias("n")).orderBy("part").collect()
    went, shifts = {}, []
    for r in ends:  # what earlier partitions hold of the conversation that a partition begins with
        if r["first"] in went:
            shifts.append((r["part"], r["first"], went[r["first"]]))
        went = {r["last"]: r["n"] + went.get(r["last"], 0)}
    shifted = F.broadcast(spark.createDataFrame(shifts, "part int, c long, shift long"))
    return local.join(shifted, ["part", "c"], "left").select("c", (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("pos"), "n", "g", "words")


def rejoined(turns: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the turns of others: ((c, pos, n, g, words), (c, size)).

    starts (c, base, h): conversation c gets the first h turns of base (all if it has fewer, none if
    it does not exist), and then its own turns after its own first h. size is its number of turns.
    """
    most = starts.agg(F.max("h")).first()[0] or 0
    lengths = turns.groupBy("c").agg(F.max(F.col("pos") + F.col("n")).alias("own"))
    held = starts.join(lengths, "c", "left").join(lengths.toDF("base", "base_own"), "base", "left")
    taken = F.least("h", F.coalesce("base_own", F.lit(0)))
    info = stored(held.select("c", "base", "h", taken.alias("taken"), (taken + F.greatest(F.coalesce("own", F.lit(0)) - F.col("h"), F.lit(0))).alias("size")), "starts")
    opening = turns.where(F.col("pos") < most).toDF("base", "pos", "n", "g", "words")
    begun = info.where("taken > 0").join(opening, "base").where("pos < taken").select("c", "pos", F.least("n", F.col("taken") - F.col("pos")).alias("n"), "g", "words")
    skipped = F.greatest(F.col("h") - F.col("pos"), F.lit(0))
    rest = turns.join(info.select("c", "h", "taken"), "c").where("pos + n > h").select("c", (F.greatest(F.col("pos") - F.col("h"), F.lit(0)) + F.col("taken")).alias("pos"), (F.col("n") - skipped).alias("n"), "g", "words")
    return begun.unionByName(rest), info.select("c", "size")


def _ends_digests(ends: DataFrame) -> DataFrame:
    """(class, c) -> (class, ends_sha256): the SHA-256 of the ids of a class, ascending and comma-joined.

    Ids are sorted over all tasks by class and id, so that a large class is spread over many; each
    writes its ids as text in pieces, and only those pieces meet, one after the other, in the hash."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, size, number, part = None, [], 0, 0, 0
        kind = pa.schema([("class", pa.binary()), ("part", pa.int32()), ("number", pa.int64()), ("ids", pa.string())])

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((own, part, number, ",".join(ids)), kind.types, strict=True)], schema=kind)

        for batch in batches:
            for name, c, part in zip(batch.column("class").to_pylist(), batch.column("c").to_pylist(), batch.column("part").to_pylist(), strict=True):  # noqa: B007  the partition is one
                if ids and (name != own or size >= PIECE):
                    yield piece()
                    ids, size, number = [], 0, number + 1
                own = name
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield piece()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, h = None, None
        for batch in batches:
            names, told = [], []
            for name, ids in zip(batch.column("class").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if name != own:
                    if h is not None:
                        names.append(own)
                        told.append(h.hexdigest())
                    own, h = name, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(told, pa.string())], ["class", "ends_sha256"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.binary()), pa.array([h.hexdigest()], pa.string())], ["class", "ends_sha256"])

    ranged = ends.repartitionByRange("class", "c").sortWithinPartitions("class", "c").select(F.spark_partition_id().alias("part"), "class", "c")
    cut = ranged.mapInArrow(pieces, "class binary, part int, number long, ids string")
    return cut.repartition("class").sortWithinPartitions("class", "part", "number").select("class", "ids").mapInArrow(hashes, "class binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, starts: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The nodes of the trie: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    A node of depth d is a sequence of d turns (role, text) with which conversations, its members,
    begin; depth 0 is the root. conv_id is its smallest member, so that conv_id and depth tell a node
    and its last turn. n_leaves counts the nodes without children in its subtree, itself included;
    saved_tokens sums (members - 1) * words of the last turn over that subtree; ends_sha256 is the
    SHA-256 of the ids of the members that end there, ascending and comma-joined.

    Turns are ordered as numbered() says, which tells what nulls, ties and repeated rows become.
    starts is that of rejoined(): conversations that begin with the turns of others, those without
    turns too. No conversations give no nodes. Keys are whole numbers; other columns are not read.

    A class is named by the hash of its turns. A round groups by that name, which tasks sum before
    the shuffle, and takes the retired conversations out by their own ids: neither meets in one task,
    however many conversations begin alike. Every round is a table in the shared folder.
    """
    with scratch(conversations.sparkSession):
        turns = numbered(conversations, conv, turn, role, text)
        if starts is None:
            sizes = turns.groupBy("c").agg(F.max(F.col("pos") + F.col("n")).alias("size"))
        else:
            turns, sizes = rejoined(turns, starts)
        return stored(_nodes(turns, sizes), "nodes", keep=True)


def _each(df: DataFrame, low: Column, high: Column, out: str, block: int = 4096) -> DataFrame:
    """A row for each number from low to high, by blocks, so that no row holds a long list."""
    first = F.explode(F.sequence(low - low % block, F.greatest(low, high), F.lit(block).cast("long")))
    blocks = df.where(low <= high).select("*", first.alias(out))
    return blocks.withColumn(out, F.explode(F.sequence(F.greatest(low, F.col(out)), F.least(high, F.col(out) + block - 1))))


def _nodes(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    spark = turns.sparkSession
    each = _each(turns, F.col("pos"), F.col("pos") + F.col("n") - 1, "d")
    chunk = F.floor(F.col("d") / CHUNK)
    rows = each.groupBy("c", chunk.alias("k")).agg(F.array_sort(F.collect_list(F.struct("d", "g", "words"))).alias("tail"))
    chunks = stored(rows, "chunks")
    sizes = stored(sizes.select("c", F.col("size").cast("long").alias("size")), "sizes")
    total = sizes.agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).first()
    if not total["n"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    level = spark.createDataFrame([(b"", None, total["c"], total["n"], 0)], "class binary, parent binary, c long, n long, words long")
    active, depth = sizes.select("c", F.lit(b"").alias("class"), "size"), 0
    levels, ends = [level], []
    while True:
        if depth % CHUNK == 0:
            active = active.drop("tail").join(chunks.where(F.col("k") == depth // CHUNK).select("c", "tail"), "c", "left")
        ends.append(active.where(F.col("size") == depth).select("class", "c"))
        turn = F.try_element_at("tail", F.lit(depth % CHUNK + 1))
        split = active.where(F.col("size") > depth).select("c", F.unhex(F.sha2(F.concat("class", turn["g"]), 256)).alias("class"), F.col("class").alias("parent"), turn["words"].alias("words"), "size", "tail")
        level = stored(split.groupBy("class").agg(F.first("parent").alias("parent"), F.min("c").alias("c"), F.count(F.lit(1)).alias("n"), F.first("words").alias("words")), "level")
        levels.append(level)
        depth += 1
        active = stored(split.drop("parent", "words").join(level.where("n = 1").select("c"), "c", "left_anti"), "active")
        if active.isEmpty():
            break

    # fold back: levels[d] gets what its children sum up to, and hands its members' smallest id down
    below, folded, tails = None, [], []
    for d in range(depth, -1, -1):
        level = levels[d]
        if below is not None:
            sums = below.groupBy(F.col("parent").alias("class")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
            level = level.join(sums, "class", "left")
        else:
            level = level.withColumns(dict.fromkeys(("n_children", "n_leaves", "saved_tokens"), F.lit(None).cast("long")))
        above = levels[d - 1].select(F.col("class").alias("parent"), F.col("c").alias("parent_c")) if d else None
        named = level.join(above, "parent", "left") if d else level.withColumn("parent_c", F.lit(None).cast("long"))
        own = (F.col("n") - 1) * F.col("words") + F.coalesce("saved_tokens", F.lit(0))
        below = stored(named.select("class", "parent", "c", "parent_c", F.lit(d).cast("long").alias("depth"), "n", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), own.alias("saved_tokens")), "folded")
        folded.append(below.where("n > 1 OR depth = 0"))
        tails.append(below.where("n = 1 AND depth > 0").select("c", "depth", "parent_c"))

    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    shared = reduce(DataFrame.unionByName, folded).join(_ends_digests(reduce(DataFrame.unionByName, ends)), "class", "left")
    branching = shared.select(F.col("c").alias("conv_id"), "depth", F.col("parent_c").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256"))
    # retired conversations: their tails as chains
    retired = reduce(DataFrame.unionByName, tails).withColumnRenamed("depth", "from").join(sizes, "c")
    chains = _each(retired, F.col("from"), F.col("size"), "depth").withColumnRenamed("c", "conv_id")
    last = F.col("depth") == F.col("size")
    chained = chains.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("from"), F.col("parent_c")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nobody).alias("ends_sha256"),
    )
    return branching.unionByName(chained)
