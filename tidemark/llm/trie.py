"""Prefix trie of conversations by leaf-peeling message passing.

Every prefix of a conversation has a key, a polynomial hash modulo 2^127 - 1 of its turns' digests. Such hashes can be
joined, so that a conversation may lie across many tasks: sorted rows are scanned three times, and only the state at the
end of each partition goes through the driver. A node is the group of equal keys.

Peeling goes over chains of nodes instead of single nodes. A node's chain is the member whose hashed id is least; that
member's nodes below it are of the same chain, so chains are vertical. Along any path from the root the chain changes only
when the least member leaves, which for hashed ids is expected log(members) times, however long the conversations
are and however their ids are ordered. A chain holds a counter of chains below it that have not finished; a finished
chain sends its totals to the node it hangs from and lowers that counter, until only the root's chain finishes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut, join_copies, table

PRIME, BASE = 2**127 - 1, 0x5DEECE66D_2545F4914F6CDD1D_9E3779B97F4A7C15 % (2**127 - 1)
#: Nodes of a chain that are summed in one group; the sums of groups are summed after that.
BLOCK = 1024
#: Ids that one segment of a node's list of ended conversations holds at most.
SEGMENT = 65_536
EMPTY = hashlib.sha256(b"").hexdigest()


def light(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, digest, chars) of every turn; null role or text is empty, rows without a conversation are left out."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    return turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))


def shared_heads(turns: DataFrame, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, skip) and the rows of their rebuilt forms (conv_id, own, skip, turn, at, digest, chars).

    Conversation c takes the first h turns of conversation c - c % family, h = crc32(decimal c) % most, and then its own
    turns without the first h. `skip` is h; it falls to the scan to leave out the first `skip` own rows.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = turns.select("conv_id").distinct().select("conv_id", h.cast("int").alias("skip"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    heads = turns.where(F.col("conv_id") % family == 0).withColumn("at", F.row_number().over(order)).where(F.col("at") < most)
    taken = convs.join(heads.withColumnRenamed("conv_id", "base"), "base").where("at <= skip")
    kind = turns.schema["turn"].dataType
    first = taken.select("conv_id", F.lit(False).alias("own"), F.lit(0).alias("skip"), F.lit(None).cast(kind).alias("turn"), "at", "digest", "chars")
    own = turns.select("conv_id", F.lit(True).alias("own"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int").alias("skip"), "turn", F.lit(0).alias("at"), "digest", "chars")
    return convs.select("conv_id"), first.unionByName(own)


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations and rows of conversations as they are, in the form of `shared_heads`."""
    return turns.select("conv_id").distinct(), turns.select("conv_id", F.lit(True).alias("own"), F.lit(0).alias("skip"), "turn", F.lit(0).alias("at"), "digest", "chars")


def _walk(batches: Iterator[pa.RecordBatch], before: dict[int, tuple[int, int, int, int]], rows: bool) -> Iterator[pa.RecordBatch]:
    """Scan one sorted partition from the state (conversation, own rows, depth, hash) that the partitions before it leave.

    With `rows` every kept row comes out as a step of the trie, else one row with the state at the end, in which depth and
    hash count from the partition's start.
    """
    conv = first = part = None
    own = depth = value = n = 0
    for batch in batches:
        c = {k: batch.column(k).to_pylist() for k in batch.schema.names}
        out: list[tuple] = []
        for part, key, mine, skip, digest, chars in zip(c["part"], c["conv_id"], c["own"], c["skip"], c["digest"], c["chars"], strict=True):
            if key != conv:
                start = before.get(part) if conv is None else None
                if conv is None:
                    first = key
                conv, own, depth, value = key, 0, 0, 0
                if start and start[0] == key:
                    _, own, depth, value = start
            n += 1
            if mine:
                own += 1
                if own <= skip:
                    continue
            parent = value
            depth, value = depth + 1, (value * BASE + int.from_bytes(digest, "big")) % PRIME
            if rows:
                out.append((key, depth, value.to_bytes(16, "big"), parent.to_bytes(16, "big"), chars))
        if rows and out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["conv_id", "depth", "key", "parent", "chars"])
    if not rows and n:
        yield pa.RecordBatch.from_pylist([{"part": part, "first": first, "last": conv, "own": own, "depth": depth, "value": value.to_bytes(16, "big")}])


def steps(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent, chars): every turn of every conversation with the key of the prefix that it ends.

    Rows are range-partitioned, so a conversation of any length is dealt out; rows that share conversation, turn and digest
    are equal and may come in any order. The driver holds one row a partition.
    """
    order = ["conv_id", "own", F.col("turn").asc_nulls_first(), "at", "digest"]
    spread = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    spread = cut(spread.select("conv_id", "own", "skip", "digest", "chars")).withColumn("part", F.spark_partition_id())
    before: dict[int, tuple[int, int, int, int]] = {}
    for known in (1, 3):  # own rows first, which say what is left out; then depth and hash of what is kept
        start = dict(before)

        def ends(batches: Iterator[pa.RecordBatch], start: dict = start) -> Iterator[pa.RecordBatch]:
            return _walk(batches, start, rows=False)

        found = spread.mapInArrow(ends, "part bigint, first bigint, last bigint, own bigint, depth bigint, value binary").collect()
        state = (None, 0, 0, 0)
        before = {}
        for r in sorted(found, key=lambda r: r["part"]):
            goes_on = r["first"] == r["last"] == state[0]
            if r["first"] == state[0]:
                before[r["part"]] = state if known == 3 else (state[0], state[1], 0, 0)
            own, depth, value = r["own"], r["depth"], int.from_bytes(r["value"], "big")
            if goes_on:
                own = own if known == 3 else own + state[1]
                value = (state[3] * pow(BASE, depth, PRIME) + value) % PRIME
                depth += state[2]
            state = (r["last"], own, depth, value)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _walk(batches, before, rows=True)

    return spread.mapInArrow(keyed, "conv_id bigint, depth bigint, key binary, parent binary, chars bigint")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in sorted rows as pieces of comma-joined ids."""
    key, ids = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"key": key, "first": ids[0], "ids": ",".join(map(str, ids))}])

    for batch in batches:
        out = []
        for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (k != key or len(ids) == SEGMENT):
                out.append({"key": key, "first": ids[0], "ids": ",".join(map(str, ids))})
                ids = []
            key = k
            ids.append(c)
        if out:
            yield pa.RecordBatch.from_pylist(out)
    if ids:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each key, in order; only one piece is held at a time."""
    key, state = None, None
    for batch in batches:
        out = []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if state is not None and k == key:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                out.append({"key": key, "ends_sha256": state.hexdigest()})
            key, state = k, hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_pylist(out)
    if state is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": state.hexdigest()}])


def _peel(chains: DataFrame) -> DataFrame | None:
    """(chain, depth, saved, leaves): totals that arrive at nodes of chains from the chains that hang there.

    `chains` has (chain, above, at, saved, leaves, waiting): the chain and depth that it hangs from and its counter of
    chains that have not finished.
    """
    live, sent = cut(chains), []
    while True:
        ready = live.where("waiting = 0")
        done = cut(ready.where("above is not null").groupBy("above", "at").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"), F.count("*").alias("n")))
        if done.isEmpty():
            break
        sent.append(done.select(F.col("above").alias("chain"), F.col("at").alias("depth"), "saved", "leaves"))
        news = done.groupBy(F.col("above").alias("chain")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"), F.sum("n").alias("n"))
        got = lambda x: F.coalesce(x, F.lit(0))
        live = cut(
            live.where("waiting > 0").join(news, "chain", "left")
            .select("chain", "above", "at", (F.col("saved") + got("s")).alias("saved"), (F.col("leaves") + got("l")).alias("leaves"), (F.col("waiting") - got("n")).alias("waiting"))
        )
    if not sent:
        return None
    every = sent[0]
    for other in sent[1:]:
        every = every.unionByName(other)
    return every  # a node's chains may finish in different rounds


def trie(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations `convs` with the turns `rows` (see `whole`).

    conv_id: smallest member; depth; parent_conv_id: the parent's conv_id, null for the root; n_convs: members; n_children;
    n_leaves: childless nodes of the subtree, itself included; saved_tokens: over the subtree, members less one times the
    code points of the last text; ends_sha256: SHA-256 of the ids, ascending and comma-joined, of the members that end there.

    Turns are ordered by turn, nulls first; turns that tie are ordered by the digest of role and text, repeated turns stay.
    Rows without a conversation are left out. A conversation without turns is a member of the root. No conversations: no
    rows. Extra columns do not matter, as `light` takes four by name. A node that holds a third of all conversations
    costs no more than others but for its hash, which is by its nature one stream.
    """
    convs = table(convs)
    if convs.isEmpty():
        return convs.selectExpr("conv_id", *(f"conv_id {n}" for n in ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), "'' ends_sha256")
    turns = table(steps(rows))
    root = F.lit(b"\x00" * 16)
    label = F.min(F.struct(F.xxhash64("conv_id").alias("h"), F.col("conv_id").alias("chain")))["chain"]
    members = [F.count("*").alias("n_convs"), label.alias("chain")]
    below = turns.groupBy("depth", "key", "parent").agg(F.min("chars").alias("chars"), F.min("conv_id").alias("conv_id"), *members)
    top = convs.groupBy().agg(F.min("conv_id").alias("conv_id"), *members).select(F.lit(0).cast("long").alias("depth"), root.alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars"), "conv_id", "n_convs", "chain")
    nodes = table(below.unionByName(top))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = table(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("chain").alias("above"), F.col("n_children").alias("copies"))
    hung = join_copies(nodes.where("parent is not null"), parents, "parent")
    hung = hung.unionByName(nodes.where("parent is null").withColumns({"parent_conv_id": F.lit(None).cast("long"), "above": F.lit(None).cast("long")}))
    own = ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    nodes = table(hung.select("key", "depth", "conv_id", "parent_conv_id", "chain", "above", "n_convs", "n_children", own, (F.col("n_children") == 0).cast("long").alias("leaves")))

    chains = nodes.groupBy("chain").agg(F.min(F.struct("depth", "above")).alias("top"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    chains = table(chains.select("chain", F.col("top.above").alias("above"), (F.col("top.depth") - 1).alias("at"), "saved", "leaves"))
    waiting = chains.where("above is not null").groupBy(F.col("above").alias("chain")).agg(F.count("*").alias("waiting"))
    arrived = _peel(chains.join(waiting, "chain", "left").withColumn("waiting", F.coalesce("waiting", F.lit(0))))

    weights = nodes.select("chain", "depth", "saved", "leaves")
    if arrived is not None:
        weights = weights.unionByName(arrived)
    block = F.floor(F.col("depth") / BLOCK).alias("block")
    weights = table(weights.groupBy("chain", "depth", block).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")))
    inside = Window.partitionBy("chain", "block").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("chain").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = weights.groupBy("chain", "block").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    sums = sums.select("chain", "block", F.coalesce(F.sum("s").over(after), F.lit(0)).alias("s"), F.coalesce(F.sum("l").over(after), F.lit(0)).alias("l"))
    totals = weights.select("chain", "depth", "block", F.sum("saved").over(inside).alias("in_s"), F.sum("leaves").over(inside).alias("in_l")).join(sums, ["chain", "block"])
    totals = totals.select("chain", "depth", (F.col("in_s") + F.col("s")).alias("saved_tokens"), (F.col("in_l") + F.col("l")).alias("n_leaves"))

    last = turns.groupBy("conv_id").agg(F.max(F.struct("depth", "key")).alias("x"))
    ended = convs.join(last, "conv_id", "left").select(F.coalesce("x.key", root).alias("key"), "conv_id")
    lists = ended.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_segments, "key binary, first bigint, ids string")
    hashes = lists.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(_hashed, "key binary, ends_sha256 string")
    found = nodes.drop("saved", "leaves").join(totals, ["chain", "depth"]).join(hashes, "key", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def shared_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt on shared heads; see `shared_heads` and `trie`."""
    return trie(*shared_heads(table(light(conversations))))
