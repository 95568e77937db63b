"""Conversation prefix trie by time-forward processing.

Conversations that begin with the same turns share the nodes of those turns. Steps:

1. All turns are sorted by ranges of (conversation, turn), so that one very long conversation lies in many tasks. A prefix is
   named by two polynomial hashes of its turns' digests; tasks hash what they hold, and what a conversation has in earlier
   ranges is put before it. That no two prefixes share a name is verified: all members of a node must agree on its parent's
   name and on the digest of its last turn. If not, other bases are taken.
2. A node is named by its smallest member and its depth. Nodes with many members (``SHARE``) are the top of the trie; what
   hangs below it are shards, cut again every ``BAND`` levels.
3. Shards are sorted by reverse level order. A task goes through a shard and passes totals from nodes to parents, which come
   later in that order, in a priority queue that spills. What the roots of shards hold is passed on in the same way over the
   top of the trie, and from there back to where shards below a band are attached.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import tempfile
from collections.abc import Iterator
from itertools import count, islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import HOT_ROWS, HOT_SHARE, WORD, discard, join_to_groups, materialise

PRIME = (1 << 61) - 1
#: Levels of a shard, at least; messages that a queue holds in memory.
BAND, ROOM = 1024, 200_000
NO_IDS = hashlib.sha256(b"").hexdigest()


def _bases(attempt: int) -> tuple[int, int]:
    """Two bases of the polynomials, others at each attempt."""
    return tuple(int.from_bytes(hashlib.sha256(f"{attempt} {lane}".encode()).digest()[:7], "big") + 2 for lane in range(2))


def _values(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "big") % PRIME, int.from_bytes(digest[8:16], "big") % PRIME


PLACED = "conv_id long, pid int, pos long, a long, b long, sha binary, words long"


def _place(bases: tuple[int, int]):
    p, q = bases

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of turns in order: the place in what this task has of the conversation, and the hashes up to there."""
        now, pos, a, b = None, 0, 0, 0
        for batch in batches:
            rows = []
            for conv, pid, sha, words in batch.itertuples(index=False, name=None):
                if conv != now:
                    now, pos, a, b = conv, 0, 0, 0
                x, y = _values(sha)
                pos, a, b = pos + 1, (a * p + x) % PRIME, (b * q + y) % PRIME
                rows.append((conv, pid, pos, a, b, sha, words))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PLACED.split(", ")])

    return run


def _carries(placed: DataFrame, bases: tuple[int, int]) -> DataFrame:
    """pid, conv_id, had, ha, hb: what the first conversation of a range has in the ranges before it. One row a task at most goes through the driver."""
    last = F.max_by(F.struct("pos", "a", "b"), F.struct("conv_id", "pos")).alias("last")
    held, out = None, []
    for r in placed.groupBy("pid").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("conv"), last).orderBy("pid").collect():
        n, a, b = r["last"]
        goes_on = held is not None and held[0] == r["first"]
        if goes_on:
            out.append((r["pid"], *held))
        if goes_on and r["first"] == r["conv"]:
            _, had, ha, hb = held
            held = (r["conv"], had + n, (ha * pow(bases[0], n, PRIME) + a) % PRIME, (hb * pow(bases[1], n, PRIME) + b) % PRIME)
        else:
            held = (r["conv"], n, a, b)
    return placed.sparkSession.createDataFrame(out, "pid int, conv_id long, had long, ha long, hb long")


OWN = "conv_id long, i long, a long, b long, sha binary, words long"


def _carried(bases: tuple[int, int]):
    p, q = bases

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, pos, a, b, sha, words, had, ha, hb in batch[["conv_id", "pos", "a", "b", "sha", "words", "had", "ha", "hb"]].itertuples(index=False, name=None):
                if had:
                    a, b = (ha * pow(p, pos, PRIME) + a) % PRIME, (hb * pow(q, pos, PRIME) + b) % PRIME
                rows.append((conv, pos + had, a, b, sha, words))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in OWN.split(", ")])

    return run


TURNS = "conv_id long, depth long, length long, a long, b long, pa long, pb long, sha binary, words long"


def _grafted(bases: tuple[int, int]):
    p, q = bases
    back_p, back_q = pow(p, -1, PRIME), pow(q, -1, PRIME)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Own turns behind the head of another conversation: what differs before them is multiplied up to their place."""
        for batch in batches:
            rows = []
            for conv, i, a, b, sha, words, skip, kept, length, da, db in batch[["conv_id", "i", "a", "b", "sha", "words", "skip", "kept", "length", "da", "db"]].itertuples(index=False, name=None):
                if da or db:
                    a, b = (a + da * pow(p, i - skip, PRIME)) % PRIME, (b + db * pow(q, i - skip, PRIME)) % PRIME
                x, y = _values(sha)
                rows.append((conv, kept + i - skip, length, a, b, (a - x) * back_p % PRIME, (b - y) * back_q % PRIME, sha, words))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in TURNS.split(", ")])

    return run


def _rebuilt(given: DataFrame, base: Column | None, head: Column | None, most: int, bases: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): every turn of every rebuilt conversation with the names of its node and that one's parent."""
    ordered = given.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    words = F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("long")
    placed = materialise(ordered.select("conv_id", F.spark_partition_id().alias("pid"), digest.alias("sha"), words.alias("words")).mapInPandas(_place(bases), PLACED), "placed")
    own = placed.join(F.broadcast(_carries(placed, bases)), ["pid", "conv_id"], "left").fillna(0, ["had", "ha", "hb"])  # a row a task at most
    own = own.mapInPandas(_carried(bases), OWN)

    first = F.sort_array(F.collect_list(F.when(F.col("i") <= most, F.struct("i", "a", "b", "sha", "words")))).alias("first")  # at most ``most``
    convs = own.groupBy("conv_id").agg(F.max("i").alias("len"), first)
    zero = F.lit(0).cast("long")
    if base is None:
        convs = convs.withColumns({"skip": zero, "kept": zero, "before": F.slice("first", 1, 0), "da": zero, "db": zero})
    else:
        convs = materialise(convs, "heads")
        heads = convs.select(F.col("conv_id").alias("base_id"), F.col("first").alias("base_first"))
        convs = convs.withColumn("skip", head.cast("long")).withColumn("base_id", base).join(heads, "base_id", "left")
        convs = convs.withColumn("kept", F.least("skip", F.coalesce(F.size("base_first"), zero)).cast("long"))
        at = lambda turns, n, lane: F.when(F.col(n) > 0, F.element_at(turns, F.col(n).cast("int"))[lane]).otherwise(0)
        shift = lambda lane: F.when(F.col("len") > F.col("skip"), F.pmod(at("base_first", "kept", lane) - at("first", "skip", lane), F.lit(PRIME))).otherwise(0)
        convs = convs.withColumns({"before": F.slice(F.coalesce("base_first", F.slice("first", 1, 0)), F.lit(1), F.col("kept").cast("int")), "da": shift("a"), "db": shift("b")})
    convs = convs.withColumn("length", F.col("kept") + F.greatest(zero, F.col("len") - F.col("skip")))
    convs = materialise(convs.select("conv_id", "len", "skip", "kept", "length", "before", "da", "db"), "conversations")

    rows = placed.count()
    tail = join_to_groups(own, convs.drop("before"), ["conv_id"], "len", rows).where("i > skip").mapInPandas(_grafted(bases), TURNS)
    before = convs.select("conv_id", "length", "before", F.posexplode("before").alias("at", "t"))
    parent = lambda lane: F.when(F.col("at") > 0, F.element_at("before", F.greatest(F.col("at"), F.lit(1)))[lane]).otherwise(0)
    heads = before.select("conv_id", (F.col("at") + 1).cast("long").alias("depth"), "length", "t.a", "t.b", parent("a").alias("pa"), parent("b").alias("pb"), "t.sha", "t.words")
    turns = materialise(heads.union(tail), "turns")
    discard(placed)
    return turns, convs


class Messages:
    """A priority queue of (time, owner, children, leaves, saved), least first; beyond ``room`` messages it spills sorted runs to where Spark spills."""

    def __init__(self, room: int):
        self.room, self.heap, self.runs = room, [], []

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.room:
            file = tempfile.TemporaryFile("w+", dir=next(iter(os.environ.get("SPARK_LOCAL_DIRS", "").split(",")), None) or None)
            file.writelines("%d %d %d %d %d\n" % m for m in sorted(self.heap))
            file.seek(0)
            self.heap = []
            self._next(file)

    def _next(self, file) -> None:
        lines = list(islice(file, 1000))
        if lines:
            heapq.heappush(self.runs, (tuple(map(int, lines[0].split())), id(file), lines[:0:-1], file))

    def taken(self, key: tuple) -> tuple[int, int, int]:
        """The sums of all messages for this time and owner."""
        out = (0, 0, 0)
        while self.heap and self.heap[0][:2] == key:
            out = tuple(x + y for x, y in zip(out, heapq.heappop(self.heap)[2:], strict=True))
        while self.runs and self.runs[0][0][:2] == key:
            message, name, rest, file = heapq.heappop(self.runs)
            out = tuple(x + y for x, y in zip(out, message[2:], strict=True))
            if rest:
                heapq.heappush(self.runs, (tuple(map(int, rest.pop().split())), name, rest, file))
            else:
                self._next(file)
        return out


NODES = "so long, sd long, owner long, depth long, po long, pd long, n_convs long, children long, leaves long, saved long"


def time_forward(room: int = ROOM):
    """Totals of the nodes of shards in reverse level order; the root of a shard passes nothing on inside it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, queue = None, None
        for batch in batches:
            rows = []
            for so, sd, owner, depth, po, pd_, n, *own in batch.itertuples(index=False, name=None):
                if (so, sd) != shard:
                    shard, queue = (so, sd), Messages(room)
                children, leaves, saved = (x + y for x, y in zip(own, queue.taken((-depth, owner)), strict=True))
                rows.append((so, sd, owner, depth, po, pd_, n, children, leaves, saved))
                if (owner, depth) != shard:
                    queue.push((-pd_, po, 1, leaves, saved))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in NODES.split(", ")])

    return run


def _forward(nodes: DataFrame, name: str, alone: bool = False) -> DataFrame:
    columns = [x.split()[0] for x in NODES.split(", ")]
    dealt = nodes.select(columns).coalesce(1) if alone else nodes.select(columns).repartition("so", "sd")
    return materialise(dealt.sortWithinPartitions("so", "sd", F.desc("depth"), "owner").mapInPandas(time_forward(), NODES), name)


def _sums(messages: DataFrame) -> DataFrame:
    """What nodes get from the roots of shards below: po and pd name the node."""
    return messages.groupBy("po", "pd").agg(F.count("*").alias("c"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))


def _given(nodes: DataFrame, sums: DataFrame) -> DataFrame:
    got = sums.select(F.col("po").alias("owner"), F.col("pd").alias("depth"), "c", "l", "s")
    add = lambda name, more: F.col(name) + F.coalesce(more, F.lit(0))
    return nodes.join(got, ["owner", "depth"], "left").withColumns({"children": add("children", "c"), "leaves": add("leaves", "l"), "saved": add("saved", "s")}).drop("c", "l", "s")


def _digests(ends: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256 over the members that end there, in order. What crosses the network is joined ids, a row a range and node."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, held = None, []
        names = ["owner", "depth", "at", "ids"]
        for batch in batches:
            rows = []
            for owner, depth, conv in batch.itertuples(index=False, name=None):
                if (owner, depth) != node or len(held) == 50_000:
                    if held:
                        rows.append((*node, held[0], ",".join(map(str, held)).encode()))
                    node, held = (owner, depth), []
                held.append(conv)
            if rows:
                yield pd.DataFrame(rows, columns=names)
        if held:
            yield pd.DataFrame([(*node, held[0], ",".join(map(str, held)).encode())], columns=names)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, sha = None, None
        names = ["owner", "depth", "ends_sha256"]
        for batch in batches:
            rows = []
            for owner, depth, _, ids in batch.itertuples(index=False, name=None):
                if (owner, depth) == node:
                    sha.update(b",")
                else:
                    if node:
                        rows.append((*node, sha.hexdigest()))
                    node, sha = (owner, depth), hashlib.sha256()
                sha.update(ids)
            if rows:
                yield pd.DataFrame(rows, columns=names)
        if node:
            yield pd.DataFrame([(*node, sha.hexdigest())], columns=names)

    found = ends.select("owner", "depth", "conv_id").repartitionByRange("conv_id").sortWithinPartitions("owner", "depth", "conv_id").mapInPandas(pieces, "owner long, depth long, at long, ids binary")
    return found.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "at").mapInPandas(hashed, "owner long, depth long, ends_sha256 string")


def conversation_trie(
    conversations: DataFrame, base: Column | None = None, head: Column | None = None, most_head: int = 3, share: int = HOT_SHARE, least: int = HOT_ROWS, band: int = BAND,
) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role and text. Turns of a conversation stand by turn (null first), equal ones by role
    and text; null role or text is empty; repeated rows are turns each. With ``base`` and ``head``, expressions of conv_id,
    a conversation first takes the first ``head`` turns (``most_head`` at most) of conversation ``base``, then its own after as
    many. Rows with a null conv_id belong to no conversation and are left out; an empty table gives no rows. Nodes with more
    than ``least`` members and a ``share``-th of all conversations are the top of the trie; ``band`` is the depth of a shard.
    """
    given = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    for attempt in count():
        turns, convs = _rebuilt(given, base, head, most_head, _bases(attempt))
        same = F.struct("pa", "pb", "sha")
        nodes = materialise(
            turns.groupBy("depth", "a", "b").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), F.max("length").alias("reach"), F.max("words").alias("words"), F.min(same).alias("of"), F.max(same).alias("other")),
            "nodes",
        )
        if nodes.where("of <> other").isEmpty():
            break
    total = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), F.max("length").alias("reach"))
    n, rows = total.first()["n_convs"], turns.count()
    top = total.where("n_convs > 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "n_convs", "owner", "reach", F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("pa"), F.lit(0).cast("long").alias("pb"))
    nodes = top.unionByName(nodes.select("depth", "a", "b", "n_convs", "owner", "reach", "words", "of.pa", "of.pb"))
    limit, band = max(least, n // share), max(band, rows // (10 * share))
    heavy = (F.col("n_convs") > limit) | (F.col("depth") == 0)
    facts = nodes.withColumns({"heavy": heavy, "children": F.lit(0).cast("long"), "leaves": (F.col("reach") == F.col("depth")).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})

    # the parent's name is its owner, one level up
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("owner").alias("po"), F.col("n_convs").alias("siblings"))
    below = join_to_groups(facts.where("depth > 0"), parents, ["depth", "pa", "pb"], "siblings", rows)
    named = materialise(below.drop("siblings").unionByName(facts.where("depth = 0").withColumn("po", F.lit(-1).cast("long"))).withColumn("pd", F.col("depth") - 1), "named")

    # where each conversation leaves the top of the trie, and where it ends
    paths = join_to_groups(turns.select("conv_id", "depth", "length", "a", "b"), named.where("depth > 0").select("depth", "a", "b", "owner", "n_convs", "heavy"), ["depth", "a", "b"], "n_convs", rows)
    paths = materialise(paths.select("conv_id", "depth", "length", "owner", "heavy"), "paths")
    exits = paths.where("not heavy").groupBy("conv_id").agg(F.min(F.struct("depth", "owner")).alias("exit")).select(F.col("conv_id").alias("owner"), F.col("exit.owner").alias("so"), F.col("exit.depth").alias("sd"))
    light = named.where("not heavy").join(exits, "owner")
    columns = [x.split()[0] for x in NODES.split(", ")]
    deep = (named.agg(F.max("depth")).first()[0] or 0) > band
    if deep:  # shards are cut again every ``band`` levels, at the node of the own path there
        level = F.floor((F.col("depth") - F.col("sd")) / band).cast("long")
        cuts = paths.where("not heavy").select(F.col("conv_id").alias("member"), "depth", F.col("owner").alias("cut_owner")).join(exits.withColumnRenamed("owner", "member"), "member")
        cuts = cuts.where((F.col("depth") > F.col("sd")) & ((F.col("depth") - F.col("sd")) % band == 0)).select(F.col("member").alias("owner"), level.alias("level"), "cut_owner")
        light = light.withColumns({"level": level, "ro": F.col("so"), "rd": F.col("sd")}).join(cuts, ["owner", "level"], "left")
        light = light.withColumns({"so": F.coalesce("cut_owner", "so"), "sd": F.col("rd") + F.col("level") * band})
        light = materialise(light.select(*columns, "level", "ro", "rd"), "light")
    totals = _forward(light, "totals")

    roots = totals.where("owner = so and depth = sd")
    high = named.where("heavy").withColumns({"so": F.lit(-1).cast("long"), "sd": F.lit(-1).cast("long")}).select(columns)
    if not deep:
        upper = _forward(_given(high, _sums(roots)), "upper", alone=True)
        done = totals.unionByName(upper)
    else:
        where = light.select("owner", "depth", "level", "ro", "rd", F.col("so").alias("fo"), F.col("sd").alias("fd"))
        roots = roots.join(where, ["owner", "depth"])
        cut = roots.where("level > 0").select("ro", "rd").distinct()
        chained = roots.join(cut, ["ro", "rd"], "left_semi")
        # a shard below a band hangs from the shard that holds its root's parent
        parent = where.select(F.col("owner").alias("po"), F.col("depth").alias("pd"), F.col("fo").alias("parent_fo"), F.col("fd").alias("parent_fd"))
        linked = chained.where("level > 0").join(parent, ["po", "pd"])
        shards = linked.withColumns({"po": F.col("parent_fo"), "pd": F.col("parent_fd")}).select(columns).union(chained.where("level = 0").select(columns)).withColumns({"so": F.lit(-1).cast("long"), "sd": F.lit(-1).cast("long")})
        single = roots.join(cut, ["ro", "rd"], "left_anti")
        upper = _forward(_given(high, _sums(single)).select(columns).unionByName(shards.select(columns)), "upper", alone=True)
        whole = linked.select("owner", "depth", "po", "pd").join(upper.select("owner", "depth", "leaves", "saved"), ["owner", "depth"])
        again = _given(light.join(cut, ["ro", "rd"], "left_semi"), _sums(whole))
        done = totals.join(light.join(cut, ["ro", "rd"], "left_semi").select("owner", "depth"), ["owner", "depth"], "left_anti").unionByName(_forward(again, "again"))
        done = done.unionByName(upper.join(high.select("owner", "depth"), ["owner", "depth"], "left_semi"))

    ends = paths.where("depth = length").select("owner", "depth", "conv_id").union(convs.where("length = 0").join(F.broadcast(total.select("owner")), how="cross").select("owner", F.lit(0).cast("long").alias("depth"), "conv_id"))  # total is one row
    return done.join(_digests(ends), ["owner", "depth"], "left").select(
        F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("po")).alias("parent_conv_id"), "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"),
    )
