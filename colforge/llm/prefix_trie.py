"""Trie over the prefixes of rebuilt conversations, by composable fingerprints.

Every conversation c takes the first h turns of its base (c - c % FAMILY) instead of its own first h, h = crc32 of c's
decimal text modulo HEADS. Nothing rebuilt is ever written out. A run of turns is the pair (length, sum of
term * B^place modulo 2^31 - 1), and two runs compose as (l, s)(m, t) = (l + m, s + t * B^l): the fingerprint of every
rebuilt prefix is a product of a stored prefix of the base and a stored stretch of the own turns. Three such lanes make
93 bits. All sums are prefix sums inside a conversation, taken per stretch of STRETCH places and then over stretches, so
that one conversation with a third of all rows is many tasks.

Fingerprints find the groups, references prove them: a row names its last turn by a hash pair, every hash pair is checked
to stand for one (role, text) in the whole table, and all rows of a group must name the same turn and the same parent. By
induction over the depth the group then has one sequence of turns. If any check fails, all fingerprints are drawn anew.

Sums over subtrees need no walk over levels. Each node belongs to its smallest member; a conversation's own nodes are the
lower end of its path. The sum over a subtree is the sum over the members of what each owns, less what the node's owner
owns above the node: one running sum per owner and one sum per node.

Order: by turn, nulls first; ties by role, then by a hash of the text (rows equal in all are interchangeable). Null roles
and texts are empty. Rows without conv_id belong to no conversation and take no part. A conversation with no turn left
(its own are fewer than h, its base is absent) is a member of the root and ends there. Repeated rows are turns of their
own. An empty table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colforge.llm.common import materialize, prepare
from colforge.plans.ordered import OrderedScan, RowIndex

FAMILY = 20
HEADS = 4
STRETCH = 1 << 16
HEAVY_SHARE = 1000
CHUNK_IDS = 50_000
PRIME = (1 << 31) - 1
LANES = 3
WORDS = "[^\\x20\\x09-\\x0D]+"
KEY = ("depth", "k1", "k2")


class Fingerprints:
    """Bases of the lanes and the arithmetic with them, as columns."""

    def __init__(self, seed: int):
        self.bases = [int(b) for b in np.random.default_rng([17, seed]).integers(1 << 20, PRIME - 1, LANES)]

    def power(self, lane: int, place: Column) -> Column:
        """B^place, from one table per six bits of the place (up to 2^36)."""
        out = F.lit(1).cast("long")
        for digit in range(6):
            row = F.array(*[F.lit(pow(self.bases[lane], v << 6 * digit, PRIME)).cast("long") for v in range(64)])
            out = out * F.get(row, F.shiftright(place, 6 * digit).bitwiseAND(F.lit(63)).cast("int")) % PRIME
        return out

    def back(self, lane: int, steps: Column) -> Column:
        """B^-steps for less than HEADS steps."""
        row = [F.lit(pow(self.bases[lane], -s, PRIME)).cast("long") for s in range(HEADS)]
        return F.get(F.array(*row), steps.cast("int"))


def _key(parts: list[Column], names: tuple[str, str]) -> list[Column]:
    return [(parts[0] * F.lit(1 << 31) + parts[1]).alias(names[0]), parts[2].alias(names[1])]


def running(df: DataFrame, owner: str, place: str, sums: dict[str, Column], falling: bool = False) -> DataFrame:
    """`df` with running sums over `place` per `owner` (from the last place on if `falling`).

    Stretches of STRETCH places are summed each for itself, what lies before a stretch comes from a row per stretch.
    """
    key = F.col(place)
    cut = df.withColumn("__stretch", F.floor(key / STRETCH)).withColumns({f"__{n}": c for n, c in sums.items()})
    order = F.desc if falling else F.asc
    inside = Window.partitionBy(owner, "__stretch").orderBy(order(place)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(owner).orderBy(order("__stretch")).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(owner, "__stretch").agg(*[F.sum(f"__{n}").alias(f"__t_{n}") for n in sums])
    totals = totals.select(owner, "__stretch", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums])
    rows = cut.withColumns({n: F.sum(f"__{n}").over(inside) for n in sums}).join(totals, [owner, "__stretch"])
    return rows.select(*df.columns, *[(F.col(n) + F.col(f"__b_{n}")).alias(n) for n in sums])


def spread(df: DataFrame, places: Column) -> DataFrame:
    """Each row once per stretch of its conversation, to be joined with rows of that stretch only."""
    return df.withColumn("__stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(places / STRETCH))))


def _turns(conversations: DataFrame, prints: Fingerprints, seed: int) -> DataFrame | None:
    """conv_id, i (from 1), words, the turn's name (a, b), and per lane its share z and the prefix sum s."""
    said = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    name = [F.xxhash64(F.lit(2 * seed + k), "role", "text").alias(n) for k, n in enumerate("ab")]
    content = F.struct("role", "text")
    shared = said.select(*name, content.alias("c")).groupBy("a", "b").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    if not shared.where("low <> high").isEmpty():
        return None
    narrow = said.select("conv_id", "turn", "role", *name, F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"))
    placed = OrderedScan(narrow, ["turn", "role", "a", "b"], ["conv_id"]).add({"i": RowIndex()})
    placed = placed.select("conv_id", (F.col("i") + 1).alias("i"), "words", "a", "b")
    shares = {f"z{k}": F.pmod(F.xxhash64(F.lit(k), "a", "b"), F.lit(PRIME)) * prints.power(k, F.col("i")) % PRIME for k in range(LANES)}
    placed = materialize(placed.withColumns(shares))
    summed = running(placed, "conv_id", "i", {f"s{k}": F.col(f"z{k}") for k in range(LANES)})
    return materialize(summed.withColumns({f"s{k}": F.col(f"s{k}") % PRIME for k in range(LANES)}))


def _frames(turns: DataFrame) -> DataFrame:
    """Per conversation: h, hb (turns it gets from its base), heads (these turns), own (prefix sums after h own turns), own and rebuilt length."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("long")
    numbered = turns.withColumn("h", h)
    own = F.struct(*[F.max(F.when(F.col("i") == F.col("h"), F.col(f"s{k}"))).alias(f"s{k}") for k in range(LANES)])
    convs = numbered.groupBy("conv_id", "h").agg(F.max("i").alias("n"), own.alias("own"))
    turn = F.struct("i", "words", "a", "b", *[f"{x}{k}" for x in "zs" for k in range(LANES)])
    # At most HEADS - 1 turns per base.
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("i") < HEADS)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(turn)).alias("heads"))
    joined = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "base", "left")
    joined = joined.withColumn("heads", F.slice(F.coalesce("heads", F.array().cast(joined.schema["heads"].dataType)), F.lit(1), F.col("h").cast("int")))
    joined = joined.withColumn("hb", F.size("heads").cast("long"))
    return joined.select("conv_id", "h", "hb", "heads", "own", "n", (F.col("hb") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def _members(turns: DataFrame, frames: DataFrame, prints: Fingerprints) -> DataFrame:
    """One row per conversation and rebuilt turn: the prefix up to it (k1, k2), the one before (p1, p2), its turn (a, b)."""
    last = F.col("depth") == F.col("length")
    lanes = range(LANES)
    first = frames.select("conv_id", "length", F.explode("heads").alias("t")).select(
        "conv_id", F.col("t.i").alias("depth"), "length", *_key([F.col(f"t.s{k}") for k in lanes], ("k1", "k2")),
        *_key([F.pmod(F.col(f"t.s{k}") - F.col(f"t.z{k}"), F.lit(PRIME)) for k in lanes], ("p1", "p2")), "t.a", "t.b", "t.words",
    )
    head = F.try_element_at(F.col("heads"), F.col("hb").cast("int"))
    frame = spread(frames.where("n > h"), F.col("n")).select(
        "conv_id", "__stretch", "h", "hb", "length",
        *[F.when(F.col("hb") > 0, head[f"s{k}"]).otherwise(F.lit(0)).alias(f"head{k}") for k in lanes],
        *[F.coalesce(F.col(f"own.s{k}"), F.lit(0)).alias(f"own{k}") for k in lanes],
    )
    rest = turns.withColumn("__stretch", F.floor(F.col("i") / STRETCH)).join(frame, ["conv_id", "__stretch"]).where("i > h")
    shift = [prints.back(k, F.col("h") - F.col("hb")) for k in lanes]
    here = [(F.col(f"head{k}") + F.pmod(F.col(f"s{k}") - F.col(f"own{k}"), F.lit(PRIME)) * shift[k] % PRIME) % PRIME for k in lanes]
    rest = rest.withColumns({f"f{k}": here[k] for k in lanes} | {f"g{k}": F.col(f"z{k}") * shift[k] % PRIME for k in lanes})
    rest = rest.select(
        "conv_id", (F.col("hb") + F.col("i") - F.col("h")).alias("depth"), "length", *_key([F.col(f"f{k}") for k in lanes], ("k1", "k2")),
        *_key([F.pmod(F.col(f"f{k}") - F.col(f"g{k}"), F.lit(PRIME)) for k in lanes], ("p1", "p2")), "a", "b", "words",
    )
    return materialize(first.unionByName(rest).withColumn("last", last).drop("length"))


def _hash_ends(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids per node, comma-joined.

    A digest is sequential, but its input need not come row by row: ranges of (node, id) become texts of many ids in
    parallel, and the task that digests a node reads these, one batch at a time.
    """

    def texts(batches):
        out, now, ids = [], None, []

        def flush():
            if ids:
                out.append((*now, ids[0], ",".join(map(str, ids))))
                ids.clear()

        for batch in batches:
            for *node, conv in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if node != now or len(ids) >= CHUNK_IDS:
                    flush()
                    now = node
                ids.append(conv)
            yield _batch(out, [*KEY, "first", "ids"], [pa.int64()] * 4 + [pa.string()])
            out.clear()
        flush()
        yield _batch(out, [*KEY, "first", "ids"], [pa.int64()] * 4 + [pa.string()])

    def digests(batches):
        now, digest, out = None, None, []
        for batch in batches:
            for *node, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
                if node != now:
                    if now:
                        out.append((*now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _batch(out, [*KEY, "ends_sha256"], [pa.int64()] * 3 + [pa.string()])
            out.clear()
        if now:
            yield _batch([(*now, digest.hexdigest())], [*KEY, "ends_sha256"], [pa.int64()] * 3 + [pa.string()])

    ranged = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    parts = ranged.mapInArrow(texts, "depth long, k1 long, k2 long, first long, ids string")
    return parts.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, "depth long, k1 long, k2 long, ends_sha256 string")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def _parents(nodes: DataFrame, total: int) -> DataFrame:
    """Nodes below depth 1 with parent_conv_id. Parents of more than 1 / HEAVY_SHARE of all nodes, at most HEAVY_SHARE
    of them, are broadcast, so that their children stay where they are; the rest meet by shuffle."""
    parent = [F.col("depth").alias("__depth"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("conv_id").alias("parent_conv_id")]
    heavy = F.col("n_children") * HEAVY_SHARE > total
    on = [F.col("depth") - 1 == F.col("__depth"), F.col("p1") == F.col("__k1"), F.col("p2") == F.col("__k2")]
    below = nodes.where("depth > 1")
    many = F.broadcast(nodes.where(heavy).select(*parent))
    few = nodes.where(~heavy & (F.col("n_children") > 0)).select(*parent)
    first = below.join(many, on).drop("__depth", "__k1", "__k2")
    rest = below.join(many, on, "left_anti").join(few, on).drop("__depth", "__k1", "__k2")
    return first.unionByName(rest)


def trie(conversations: DataFrame) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    prepare(conversations.sparkSession)
    for seed in range(64):
        prints = Fingerprints(seed)
        turns = _turns(conversations, prints, seed)
        if turns is None:
            continue
        frames = materialize(_frames(turns))
        members = _members(turns, frames, prints)
        same = [F.min(c) != F.max(c) for c in ("a", "b", "p1", "p2")]
        nodes = members.groupBy(*KEY).agg(
            F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
            (same[0] | same[1] | same[2] | same[3]).alias("mixed"),
        )
        nodes = materialize(nodes)
        if nodes.where("mixed").isEmpty():
            break
    else:
        raise RuntimeError("fingerprints keep colliding")

    children = nodes.where("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, list(KEY), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).drop("mixed", "words")
    nodes = materialize(running(nodes, "conv_id", "depth", {"below": F.col("saved")}, falling=True))
    leaf = (F.col("n_children") == 0).cast("long")
    owned = nodes.groupBy("conv_id").agg(F.sum("saved").alias("owned"), F.sum(leaf).alias("leaves"), F.max("depth").alias("end"))
    # An owner's path ends at its deepest node, so `end` is the length of its rebuilt conversation.
    share = spread(owned, F.col("end")).drop("end")
    cut = members.withColumn("__stretch", F.floor(F.col("depth") / STRETCH)).join(share, ["conv_id", "__stretch"])
    sums = cut.groupBy(*KEY).agg(F.sum("owned").alias("all_owned"), F.sum("leaves").alias("n_leaves"))
    ends = members.where("last").select(*KEY, "conv_id").unionByName(frames.where("length = 0").select(*[F.lit(0).cast("long").alias(c) for c in KEY], "conv_id"))
    digests = materialize(_hash_ends(ends))

    whole = frames.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).first()
    every = nodes.agg(F.count("*").alias("n"), F.count_if(F.expr("depth = 1")).alias("top"), F.sum("saved").alias("saved"), F.count_if(F.expr("n_children = 0")).alias("leaves")).first()
    empty = hashlib.sha256(b"").hexdigest()
    long = lambda value: F.lit(value).cast("long")
    top = nodes.where("depth = 1").withColumn("parent_conv_id", long(whole["conv_id"]))
    linked = top.unionByName(_parents(nodes, every["n"]))
    linked = linked.withColumn("__stretch", F.floor(F.col("depth") / STRETCH)).join(share.drop("leaves"), ["conv_id", "__stretch"]).join(sums, list(KEY))
    linked = linked.withColumn("saved_tokens", F.col("all_owned") - F.col("owned") + F.col("below"))
    root = frames.limit(1).select(
        *[long(0).alias(c) for c in KEY], long(whole["conv_id"]).alias("conv_id"), long(None).alias("parent_conv_id"), long(whole["n_convs"]).alias("n_convs"),
        long(every["top"]).alias("n_children"), long(every["leaves"] or 1).alias("n_leaves"), long(every["saved"] or 0).alias("saved_tokens"),
    )
    out = linked.select(root.columns).unionByName(root).join(digests, list(KEY), "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")
    )
