"""Quotation linking: who answers whom in conversations, from the passages that messages quote.

A line that begins with one or more `>` is quoted, as deep as it has marks (spaces between them do not count). Lines of
one depth in a row are a passage; lines of nothing but marks and white space do not count. Lines are normalised (marks
cut off, white space reduced, A-Z lower-cased) and hashed. A message says a passage when

- the passage's lines stand one after another among the message's own lines (quoted and blank lines between them do not
  count), wherever they begin, or
- the passage's words are those of its whole unquoted text, of one of its paragraphs, of a stretch between two quotes
  or of one line, so that a quote with other line breaks is found too.

A quoted passage belongs to the first message of its conversation that says it, if that is an earlier turn; else to the
first message of another conversation. A message answers the original of its shallowest linked passage, of several the
latest. By default other conversations count only when their id is smaller (ids in the order of time); with
`any_conversation` every one counts, and where answers would form a circle its smallest message answers nothing.

Each message gets its text without quotes, the message it answers, the root of its thread and its depth there (by
pointer doubling, a few narrow columns per round), and its position in the conversation by (thread root, depth, turn):
answers come after what they answer. Without quotes that is the order of turns.

Null or empty texts quote nothing and are no originals. Messages with a null conv_id or turn cannot be linked and keep
their text; repeated (conv_id, turn) are messages each for itself that share links. Positions come from a distributed
scan over all rows, so that one conversation may hold a third of them. Other columns are not read.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colforge.llm.common import by_batch, materialize
from colforge.operators.computed import row_id

LINE_BREAK = re.compile(r"\r\n|\r|\n")
MARKS = re.compile(r"^[ \t]*>[> \t]*")
BLANK = re.compile(r"[\x00-\x20]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DIGEST = 16  # bytes of a line's hash


def _normal(text: str) -> str:
    return BLANK.sub(" ", text).strip(" ").translate(LOWER)


def _digest(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=DIGEST).digest()


def _parse_text(text: str) -> tuple[str, list[bytes], bytes, list[tuple[int, bytes, bytes]]]:
    """Body, digests of what the message says as a unit, digests of its own lines, and passages (depth, said, lines)."""
    own, own_lines, units, passages = [], [], set(), []
    stretch: list[str] = []  # own lines since the last quote
    paragraph: list[str] = []  # own lines since the last blank one
    quoted: list[str] = []
    depth = 0

    def close(lines):
        if lines:
            units.add(" ".join(lines))
            lines.clear()

    def end_passage():
        if quoted:
            passages.append((depth, _digest(" ".join(quoted)), b"".join(map(_digest, quoted))))
            quoted.clear()

    for line in LINE_BREAK.split(text):
        marks = MARKS.match(line)
        now = marks.group().count(">") if marks else 0
        if now != depth:
            end_passage()
        depth = now
        said = _normal(line[marks.end() :] if marks else line)
        if now:
            close(stretch)
            if said:
                quoted.append(said)
            continue
        own.append(line)
        if not said:
            close(paragraph)
            continue
        own_lines.append(said)
        stretch.append(said)
        paragraph.append(said)
    end_passage()
    units.update([" ".join(own_lines), *own_lines])
    close(stretch)
    close(paragraph)
    units.discard("")
    return "\n".join(own).strip(" "), sorted(map(_digest, units)), b"".join(map(_digest, own_lines)), passages


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body (the text without quoted lines), units, own and passages (see `_parse_text`)."""

    def run(batch: pa.RecordBatch):
        parsed = [(None, [], b"", []) if t is None else _parse_text(t) for t in batch.column("text").to_pylist()]
        body, units, own, passages = zip(*parsed)
        passages = [[{"depth": d, "said": k, "lines": x} for d, k, x in found] for found in passages]
        passage = pa.struct([("depth", pa.int32()), ("said", pa.binary()), ("lines", pa.binary())])
        found = [pa.array(body, pa.string()), pa.array(units, pa.list_(pa.binary())), pa.array(own, pa.binary()), pa.array(passages, pa.list_(passage))]
        names = ["conv_id", "turn", "role"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *found], names=[*names, "body", "units", "own", "passages"])

    rows = messages.select("conv_id", "turn", "role", "text")
    role = rows.schema["role"].dataType.simpleString()
    kinds = f"conv_id long, turn long, role {role}, body string, units array<binary>, own binary, passages array<struct<depth:int,said:binary,lines:binary>>"
    return rows.mapInArrow(by_batch(run), kinds)


def _line(lines, at):
    return F.substring(lines, at * DIGEST + 1, F.lit(DIGEST))


def _runs_of_lines(named: DataFrame, passages: DataFrame) -> DataFrame:
    """(k, conv_id, turn): runs of own lines that are as long as some quoted passage and begin like it.

    A line meets one row per quoted first line, which lists the lengths of the passages that begin so; messages with
    such lines then hash the runs in place. Nothing grows with passages x messages.
    """
    n = (F.length("lines") / DIGEST).cast("int")
    begin = passages.select(_line(F.col("lines"), F.lit(0)).alias("line"), n.alias("n")).where("n > 1").groupBy("line").agg(F.collect_set("n").alias("sizes"))
    texts = named.where(F.length("own") > DIGEST).select("conv_id", "turn", "own", F.sha1("own").alias("x")).dropDuplicates(["conv_id", "turn", "x"])
    size = (F.length("own") / DIGEST).cast("int")
    lines = F.transform(F.sequence(F.lit(0), size - 2), lambda at: F.struct(at.alias("at"), (size - at).alias("rest"), _line(F.col("own"), at).alias("line")))
    lines = texts.select("conv_id", "turn", "x", F.explode(lines).alias("l")).select("conv_id", "turn", "x", "l.at", "l.rest", "l.line")
    starts = lines.join(begin, "line").withColumn("sizes", F.filter("sizes", lambda s: s <= F.col("rest"))).where(F.size("sizes") > 0)
    starts = starts.groupBy("conv_id", "turn", "x").agg(F.collect_list(F.struct("at", "sizes")).alias("starts"))
    whole = texts.join(starts, ["conv_id", "turn", "x"]).select("conv_id", "turn", "own", F.explode("starts").alias("s"))
    whole = whole.select("conv_id", "turn", "own", F.col("s.at").alias("at"), F.explode("s.sizes").alias("n"))
    run = F.substring(F.col("own"), F.col("at") * DIGEST + 1, F.col("n") * DIGEST)
    return whole.select(F.unhex(F.sha1(run)).alias("k"), "conv_id", "turn")


def link(messages: DataFrame, any_conversation: bool = False) -> DataFrame:
    """(conv_id, turn, to_conv, to_turn): each message with the one that it answers; messages that quote nothing are absent."""
    named = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "units", "own", "passages")
    quotes = named.where(F.size("passages") > 0).select("conv_id", "turn", F.explode("passages").alias("p"))
    passages = materialize(quotes.select("conv_id", "turn", "p.depth", "p.said", "p.lines").distinct())
    # A passage has two keys: its words, and its lines where it has several.
    keys = F.array_compact(F.array("said", F.when(F.length("lines") > DIGEST, F.unhex(F.sha1("lines")))))
    quotes = passages.select("conv_id", "turn", "depth", "said", F.explode(keys).alias("k")).distinct()
    wanted = quotes.select("k").distinct()
    originals = named.select(F.explode("units").alias("k"), "conv_id", "turn").unionByName(_runs_of_lines(named, passages))
    # Only what somebody quotes goes on; the first message that says it is a minimum, whatever the number of messages.
    originals = materialize(originals.join(wanted, "k", "left_semi").groupBy("k", "conv_id").agg(F.min("turn").alias("t")))
    # The first conversations that say it: one row per key, the second one for quotes in the first.
    first = originals.groupBy("k").agg(F.min(F.struct("conv_id", "t")).alias("first"))
    second = originals.join(first, "k").where(F.col("conv_id") > F.col("first.conv_id")).groupBy("k").agg(F.min(F.struct("conv_id", "t")).alias("second"))
    elsewhere = first.join(second, "k", "left")
    found = quotes.join(originals, ["k", "conv_id"], "left").join(elsewhere, "k", "left")
    other = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    if not any_conversation:
        other = F.when(other["conv_id"] < F.col("conv_id"), other)
    near = F.min(F.when(F.col("t") < F.col("turn"), F.struct("conv_id", "t")))
    best = found.groupBy("conv_id", "turn", "depth", "said").agg(F.coalesce(near, F.min(other)).alias("to")).where("to IS NOT NULL")
    best = best.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("depth")).alias("d"), "to.conv_id", "to.t")).alias("b"))
    links = best.select("conv_id", "turn", F.col("b.conv_id").alias("to_conv"), F.col("b.t").alias("to_turn"))
    return _without_circles(materialize(links)) if any_conversation else links


def _without_circles(links: DataFrame) -> DataFrame:
    """Drops the link of the smallest message of every circle.

    Every message has at most one link. After k rounds `at` is where 2^k steps lead and `least` the smallest message on
    the way; messages whose way ends are gone. Once the places reached are as many as before, all of them lie on circles,
    and once no `least` has moved the ways go all around.
    """
    if links.where("to_conv > conv_id").isEmpty():
        return links  # every link leads to a smaller message
    here, there = F.struct("conv_id", "turn"), F.struct(F.col("to_conv").alias("conv_id"), F.col("to_turn").alias("turn"))
    now, mark = links.select(here.alias("v"), there.alias("at"), here.alias("least")), None
    while True:
        up = now.select(F.col("v").alias("at"), F.col("at").alias("next"), F.col("least").alias("other"))
        now = materialize(now.join(up, "at").select("v", F.col("next").alias("at"), F.least("least", "other").alias("least")))
        reached = now.select("at").distinct()
        before, mark = mark, (reached.count(), *now.agg(F.count("*"), F.expr("bit_xor(xxhash64(v, least))")).first())
        if mark == before:
            break
    cut = now.where("v = least").join(reached.withColumnRenamed("at", "v"), "v", "left_semi").select("v.conv_id", "v.turn")
    return materialize(links.join(cut, ["conv_id", "turn"], "left_anti"))


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, root_conv, root_turn, depth) of every message that answers another."""
    now = materialize(links.select("conv_id", "turn", F.col("to_conv").alias("root_conv"), F.col("to_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = now.select(F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"), F.col("root_conv").alias("c"), F.col("root_turn").alias("t"), F.col("depth").alias("more"))
        joined = now.join(up, ["root_conv", "root_turn"], "left")
        ended = joined.where("c IS NOT NULL").isEmpty()
        if ended:
            return now
        now = materialize(joined.select("conv_id", "turn", F.coalesce("c", "root_conv").alias("root_conv"), F.coalesce("t", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))


def conversations(messages: DataFrame, any_conversation: bool = False) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quotes, to_conv, to_turn, root_conv, root_turn, depth, position."""
    parsed = materialize(parse(messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("string").alias("text"))))
    links = materialize(link(parsed, any_conversation))
    rows = parsed.select("conv_id", "turn", "role", F.col("body").alias("text"), F.size("passages").alias("n_quotes"))
    rows = rows.join(links, ["conv_id", "turn"], "left").join(threads(links), ["conv_id", "turn"], "left")
    rows = rows.withColumns({"root_conv": F.coalesce("root_conv", "conv_id"), "root_turn": F.coalesce("root_turn", "turn"), "depth": F.coalesce("depth", F.lit(0).cast("long"))})
    return _positions(rows)


def _positions(rows: DataFrame) -> DataFrame:
    """Position from 0 within a conversation by (thread root, depth, turn): one number over all rows in that order, less the conversation's first."""
    keyed = materialize(rows.withColumn("__tie", F.md5(F.concat_ws("|", "role", "text").cast("binary"))))
    numbered = row_id(keyed, "__k", order_by=["conv_id", "root_conv", "root_turn", "depth", "turn", "__tie"])
    numbered = materialize(numbered.drop("__tie"))
    first = numbered.groupBy(F.col("conv_id").alias("__c")).agg(F.min("__k").alias("__first"))
    placed = numbered.join(first, F.col("conv_id").eqNullSafe(F.col("__c")))
    return placed.withColumn("position", (F.col("__k") - F.col("__first")).cast("long")).drop("__k", "__c", "__first")
