"""Transcript parsing: a hidden Markov model recovers who speaks, then turns are rendered alike.

A line of a transcript is in a state: it begins a turn of a role, continues one, or is a blank line of one. What shows is the line's speaker
marker (if any), its length and its last mark. Start, transition and emission probabilities are counted from conversations with known
roles, all of them, by Spark. The most probable states follow by Viterbi's algorithm, and a turn is rendered as its role, its text without the marker, and an end.

A conversation is cut into pieces of a bounded number of turns or lines. A piece is reduced to a matrix of best scores from the state before it to
the state after it; such matrices are reduced again, so a conversation that holds a third of all lines is a tree of small tasks. Boundary states are
then chosen from the top down, and each piece is decoded between its two. The result is that of one pass over the whole conversation.

Defined results: rows without a conversation id are one conversation; a null turn comes first; negative turns are one piece with the first ones; rows of one turn follow in the order of their
text; a null or empty text is a turn of one blank line, which is rendered empty where the model finds a turn there; ties go to the state listed first; an empty table
gives no turns; without any labelled row all turns are equally likely; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.session import settle

ROLES = ("system", "user", "assistant")
KINDS = ("begin", "more", "blank")
STATES = [f"{kind}:{role}" for kind in KINDS for role in ROLES]
BEGIN = np.array([s.startswith("begin") for s in STATES])
#: Speakers' names by the role they usually stand for.
MARKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "q", "customer"),
    "assistant": ("assistant", "ai", "a", "bot"),
}
MARKER = r"^[\s#>*\[<|]*([A-Za-z]{1,14})[\]>|*]*\s*:[ \t]*"
PIECE_TURNS, PIECE_LINES, FAN = 64, 256, 256


def observation(line: Column) -> Column:
    """What a line shows, as one of about a hundred values."""
    name = F.lower(F.regexp_extract(line, MARKER, 1))
    kind = F.when(name == "", "none")
    for role, names in MARKERS.items():
        kind = kind.when(name.isin(*names), role)
    n = F.length(F.trim(line))
    size = F.when(n < 30, "short").when(n < 90, "line").when(n < 250, "long").otherwise("huge")
    last = F.substring(F.trim(line), -1, 1)
    mark = F.when(last.isin("?", ":", "."), last).otherwise("-")
    return F.when(n == 0, "blank").otherwise(F.concat_ws("|", kind.otherwise("other"), size, mark))


def conversation_lines(conversations: DataFrame, style: Column | None = None) -> DataFrame:
    """Lines of conversations (conv_id, turn, role, text) as a transcript would hold them.

    Each conversation has one of five styles: three ways to name speakers, names on most turns only, or no names and a blank line after a turn.
    """
    c = conversations.select(
        F.col("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("t"),
        F.lower("role").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    style = style if style is not None else F.pmod(F.xxhash64("conv_id"), F.lit(5))
    by_style = []
    for k, (s, u, a) in enumerate((("System", "User", "Assistant"), ("Instructions", "Human", "AI"), ("### Context", "Q", "A"), ("[System]", "[User]", "[Assistant]"))):
        named = F.when(F.col("role") == "system", s).when(F.col("role") == "user", u).when(F.col("role") == "assistant", a)
        by_style.append((k, F.concat(F.coalesce(named, F.lit("Speaker")), F.lit(": "))))
    marker = F.lit("")
    for k, named in reversed(by_style):
        skipped = (F.pmod(F.xxhash64("conv_id", "t"), F.lit(4)) == 0) if k == 3 else F.lit(False)
        marker = F.when((style == k) & ~skipped, named).otherwise(marker)
    written = F.concat(marker, F.col("text"), F.when(style == 4, "\n").otherwise(""))
    return c.select("conv_id", "t", "role", F.floor(F.greatest("t", F.lit(0)) / PIECE_TURNS).cast("long").alias("piece"), F.split(written, "\n").alias("lines"))


def transcript_lines(transcripts: DataFrame) -> DataFrame:
    """Lines of transcripts (conv_id, text), in pieces."""
    lines = transcripts.select("conv_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("t", "line"))
    return lines.select("conv_id", F.col("t").cast("long").alias("t"), F.floor(F.col("t") / PIECE_LINES).cast("long").alias("piece"), F.array("line").alias("lines"))


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    show: dict[str, np.ndarray] = field(default_factory=dict)
    unseen: np.ndarray = field(default_factory=lambda: np.zeros(len(STATES)))

    def steps(self, observations: list[str]) -> np.ndarray:
        """A matrix per line: from the state before (the last row: none, the transcript starts) to the state of the line."""
        show = np.array([self.show.get(o, self.unseen) for o in observations])
        return np.vstack([self.move, self.start])[None, :, :] + show[:, None, :]


def fit(labelled: DataFrame) -> Model:
    """Count from ``conversation_lines`` of conversations whose roles are known."""
    known = labelled.where(F.col("role").isin(*ROLES))
    kind = F.transform("lines", lambda line, i: F.when(i == 0, "begin").when(F.trim(line) == "", "blank").otherwise("more"))
    turns = known.select("conv_id", "t", F.transform(kind, lambda k: F.concat(k, F.lit(":"), F.col("role"))).alias("states"), F.transform("lines", observation).alias("seen"))
    turns = settle(turns, "labelled-turns")
    shown = turns.select(F.explode(F.arrays_zip("states", "seen")).alias("x")).groupBy("x.states", "x.seen").count().collect()
    n = F.size("states")
    pairs = turns.where(n > 1).select(F.explode(F.arrays_zip(F.slice("states", 1, n - 1).alias("a"), F.slice("states", 2, n - 1).alias("b"))).alias("x"))
    inside = pairs.groupBy("x.a", "x.b").count().collect()
    here = turns.select("conv_id", "t", F.element_at("states", -1).alias("a"), F.element_at("states", 1).alias("first"))
    after = here.select("conv_id", (F.col("t") - 1).alias("t"), F.col("first").alias("b"))
    between = here.join(after, ["conv_id", "t"]).groupBy("a", "b").count().collect()
    opening = turns.join(turns.groupBy("conv_id").agg(F.min("t").alias("t")), ["conv_id", "t"]).groupBy(F.element_at("states", 1).alias("s")).count().collect()
    place = {s: k for k, s in enumerate(STATES)}
    start, move = np.where(BEGIN, 0.1, 0.0), np.full((len(STATES), len(STATES)), 0.1)
    for row in opening:
        start[place[row["s"]]] += row["count"]
    for k, s in enumerate(STATES):  # a turn goes on with its own role
        move[k] = [0.1 if BEGIN[j] or t.split(":")[1] == s.split(":")[1] else 0.0 for j, t in enumerate(STATES)]
    for row in [*inside, *between]:
        move[place[row["a"]], place[row["b"]]] += row["count"]
    seen = sorted({row["seen"] for row in shown})
    counts = np.full((len(STATES), len(seen) + 1), 0.05)
    for row in shown:
        counts[place[row["states"]], seen.index(row["seen"])] += row["count"]
    show = np.log(counts / counts.sum(axis=1, keepdims=True))
    with np.errstate(divide="ignore"):
        return Model(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), {o: show[:, k] for k, o in enumerate(seen)}, show[:, -1])


def joined(steps: np.ndarray) -> np.ndarray:
    """Best scores through all steps; the last row is the start."""
    total = steps[0]
    for step in steps[1:]:
        total = (total[:, :, None] + step[None, :-1, :]).max(axis=1)
    return total


def path(steps: np.ndarray, before: int, last: int | None) -> list[int]:
    """Best states of all steps from the state before them (-1: the start) to the given last one (None: the best)."""
    score = steps[0][before]
    back = []
    for step in steps[1:]:
        options = score[:, None] + step[:-1]
        back.append(options.argmax(axis=0))
        score = options.max(axis=0)
    state = int(score.argmax()) if last is None else last
    out = [state]
    for pointers in reversed(back):
        state = int(pointers[state])
        out.append(state)
    return out[::-1]


def recover(lines: DataFrame, model: Model) -> DataFrame:
    """conv_id, turn (from 0), role, n_lines, text and rendered: one row per recovered turn."""
    shipped = lines.sparkSession.sparkContext.broadcast(model)  # a few states by about a hundred observations
    kind = lines.schema["conv_id"].dataType.simpleString()
    lines = lines.withColumn("c", F.coalesce(F.concat(F.lit("i"), F.col("conv_id").cast("string")), F.lit("n")))
    entry = F.struct("t", "lines", F.transform("lines", observation).alias("seen"))
    pieces = lines.groupBy("c", "piece").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(entry)).alias("turns"))
    width = len(STATES)

    def reduce_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [joined(shipped.value.steps([o for t in turns for o in t["seen"]])).ravel() for turns in batch.column("turns").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(m, pa.list_(pa.float64()))], names=["c", "piece", "conv_id", "turns", "m"])

    leaf_fields = f"c string, piece long, conv_id {kind}, turns array<struct<t:bigint,lines:array<string>,seen:array<string>>>, m array<double>"
    leaves = settle(pieces.select("c", "piece", "conv_id", "turns").mapInArrow(reduce_lines, leaf_fields), "pieces")
    levels = [leaves.select("c", "piece", "m")]

    def stacked(rows: list[dict]) -> np.ndarray:
        return np.array([r["m"] for r in rows]).reshape(-1, width + 1, width)

    def reduce_nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [joined(stacked(rows)).ravel() for rows in batch.column("below").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("up"), pa.array(m, pa.list_(pa.float64()))], names=["c", "piece", "m"])

    def above(level: DataFrame) -> DataFrame:
        up = level.withColumn("up", F.floor(F.col("piece") / FAN).cast("long"))
        return up.groupBy("c", "up").agg(F.sort_array(F.collect_list(F.struct("piece", "m"))).alias("below"))

    while not levels[-1].groupBy("c").agg((F.max("piece") - F.min("piece")).alias("n")).where("n > 0").isEmpty():
        levels.append(settle(above(levels[-1]).mapInArrow(reduce_nodes, "c string, piece long, m array<double>"), "level"))

    whole = lambda level: level.select("c", "piece", F.lit(-1).alias("before"), F.lit(-1).alias("last"))
    bounds = whole(levels[-1])

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, below, before, last in zip(*(batch.column(k).to_pylist() for k in ("c", "below", "before", "last")), strict=True):
                states = path(stacked(below), before, None if last < 0 else last)
                out += [(c, r["piece"], b, s) for r, b, s in zip(below, [before, *states[:-1]], states, strict=True)]
            columns = list(zip(*out, strict=True))
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=["c", "piece", "before", "last"])

    for level in reversed(levels[:-1]):
        nodes = above(level).join(bounds.withColumnRenamed("piece", "up"), ["c", "up"])
        bounds = settle(nodes.mapInArrow(choose, "c string, piece long, before int, last int"), "bounds")

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, piece, conv, turns, before, last in zip(*(batch.column(k).to_pylist() for k in ("c", "piece", "conv_id", "turns", "before", "last")), strict=True):
                held = [line for t in turns for line in t["lines"]]
                states = path(shipped.value.steps([o for t in turns for o in t["seen"]]), before, None if last < 0 else last)
                local = 0
                for line, state in zip(held, states, strict=True):
                    if BEGIN[state] or not out or out[-1][:2] != [c, piece]:
                        local += bool(BEGIN[state])
                        out.append([c, piece, conv, local, STATES[state].split(":")[1], bool(BEGIN[state]), []])
                    out[-1][6].append(line)
            if out:
                columns = list(zip(*out, strict=True))
                kinds = (pa.string(), pa.int64(), batch.schema.field("conv_id").type, pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=["c", "piece", "conv_id", "local", "role", "begins", "lines"])

    bounded = leaves.drop("m").join(bounds, ["c", "piece"])
    parts = settle(bounded.mapInArrow(decode, f"c string, piece long, conv_id {kind}, local int, role string, begins boolean, lines array<string>"), "turn-parts")
    return _turns(parts)


def _turns(parts: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    # one number per piece, not its lines, goes through the window
    begun = parts.groupBy("c", "piece").agg(F.max("local").alias("n"))
    before = F.sum("n").over(Window.partitionBy("c").orderBy("piece")) - F.col("n")
    numbered = parts.join(begun.select("c", "piece", before.alias("base")), ["c", "piece"])
    turn = (F.col("base") + F.col("local") - 1).alias("turn")
    by_turn = numbered.select("c", "conv_id", turn, "piece", "role", "begins", "lines").groupBy("c", "turn")
    whole = by_turn.agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("piece", "begins", "role", "lines"))).alias("p"))
    lines = F.flatten(F.transform("p", lambda x: x["lines"]))
    whole = whole.select("conv_id", F.col("turn").cast("int").alias("turn"), F.element_at("p", 1)["role"].alias("role"), lines.alias("lines"))
    text = F.rtrim(F.regexp_replace(F.array_join("lines", "\n"), MARKER.replace(r"^[\s", r"\A[\s").replace(r"\s*:", r"[ \t]*:"), ""))
    text = F.regexp_replace(text, r"\s+\z", "")
    whole = whole.select("conv_id", "turn", "role", F.size("lines").alias("n_lines"), text.alias("text"))
    return whole.withColumn("rendered", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n")))


def held_out(conv_id: Column) -> Column:
    return F.coalesce(F.crc32(conv_id.cast("string")) % 3 == 1, F.lit(True))

