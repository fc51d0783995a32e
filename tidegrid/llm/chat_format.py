"""Chat formatting: a hidden Markov model recovers the turns and speakers of transcripts, which are then rendered canonically.

A row's text may be one message or a whole transcript of several turns. It is read by lines. A line is seen through its
speaker marker (``User:``, ``Assistant:`` and the like) and line features (length, question mark); a state is a role and
whether the line begins a turn. A turn begins at a row's first line or at a marked line; whether a marked line inside a
row does, or only quotes a marker, is for Viterbi to find.

Starts, transitions and emissions are counted over labelled rows (each one turn of its ``role``) and smoothed; markers keep
half of their prior weight however many rows have none. A conversation starts with its first numbered turn. No row is judged by a model that has seen it: conversations fall
in two halves by a hash, and each half is decoded by the model of the other.

Rows are spread by range of (conversation, turn) and sorted inside the partitions, so that a conversation, however long,
takes as many tasks as its rows fill. Conversations inside a partition are decoded there, many at a time. Of the two at
its edges, which may go on beside it, the task keeps a max-plus matrix and the turns under every state before and behind;
the matrices of a conversation, one a partition, are chained, and the right turns are chosen. A task holds the rows of its
part of one conversation, with their texts; a part is no larger than a partition of the range exchange.

Defined results: a null text is one empty line; null roles train nothing; rows that share a conversation and a turn number
are put in the order of a hash of their texts; a null turn stays null and comes first; rows with a null conversation are
one conversation; a table without known roles decodes by the markers alone; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scope, persisted, scope, small_batches

ROLES = ("system", "user", "assistant")
#: Speaker markers at the start of a line, by role.
MARKERS = (
    ("system", r"(?i)^\s*(?:#+\s*|\*\*|\[|<\|?)?(?:system|instructions?)(?:\*\*|\]|\|?>)?\s*[:>\]]"),
    ("user", r"(?i)^\s*(?:#+\s*|\*\*|\[|<\|?)?(?:user|human|customer|question|q|me)(?:\*\*|\]|\|?>)?\s*[:>\]]"),
    ("assistant", r"(?i)^\s*(?:#+\s*|\*\*|\[|<\|?)?(?:assistant|ai|bot|agent|answer|a|model)(?:\*\*|\]|\|?>)?\s*[:>\]]"),
)
N = len(ROLES)
#: States: a role's first line, then a role's further lines.
STATES = 2 * N
#: Codes by feature: marker (0 none, then by role; behind it the same for a row's first line), characters, question mark.
SIZES = (2 * (N + 1), 10, 2)
CELLS = int(np.prod(SIZES))
#: Prior counts: of a turn's own marker against another's and against none inside a row; of a marker inside a turn.
OWN_MARKER, PLAIN, QUOTED = 50.0, 50.0, 0.1
#: Lines that are decoded at once.
CHUNK_LINES = 20_000


def cells(text: Column) -> Column:
    """By line of a text its features as one number."""

    def cell(line: Column, i: Column) -> Column:
        marker = F.lit(0)
        for k, (_, pattern) in reversed(list(enumerate(MARKERS))):
            marker = F.when(line.rlike(pattern), F.lit(k + 1)).otherwise(marker)
        size = F.least(F.floor(F.log2(F.length(line) + 1)).cast("int"), F.lit(SIZES[1] - 1))
        return ((marker + F.when(i == 0, N + 1).otherwise(0)) * SIZES[1] + size) * SIZES[2] + F.rtrim(line).endswith("?").cast("int")

    return F.transform(F.split(text, "\n", -1), cell)


class Hmm:
    """Log chances: ``start`` by role, ``move`` from role to role of the next turn, ``emit`` by state and cell; ``stay`` is the
    chance by role that a turn has another line."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, stay: np.ndarray):
        self.start, self.emit = start, emit
        # From any line of a role: on with the turn, or the first line of the next turn.
        on = np.where(np.eye(N, dtype=bool), np.log(stay), -np.inf)
        self.step = np.tile(np.hstack([move + np.log(1 - stay)[:, None], on]), (2, 1))
        self.enter = np.vstack([self.step, np.concatenate([start, np.full(N, -np.inf)])])  # the last row: a conversation begins

    @classmethod
    def of(cls, starts: np.ndarray, moves: np.ndarray, counts: np.ndarray) -> Hmm:
        """From counts of first roles, of roles behind each other, and of cells by state."""
        start, move = starts + 1.0, moves + 1.0
        prior = np.full((STATES, SIZES[0]), QUOTED)
        for r in range(N):
            prior[r, 0] = prior[N + r, N + 1 :] = 0.0  # turns begin at marked lines and first lines, first lines begin turns
            prior[r, [1 + r, N + 1, N + 2 + r]] = OWN_MARKER, PLAIN, OWN_MARKER
            prior[N + r, 0] = PLAIN
        by = counts.reshape(STATES, *SIZES)
        marker = by.sum(axis=(2, 3))
        seen = marker.sum(axis=1, keepdims=True)
        marker = marker + np.maximum(1.0, seen / prior.sum(axis=1, keepdims=True)) * prior
        with np.errstate(divide="ignore"):
            parts = [np.log(x / x.sum(axis=1, keepdims=True)) for x in (marker * (prior > 0), by.sum(axis=(1, 3)) + 1.0, by.sum(axis=(1, 2)) + 1.0)]
        emit = (parts[0][:, :, None, None] + parts[1][:, None, :, None] + parts[2][:, None, None, :]).reshape(STATES, CELLS)
        lines = seen.reshape(2, N) + 1.0
        return cls(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), emit, lines[1] / lines.sum(axis=0))

    def decoded(self, lines: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best state of every line of whole conversations; ``first``: positions of their first lines, and the end."""
        order = np.argsort(-np.diff(first), kind="stable")
        begin, size = first[:-1][order], np.diff(first)[order]
        seen, longest = self.emit[:, lines].T, int(size.max(initial=0))
        score = self.enter[-1] + seen[begin]
        back, alive = [], [len(size)]
        for t in range(1, longest):
            n = int(np.searchsorted(-size, -t, side="left"))  # those of more than t lines
            step = score[:n, :, None] + self.step
            back.append(step.argmax(axis=1).astype(np.int8))
            score[:n] = np.take_along_axis(step, back[-1][:, None, :].astype(np.int64), axis=1)[:, 0] + seen[begin[:n] + t]
            alive.append(n)
        now = score.argmax(axis=1)
        out = np.zeros(len(lines), np.int8)
        for t in range(longest - 1, -1, -1):
            n = alive[t]
            out[begin[:n] + t] = now[:n]
            if t:
                now[:n] = back[t - 1][np.arange(n), now[:n]]
        return out

    def edge(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a part of a conversation: best scores from each state before it (and from the start) to each last state,
        and the states of its lines (lines x before x last)."""
        seen = self.emit[:, lines].T
        score, back = self.enter + seen[0], []
        for row in seen[1:]:
            step = score[:, :, None] + self.step
            back.append(step.argmax(axis=1).astype(np.int8))
            score = step.max(axis=1) + row
        states = np.zeros((len(lines), STATES + 1, STATES), np.int8)
        now = np.tile(np.arange(STATES), (STATES + 1, 1))
        for t in range(len(lines) - 1, -1, -1):
            states[t] = now
            if t:
                now = np.take_along_axis(back[t - 1].astype(np.int64), now, axis=1)
        return score, states


def prepared(turns: DataFrame) -> DataFrame:
    """``conv, turn, text, role, half, x`` of every row; ``x`` has a cell for each line."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("role").cast("string").alias("role"))
    return rows.withColumns({"half": F.pmod(F.xxhash64("conv"), F.lit(2)).cast("int"), "x": cells(F.col("text"))})


def fitted(rows: DataFrame) -> tuple[Hmm, Hmm]:
    """The models of the two halves of the conversations, from all of their labelled rows."""
    state = F.lit(0)
    for i, r in enumerate(ROLES):
        state = F.when(F.col("role") == r, F.lit(i)).otherwise(state)
    known = rows.where(F.col("role").isin(*ROLES)).select("half", "conv", "turn", "x", state.alias("s"))
    emit, starts, moves = np.zeros((2, STATES, CELLS)), np.zeros((2, N)), np.zeros((2, N, N))
    lines = known.select("half", "s", F.posexplode("x").alias("at", "cell"))
    for r in lines.groupBy("half", "s", (F.col("at") > 0).alias("on"), "cell").count().collect():  # at most 2 * STATES * CELLS rows
        emit[r.half, r.s + N * r.on, r.cell] += r["count"]
    begins = known.where("turn is not null").groupBy("half", "conv").agg(F.min(F.struct("turn", "s")).getField("s").alias("s"))
    for r in begins.groupBy("half", "s").count().collect():
        starts[r.half, r.s] += r["count"]
    # A turn follows the one numbered before it; repeated numbers count by their shares, so no window over a conversation.
    per = known.where("turn is not null").groupBy("half", "conv", "turn", "s").count()
    after = per.select("conv", (F.col("turn") - 1).alias("turn"), F.col("s").alias("t"), F.col("count").alias("times"))
    for r in per.join(after, ["conv", "turn"]).groupBy("half", "s", "t").agg(F.sum(F.least("count", "times")).alias("times")).collect():
        moves[r.half, r.s, r.t] += r.times
    return tuple(Hmm.of(starts[h], moves[h], emit[h]) for h in range(2))


def begun(states: np.ndarray, size: np.ndarray) -> pa.Array:
    """By row a list of alternatives, each the turns that begin in it: line times roles, plus role. ``states``: lines x
    alternatives; ``size``: lines of each row."""
    ends, ways = np.cumsum(size), states.shape[1]
    row = np.repeat(np.arange(len(size)), size)
    line = np.arange(len(row)) - (ends - size)[row]
    at, way = np.nonzero(states < N)
    order = np.lexsort((at, way, row[at]))
    at, way = at[order], way[order]
    turns = line[at] * N + states[at, way]
    counts = np.bincount(row[at] * ways + way, minlength=len(size) * ways)
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(turns.astype(np.int32)))
    return pa.ListArray.from_arrays(pa.array((np.arange(len(size) + 1) * ways).astype(np.int32)), inner)


OUT = "conv long, turn long, text string, ways array<array<int>>, part int, edge int, half int, best array<double>"


def _decoded(models: tuple):
    """Rows in order of conversation to their turns. ``edge`` is null inside a partition, 0 for the conversation at its
    beginning and 1 for another at its end; the last row of an edge has its matrix as ``best``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, edges, held = TaskContext.get().partitionId(), 0, []

        def out(table: pa.Table, first: np.ndarray | None) -> pa.RecordBatch:
            """Whole conversations that begin at rows ``first``, or (None) one at an edge."""
            nonlocal edges
            x = table.column("x").combine_chunks()
            lines, size = x.flatten().to_numpy(), x.value_lengths().to_numpy()
            half = table.column("half").to_numpy()
            edge, best = pa.nulls(len(size), pa.int32()), [None] * len(size)
            if first is None:
                score, states = models[1 - half[0]].edge(lines)
                ways, edge, best[-1] = begun(states.reshape(len(lines), -1), size), pa.array(np.full(len(size), edges, np.int32)), score.ravel().tolist()
                edges += 1
            else:
                states = np.zeros(len(lines), np.int8)
                at = np.concatenate([[0], np.cumsum(size)])[np.append(first, len(size))]
                for h in range(2):
                    own = np.flatnonzero(half[first] == h)
                    take = np.concatenate([np.arange(at[c], at[c + 1]) for c in own]) if len(own) else np.zeros(0, np.int64)
                    states[take] = models[1 - h].decoded(lines[take], np.concatenate([[0], np.cumsum(at[own + 1] - at[own])]))
                ways = begun(states[:, None], size)
            plain = [table.column(c).combine_chunks() for c in ("conv", "turn", "text")]
            return pa.RecordBatch.from_arrays([*plain, ways, pa.array(np.full(len(size), part, np.int32)), edge, pa.array(half.astype(np.int32)), pa.array(best, pa.list_(pa.float64()))], ["conv", "turn", "text", "ways", "part", "edge", "half", "best"])

        def starts(table: pa.Table) -> np.ndarray:
            conv = table.column("conv")
            key, null = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy()
            return np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (null[1:] != null[:-1])]))

        lines = 0
        for batch in batches:
            held.append(batch)
            lines += int(batch.column(batch.schema.get_field_index("x")).value_lengths().to_numpy().sum())
            if lines < CHUNK_LINES:
                continue
            # All but the last conversation are whole.
            table = pa.Table.from_batches(held)
            first = starts(table)
            done = 0
            if not edges and len(first) > 1:
                yield out(table.slice(0, first[1]), None)
                done = 1
            if len(first) - 1 > done:
                yield out(table.slice(first[done], first[-1] - first[done]), first[done:-1] - first[done])
            if len(first) > 1:
                table = table.slice(first[-1])
                held = table.to_batches()
            lines = 0
        if held:
            table = pa.Table.from_batches(held)
            first = starts(table)
            if not edges:
                yield out(table.slice(0, first[1] if len(first) > 1 else len(table)), None)
                table = table.slice(first[1]) if len(first) > 1 else table.slice(len(table))
                first = first[1:] - first[1] if len(first) > 1 else first[:0]
            if len(first) > 1:
                yield out(table.slice(0, first[-1]), first[:-1])
            if len(first):
                yield out(table.slice(first[-1]), None)

    return run


def _chained(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one conversation's edges, in order, which alternative of each is the best path's."""
    pdf = pdf.sort_values(["part", "edge"])
    best = [np.array(b).reshape(STATES + 1, STATES) for b in pdf["best"]]
    score, scores = best[0][-1], [best[0][-1]]
    for b in best[1:]:
        score = (score[:, None] + b[:-1]).max(axis=0)
        scores.append(score)
    leave = [int(scores[-1].argmax())]
    for k in range(len(best) - 1, 0, -1):
        leave.append(int((scores[k - 1] + best[k][:-1, leave[-1]]).argmax()))
    leave = leave[::-1]
    enter = [STATES, *leave[:-1]]
    return pd.DataFrame({"part": pdf["part"].to_numpy(), "edge": pdf["edge"].to_numpy(), "way": [e * STATES + x for e, x in zip(enter, leave, strict=True)]})


def marker(role: Column, text: Column) -> Column:
    """What a turn's text begins with that only says who speaks: the speaker marker of its first line and the white space
    behind it, where that line was read as marked by ``role``; else nothing."""
    line = F.substring_index(text, "\n", 1)
    own = F.lit("")
    for name, pattern in reversed(MARKERS):
        own = F.when(line.rlike(pattern), F.when(role == name, F.regexp_extract(line, pattern, 0)).otherwise("")).otherwise(own)
    behind = F.regexp_extract(F.substring(text, F.length(own) + 1, F.length(text)), r"^\s*", 0)
    return F.when(own == "", "").otherwise(F.concat(own, behind))


def rendered(role: Column, text: Column) -> Column:
    """A turn in canonical form: role, the text behind its :func:`marker`, which is otherwise as it was, and the end."""
    plain = F.substring(text, F.length(marker(role, text)) + 1, F.length(text))
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), plain, F.lit("\n<|end|>\n"))


def formatted(turns: DataFrame, *, models: tuple[Hmm, Hmm] | None = None) -> DataFrame:
    """``conv_id, turn, part, role, rendered, marker`` for every turn; ``part`` numbers the turns of a row from 0. ``marker`` is
    what was taken off: with the rendered texts it gives back the row, turn by turn, joined by newlines. ``models`` (of other
    conversations, one for each half) replace those that are counted on the table itself."""
    with scope() as here:
        return here.result(_formatted(turns, models, here), "chat-rendered")


def _formatted(turns: DataFrame, models: tuple[Hmm, Hmm] | None, here: Scope) -> DataFrame:
    small_batches(turns.sparkSession)
    rows = persisted(prepared(turns), "chat-rows")
    own = models or fitted(rows)
    keyed = rows.select("conv", "turn", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"), "text", "half", "x")
    keys = ["conv", "turn", "tie", "row"]
    ordered = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "turn", "text", "half", "x")
    found = persisted(ordered.mapInArrow(_decoded(own), OUT), "chat-turns")
    here.drop(but=1)
    edges = found.where("best is not null").groupBy("conv").applyInPandas(_chained, "part int, edge int, way int")
    found = found.drop("best").join(F.broadcast(edges), ["part", "edge"], "left")  # two rows at most for each partition
    lines = F.split("text", "\n", -1)
    begins = F.element_at("ways", F.coalesce("way", F.lit(0)) + 1)
    out = found.select("conv", "turn", lines.alias("lines"), begins.alias("begins"))
    out = out.select("conv", "turn", "lines", "begins", F.posexplode("begins").alias("part", "code"))
    first = F.expr(f"code div {N}").cast("int")
    end = F.coalesce(F.expr(f"get(begins, part + 1) div {N}").cast("int"), F.size("lines"))
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.col("code") % N + 1).cast("int"))
    text = F.array_join(F.slice("lines", first + 1, end - first), "\n")
    return out.select(F.col("conv").alias("conv_id"), "turn", "part", role.alias("role"), rendered(role, text).alias("rendered"), marker(role, text).alias("marker"))
