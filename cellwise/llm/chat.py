"""Chat formatting: a hidden Markov model over lines recovers the roles of a transcript, then its turns are rendered."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.llm.store import keep

ROLES = ("system", "user", "assistant")
#: Names that mark a speaker at the start of a line.
MARKERS = {
    "system": "system sys instruction instructions context",
    "user": "user human customer prompt question q me student client visitor",
    "assistant": "assistant ai bot model chatbot agent answer a response gpt tutor expert",
}
NAMES = {name: role for role, names in MARKERS.items() for name in names.split()}
_MARKER = re.compile(r"^\s*+(?:#{1,6}\s*+|\*{1,2}|<\|?|\[|>\s*+)?+([A-Za-z]+)(?:\s*+\*{1,2}\s*+:|\s*+:\s*+\*{1,2}|\s*+\|?>|\]\s*+:?|\s*+:)\s*+")
_BULLET = re.compile(r"^\s*(?:[-*•]\s|\d+[.)]\s|```)")

#: States are a role's first line of a turn (0-2) and a later line of one (3-5).
STATES = 6
FIRST = slice(0, 3)


@dataclass
class Model:
    """Logarithms of probabilities. sizes: (role, size class of a block); marks: (state, marker's class); bullets, opens: (state, no or yes)."""

    start: np.ndarray
    turn: np.ndarray
    stop: np.ndarray
    sizes: np.ndarray
    marks: np.ndarray
    bullets: np.ndarray
    opens: np.ndarray
    inside: float = float(np.log(0.9))


def size_class(n: int) -> int:
    """Of a block of n characters: by powers of the square root of two, 0 to 27."""
    return min(27, int(2 * np.log2(n + 1)))


def marker_of(line: str) -> tuple[int, str]:
    """The marked role's place in ROLES (3: none), and the line without its marker."""
    match = _MARKER.match(line)
    role = NAMES.get(match[1].lower()) if match else None
    return (ROLES.index(role), line[match.end() :]) if role else (3, line)


#: What is held of lines before any is counted, as if PRIOR lines of each state had been seen: the shares of list lines and of lines that begin a block by
#: state, and of the roles that a speaker's marker names by the line's role. How many lines carry a marker at all (MARKED: of first and of later ones), and how often a
#: turn goes on, differ between kinds of transcripts, so these stay as stated.
PRIOR = 40.0
BULLETS = np.array([0.05, 0.05, 0.05, 0.1, 0.1, 0.2])
OPENS = np.array([0.98, 0.98, 0.98, 0.1, 0.1, 0.1])
MARKED = np.array([0.49, 0.49, 0.49, 0.0015, 0.0015, 0.0015])


def model_of(starts: dict, turns: dict, stops: dict, sizes: dict, lines: dict | None = None) -> Model:
    """From counts by role: of first turns, of (role, next role), of last turns, of (role, size class), with one more of each; and of lines by (state, marker's
    class, list line or not, beginning of a block or not).

    Size counts are smoothed over neighbouring classes.
    """
    start = np.array([starts.get(r, 0) + 1.0 for r in ROLES])
    turn = np.array([[turns.get((r, s), 0) + 1.0 for s in ROLES] for r in ROLES])
    last = np.array([stops.get(r, 0) + 1.0 for r in ROLES])
    size = np.array([[sizes.get((r, k), 0) for k in range(28)] for r in ROLES], float)
    size = np.array([np.convolve(s, [0.25, 0.5, 0.25], "same") for s in size]) + 0.5
    total = turn.sum(1) + last
    named = PRIOR * np.where(np.eye(3)[[0, 1, 2, 0, 1, 2]] + (np.arange(STATES) >= 3)[:, None] > 0, 1.0, 0.02)
    bullets, opens = (PRIOR * np.stack([1 - p, p], 1) for p in (BULLETS, OPENS))
    for (state, mark, bullet, opened), n in (lines or {}).items():
        if mark < 3:
            named[state, mark] += n
        bullets[state, bullet] += n
        opens[state, opened] += n
    named, bullets, opens = (x / x.sum(1, keepdims=True) for x in (named, bullets, opens))
    marks = np.hstack([MARKED[:, None] * named, 1 - MARKED[:, None]])
    return Model(*(np.log(x) for x in (start / start.sum(), turn / total[:, None], last / total, size / size.sum(1, keepdims=True), marks, bullets, opens)))


@dataclass
class Line:
    text: str
    mark: int
    bullet: int
    opens: bool  # the first line of a message, or after an empty line
    forced: bool  # the first line of a message: a turn begins here
    size: int  # size class of its block, up to the next opening


def lines_of(message: str | None) -> list[Line]:
    """The lines of a message; empty ones only part blocks, unless there is no other."""
    out: list[Line] = []
    gap = True
    for raw in (message or "").split("\n"):
        if raw.strip() or not out and not (message or "").strip():
            mark, text = marker_of(raw)
            out.append(Line(text, mark, int(bool(_BULLET.match(text))), gap or mark < 3, not out, len(text)))
            gap = False
            if not raw.strip():
                break
        else:
            gap = True
    total = 0
    for line in reversed(out):
        total += line.size
        if line.opens:
            line.size, total = size_class(total), 0
        else:
            line.size = -1
    return out


def steps(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Transitions between lines for lines that must begin a turn, and for others: [from, to]."""
    forced = np.full((STATES, STATES), -np.inf)
    forced[FIRST, FIRST] = forced[3:, FIRST] = model.turn
    free = forced + np.log(1 - np.exp(model.inside))
    for r in range(3):
        free[r, r + 3] = free[r + 3, r + 3] = model.inside
    return forced, free


def emission(model: Model, line: Line) -> np.ndarray:
    out = model.marks[:, line.mark] + model.bullets[:, line.bullet] + model.opens[:, int(line.size >= 0)]
    return out if line.size < 0 else out + np.tile(model.sizes[:, line.size], 2)


def transfer(model: Model, lines: list[Line]) -> np.ndarray:
    """The best log probability of the lines from each state before them (row 6: the transcript's start) to each last state."""
    forced, free = steps(model)
    best = np.full((STATES + 1, STATES), -np.inf)
    for i, line in enumerate(lines):
        step, emit = forced if line.forced else free, emission(model, line)
        if i == 0:
            best[:STATES] = step + emit
            best[STATES, FIRST] = model.start + emit[FIRST]
        else:
            best = (best[:, :, None] + step[None]).max(1) + emit
    return best


def viterbi(model: Model, lines: list[Line], before: int = STATES, after: int | None = None) -> list[int]:
    """The most probable states, from state ``before`` (6: start) to the last state ``after`` (None: the end); ties to the lower state."""
    forced, free = steps(model)
    back: list[np.ndarray] = []
    best = np.empty(0)
    for i, line in enumerate(lines):
        step, emit = forced if line.forced else free, emission(model, line)
        if i == 0:
            best = step[before] + emit if before < STATES else np.concatenate([model.start, [-np.inf] * 3]) + emit
        else:
            every = best[:, None] + step
            back.append(every.argmax(0))
            best = every.max(0) + emit
    path = [int((best + np.tile(model.stop, 2)).argmax()) if after is None else after]
    for choice in reversed(back):
        path.append(int(choice[path[-1]]))
    return path[::-1]


def render(role: str, content: str) -> str:
    """A turn in canonical form; the form's own marks within a content are spaced out."""
    content = content.strip().replace("<|im_", "<| im_")
    return f"<|im_start|>{role}\n{content}<|im_end|>\n"


def fit(conversations: DataFrame) -> Model:
    """Counts over all rows of ``conversations(conv_id, turn, role, text)`` that have a known role; a row is one turn of that role.

    Null and other roles are left out, a null text is an empty one, repeated rows count as often as they come: a turn that comes m times before one that comes n
    times is the lesser number of steps. An empty table leaves what was held before.
    """
    rows = conversations.select("conv_id", "turn", F.lower("role").alias("role"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("role").isin(*ROLES))
    size = F.least(F.lit(27), F.floor(2 * F.log2(F.length("text") + 1))).cast("int")
    # next turns by equi-join on the turn's number, so that a conversation of any length is no single window
    ends = rows.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    turns = rows.groupBy("conv_id", "turn", "role").agg(F.count("*").alias("n"))  # before they meet, so that repeated rows don't multiply
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"), F.col("n").alias("m"))
    pairs = turns.join(following, ["conv_id", "turn"]).groupBy("role", "next").agg(F.sum(F.least("n", "m")).alias("count")).collect()
    outer = lambda end: {r["role"]: r["count"] for r in rows.select("conv_id", "turn", "role").join(ends, "conv_id").where(F.col("turn") == F.col(end)).groupBy("role").count().collect()}
    sizes = rows.groupBy("role", size.alias("size")).count().collect()

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter[tuple[int, int, int, int]] = Counter()
            for role, text in zip(batch["role"], batch["text"]):
                for i, line in enumerate(lines_of(text)):
                    counts[ROLES.index(role) + 3 * (i > 0), line.mark, line.bullet, int(line.size >= 0)] += 1
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["state", "mark", "bullet", "opened", "n"])

    tally = rows.select("role", "text").mapInPandas(seen, "state int, mark int, bullet int, opened int, n long")
    lines = tally.groupBy("state", "mark", "bullet", "opened").agg(F.sum("n").alias("n")).collect()  # at most 96 rows
    return model_of(
        outer("first"), {(r["role"], r["next"]): r["count"] for r in pairs}, outer("last"), {(r["role"], r["size"]): r["count"] for r in sizes},
        {(r["state"], r["mark"], r["bullet"], r["opened"]): r["n"] for r in lines},
    )


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, list[tuple], list[Line]]]:
    """From batches sorted by (range, conversation, turn): each stretch of one conversation in one range, with its rows and lines."""
    key, rows, lines = None, [], []
    for batch in batches:
        for row in batch.itertuples(index=False):
            here = (int(row.range), None if pd.isna(row.conv_id) else int(row.conv_id))
            if here != key:
                if rows:
                    yield key, rows, lines
                key, rows, lines = here, [], []
            own = lines_of(row.text)
            rows.append((row, len(own)))
            lines += own
    if rows:
        yield key, rows, lines


OUT = "conv_id long, turn long, part int, role string, content string, rendered string"


def recover(conversations: DataFrame, model: Model) -> DataFrame:
    """Rows (conv_id, turn, part, role, content, rendered): the turns of ``conversations(conv_id, turn, text)``.

    A row is a message or a piece of a transcript: its first line begins a turn, later ones may, so a row gives one turn or several
    (``part`` counts them). Roles come from Viterbi's path over all lines of a conversation in the order of turn and text. Rows are dealt by
    ranges, so a conversation of any length is spread over tasks: where one crosses ranges, each range first sums its stretch up in a
    table of best probabilities from state to state, these tables (at most two per range) fix the states at the borders, and each range then
    decodes its own. A null or blank text is one turn without content. Rows with a null conv_id form one conversation, null
    turns come first, repeated rows are turns of their own; other columns are ignored; an empty table gives an empty result.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "text")
    order = ["conv_id", "turn", "text"]
    kept = keep(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "transcripts")
    spans = kept.groupBy("conv_id").agg(F.min("range").alias("low"), F.max("range").alias("high")).where("low < high").select(F.col("conv_id").alias("split_id"))
    split = kept.join(F.broadcast(spans), kept["conv_id"].eqNullSafe(F.col("split_id"))).drop("split_id")  # at most one per range

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition("range").sortWithinPartitions("range", *order)

    def sum_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (span, conv), _, lines in _segments(batches):
            yield pd.DataFrame({"conv_id": pd.array([conv], "Int64"), "range": [span], "table": [transfer(model, lines).ravel()]})

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("range")
        tables = [np.array(t).reshape(STATES + 1, STATES) for t in frame["table"]]
        best, back = tables[0][STATES], []
        for table in tables[1:]:
            every = best[:, None] + table[:STATES]
            back.append(every.argmax(0))
            best = every.max(0)
        path = [int((best + np.tile(model.stop, 2)).argmax())]
        for choice in reversed(back):
            path.append(int(choice[path[-1]]))
        path = path[::-1]
        return pd.DataFrame({"border_id": frame["conv_id"].astype("Int64"), "border": frame["range"], "before": [STATES, *path[:-1]], "after": path})

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for (_, conv), found, lines in _segments(batches):
            row = found[0][0]
            known = not pd.isna(row.after)
            path = viterbi(model, lines, int(row.before) if known else STATES, int(row.after) if known else None)
            at = 0
            for row, count in found:
                role, content, part = None, [], 0
                turn = None if pd.isna(row.turn) else int(row.turn)
                for line, state in [*zip(lines[at : at + count], path[at : at + count]), (None, 0)]:
                    if line is None or state < 3:
                        if role:
                            text = "\n".join(content).strip()
                            out.append((conv, turn, part, role, text, render(role, text)))
                            part += 1
                        role, content = ROLES[state], []
                    if line is not None:
                        content.append(line.text)
                at += count
            if len(out) >= 5000:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)

    tables = dealt(split).mapInPandas(sum_up, "conv_id long, range int, table array<double>")
    borders = keep(tables.groupBy("conv_id").applyInPandas(chain, "border_id long, border int, before int, after int"), "borders")
    same = kept["conv_id"].eqNullSafe(borders["border_id"]) & (kept["range"] == borders["border"])
    ready = kept.join(F.broadcast(borders), same, "left").drop("border_id", "border")  # at most two rows per range
    return dealt(ready).mapInPandas(decode, OUT)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
    return frame.astype({"conv_id": "Int64", "turn": "Int64"})


def recover_held_out(conversations: DataFrame, folds: int = 2) -> DataFrame:
    """``recover`` where the model that decodes a conversation was fitted on the others: by the hash of conv_id, each fold by all but itself.

    Cases as in ``recover``; with a single conversation nothing is counted, and what was held before decides.
    """
    fold = F.pmod(F.xxhash64("conv_id", F.lit(13)), F.lit(folds))
    parts = [recover(conversations.where(fold == k), fit(conversations.where(fold != k))) for k in range(folds)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
