"""Roles of raw chat transcripts by a hidden Markov model, and their canonical rendering.

Hidden states are role and place in a turn (its first line, or a later one); what shows is a
line's speaker marker and its looks. Viterbi's path gives the turns, even where markers are missing or odd.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_arrow

ROLES = ("system", "user", "assistant")
#: Bound of the fit: labelled conversations.
FIT_CONVERSATIONS = 2_000
SMOOTHING = 0.5
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SCHEMA = "conv_id bigint, roles array<string>, n_turns int, text string"

#: Speaker markers of raw transcripts, by style: system, user, assistant.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("### System: ", "### Human: ", "### Assistant: "),
    ("[system] ", "[user] ", "[bot] "),
    ("SYSTEM> ", "Q> ", "A> "),
    ("System - ", "Customer - ", "Agent - "),
    ("", "Alex: ", "Robin: "),
    ("", "", ""),
)
#: Every so manieth turn of a raw transcript has lost its marker.
LOSS = 9

_MARKER = re.compile(r"^\s*(?:#{1,4}\s*|\*\*|>\s*|-\s*)?[\[(<]?\s*(\w[\w.' ]{0,23}?)\s*(?:[\])>]\s*[:\-]?|\*\*\s*[:\-]|:\*\*|:|\s-)(?=\s|$)\s*")
_NAMES = {
    **dict.fromkeys("system instructions instruction context".split(), 1),
    **dict.fromkeys("user human customer client question q me prompter student you".split(), 2),
    **dict.fromkeys("assistant ai bot chatbot agent answer a model gpt helper tutor".split(), 3),
}
#: Marker classes: none, system, user, assistant, some other name, of which transcripts tell the first and the second.
MARKERS, OTHER = 6, 4
_LENGTHS = (1, 20, 60, 150, 400)


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (turn, role, text, line: the text after its marker), in the order of turn, role, text."""
    c = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    lost = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(LOSS)) == 0
    marks = F.array(*[F.array(*map(F.lit, s)) for s in STYLES])
    place = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    marker: Column = F.when(lost | F.col("role").isNull() | (place == 0), "").otherwise(F.try_element_at(F.get(marks, style), place.cast("int")))
    line = F.concat(F.coalesce(marker, F.lit("")), F.coalesce("text", F.lit("")))
    return c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))).alias("turns"))


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, transcript of conversations (conv_id, turn, role, text), as chats come that were saved as text.

    Turns are in the order of turn, role, text (nulls first), repeated rows repeated, each after a speaker marker and with an empty line
    between two. The style of the markers goes by a hash of conv_id; one in LOSS turns, also by a hash, and turns with an unknown role
    have none. A null text is empty; rows with a null conv_id are left out. Other columns, whatever their names, are ignored; an empty table gives an empty one.
    """
    return _turns(conversations).select("conv_id", F.array_join(F.transform("turns", lambda t: t["line"]), "\n\n").alias("transcript"))


def marker_of(line: str) -> tuple[str | None, int]:
    """The speaker's name that a line begins with, in small letters, and where the rest begins."""
    m = _MARKER.match(line)
    if not m or len(m.group(1).split()) > 2:
        return None, 0
    name = m.group(1).lower()
    if name not in _NAMES and not m.group(1)[0].isupper():
        return None, 0
    return name, m.end()


def _speakers(found: list[tuple[str | None, int]], after_gap: list[bool]) -> list[str]:
    """Names that no list has and that are speakers all the same, in the order in which they come.

    They are if no line has a listed name, two or more of them begin three lines or more, each after an empty line, and take turns as a rule. A label within
    a turn ("Note:") is none then.
    """
    lines = [(name, gap) for (name, _), gap in zip(found, after_gap) if name]
    if any(name in _NAMES for name, _ in lines):
        return []
    inside = {name for name, gap in lines if not gap}
    order = [name for name, _ in lines if name not in inside]
    changes = sum(a != b for a, b in zip(order, order[1:]))
    names = list(dict.fromkeys(order))
    return names if len(names) > 1 and len(order) > 2 and 3 * changes >= 2 * (len(order) - 1) and max(map(order.count, names)) > 1 else []


def observe(transcript: str) -> tuple[list[str], list[int], list[int], np.ndarray]:
    """Lines with text, where each one's text begins, how many empty lines come before it, and its features: marker class, empty line before, length, question."""
    lines, gaps, gap = [], [], 0
    for line in transcript.split("\n"):
        if line.strip():
            lines.append(line)
            gaps.append(gap)
            gap = 0
        else:
            gap += 1
    found = [marker_of(x) for x in lines]
    after_gap = [not i or g > 0 for i, g in enumerate(gaps)]
    others = _speakers(found, after_gap)
    begins, rows = [], np.zeros((len(lines), 4), np.int64)
    for i, (line, (name, at)) in enumerate(zip(lines, found)):
        if name in _NAMES:
            kind = _NAMES[name]
        elif name in others:
            kind = OTHER + min(others.index(name), 1)
        else:
            kind, at = 0, 0
        begins.append(at)
        n = len(line) - at
        rows[i] = kind, after_gap[i], sum(n >= x for x in _LENGTHS), line.rstrip().endswith("?")
    return lines, begins, gaps, rows


@dataclass
class HMM:
    """Log probabilities; states are 2 * role + (0 for a turn's first line, 1 for a later one)."""

    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]

    @staticmethod
    def fit(sequences: list[tuple[np.ndarray, np.ndarray]], smoothing: float = SMOOTHING) -> HMM:
        """From (states, features) of labelled transcripts."""
        n = 2 * len(ROLES)
        start, move = np.full(n, smoothing), np.full((n, n), smoothing)
        emit = [np.full((n, k), smoothing) for k in (MARKERS, 2, len(_LENGTHS) + 1, 2)]
        for states, rows in sequences:
            if len(states):
                start[states[0]] += 1
                np.add.at(move, (states[:-1], states[1:]), 1)
                for f, table in enumerate(emit):
                    np.add.at(table, (states, rows[:, f]), 1)
        for s in range(n):
            start[s] = 0 if s % 2 else start[s]  # a transcript begins with a turn's first line
            for t in range(1, n, 2):
                if t // 2 != s // 2:
                    move[s, t] = 0  # a later line has its turn's role
        with np.errstate(divide="ignore"):
            return HMM(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), [np.log(t / t.sum(axis=1, keepdims=True)) for t in emit])

    def viterbi(self, rows: np.ndarray) -> np.ndarray:
        """The likeliest states; the lower-numbered of equally likely ones."""
        if not len(rows):
            return np.zeros(0, np.int64)
        shown = sum(table[:, rows[:, f]].T for f, table in enumerate(self.emit))
        best, back = self.start + shown[0], np.zeros((len(rows), len(self.start)), np.int64)
        for i in range(1, len(rows)):
            paths = best[:, None] + self.move
            back[i] = paths.argmax(axis=0)
            best = paths[back[i], np.arange(len(best))] + shown[i]
        states = np.empty(len(rows), np.int64)
        states[-1] = best.argmax()
        for i in range(len(rows) - 1, 0, -1):
            states[i - 1] = back[i, states[i]]
        return states


def labelled_sequence(turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """States and features of a raw transcript of these turns (role, text after its marker). A turn without any text has no line and no state."""
    states = []
    for role, line in turns:
        n = sum(bool(x.strip()) for x in line.split("\n"))
        states += [2 * ROLES.index(role) + (k > 0) for k in range(n)]
    return np.array(states, np.int64), observe("\n\n".join(line for _, line in turns))[3]


def fit(conversations: DataFrame, most: int = FIT_CONVERSATIONS) -> HMM:
    """A model from a bounded number of labelled conversations; those with an unknown role are passed over. An empty table gives a model that knows no more than the smoothing."""
    known = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
    some = bounded_sample(known.select("conv_id").distinct(), most, "conv_id")
    rows = _turns(known.join(F.broadcast(some), "conv_id", "left_semi")).collect()
    return HMM.fit([labelled_sequence([(t.role, t.line) for t in r.turns]) for r in rows if all(t.role in ROLES for t in r.turns)])


def parse(transcript: str, model: HMM) -> list[tuple[str, str]]:
    """Turns (role, text) of a raw transcript. Speaker markers at their begins and one empty line between two go, all else stays.

    Of several empty lines between two turns the first ones belong to the earlier turn, those before the first turn to that one, those after the last line to the last.
    """
    lines, begins, gaps, rows = observe(transcript)
    turns: list[tuple[str, list[str]]] = []
    for line, at, gap, state in zip(lines, begins, gaps, model.viterbi(rows).tolist()):
        if not turns:
            turns.append((ROLES[state // 2], [""] * gap + [line[at:]]))
        elif state % 2 == 0:
            turns[-1][1].extend([""] * max(0, gap - 1))
            turns.append((ROLES[state // 2], [line[at:]]))
        else:
            turns[-1][1].extend([""] * gap + [line])
    if turns:
        parts = transcript.split("\n")
        turns[-1][1].extend([""] * next(k for k, x in enumerate(reversed(parts)) if x.strip()))
    return [(role, "\n".join(text)) for role, text in turns]


def render(turns: list[tuple[str, str]]) -> str:
    """One turn after the other between control marks; such marks in a turn's own text get a blank, so that they aren't any."""
    return "".join(f"{OPEN}{role}\n{text.replace('<|', '< |')}{CLOSE}\n" for role, text in turns)


def formatted(transcripts: DataFrame, model: HMM) -> DataFrame:
    """conv_id, roles, n_turns, text (rendered) of each row of transcripts (conv_id, transcript).

    A null transcript gives nulls and 0 turns, a blank one no turns and an empty text; very long ones are read whole. Equally likely roles go to the
    first of ROLES. Empty lines within a turn stay (as such, without their blanks), the one between two turns goes. Repeated
    rows get equal results; other columns, whatever their names, are ignored. An empty table gives an empty one.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        turns = [None if t is None else parse(t, model) for t in batch.column(1).to_pylist()]
        yield pa.record_batch(
            [
                batch.column(0),
                pa.array([None if t is None else [r for r, _ in t] for t in turns], pa.list_(pa.string())),
                pa.array([len(t or ()) for t in turns], pa.int32()),
                pa.array([None if t is None else render(t) for t in turns], pa.string()),
            ],
            names=["conv_id", "roles", "n_turns", "text"],
        )

    return map_arrow(transcripts.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("transcript").cast("string").alias("transcript")), run, SCHEMA)
