"""Chat formatting: transcripts are parsed by a hidden Markov model and rendered in one canonical form.

A transcript is cut into lines. The hidden state of a line is a role and whether a turn begins there; what is observed are
the speaker marker at its start (of which role, or none), whether a blank line comes before it, its length, its last character
and whether it begins with a capital. Start, transition and observation probabilities are smoothed counts over labelled
transcripts; Viterbi gives the likeliest states, whose turns lose their markers and are rendered one after another.

Rows are independent, so a task holds one batch of transcripts. `transcripts` makes them from a table of turns; a long
conversation gives one transcript per PART turns, and where more than PART rows claim the same turns (repeated numbers, no number,
no conversation) they are dealt by hash to as many transcripts as it takes, so that none grows without bound. Conversations that are
held out are written in marker styles of their own, which the model never saw.

A turn's text is what the transcript has from its marker to its last line that is not blank, untouched. Blank lines around turns
part them and are not kept.

Edge cases: a null or empty text has no turns and renders as an empty text; null ids are kept; a text that itself holds the
canonical marks has them broken up by a space; lines end with LF, CR or both; without training transcripts markers alone
decide; in `transcripts`, null turns come first, a role that is not one of ROLES is `user`, a null text is empty and repeated rows count
once; ties go to the first state in the order of ROLES; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant", "tool")
#: Turns of a conversation in one transcript.
PART = 128
SMOOTHING = 0.5
#: Lines with the expected marker that each state is taken to have shown before training.
PRIOR = 5

#: The words that mark a speaker, by role.
MARKERS = {
    "system": "system instruction instructions context",
    "user": "user human customer question q client prompter",
    "assistant": "assistant ai bot agent answer a model gpt response",
    "tool": "tool function observation",
}
_ROLE_OF = {w: r for r, words in MARKERS.items() for w in words.split()}
_MARKER = re.compile(r"^\s*(?:#{1,4}\s*|\*{2}|<\|?|\[|\(|-\s+)?(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")\b\s*(?:\*{2}\s*:?|\|?>\s*:?|\]\s*:?|\)\s*:?|:\s*(?:\*{2})?|>)\s*", re.IGNORECASE)

#: Styles in which `transcripts` writes the markers of the roles; the last has none. Those of HELD_STYLES are not learnt from.
STYLES = (
    ("System: ", "User: ", "Assistant: ", "Tool: "),
    ("### Instruction: ", "### Human: ", "### Assistant: ", "### Function: "),
    ("[system] ", "[user] ", "[bot] ", "[tool] "),
    ("", "", "", ""),
)
HELD_STYLES = (
    ("**Context:** ", "**Question:** ", "**Answer:** ", "**Observation:** "),
    ("Instructions> ", "Client> ", "Agent> ", "Function> "),
    ("", "", "", ""),
)

#: Sizes of the observations: marker's role or none, blank before, length, last character, capital.
_WIDTHS = (len(ROLES) + 1, 2, 5, 4, 2)
_LENGTHS = (20, 80, 200, 600)
STATES = 2 * len(ROLES)  # 2 * role + (0 where a turn begins, 1 inside it)
_PARSED = "n_lines long, turns array<struct<role:string,text:string>>, rendered string"


_LINE = re.compile(r"[^\r\n]+")


def line_spans(text: str) -> list[tuple[int, int]]:
    """Where the lines that are not blank begin and end."""
    return [m.span() for m in _LINE.finditer(text) if not m[0].isspace()]


def split_lines(text: str) -> tuple[list[str], list[bool]]:
    """Lines that are not blank, and whether a blank one (or the start) comes before each."""
    lines, gaps, end = [], [], 0
    for a, b in line_spans(text):
        between = text[end:a].replace("\r\n", "\n").replace("\r", "\n")
        lines.append(text[a:b])
        gaps.append(not gaps or between.count("\n") > 1)
        end = b
    return lines, gaps


def observe(lines: list[str], gaps: list[bool]) -> np.ndarray:
    out = np.zeros((len(lines), len(_WIDTHS)), np.int64)
    for i, (line, gap) in enumerate(zip(lines, gaps, strict=True)):
        found = _MARKER.match(line)
        out[i, 0] = ROLES.index(_ROLE_OF[found[1].lower()]) if found else len(ROLES)
        out[i, 1] = gap
        body = line[found.end() :] if found else line
        out[i, 2] = sum(len(body) > n for n in _LENGTHS)
        last = body.rstrip()[-1:]
        out[i, 3] = 0 if last == "?" else 1 if last in ".!" else 2 if last in ":," else 3
        out[i, 4] = body.lstrip()[:1].isupper()
    return out


class Model:
    """Log probabilities of starts, transitions and observations."""

    def __init__(self, start: np.ndarray, step: np.ndarray, seen: list[np.ndarray]):
        def log(counts: np.ndarray) -> np.ndarray:
            counts = counts + SMOOTHING
            return np.log(counts / counts.sum(axis=-1, keepdims=True))

        self.start, self.step, self.seen = log(start), log(step), [log(s) for s in seen]
        inside = np.arange(STATES) % 2 == 1
        self.start[inside] = -np.inf
        for a in range(STATES):  # a turn goes on in its own role only
            self.step[a, inside & (np.arange(STATES) // 2 != a // 2)] = -np.inf

    def viterbi(self, observed: np.ndarray) -> np.ndarray:
        if not len(observed):
            return np.zeros(0, np.int64)
        emit = sum(s[:, observed[:, k]] for k, s in enumerate(self.seen)).T
        best, back = self.start + emit[0], np.zeros((len(observed), STATES), np.int8)
        for i in range(1, len(observed)):
            through = best[:, None] + self.step
            back[i] = through.argmax(axis=0)
            best = through[back[i], np.arange(STATES)] + emit[i]
        path = np.zeros(len(observed), np.int64)
        path[-1] = best.argmax()
        for i in range(len(observed) - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        return path

    def parse(self, text: str | None) -> tuple[int, list[tuple[str, str]]]:
        """Number of lines, and turns (role, text)."""
        text = text or ""
        lines, gaps = split_lines(text)
        turns: list[list] = []  # role, start, end
        for line, (start, end), state in zip(lines, line_spans(text), self.viterbi(observe(lines, gaps)).tolist(), strict=True):
            if state % 2 == 0:
                role, found = ROLES[state // 2], _MARKER.match(line)
                marked = found and _ROLE_OF[found[1].lower()] == role  # another role's word is the turn's own
                turns.append([role, start + (found.end() if marked else 0), end])
            else:
                turns[-1][2] = end
        return len(lines), [(role, text[start:end]) for role, start, end in turns]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|im_start|>{role}\n{text.replace('<|', '< |')}<|im_end|>\n" for role, text in turns)


#: Places of starts, transitions and observations in one array of counts.
_PLACES = np.cumsum([0, STATES, STATES * STATES, *(STATES * w for w in _WIDTHS)])


def tally(examples: Iterable[tuple[str, list[tuple[str, str]]]]) -> np.ndarray:
    """Counts over pairs of a transcript and the (role, written text) of its turns, which it holds one after another."""
    out = np.zeros(_PLACES[-1])
    for text, turns in examples:
        lines, gaps = split_lines(text)
        states = np.array([2 * ROLES.index(role) + (k > 0) for role, written in turns for k in range(len(split_lines(written)[0]))], np.int64)
        if len(states) != len(lines) or not lines:
            continue
        out[states[0]] += 1
        np.add.at(out, _PLACES[1] + states[:-1] * STATES + states[1:], 1)
        for k, values in enumerate(observe(lines, gaps).T):
            np.add.at(out, _PLACES[2 + k] + states * _WIDTHS[k] + values, 1)
    return out


def fitted(told: np.ndarray) -> Model:
    start, step, *seen = (told[a:b] for a, b in itertools.pairwise(_PLACES))
    seen = [s.reshape(STATES, w) for s, w in zip(seen, _WIDTHS, strict=True)]
    for state in range(STATES):  # before anything is learnt: a turn begins with its role's marker and goes on without one
        seen[0][state, len(ROLES) if state % 2 else state // 2] += PRIOR
    return Model(start, step.reshape(STATES, STATES), seen)


def counts(examples: Iterable[tuple[str, list[tuple[str, str]]]]) -> Model:
    return fitted(tally(examples))


def held_out(conv_id: Column | str) -> Column:
    conv_id = F.col(conv_id) if isinstance(conv_id, str) else conv_id
    return F.crc32(F.coalesce(conv_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def transcripts(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, part, slot, text, told): transcripts of turns (conv_id, turn, role, text), with told, the (role, written) of each turn."""
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("user")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / PART), F.lit(0)).cast("long"))
    crowded = rows.groupBy("conv_id", "part").agg(F.ceil(F.count("*") / PART).alias("slots")).where("slots > 1").withColumnsRenamed({"conv_id": "c", "part": "p"})
    slot = F.coalesce(F.pmod(F.xxhash64("turn", "role", "text"), F.col("slots")), F.lit(0))
    rows = rows.join(crowded, rows["conv_id"].eqNullSafe(crowded["c"]) & (rows["part"] == crowded["p"]), "left").withColumn("slot", slot).drop("slots", "c", "p")

    def marker(styles: tuple) -> Column:
        style = F.pmod(F.xxhash64("conv_id", "part", "slot"), F.lit(len(styles))) + 1
        return F.element_at(F.element_at(F.array(*(F.array(*map(F.lit, s)) for s in styles)), style.cast("int")), F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int"))

    rows = rows.withColumn("written", F.concat(F.when(held_out("conv_id"), marker(HELD_STYLES)).otherwise(marker(STYLES)), "text"))
    grouped = rows.groupBy("conv_id", "part", "slot").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "written"))).alias("told"))  # about PART rows at most
    text = F.array_join(F.transform("told", lambda t: t["written"]), "\n\n")
    return grouped.select("conv_id", "part", "slot", text.alias("text"), F.transform("told", lambda t: F.struct(t["role"].alias("role"), t["written"].alias("written"))).alias("told"))


def train(labelled: DataFrame) -> Model:
    """Fits on all rows (text, told): counts are added up in each batch and then in Spark, a number per parameter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = ([(t["role"], t["written"]) for t in turns] for turns in batch.column("told").to_pylist())
            yield pa.record_batch({"n": pa.array([tally(zip(batch.column("text").to_pylist(), told, strict=True)).tolist()], pa.list_(pa.float64()))})

    rows = labelled.select("text", "told").mapInArrow(run, "n array<double>").select(F.posexplode("n").alias("place", "n"))
    told = np.zeros(_PLACES[-1])
    for r in rows.groupBy("place").agg(F.sum("n").alias("n")).collect():  # as many rows as the model has parameters
        told[r.place] = r.n
    return fitted(told)


def parse(texts: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*keep, n_lines, turns, rendered) of texts (text, *keep)."""
    rows = texts.select("text", *keep)
    kept = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep)
    sent = texts.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.parse(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                {k: batch.column(k) for k in keep}
                | {
                    "n_lines": pa.array([n for n, _ in found], pa.int64()),
                    "turns": pa.array([[{"role": r, "text": t} for r, t in turns] for _, turns in found], kind),
                    "rendered": pa.array([render(turns) for _, turns in found], pa.string()),
                }
            )

    return rows.mapInArrow(run, ", ".join(x for x in (kept, _PARSED) if x))


def parse_conversations(turns: DataFrame) -> DataFrame:
    """Transcripts of a table of turns, parsed by a model of those that are not held out, beside the roles that were told."""
    made = transcripts(turns)
    parsed = parse(made, train(made.where(~held_out("conv_id"))), keep=("conv_id", "part", "slot", "told"))
    right = F.size(F.filter(F.arrays_zip(F.transform("told", lambda t: t["role"]).alias("a"), F.transform("turns", lambda t: t["role"]).alias("b")), lambda z: z["a"] == z["b"]))
    return parsed.select(
        "conv_id", "part", "slot", held_out("conv_id").alias("held_out"), "n_lines", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["role"]), ",").alias("roles"),
        "rendered", F.size("told").cast("long").alias("n_told"), right.cast("long").alias("n_right"),
    )
