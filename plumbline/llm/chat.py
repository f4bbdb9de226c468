"""Chat formatting by schema fingerprints.

A record's nested field paths (array steps as []) are hashed; the fingerprint picks a declarative mapping that
turns the record's layout (prompt and answer, instruction and input, message lists, single turns) into canonical
(role, text) turns. Turns are then written between control strings; control strings inside roles and texts are
escaped reversibly: every `<`, backslashes, `|` gets one backslash more. The loss mask covers assistant texts.

A conversation may hold a third of all rows: its turns are sorted and streamed, never gathered.

Nulls: a null text is empty, a null role is the empty role. Turns of equal position are ordered by role, then
text; rows that repeat are turns of their own. A null conversation id is a conversation. A record whose
fingerprint no mapping knows, that is no JSON object, is nested beyond DEEPEST, or has a list with an element that is no
turn, gives one turn of role `unknown` that holds the record.
Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import partitions

START, END = "<|im_start|>", "<|im_end|>"
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_SEGMENT = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


@dataclass(frozen=True)
class Layout:
    """fields: (role, path) in order, texts of one role joined by a blank line; or a list of turns at `turns` with keys role and text."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    fields: tuple[tuple[str, str], ...] = ()
    turns: str | None = None
    role: str = ""
    text: str = ""

    def path_sets(self) -> list[frozenset[str]]:
        return [frozenset(self.required + some) for k in range(len(self.optional) + 1) for some in combinations(self.optional, k)]


#: The mappings, by the paths their records have.
LAYOUTS = (
    Layout("turn", ("role", "text"), ("turn",), turns="", role="role", text="text"),
    Layout("prompt_completion", ("prompt", "completion"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question_answer", ("question", "answer"), ("context",), (("user", "context"), ("user", "question"), ("assistant", "answer"))),
    Layout("instruction", ("instruction", "output"), ("input", "system"), (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("messages", ("messages", "messages[]", "messages[].role", "messages[].content"), ("messages[].name", "id"), turns="messages", role="role", text="content"),
    Layout("conversations", ("conversations", "conversations[]", "conversations[].from", "conversations[].value"), ("id",), turns="conversations", role="from", text="value"),
)


#: Records nested deeper than this have no layout here.
DEEPEST = 24


def _step(key: str) -> str:
    """A key as a step of a path: marks that paths use are escaped."""
    return re.sub(r"[\\.\[\]]", lambda m: "\\" + m[0], key)


def paths(value, at: str = "", depth: int = 0) -> set[str]:
    """All nested field paths below a JSON value; elements of an array share the step [], those that are no objects there are [?]."""
    if depth > DEEPEST:
        return {f"{at}..."}
    if isinstance(value, dict):
        return {p for k, v in value.items() for key in [f"{at}.{_step(k)}" if at else _step(k)] for p in {key} | paths(v, key, depth + 1)}
    if isinstance(value, list):
        return {p for v in value for p in {f"{at}[]" if isinstance(v, dict) else f"{at}[?]"} | paths(v, f"{at}[]", depth + 1)}
    return set()


def fingerprint(found: set[str] | frozenset[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(found)).encode(), digest_size=8).hexdigest()


MAPPINGS = {fingerprint(s): layout for layout in LAYOUTS for s in layout.path_sets()}


def _alike(turns, layout: Layout) -> bool:
    """Whether each turn of a list is an object with a role and a text: the paths of the list are those of all its elements together."""
    return isinstance(turns, list) and all(isinstance(t, dict) and layout.role in t and layout.text in t for t in turns)


def to_turns(record: str | None) -> tuple[str, list[tuple[str, str]]]:
    """Layout name and turns of one record."""
    try:
        value = json.loads(record or "")
    except (ValueError, RecursionError):  # no JSON, or nested beyond what the parser takes
        value = None
    layout = MAPPINGS.get(fingerprint(paths(value))) if isinstance(value, dict) else None
    if layout is not None and layout.turns and not _alike(value[layout.turns], layout):
        layout = None
    text = lambda x: x if isinstance(x, str) else "" if x is None else json.dumps(x, ensure_ascii=False)
    if layout is None:
        return "unknown", [("unknown", record or "")]
    role = lambda x: ROLES.get(text(x), text(x))
    if layout.turns is not None:
        turns = value[layout.turns] if layout.turns else [value]
        return layout.name, [(role(t.get(layout.role)), text(t.get(layout.text))) for t in turns]
    out: list[tuple[str, str]] = []
    for r, p in layout.fields:
        if p in value and (text(value[p]) or r != "user" or not out):
            if out and out[-1][0] == r == "user":
                out[-1] = (r, f"{out[-1][1]}\n\n{text(value[p])}")
            elif not (r == "system" and not text(value[p])):
                out.append((r, text(value[p])))
    return layout.name, out


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def _unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn's part of the output, and its loss mask (code points from, to) in it."""
    head, body = f"{START}{_escape_role(role)}\n", escape(text)
    loss = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return f"{head}{body}{END}\n", *loss


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(_unescape_role(m[1]), unescape(m[2])) for m in _SEGMENT.finditer(formatted)]


def format_records(records: DataFrame) -> DataFrame:
    """(conv_id, position, layout, part, loss_from, loss_to) in order within a partition, from (conv_id, position, record).

    A conversation's parts, in this order, are its formatted text. One conversation is in one partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for conv, at, record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name, turns = to_turns(record)
                for role, text in turns:
                    part, a, b = render(role, text)
                    for column, x in zip(out, (conv, at, name, part, a, b)):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["conv_id", "position", "layout", "part", "loss_from", "loss_to"])

    rows = records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("position").cast("long").alias("position"), F.col("record").cast("string").alias("record"))
    dealt = rows.repartition(partitions(records.sparkSession), "conv_id").sortWithinPartitions("conv_id", "position", "record")
    return dealt.mapInArrow(run, "conv_id long, position long, layout string, part string, loss_from long, loss_to long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests by conversation, from the formatted parts alone: each part is parsed again, and the mask cut out of it."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, state = None, None

        def row(conv, s):
            return (conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4])

        for batch in batches:
            done = []
            for conv, part, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != open_id:
                    if state is not None:
                        done.append(row(open_id, state))
                    open_id, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(part):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                loss = unescape(part[a:b])
                state[2] += len(loss)
                state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += len(part)
            yield table(done)
        if state is not None:
            yield table([row(open_id, state)])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return formatted.select("conv_id", "part", "loss_from", "loss_to").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turn_records(turns: DataFrame) -> DataFrame:
    """(conv_id, position, record) from a table of turns (conv_id, turn, role, text): a record for each row, in the `turn` layout."""
    body = F.to_json(F.struct("role", F.coalesce(F.col("text"), F.lit("")).alias("text")), {"ignoreNullFields": "false"})
    return turns.select("conv_id", F.col("turn").alias("position"), body.alias("record"))
