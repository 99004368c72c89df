"""Actions in free-form agent output.

Output is read in three steps: ``messages`` cuts a dialogue at its role lines,
``objects`` finds the JSON objects of a text, and ``SHAPES`` is the table of
objects that state an action. JSON inside text needs a scanner, so this is
plain Python, to be called for Arrow batches or as a table function.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

Action = int | str | None

#: Action words, role lines, source tags, and tokens of up to three digits or of any number.
STOP, ADD = "STOP", "ADD_TRIPLE"
ROLES = {"assistant", "user", "system", "tool"}
FALLBACK, TOKEN = "_fallback", "token_fallback"
SHORT_TOKENS = re.compile(r"\bSTOP\b|\b\d{1,3}\b", re.IGNORECASE)
LONG_TOKENS = re.compile(r"\bSTOP\b|\b\d+\b", re.IGNORECASE)

_THINK = re.compile(r"<think>.*?</think>", re.DOTALL)
_TRIPLE_AT_END = re.compile(r"\([^()]+\)$")
_NUMBERED = re.compile(r"\s*\[(\d+)\]\s*\(")


class Found(NamedTuple):
    value: dict
    begin: int
    end: int


class Parsed(NamedTuple):
    action: int | str
    source: str
    segment: str


def without_thoughts(text: str | None) -> str:
    return _THINK.sub("", text or "").strip()


def objects(text: str | None) -> Iterator[Found]:
    """JSON objects of a text: every opening brace from which one can be read, those inside another one too."""
    decoder = json.JSONDecoder()
    for brace in re.finditer(r"\{", text or ""):
        try:
            value, end = decoder.raw_decode(text, brace.start())
        except json.JSONDecodeError:
            continue
        yield Found(value, brace.start(), end)


def _word(value) -> str:
    return value.strip().upper() if isinstance(value, str) else ""


def _number(value) -> int | None:
    """Integers, integral floats and digits in a string name a triple; truth values do not."""
    if isinstance(value, str):
        return int(value) if value.strip().isdecimal() else None
    integral = isinstance(value, int | float) and not isinstance(value, bool) and value % 1 == 0
    return int(value) if integral else None


def choice(value) -> Action:
    return STOP if _word(value) == STOP else _number(value)


#: What states an action: the keys of the object, how its action is read, and the source tag.
SHAPES = (
    ({"action", "triple_id"}, lambda o: _number(o.get("triple_id")) if _word(o.get("action")) == ADD else None, "json_action_sft"),
    ({"action"}, lambda o: choice(o.get("action")), "json_action"),
    ({"triple_id"}, lambda o: None if "action" in o else _number(o.get("triple_id")), "json_action_sft"),
)


def segment_action(segment: str) -> Parsed | None:
    """The action of one message or line: of its first object if that states one, else its first token.

    An object with other keys, or with text around it, is a fallback; an object
    alone that states no action is none, whatever numbers it holds.
    """
    text = without_thoughts(segment)
    first = next(objects(text), None)
    if first:
        alone = first.end - first.begin == len(text)
        for keys, read, tag in SHAPES:
            action = read(first.value)
            if action is not None:
                strict = alone and keys.issuperset(first.value)
                return Parsed(action, tag if strict else tag + FALLBACK, text)
        if alone:
            return None
    token = LONG_TOKENS.search(text)
    return Parsed(choice(token[0]), TOKEN, token[0]) if token else None


def messages(text: str | None) -> list[tuple[str, str]]:
    """(role, body) of a dialogue whose roles stand on lines of their own; empty without such lines."""
    lines = (text or "").splitlines()
    roles = [(k, name) for k, line in enumerate(lines) if (name := line.strip().lower()) in ROLES]
    return [(name, "\n".join(lines[k + 1 : end]).strip()) for (k, name), (end, _) in pairwise([*roles, (len(lines), "")])]


def action_trace(text: str | None, most: int = 256) -> tuple[list[Parsed], bool]:
    """At most ``most`` actions, and whether there are role lines: one an assistant message; without roles one a line, else each token."""
    dialogue = messages(text)
    said = [body for role, body in dialogue if role == "assistant"] if dialogue else (text or "").splitlines()
    trace = [p for p in map(segment_action, said) if p]
    if not trace and not dialogue:
        trace = [Parsed(choice(t), TOKEN, t) for t in SHORT_TOKENS.findall(text or "")]
    return trace[:most], bool(dialogue)


def accepted_history(text: str | None) -> list | None:
    """The list of accepted actions in the last object that carries one."""
    lists = (o.value.get("accepted_action_history") for o in objects(text))
    return next((x for x in reversed(list(lists)) if isinstance(x, list)), None)


def solution_text(full: str | None, solution: str | None) -> str:
    """The text to replay: one with role lines before one without, the full text before the solution; blank ones only if there is no other."""
    texts = [t for t in (full, solution) if isinstance(t, str) and t.strip()]
    return max(texts, key=lambda t: bool(messages(t)), default=solution or "")


def canonical_triple(text: str) -> str:
    """``(h, r, t)`` of ``h|r|t``, ``n|h|r|t`` and ``[n] (h, r, t)``."""
    plain = re.sub(r"^\[\d+\]\s*", "", " ".join(text.split()))
    bars = re.fullmatch(r"(?:\s*\d+\s*\|(?=(?:[^|]*\|){2}[^|]*$))?([^|]*)\|([^|]*)\|([^|]*)", plain)
    return f"({', '.join(x.strip() for x in bars.groups())})" if bars else plain


@udtf(returnType="place int, action string, triple_id long, source string, segment string, dialogue boolean", useArrow=False)
class ActionTrace:
    """The actions of a text as rows; a text without one has none. ``most`` actions at most."""

    def eval(self, text: str, most: int = 256):
        trace, dialogue = action_trace(text, most)
        for place, p in enumerate(trace):
            stop = p.action == STOP
            yield place, STOP if stop else ADD, None if stop or p.action >= 1 << 63 else p.action, p.source, p.segment, dialogue


def action_rows(rows: DataFrame, text: str, most: int = 256) -> DataFrame:
    """rows with a row for each action of their text."""
    return rows.lateralJoin(ActionTrace(F.col(text).outer(), F.lit(most)))


def register_functions(spark: SparkSession) -> None:
    """action_trace(text, most) as a table function of SQL."""
    spark.udtf.register("action_trace", ActionTrace)


# --- an agent's choice among numbered candidates -------------------------------------------------------------------------

Candidates = dict[int, tuple[str, str, str]]


def _line_choice(text: str, stated: dict, known: Candidates) -> Action:
    """The first line, if it is STOP or begins with ``[n] (``."""
    line = next(iter(text.splitlines()), "").strip()
    if line.upper() == STOP:
        return STOP
    m = _NUMBERED.match(line)
    return int(m[1]) if m and int(m[1]) in known else None


def _id(value) -> int | None:
    """An agent's id: an integer, or digits in a string."""
    return None if isinstance(value, float | bool) else _number(value)


def _object_choice(text: str, stated: dict, known: Candidates) -> Action:
    """STOP or the id of the first object."""
    if _word(stated.get("action")) == STOP:
        return STOP
    number = _id(stated.get("triple_id"))
    return number if _word(stated.get("action")) == ADD and number in known else None


def _text_choice(text: str, stated: dict, known: Candidates) -> Action:
    """The candidate that the first object writes out, the smallest id of equal ones."""
    triple = stated.get("triple")
    if _word(stated.get("action")) != ADD or not isinstance(triple, str):
        return None
    names = {canonical_triple(f"({', '.join(parts)})"): i for i, parts in sorted(known.items(), reverse=True)}
    forms = map(canonical_triple, (triple, *_TRIPLE_AT_END.findall(triple.strip())))
    return next((names[f] for f in forms if f in names), None)


def _token_choice(text: str, stated: dict, known: Candidates) -> Action:
    """The first token that is STOP or a candidate."""
    return next((c for c in map(choice, SHORT_TOKENS.findall(text)) if c == STOP or c in known), None)


def _missing_choice(text: str, stated: dict, known: Candidates) -> Action:
    """An id that is no candidate ends the selection."""
    return STOP if _word(stated.get("action")) == ADD and _id(stated.get("triple_id")) is not None else None


def agent_action(text: str, candidates: Candidates) -> Action:
    """An agent's choice, by the first reading that finds one; None if none does."""
    clean = without_thoughts(text)
    stated = next((o.value for o in objects(clean)), {})
    readings = (_line_choice, _object_choice, _text_choice, _token_choice, _missing_choice)
    return next((c for read in readings if (c := read(clean, stated, candidates)) is not None), None)
