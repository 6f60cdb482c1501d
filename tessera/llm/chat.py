r"""Chat formatting by schema fingerprints.

A record is JSON of any layout. The set of its nested field paths, scalars only and list positions left out
(``messages[].role``), is hashed; the hash selects a declarative mapping from LAYOUTS, and the mapping turns
the record into canonical turns. A hash that is new is looked up once: the mapping is the one whose needed paths are all there
and are the most (the first of equal ones), whatever other fields a record has. Turns are then rendered as

    <|im_start|>role\ntext<|im_end|>\n

with ``\`` written as ``\\`` and ``<|`` as ``<\|`` inside roles and texts, and a line break in a role as ``\n``, so control
strings in a text can't end a turn and parse() gives back the exact turns. The loss mask is the list of [start, stop) code point
spans of the assistant texts.
"""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import text_batches

# The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"

#: A mapping: either a list of turns ("turns": path, "role" and "text": fields of its items) or ("fields") fields of
#: the record in order, each with its role; several fields of one role in a row are joined by an empty line.
#: "optional" paths may be missing; other fields are left out. Role names on the right are canonical.
LAYOUTS: list[dict] = [
    {"name": "messages", "turns": "messages", "role": "role", "text": "content"},
    {"name": "messages-text", "turns": "messages", "role": "role", "text": "text"},
    {"name": "from-value", "turns": "conversations", "role": "from", "text": "value", "optional": ["id", "system"]},
    {"name": "turns", "turns": "turns", "role": "role", "text": "text"},
    {"name": "instruction", "fields": [("instruction", "user"), ("input", "user"), ("output", "assistant")], "optional": ["input", "system"]},
    {"name": "prompt-completion", "fields": [("prompt", "user"), ("completion", "assistant")], "optional": ["system"]},
    {"name": "prompt-response", "fields": [("prompt", "user"), ("response", "assistant")], "optional": ["system"]},
    {"name": "question-answer", "fields": [("question", "user"), ("answer", "assistant")], "optional": ["context", "system"]},
]
#: Role names of known layouts and what they mean.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}

FORMAT_SCHEMA = (
    "layout string, fingerprint string, formatted string, loss_spans array<array<int>>, turns array<struct<role:string,text:string>>"
)


def field_paths(value: object, at: str = "") -> set[str]:
    """The paths of a record's scalar fields; positions in lists are left out."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else str(k)) for k, v in value.items())) if value else {f"{at}{{}}"}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=8).hexdigest()


def _needed(layout: dict) -> list[set[str]]:
    """The sets of paths of which a record of the layout has one."""
    if "turns" in layout:
        at = layout["turns"]
        return [{f"{at}[].{layout['role']}", f"{at}[].{layout['text']}"}, {f"{at}[]"}]
    return [{f for f, _ in layout["fields"] if f not in layout.get("optional", [])}]


class Mappings:
    """The layout for each fingerprint seen so far (MEMO of them at most, then it starts anew)."""

    MEMO = 10_000

    def __init__(self, layouts: list[dict]):
        self.layouts = layouts
        self.known: dict[str, dict | None] = {}

    def layout(self, mark: str, paths: set[str]) -> dict | None:
        if mark not in self.known:
            if len(self.known) >= self.MEMO:
                self.known.clear()
            # a text can be a list of parts: messages[].content[].text is a messages[].content
            have = paths | {p[: m.start()] for p in paths for m in re.finditer(r"\[\](?:\.text)?$", p)}
            fitting = [(len(need), -i) for i, layout in enumerate(self.layouts) for need in _needed(layout) if need <= have]
            self.known[mark] = self.layouts[-max(fitting)[1]] if fitting else None
        return self.known[mark]


def _said(x: object) -> str:
    """A value as text: null is empty, of a list of parts the texts by line; other values are JSON."""
    if x is None:
        return ""
    if isinstance(x, str):
        return x
    if isinstance(x, list) and x and all(isinstance(p, str) or isinstance(p, dict) for p in x):
        return "\n".join(p if isinstance(p, str) else _said(p["text"]) for p in x if isinstance(p, str) or "text" in p)
    return json.dumps(x, ensure_ascii=False)


def canonical_turns(record: dict, layout: dict) -> list[tuple[str, str]]:
    """A record's turns under a mapping: role (lower case of a known name, others as they are) and text; null is empty."""
    turns = [("system", _said(record["system"]))] if record.get("system") and "system" in layout.get("optional", []) else []
    if "turns" in layout:
        for item in record.get(layout["turns"]) or []:
            item = item if isinstance(item, dict) else {layout["text"]: item}
            role = _said(item.get(layout["role"]))
            turns.append((ROLES.get(role, role), _said(item.get(layout["text"]))))
        return turns
    fields = [("context", "user")] * ("context" in layout.get("optional", [])) + layout["fields"]
    for field, role in fields:
        text = _said(record.get(field))
        if field in layout.get("optional", []) and not text:
            continue
        if turns and turns[-1][0] == role:
            turns[-1] = (role, f"{turns[-1][1]}\n\n{text}")
        else:
            turns.append((role, text))
    return turns


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[list[int]]]:
    """The formatted text and the spans of the assistant texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append([at + len(head), at + len(head) + len(body)])
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text, unescaped. A line break in a role is escaped, so the role ends at the first one."""
    turns = []
    for part in formatted.split(START)[1:]:
        head, _, body = part.partition("\n")
        turns.append((unescape_role(head), unescape(body[: body.rindex(END)])))
    return turns


def format_records(df: DataFrame, record_col: str = "record", layouts: list[dict] | None = None) -> DataFrame:
    """Adds a struct column ``chat`` (FORMAT_SCHEMA) to a table with a JSON column.

    A record that is null, no JSON object or of an unknown layout has null layout, formatted, loss_spans
    and turns; its fingerprint (null for no object) tells what mapping is missing. Empty and very long texts are formatted whole.
    Other columns are kept; a column named ``chat``, in any case, is replaced.
    """
    mappings = Mappings(LAYOUTS if layouts is None else layouts)

    @F.pandas_udf(FORMAT_SCHEMA)
    def chat(records: pd.Series) -> pd.DataFrame:
        rows = []
        for text in records:
            try:
                record = json.loads(text) if text is not None else None
            except ValueError:
                record = None
            if not isinstance(record, dict):
                rows.append((None, None, None, None, None))
                continue
            paths = field_paths(record)
            mark = fingerprint(paths)
            layout = mappings.layout(mark, paths)
            if layout is None:
                rows.append((None, mark, None, None, None))
                continue
            turns = canonical_turns(record, layout)
            formatted, spans = render(turns)
            rows.append((layout["name"], mark, formatted, spans, [{"role": r, "text": t} for r, t in turns]))
        return pd.DataFrame(rows, columns=["layout", "fingerprint", "formatted", "loss_spans", "turns"])

    return text_batches(df).withColumn("chat", chat(F.col(record_col)))


def turn_records(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One JSON record (messages layout) per conversation from rows by turn, as (id, record).

    Null roles and texts are empty; null turns come first; equal turns are ordered by role and text, and
    repeated rows are kept. Rows of a null conversation id form one conversation.
    """
    item: Column = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("content")
    )
    listed = turns.groupBy(F.col(id_col).alias(id_col)).agg(F.sort_array(F.collect_list(item)).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return listed.select(id_col, F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def read_back(formatted: DataFrame, formatted_col: str = "formatted", spans_col: str = "loss_spans") -> DataFrame:
    """Adds ``read``: turns read from the formatted text and the unescaped text under its loss mask."""

    def turns_and_loss(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(text, spans, strict=True):
            if t is None:
                rows.append((None, None))
            else:
                rows.append(([{"role": r, "text": x} for r, x in parse(t)], "".join(unescape(t[a:b]) for a, b in s)))
        return pd.DataFrame(rows, columns=["turns", "loss_text"])

    udf = F.pandas_udf(turns_and_loss, "turns array<struct<role:string,text:string>>, loss_text string")
    return formatted.withColumn("read", udf(F.col(formatted_col), F.col(spans_col)))


def turns_digest(turns: Column) -> Column:
    """sha256 of role, line break, text, line break for every turn."""
    return F.sha2(F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256)
