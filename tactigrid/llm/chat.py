"""Chat formatting by schema fingerprints.

A record is a JSON document of any layout. The set of its nested field paths (with list levels) is
hashed; the hash selects a declarative mapping, which says where the turns are. Each
mapping also names the fields it reads, so a layout with more fields than a known one still finds
it; that choice is made once for each schema. The turns are written as

    <|im_start|>role\\ntext<|im_end|>\\n

Inside roles and texts one backslash is added to every "<", backslashes, "|", so no control string
can arise there, and taking one away gives back the text. Roles also escape line ends.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
#: Roles by the names that the layout "conversations" has for them; all other layouts' roles stay as given.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns: a list of messages, or single fields in order, each with its role; instruction inputs follow the instruction."""

    name: str
    fields: frozenset[str]
    messages: str = ""
    role: str = ""
    text: str = ""
    singles: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: frozenset[str] = frozenset()
    renamed: bool = False


#: Tried in this order for a schema that is seen for the first time.
MAPPINGS = (
    Mapping("messages", frozenset({"messages[].role", "messages[].content"}), "messages", "role", "content"),
    Mapping("conversations", frozenset({"conversations[].from", "conversations[].value"}), "conversations", "from", "value", renamed=True),
    Mapping("turns", frozenset({"turns[].role", "turns[].text"}), "turns", "role", "text"),
    Mapping("instruction", frozenset({"instruction", "output"}), singles=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=frozenset({"system"})),
    Mapping("prompt", frozenset({"prompt", "completion"}), singles=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=frozenset({"system"})),
    Mapping("response", frozenset({"prompt", "response"}), singles=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=frozenset({"system"})),
    Mapping("question", frozenset({"question", "answer"}), singles=(("user", ("question",)), ("assistant", ("answer",)))),
)


def paths(value: Any, at: str = "") -> Iterator[str]:
    if isinstance(value, dict):
        for k in value:
            yield from paths(value[k], f"{at}.{k}" if at else k)
    elif isinstance(value, list):
        yield f"{at}[]"
        for x in value:
            yield from paths(x, f"{at}[]")
    else:
        yield at


def fingerprint(record: Any) -> tuple[str, frozenset[str]]:
    """The hash of the record's sorted field paths, and the paths."""
    found = frozenset(paths(record))
    return hashlib.sha256("\n".join(sorted(found)).encode("utf-8", "surrogatepass")).hexdigest()[:16], found


def escape(s: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", s)


def unescape(s: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", s)


def escape_role(s: str) -> str:
    return escape(s.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(s))


def turns(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """The record's canonical turns (role, text); nulls are empty, and a message that is no object is a turn without role."""
    text = lambda x: x if isinstance(x, str) else "" if x is None else json.dumps(x, ensure_ascii=False)
    if mapping.messages:
        messages = record.get(mapping.messages) or []
        rows = [(text(x.get(mapping.role)), text(x.get(mapping.text))) if isinstance(x, dict) else ("", text(x)) for x in messages]
        return [(ROLES.get(r, r), t) for r, t in rows] if mapping.renamed else rows
    out = []
    for role, fields in mapping.singles:
        parts = [text(record.get(f)) for f in fields]
        if role not in mapping.optional or any(parts):
            out.append((role, "\n".join([parts[0], *filter(None, parts[1:])])))
    return out


def render(rows: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string, and the spans of it (code points) under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in rows:
        head, body = f"{BEGIN}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from a formatted string."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def format_records(records: DataFrame, key: str) -> DataFrame:
    """records (key, record: a JSON string): key, schema, mapping, formatted, loss (spans of code points).

    A record that is null, no JSON object, or of a layout without mapping has a null mapping and null
    output: the caller sees every record. The table of known schemas is each task's own and holds
    one entry for each schema.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Mapping | None] = {}
        for b in batches:
            rows = []
            for x in b["record"]:
                try:
                    record = json.loads(x) if isinstance(x, str) else None
                except ValueError:
                    record = None
                if not isinstance(record, dict):
                    rows.append((None, None, None, None))
                    continue
                schema, found = fingerprint(record)
                if schema not in known:
                    known[schema] = next((m for m in MAPPINGS if m.fields <= found), None)
                if (m := known[schema]) is None:
                    rows.append((schema, None, None, None))
                else:
                    formatted, spans = render(turns(record, m))
                    rows.append((schema, m.name, formatted, [list(s) for s in spans]))
            out = pd.DataFrame(rows, columns=["schema", "mapping", "formatted", "loss"])
            out.insert(0, key, b[key].array)
            yield out

    kind = dict(records.dtypes)[key]
    return records.select(key, "record").mapInPandas(work, f"`{key}` {kind}, schema string, mapping string, formatted string, loss array<array<long>>")


def from_turns(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) as one record for each conversation, of the layout "turns".

    Turns are in order of turn, role, text, nulls first; null roles and texts are empty; repeated rows
    stay; rows with a null conv_id make one conversation. One conversation is one string in the end,
    so its turns meet in one row.
    """
    each = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    x = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(each)).alias("turns"))
    return x.select("conv_id", F.to_json(F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))).alias("record"))


def digests(formatted: DataFrame) -> DataFrame:
    """format_records()'s output by conv_id, read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, schema, mapping; nulls for a record without mapping."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s, spans in zip(b["formatted"], b["loss"], strict=True):
                if s is None:
                    rows.append((None,) * 5)
                    continue
                read, loss = parse(s), "".join(unescape(s[i:j]) for i, j in spans)
                digest = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((len(read), digest("".join(f"{r}\n{t}\n" for r, t in read)), len(loss), digest(loss), len(s)))
            out = pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out = out.astype({"n_turns": "Int64", "loss_chars": "Int64", "formatted_chars": "Int64"})
            out.insert(0, "conv_id", b["conv_id"].array)
            yield out.assign(schema=b["schema"], mapping=b["mapping"])

    return formatted.mapInPandas(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, schema string, mapping string")
