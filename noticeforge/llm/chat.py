"""Chat formatting: layouts are told apart by a fingerprint of their field paths.

A record is a JSON object. Its nested field paths (array steps as []) are hashed;
the hash selects a declarative mapping that says where roles and texts lie. A record
with further fields has another hash: then the paths that a mapping reads are hashed
without the others, and the mapping that reads most decides. The canonical turns are
then formatted with turn marks, and the text of assistants is the loss mask.

Inside texts and roles a backslash goes between the parts of anything that looks
like the start of a mark ("<|", "<\\|", ...); reading removes it again, so any
text survives.

Cases: a null text or role is an empty one, one that isn't a string stands as JSON; a
null record has no turns; a record whose layout no mapping knows says so in layout
("unknown") and is one turn of that role with the whole record as its text, so that
nothing is lost. Repeated records give repeated rows. Ties in a conversation's turn numbers are
ordered by role and text, null turns come first.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeforge.llm import common

START, END = "<|im_start|>", "<|im_end|>"

#: Mappings: either a list of turns with role and text fields and names of roles, or fixed roles with their fields, in order.
MAPPINGS = {
    "messages": {"turns": "messages", "role": "role", "text": "content"},
    "turns": {"turns": "turns", "role": "role", "text": "text"},
    "share": {"turns": "conversations", "role": "from", "text": "value", "names": {"human": "user", "gpt": "assistant"}},
    "prompt": {"fields": [("user", "prompt"), ("assistant", "response")]},
    "completion": {"fields": [("user", "prompt"), ("assistant", "completion")]},
    "question": {"fields": [("user", "question"), ("assistant", "answer")]},
    "system_prompt": {"fields": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    "instruction": {"fields": [("user", "instruction"), ("assistant", "output")]},
    "instruction_input": {"fields": [("user", "instruction", "input"), ("assistant", "output")]},
}


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a JSON value; an empty list shows none of its elements'."""
    if isinstance(value, dict):
        return set().union(*({f"{at}.{k}"} | paths(v, f"{at}.{k}") for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value))
    return set()


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def _layouts(mapping: dict) -> list[set[str]]:
    """The path sets that a mapping knows."""
    if "turns" in mapping:
        top, role, text = f".{mapping['turns']}", mapping["role"], mapping["text"]
        return [{top, f"{top}[].{role}", f"{top}[].{text}"}, {top}]
    return [{f".{f}" for _, *fields in mapping["fields"] for f in fields}]


def registry(mappings: dict = MAPPINGS) -> dict[str, str]:
    """Name of the mapping for each known fingerprint."""
    return {fingerprint(p): name for name, m in mappings.items() for p in _layouts(m)}


def layout_of(record, known: dict[str, str], mappings: dict = MAPPINGS) -> str | None:
    """Name of the mapping that reads a record, None if there is none."""
    if not isinstance(record, dict):
        return None
    found = paths(record)
    candidates = [(len(found), known.get(fingerprint(found)))]
    for name, mapping in mappings.items():
        own = found & _layouts(mapping)[0]
        candidates.append((len(own), name if known.get(fingerprint(own)) == name else None))
    for _, name in sorted((c for c in candidates if c[1]), key=lambda c: -c[0]):
        mapping = mappings[name]
        turns = record.get(mapping["turns"]) if "turns" in mapping else None
        # A list has turns that can be read, or none at all.
        if "turns" not in mapping or turns is None or (isinstance(turns, list) and all(isinstance(t, dict) and {mapping["role"], mapping["text"]} <= set(t) for t in turns)):
            return name
    return None


def _string(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical(record: dict, mapping: dict) -> list[tuple[str, str]]:
    if "turns" in mapping:
        names = mapping.get("names", {})
        found = ((_string(x.get(mapping["role"])), _string(x.get(mapping["text"]))) for x in record.get(mapping["turns"]) or [])
        return [(names.get(role, role), text) for role, text in found]
    return [(role, "\n".join(x for f in fields if (x := _string(record.get(f)))) if len(fields) > 1 else _string(record.get(fields[0]))) for role, *fields in mapping["fields"]]


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A role stands on one line: line feeds become a backslash and n, backslashes double."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def render(turns: list[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask, as spans of code points."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted conversation."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.removesuffix(f"{END}\n").partition("\n")
        turns.append((unescape_role(role), unescape(text)))
    return turns


FORMATTED = "layout string, formatted string, loss_spans array<struct<start:int,stop:int>>"


def format_records(df: DataFrame, record_col: str = "record", keep: tuple[str, ...] = ("conv_id",), mappings: dict | None = None) -> DataFrame:
    """The columns in keep, layout (a mapping's name), formatted (text) and loss_spans, of JSON records."""
    mappings = mappings or MAPPINGS
    known = registry(mappings)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        for part in common.rows(batches):
            layouts, texts, masks = [], [], []
            for raw in part.column(0).to_pylist():
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                if name := layout_of(record, known, mappings):
                    turns = canonical(record, mappings[name])
                else:
                    turns = [] if raw is None else [("unknown", raw)]
                text, spans = render(turns)
                layouts.append(name or "unknown")
                texts.append(text)
                masks.append([{"start": a, "stop": b} for a, b in spans])
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(layouts, pa.string()), pa.array(texts, pa.string()), pa.array(masks, spans_type)], names=[*keep, "layout", "formatted", "loss_spans"])

    kept = df.select(F.col(record_col).alias("_record"), *keep)
    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)
    return common.map_arrow(kept, run, f"{schema}, {FORMATTED}")


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(df: DataFrame, keep: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """Counts and digests read back from formatted and loss_spans."""
    names = [*keep, *(x.split()[0] for x in DIGESTS.split(", "))]

    def run(batches):
        for part in common.rows(batches):
            out = []
            for text, spans in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans or [])
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = zip(*out) if out else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*part.columns[2:], *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=names)

    kept = df.select("formatted", "loss_spans", *keep)
    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)
    return common.map_arrow(kept, run, f"{schema}, {DIGESTS}")


def records(conversations: DataFrame) -> DataFrame:
    """conv_id and record: rows of a conversation as one JSON object with messages. One output row holds one conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    return conversations.groupBy("conv_id").agg(turns.alias("messages")).select("conv_id", F.to_json(F.struct("messages")).alias("record"))
