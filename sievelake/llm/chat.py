"""Chat formatting by schema fingerprints.

Records come as JSON of many layouts. A record's nested field paths (`messages[].role`, say; values don't count) are
sorted and hashed; the hash selects a declarative mapping, which names the paths of roles and texts, and so turns the
record into canonical turns. Each turn becomes a marked segment of a template in which control strings inside texts are
escaped reversibly. Segments are rows, in order, and so are the spans of the loss mask (assistant texts); a
conversation is the concatenation of its segments, so that even one with a third of all rows is never one value.

Escaping: the first character of any control string, and the escape character itself, is replaced by the escape
character and a letter. No control string is then left inside a text, and unescape() gives the text back.

Null texts and roles are empty. A record of a layout without a mapping, or that is no JSON object, gives no turns but
one row of `unmapped` with its fingerprint. Turns are ordered by number, then role, then text, so ties and repeated
rows have a defined order. Null numbers come first. An empty table gives no rows. Only the named columns are read. A
very long text is one segment; a very long conversation is a stream of segments through one task, since its digest is a
hash over all of its turns in order: that is the limit of read_back(), not of the format.
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

#: The template's own marks, and control strings of other public templates.
TURN, BODY, END = "<|im_start|>", "\n", "<|im_end|>\n"
CONTROL = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<|eot_id|>", "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<pad>", "<unk>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>",
)
ESCAPE = "\x1b"
LETTERS = {ESCAPE: "e", "<": "l", "[": "b", "\n": "n"}
BACK = {v: k for k, v in LETTERS.items()}
#: One character at a time is taken, so control strings that overlap are all found.
_DANGER = re.compile(ESCAPE + "|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile(ESCAPE + "(.)")


def escape(text: str) -> str:
    return _DANGER.sub(lambda m: ESCAPE + LETTERS[m.group()], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: BACK[m.group(1)], text)


def escape_role(role: str) -> str:
    """Roles stand on the marker's line."""
    return escape(role).replace("\n", ESCAPE + LETTERS["\n"])


def paths(record: Any, at: str = "") -> set[str]:
    """Nested field paths of a record; an array's elements share one path."""
    if isinstance(record, dict):
        return {p for k, v in record.items() for p in (paths(v, f"{at}.{k}" if at else k) or {f"{at}.{k}" if at else k})}
    if isinstance(record, list):
        return {p for v in record for p in (paths(v, at + "[]") or {at + "[]"})} or {at + "[]"}
    return {at} if at else set()


def fingerprint(fields: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(fields)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """How records of one layout are read: `turns` is the path of an array, whose elements have a role and a text at the given keys; `fixed` lists (role, path) of single fields instead, in order; a role of `$name` stands in the field of that name, and is taken as it is."""

    fields: tuple[str, ...]
    turns: str = ""
    role: str = "role"
    text: str = "content"
    fixed: tuple[tuple[str, str], ...] = ()
    number: str = ""

    def canonical(self, record: dict) -> list[tuple[str, str]]:
        if self.turns:
            elements = pick(record, self.turns) or []
            return [(role_name(pick(x, self.role)), as_text(pick(x, self.text))) for x in elements]
        found = [(as_text(pick(record, role[1:])) if role[:1] == "$" else role, as_text(pick(record, path))) for role, path in self.fixed]
        return [(role, text) for (role, text), (_, path) in zip(found, self.fixed, strict=True) if text or not path.startswith(("input", "system", "history"))]


def pick(record: Any, path: str) -> Any:
    for key in path.split("."):
        record = record.get(key) if isinstance(record, dict) else None
    return record


def as_text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


#: The names of the roles in layouts with an array of turns.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def role_name(value: Any) -> str:
    role = as_text(value)
    return ROLES.get(role, role)


#: Public layouts. A turn in a row of its own is the first.
MAPPINGS = (
    Mapping(("role", "text", "turn"), fixed=(("$role", "text"),), number="turn"),
    Mapping(("messages[].content", "messages[].role"), turns="messages"),
    Mapping(("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value"),
    Mapping(("turns[].speaker", "turns[].text"), turns="turns", role="speaker", text="text"),
    Mapping(("completion", "prompt"), fixed=(("user", "prompt"), ("assistant", "completion"))),
    Mapping(("prompt", "response"), fixed=(("user", "prompt"), ("assistant", "response"))),
    Mapping(("instruction", "output"), fixed=(("user", "instruction"), ("assistant", "output"))),
    Mapping(("input", "instruction", "output"), fixed=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping(("answer", "question"), fixed=(("user", "question"), ("assistant", "answer"))),
    Mapping(("data.completion", "data.prompt"), fixed=(("user", "data.prompt"), ("assistant", "data.completion"))),
    Mapping(("prompt", "response", "system"), fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
)


def by_fingerprint(mappings: tuple[Mapping, ...]) -> dict[str, Mapping]:
    return {fingerprint(set(m.fields)): m for m in mappings}


TURNS = "conv_id {kind}, turn long, position int, role string, text string, fingerprint string, unmapped boolean"


def canonical_turns(df: DataFrame, id_col: str, record_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Canonical turns of JSON records: (conv_id, turn, position, role, text, fingerprint, unmapped)."""
    known = by_fingerprint(mappings)
    rows = df.select(F.col(id_col).alias("conv_id"), F.col(record_col).alias("record"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for conv, text in zip(batch["conv_id"].astype(object), batch["record"], strict=True):
                try:
                    record = json.loads(text) if text else None
                except ValueError:
                    record = None
                mark = fingerprint(paths(record)) if isinstance(record, dict) else ""
                mapping = known.get(mark)
                conv = None if pd.isna(conv) else conv
                if mapping is None:
                    found.append((conv, None, 0, None, None, mark, True))
                    continue
                number = pick(record, mapping.number) if mapping.number else None
                found += [(conv, number, k, role, body, mark, False) for k, (role, body) in enumerate(mapping.canonical(record))]
            columns = zip(*found, strict=True) if found else [[]] * 7
            types = ["Int64" if kind in ("bigint", "int") else object, "Int64", "Int64", object, object, object, bool]
            yield pd.DataFrame({name: pd.array(list(x), dtype=t) for name, x, t in zip(("conv_id", "turn", "position", "role", "text", "fingerprint", "unmapped"), columns, types, strict=True)})

    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, TURNS.format(kind=kind))


def segments(turns: DataFrame) -> DataFrame:
    """A formatted segment for each turn, and where its loss span lies in it (null: no loss)."""

    @F.pandas_udf("segment string, loss_start long, loss_end long")
    def render(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for role, text in zip(roles, texts, strict=True):
            head, body = TURN + escape_role(role or "") + BODY, escape(text or "")
            learn = role == "assistant"
            out.append((head + body + END, len(head) if learn else None, len(head) + len(body) if learn else None))
        return pd.DataFrame(out, columns=["segment", "loss_start", "loss_end"]).astype({"loss_start": "Int64", "loss_end": "Int64"})

    return turns.where(~F.col("unmapped")).select("conv_id", "turn", "position", "role", "text", render("role", "text").alias("f")).select("conv_id", "turn", "position", F.col("role").alias("_r"), F.col("text").alias("_t"), "f.*")


def in_order(formatted: DataFrame) -> DataFrame:
    """All segments of a conversation in one part, one after the other; Spark sorts and spills, nothing is gathered."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "position", "_r", "_t").select("conv_id", "segment", "loss_start", "loss_end")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted segments say, by conversation: turns, texts under the loss mask, and lengths. Parsed from the output only, in a stream."""

    class State:
        def __init__(self, conv):
            self.conv, self.turns, self.n_turns, self.loss, self.loss_chars, self.chars = conv, hashlib.sha256(), 0, hashlib.sha256(), 0, 0

        def add(self, segment: str, start, end) -> None:
            self.chars += len(segment)
            for part in segment.split(END)[:-1]:
                role, _, body = part.removeprefix(TURN).partition(BODY)
                self.turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                self.n_turns += 1
            if not pd.isna(start):
                text = unescape(segment[int(start) : int(end)])
                self.loss.update(text.encode())
                self.loss_chars += len(text)

        def row(self) -> tuple:
            return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([r[1:] for r in rows], columns=names[1:])
        out.insert(0, "conv_id", pd.array([r[0] for r in rows], dtype="Int64" if kind in ("bigint", "int") else object))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for batch in batches:
            done = []
            for conv, segment, start, end in zip(batch["conv_id"].astype(object), batch["segment"], batch["loss_start"], batch["loss_end"], strict=True):
                conv = None if pd.isna(conv) else conv
                if state is None or conv != state.conv:
                    done += [state.row()] if state else []
                    state = State(conv)
                state.add(segment, start, end)
            if done:
                yield frame(done)
        if state:
            yield frame([state.row()])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return in_order(formatted).mapInPandas(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_rows(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments of a table with a turn in each row: each row is a record of the first layout."""
    record = F.to_json(F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")), {"ignoreNullFields": "false"})
    return segments(canonical_turns(df.select(F.col(id_col).alias("conv_id"), record.alias("record")), "conv_id", "record"))
