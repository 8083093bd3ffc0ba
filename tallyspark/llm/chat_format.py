"""Chat formatting by schema fingerprints.

A record's nested field paths (arrays as ``[]``), sorted and hashed, are its schema fingerprint. Mappings are declared over
paths; a fingerprint selects, once for all records that share it, the mapping that names most of the paths the record has.
Mappings turn prompt, instruction and message layouts into canonical turns of role and text; records that no mapping fits come
back with a reason instead.

The template marks turns as ``<s>[INST]role[/INST]text</s>``. Inside roles and texts the four control strings and the backslash
are escaped with backslashes, which reading back undoes exactly. The loss mask, spans of code points of the formatted text, covers
the texts of assistant turns.

Null texts and roles are empty. Turns with equal number are ordered by role, then text. Null ids form a conversation of their own.
Records that are null or no JSON objects have no mapping. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Mapping:
    """One layout. Either ``turns`` names an array, with the paths of role and text below it, or ``fields`` lists
    (path, role) of single texts, of which those named in ``joined`` go with the text before them into one turn.
    ``roles`` gives the canonical names of the layout's own roles; other roles stay as they are."""

    name: str
    turns: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    joined: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> set[str]:
        if self.turns:
            return {f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"}
        return {p for p, _ in self.fields} - set(self.optional)


MAPPINGS = (
    Mapping("messages", turns="messages", role="role", text="content"),
    Mapping("conversations", turns="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))),
    Mapping("conversation", turns="conversation", role="role", text="text"),
    Mapping("instruction", fields=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")), joined=("input",), optional=("system", "input")),
    Mapping("prompt-response", fields=(("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=("system",)),
    Mapping("prompt-completion", fields=(("system", "system"), ("prompt", "user"), ("completion", "assistant")), optional=("system",)),
    Mapping("question-answer", fields=(("question", "user"), ("answer", "assistant"))),
)


def field_paths(value: object, at: str = "") -> set[str]:
    """Paths of all leaves of a JSON value."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at + "{}"}
    if isinstance(value, list):
        return set().union(*(field_paths(v, at + "[]") for v in value)) if value else {at + "[]"}
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def choose(paths: set[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping | None:
    """The mapping whose paths the record has, with most of them; among equals the first."""
    fit = [m for m in mappings if m.paths() <= paths or m.turns and paths & {f"{m.turns}[]"}]
    return max(fit, key=lambda m: len((m.paths() | set(m.optional)) & paths), default=None)


def _text(value: object) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def canonical(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """Turns (role, text) of a record."""
    if mapping.turns:
        rows = [x if isinstance(x, dict) else {} for x in record.get(mapping.turns) or []]
        named = dict(mapping.roles)
        return [(named.get(r := _text(x.get(mapping.role)), r), _text(x.get(mapping.text))) for x in rows]
    out: list[tuple[str, str]] = []
    for path, role in mapping.fields:
        text = _text(record.get(path))
        if path in mapping.optional and not text:
            continue
        if path in mapping.joined and out:
            out[-1] = (out[-1][0], out[-1][1] + "\n\n" + text)
        else:
            out.append((role, text))
    return out


_ESCAPED = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])")
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turns(turns: list[tuple[str, str]], learned: tuple[str, ...] = ("assistant",)) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans under the loss mask."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>[INST]{escape(role)}[/INST]", escape(text)
        at += len(head)
        if role in learned:
            mask.append((at, at + len(body)))
        at += len(body) + 4
        parts += [head, body, "</s>"]
    return "".join(parts), mask


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(formatted)]


FORMATTED = T.StructType(
    [
        T.StructField("fingerprint", T.StringType()),
        T.StructField("mapping", T.StringType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("loss", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("reason", T.StringType()),
    ]
)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_records(records: DataFrame, *, record_id: str = "record_id", record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(record_id, fingerprint, mapping, formatted, loss, reason) of every JSON record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen: dict[str, Mapping | None] = {}
        for batch in batches:
            rows = []
            for value in batch.column(1):
                try:
                    data = json.loads(value.as_py() or "null")
                except ValueError:
                    data = None
                if not isinstance(data, dict):
                    rows.append((None, None, None, None, "no JSON object"))
                    continue
                mark = fingerprint(paths := field_paths(data))
                if mark not in chosen:
                    chosen[mark] = choose(paths, mappings)
                if (mapping := chosen[mark]) is None:
                    rows.append((mark, None, None, None, "no mapping"))
                    continue
                text, mask = format_turns(canonical(data, mapping))
                rows.append((mark, mapping.name, text, [{"start": a, "end": b} for a, b in mask], None))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.string(), pa.string(), pa.string(), _SPANS, pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [record_id, *FORMATTED.names])

    ids = records.select(F.col(record_id), F.col(record).cast("string").alias("record"))
    return ids.mapInArrow(run, T.StructType([T.StructField(record_id, records.schema[record_id].dataType), *FORMATTED.fields]))


def conversation_records(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One JSON record of messages for each conversation of a table of turns."""
    some = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("content"))
    grouped = rows.select(F.col(conv_id).alias("record_id"), some.alias("m")).groupBy("record_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return grouped.select("record_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def read_back(formatted: DataFrame, *, record_id: str = "record_id") -> DataFrame:
    """What stands in formatted texts: (record_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                said = "".join(f"{a}\n{b}\n" for a, b in turns)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [record_id, *names])

    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = formatted.schema[record_id].dataType.simpleString()
    good = formatted.where(F.col("formatted").isNotNull()).select(record_id, "formatted", "loss")
    return good.mapInArrow(run, f"{record_id} {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
