"""Chat formatting: schema fingerprints select declarative mappings to canonical turns; a reversible template.

A record's fingerprint is a hash of its sorted nested field paths (array elements as ``[]``). ``MAPPINGS`` declares a
layout for each known set of paths: which fields hold turns, roles and texts. A fingerprint that isn't listed takes
the layout whose paths it includes; records that fit none come out as rejected rows. Records are JSON strings, so prompt,
instruction and message layouts can share one column. Formatting works turn by turn and writes one segment a turn;
a conversation's segments, joined in order, are its training text, so a very long conversation is never held whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import quoted, table

# The layouts, by the paths a record has. Fields named None are absent.
# turns: path of the array of turns, role: its role field, text: its text field.
# fields: (role, (text fields, joined by a blank line)) for flat layouts.
LAYOUTS: list[dict] = [
    {"name": "turn", "fields": [("@role", ("text",))], "paths": ["role", "text"]},
    {"name": "turn_content", "fields": [("@role", ("content",))], "paths": ["content", "role"]},
    {"name": "messages", "turns": "messages", "role": "role", "text": "content", "paths": ["messages", "messages[].content", "messages[].role"]},
    {"name": "conversations", "turns": "conversations", "role": "from", "text": "value", "paths": ["conversations", "conversations[].from", "conversations[].value"]},
    {"name": "system_messages", "head": ("system", "system"), "turns": "messages", "role": "role", "text": "content", "paths": ["messages", "messages[].content", "messages[].role", "system"]},
    {"name": "prompt_completion", "fields": [("user", ("prompt",)), ("assistant", ("completion",))], "paths": ["completion", "prompt"]},
    {"name": "prompt_response", "fields": [("user", ("prompt",)), ("assistant", ("response",))], "paths": ["prompt", "response"]},
    {"name": "system_prompt_response", "fields": [("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))], "paths": ["prompt", "response", "system"]},
    {"name": "question_answer", "fields": [("user", ("question",)), ("assistant", ("answer",))], "paths": ["answer", "question"]},
    {"name": "instruction", "fields": [("user", ("instruction",)), ("assistant", ("output",))], "paths": ["instruction", "output"]},
    {"name": "instruction_input", "fields": [("user", ("instruction", "input")), ("assistant", ("output",))], "paths": ["input", "instruction", "output"]},
]
# Role names of other layouts.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant"}


def paths(value: object) -> set[str]:
    """Field paths of a parsed record."""
    found, open_ = set(), [(value, "")]
    while open_:
        v, at = open_.pop()
        if isinstance(v, dict):
            more = [(x, f"{at}.{k}" if at else k) for k, x in v.items()]
            found.update(p for _, p in more)
            open_ += more
        elif isinstance(v, list):
            open_ += [(x, f"{at}[]") for x in v]
    return found


def fingerprint(of: set[str] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(of)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


MAPPINGS = {fingerprint(x["paths"]): x for x in LAYOUTS}


def mapping_of(of: set[str]) -> dict | None:
    """The layout that a record's paths have exactly, or else the one with the most paths among those they include.

    An array of turns may be empty: a layout then needs only its other paths. The first of equals in LAYOUTS is taken.
    """
    exact = MAPPINGS.get(fingerprint(of))
    if exact is not None:
        return exact
    needs = lambda x: {p for p in x["paths"] if "[]" not in p or any(q.startswith(x["turns"] + "[]") for q in of)}
    fit = [x for x in LAYOUTS if needs(x) <= of]
    return max(fit, key=lambda x: len(needs(x) & of), default=None)


def _text(v: object) -> str:
    out = "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    try:
        out.encode()
    except UnicodeEncodeError:  # half a surrogate pair, which no UTF-8 text can hold
        out = out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return out


def turns_of(record: object, known: dict[str, dict | None] | None = None) -> tuple[str, str | None, list[tuple[str, str]]]:
    """(fingerprint, layout or None, turns) of a parsed record; an unknown layout has no turns.

    ``known`` keeps the mapping chosen for each fingerprint. Fields that the layout doesn't name are ignored; an element
    of the turns that is no object is a turn without a role.
    """
    of = paths(record)
    mark, known = fingerprint(of), {} if known is None else known
    if mark not in known:
        known[mark] = mapping_of(of)
    layout = known[mark]
    if layout is None or not isinstance(record, dict):
        return mark, None, []
    out: list[tuple[str, str]] = []
    if "head" in layout:
        out.append((layout["head"][0], _text(record.get(layout["head"][1]))))
    for role, fields in layout.get("fields", ()):
        own = _text(record.get("role")) if role == "@role" else role
        out.append((own, _text(record[fields[0]]) if len(fields) == 1 else "\n\n".join(t for f in fields if (t := _text(record[f])))))
    listed = record.get(layout.get("turns", ""), None)
    for turn in listed if isinstance(listed, list) else () if listed is None else (listed,):
        if not isinstance(turn, dict):
            out.append(("", _text(turn)))
            continue
        role = _text(turn.get(layout["role"]))
        out.append((ROLE_NAMES.get(role, role) if layout["role"] == "from" else role, _text(turn.get(layout["text"]))))
    return mark, layout["name"], out


def _read(record: str | None, known: dict) -> tuple[str | None, str | None, list[tuple[str, str]], str | None]:
    """(fingerprint, layout, turns, reason of rejection)."""
    if record is None:
        return None, None, [], "null"
    try:
        mark, name, turns = turns_of(json.loads(record), known)
    except RecursionError:
        return None, None, [], "nested too deep"
    except ValueError:
        return None, None, [], "not JSON"
    return mark, name, turns, "unknown layout" if name is None else None if turns else "no turns"


_TURNS = ("part", "role", "text", "fingerprint", "layout", "rejected")


def canonical_turns(records: DataFrame, keys: list[str], record: str = "record") -> DataFrame:
    """A row for each turn of the JSON column ``record``: ``keys``, part (from 0), role, text, fingerprint, layout, rejected.

    A record that gives no turns has one row without part, role and text, whose ``rejected`` says why (null, not JSON,
    nested too deep, unknown layout, no turns), so none is lost unseen. Null texts and roles are empty strings, halves of
    surrogate pairs U+FFFD; repeated records have their rows each. Columns that are neither key nor record are left
    out; keys named like one of the new columns are refused. Every record is parsed once.
    """
    if clash := set(keys) & set(_TURNS):
        raise ValueError(f"keys named like new columns: {sorted(clash)}")
    chosen = records.select(*(F.col(quoted(k)) for k in keys), F.col(quoted(record)).cast("string").alias("_record"))
    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict | None] = {}
        for batch in batches:
            if len(known) > 100_000:
                known.clear()
            at, rows, held = [], [], 0
            for i, x in enumerate(batch.column(len(keys)).to_pylist()):
                mark, name, turns, why = _read(x, known)
                new = [(k, r, t, mark, name, None) for k, (r, t) in enumerate(turns)] or [(None, None, None, mark, name, why)]
                rows += new
                at += [i] * len(new)
                held += len(x or "")
                if held > 4 << 20 or i == batch.num_rows - 1:
                    types = (pa.int64(), *[pa.string()] * 5)
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns[: len(keys)]), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=[*keys, *_TURNS])
                    at, rows, held = [], [], 0

    return chosen.mapInArrow(f, f"{schema}, part bigint, role string, text string, fingerprint string, layout string, rejected string".lstrip(", "))


# The template's control strings and their escapes; the escape character comes first.
OPEN, CLOSE = "<turn:", "</turn>"
ESCAPES = [("\\", "\\\\"), (OPEN, "\\o"), (CLOSE, "\\c"), (">\n", "\\n")]
_BACK = {v: k for k, v in ESCAPES}
_SEGMENT = re.compile(r"<turn:(.*?)>\n(.*?)</turn>\n", re.S)


def escaped(c):
    for what, by in ESCAPES:
        c = F.replace(c, F.lit(what), F.lit(by))
    return c


def unescape(text: str) -> str:
    return re.sub(r"\\(?:\\|o|c|n)", lambda m: _BACK[m[0]], text)


def formatted(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """``turns`` (role, text and any keys) with ``segment``, ``loss_from`` and ``loss_to`` (code points in the segment,
    end exclusive; both 0 for roles that are not trained on). Null roles and texts are taken as empty."""
    role, text = escaped(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OPEN), role, F.lit(">\n"))
    on = F.col("role") == trained
    begin = F.when(on, F.length(head)).otherwise(0)
    return turns.withColumns({"segment": F.concat(head, text, F.lit(CLOSE + "\n")), "loss_from": begin, "loss_to": F.when(on, begin + F.length(text)).otherwise(0)})


def parse(segment: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in formatted text."""
    return [(unescape(r), unescape(t)) for r, t in _SEGMENT.findall(segment)]


_FORMS = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
_NAMES = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_rejected")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted segments read back as a stream: one conversation's hashes are open at a time, none of its text kept."""
    now, out = None, []

    def close() -> None:
        if now is not None:
            out.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6]))

    for batch in batches:
        x = batch.to_pydict()
        for conv, segment, a, b in zip(x["conv_id"], x["segment"], x["loss_from"], x["loss_to"], strict=True):
            if now is None or now[0] != conv:
                close()
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            if segment is None:
                now[6] += 1
                continue
            for role, text in parse(segment):
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
            loss = unescape(segment[a:b])
            now[3] += len(loss)
            now[4].update(loss.encode())
            now[5] += len(segment)
        if len(out) > 1000:
            yield _rows(out)
            out = []
    close()
    yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_FORMS)], names=list(_NAMES))


def read_back(segments: DataFrame) -> DataFrame:
    """Per conv_id, what its segments (conv_id, turn, part, segment, loss_from, loss_to) say when parsed again.

    The segments of a conversation meet in one task as a sorted stream, since a hash of its text in order needs that;
    the task's memory doesn't follow the conversation. Turns that tie are ordered by part, then segment; null turns come
    first. Rows without a segment are rejected records, which ``n_rejected`` counts; a null conv_id is one conversation.
    """
    x = segments.select("conv_id", "turn", "part", "segment", "loss_from", "loss_to").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "segment")
    return x.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rejected long")


def format_conversations(rows: DataFrame) -> DataFrame:
    """Segments of ``rows`` (conv_id, turn, record as JSON in any layout): (conv_id, turn, part, segment, loss_from, loss_to,
    fingerprint, layout, rejected); see ``canonical_turns`` for odd records and ``formatted`` for nulls.

    A rejected record has one row without a segment. Repeated rows are formatted each; an empty table has no rows.
    """
    x = formatted(canonical_turns(rows, ["conv_id", "turn"]))
    turn = F.col("rejected").isNull()
    return x.select("conv_id", "turn", "part", *(F.when(turn, F.col(c)).alias(c) for c in ("segment", "loss_from", "loss_to")), "fingerprint", "layout", "rejected")


#: Conversation -7: a user, then an assistant row, both with a text full of control strings.
TRICKY = "\\### Assistant: </turn> ok"


def _record(layout: F.Column) -> F.Column:
    """A turn as a JSON record in one of five layouts; roles that a layout would rename are written in the first."""
    keep = {"ignoreNullFields": "false"}
    name = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    content = F.struct("role", F.col("text").alias("content"))
    plain = F.to_json(F.struct("role", "text"), keep)
    usual = F.coalesce(F.col("role").isin("user", "assistant", "system"), F.lit(False))
    return (
        F.when((layout == 1) & usual, F.to_json(F.struct("role", F.col("text").alias("content")), keep))
        .when((layout == 2) & usual, F.to_json(F.struct(F.array(content).alias("messages")), keep))
        .when((layout == 3) & usual, F.to_json(F.struct(F.array(F.struct(name.alias("from"), F.col("text").alias("value"))).alias("conversations")), keep))
        .when((layout == 4) & usual, F.to_json(F.struct(F.col("conv_id").alias("id"), F.array(content).alias("messages")), keep))
        .otherwise(plain)
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, read back from the formatted text.

    Rows are given as records in five layouts, by a hash of conversation and turn, and come back through their mappings.
    Null roles and texts are empty; a null conv_id is one conversation, and null turns come first.
    """
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    rows = rows.unionByName(more)
    records = rows.select("conv_id", "turn", _record(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5))).alias("record"))
    return read_back(format_conversations(records))


_ESC = "replace(replace(replace(replace({}, '\\', '\\\\'), '<turn:', '\\o'), '</turn>', '\\c'), '>' || chr(10), '\\n')"
ORACLE_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}')
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(length({_ESC.format("role")}) + length({_ESC.format("text")}) + 16) AS BIGINT) AS formatted_chars,
       CAST(0 AS BIGINT) AS n_rejected
FROM c GROUP BY conv_id
"""
