r"""Chat formatting by schema fingerprints.

A record is a JSON object of any layout. Its nested field paths (``messages[].role``)
are hashed to a fingerprint; the fingerprint selects one of the declarative
``LAYOUTS``, which says where the turns lie: a role and a path, or a list whose
elements hold roles and texts. A fingerprint is matched with the layouts once per
task and looked up after that. ``record_of`` makes records of typed columns.

The template writes a turn as ``<|turn|>role<|text|>text<|end|>`` and a line end.
Inside roles and texts ``\`` becomes ``\\`` and ``<|`` becomes ``<\|``, so no
control string is left in them and removing the escapes gives the text back.
The loss mask of a formatted string is a list of spans of code points, one for
each assistant text, without the marks around it.

Records are ordered by conversation and place with a range partitioning on all
of it, and each task joins neighbouring turns of a conversation into segments
of about ``SEGMENT`` code points. So a conversation that holds a third of all
turns is written by many tasks, and none holds more than one segment.

Defined results: a record that is null, not a JSON object, or of no known layout has
layout ``none`` and no turns (``rejected`` lists it); null, missing and empty roles or texts are
empty strings; numbers and truth values are their JSON text, lists of parts
their joined texts. Null places come first, equal places are ordered by role,
then by the text's MD5; rows equal in all of it stay as often as they occur. A
null conversation id is a conversation of its own. An empty table gives no
rows. Other columns are not read. A single turn is one row, however long.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm.common import batch, output_root, pieces, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Code points after which a segment of a conversation is closed.
SEGMENT = 1 << 18
ASSISTANT = "assistant"
NONE = "none"


@dataclass(frozen=True)
class One:
    """One turn: a fixed role, and the fields whose texts make it, joined by blank lines."""

    role: str
    fields: tuple[str, ...]
    optional: bool = False  # no turn if all of its fields are empty


@dataclass(frozen=True)
class Each:
    """A turn for each element of the list ``field``: its role and text fields, and other names of roles."""

    field: str
    role: str
    text: str
    names: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Pairs:
    """Two turns, of a user and an assistant, for each element of a list of pairs."""

    field: str


@dataclass(frozen=True)
class Alternate:
    """Turns of a list of texts: user and assistant in turn."""

    field: str


@dataclass(frozen=True)
class FromFields:
    """One turn whose role and text are fields of the record."""

    role: str
    text: str


@dataclass(frozen=True)
class Layout:
    """A name, the sets of paths of which one must be present, and the turns in order."""

    name: str
    needs: tuple[frozenset[str], ...]
    turns: tuple


def _needs(*sets: str) -> tuple[frozenset[str], ...]:
    return tuple(frozenset(s.split()) for s in sets)


SHARED_NAMES = (("human", "user"), ("gpt", "assistant"), ("chatgpt", "assistant"), ("bot", "assistant"))
SYSTEM = One("system", ("system",), optional=True)
#: Tried in this order; the first that fits wins.
LAYOUTS = (
    Layout("messages", _needs("messages[].role", "messages[].content"), (SYSTEM, Each("messages", "role", "content"))),
    Layout("shared", _needs("conversations[].from", "conversations[].value"), (SYSTEM, Each("conversations", "from", "value", SHARED_NAMES))),
    Layout("instruction with history", _needs("history[][] instruction", "history[][] output"), (SYSTEM, Pairs("history"), One("user", ("instruction", "input")), One("assistant", ("output",)))),
    Layout("instruction", _needs("instruction output", "instruction"), (SYSTEM, One("user", ("instruction", "input")), One("assistant", ("output",)))),
    Layout("prompt and response", _needs("prompt response"), (SYSTEM, One("user", ("prompt",)), One("assistant", ("response",)))),
    Layout("prompt and completion", _needs("prompt completion"), (SYSTEM, One("user", ("prompt",)), One("assistant", ("completion",)))),
    Layout("question and answer", _needs("question answer"), (SYSTEM, One("user", ("context", "question")), One("assistant", ("answer",)))),
    Layout("dialog", _needs("dialog[]"), (SYSTEM, Alternate("dialog"))),
    Layout("turn with content", _needs("role content"), (FromFields("role", "content"),)),
    Layout("turn", _needs("role text", "role"), (FromFields("role", "text"),)),
)


def paths(value, at: str = "") -> Iterator[str]:
    """Nested field paths with a value; a list adds ``[]``, null adds none."""
    if isinstance(value, dict):
        for name, inner in value.items():
            yield from paths(inner, f"{at}.{name}" if at else name)
    elif isinstance(value, list):
        yield f"{at}[]"
        for inner in value:
            yield from paths(inner, f"{at}[]")
    elif value is not None:
        yield at


def fingerprint(found: frozenset[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(found)).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def layout_of(found: frozenset[str], layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    return next((x for x in layouts if any(need <= found for need in x.needs)), None)


def text_of(value) -> str:
    if isinstance(value, str):
        return value
    if value is None:
        return ""
    if isinstance(value, list):
        return "".join(text_of(v.get("text") if isinstance(v, dict) else v) for v in value)
    if isinstance(value, dict):
        return text_of(value.get("text"))
    return json.dumps(value)


def turns_of(record: dict, layout: Layout) -> Iterator[tuple[str, str]]:
    """(role, text) of a record under its layout."""

    def elements(name: str) -> list:
        value = record.get(name)
        return value if isinstance(value, list) else []

    for rule in layout.turns:
        if isinstance(rule, One):
            texts = [t for f in rule.fields if (t := text_of(record.get(f)))]
            if texts or not rule.optional:
                yield rule.role, "\n\n".join(texts)
        elif isinstance(rule, Each):
            names = dict(rule.names)
            for x in elements(rule.field):
                x = x if isinstance(x, dict) else {rule.text: x}
                role = text_of(x.get(rule.role))
                yield names.get(role, role), text_of(x.get(rule.text))
        elif isinstance(rule, Pairs):
            for x in elements(rule.field):
                x = x if isinstance(x, list) else [x]
                yield from zip(("user", ASSISTANT), map(text_of, [*x, None, None][:2]), strict=True)
        elif isinstance(rule, Alternate):
            for k, x in enumerate(elements(rule.field)):
                yield ("user", ASSISTANT)[k % 2], text_of(x)
        else:
            yield text_of(record.get(rule.role)), text_of(record.get(rule.text))


def record_of(*columns) -> F.Column:
    """The columns as one JSON record; null columns are absent paths."""
    return F.to_json(F.struct(*columns))


TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("part", pa.int32()), ("fingerprint", pa.string()), ("layout", pa.string()), ("role", pa.string()), ("text", pa.string())])


def canonical(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Turns of records (conv_id, place, record): conv_id, place, part, fingerprint, layout, role, text.

    ``part`` numbers the turns of a record. A record without turns gives one
    row of null role and text, so that no record is lost unseen.
    """

    def run(batches):
        known: dict[frozenset[str], tuple[str, Layout | None]] = {}
        for rows in pieces(batches):
            out = []
            for conv_id, place, raw in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "place", "record")), strict=True):
                try:
                    record = json.loads(raw) if raw is not None else None
                except (ValueError, RecursionError):
                    record = None
                found = frozenset(paths(record)) if isinstance(record, dict) else frozenset()
                if found not in known:
                    if len(known) > 10_000:
                        known.clear()  # only a cache: the same paths give the same answer again
                    known[found] = fingerprint(found), layout_of(found, layouts)
                mark, layout = known[found]
                turns = list(turns_of(record, layout)) if layout else []
                name = layout.name if layout else NONE
                out += [(conv_id, place, k, mark, name, role, text) for k, (role, text) in enumerate(turns)] or [(conv_id, place, None, mark, name, None, None)]
            if out:
                # a lone surrogate of a JSON escape has no UTF-8 form
                clean = [(*row[:5], *(v if v is None else v.encode("utf-8", "replace").decode() for v in row[5:])) for row in out]
                yield batch(TURNS, list(zip(*clean, strict=True)))

    rows = records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("place").cast("long").alias("place"), F.col("record").cast("string").alias("record"))
    return rows.mapInArrow(run, "conv_id long, place long, part int, fingerprint string, layout string, role string, text string")


def rejected(turns: DataFrame) -> DataFrame:
    """Records of ``canonical`` that gave no turn: conv_id, place, fingerprint, layout."""
    return turns.where("part IS NULL").select("conv_id", "place", "fingerprint", "layout")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return "\\".join(x.replace("<\\|", "<|") for x in text.split("\\\\"))


SEGMENTS = pa.schema([("conv_id", pa.int64()), ("task", pa.int32()), ("segment", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])


def format_turns(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Segments of formatted conversations: conv_id, task, segment, n_turns, formatted, loss_starts, loss_ends.

    Segments of a conversation are in the order of (task, segment).
    """
    keyed = turns.where("part IS NOT NULL").select("conv_id", "place", "part", "role", "text", F.md5("text").alias("_md5"), F.monotonically_increasing_id().alias("_row"))
    order = ["conv_id", "place", "part", "role", "_md5", "_row"]
    spark = turns.sparkSession
    dealt = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def run(batches):
        task = TaskContext.get().partitionId()
        number, conv, text, starts, ends, length, n = 0, None, [], [], [], 0, 0
        for rows in pieces(batches):
            done = []
            for conv_id, role, words in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if n and (conv_id != conv or length >= segment):
                    done.append((conv, task, number, n, "".join(text), starts, ends))
                    number, text, starts, ends, length, n = number + 1, [], [], [], 0, 0
                head, body = f"{TURN}{escape(role)}{TEXT}", escape(words)
                if role == ASSISTANT:
                    starts.append(length + len(head))
                    ends.append(length + len(head) + len(body))
                text += [head, body, END]
                length += len(head) + len(body) + len(END)
                conv, n = conv_id, n + 1
            if done:
                yield batch(SEGMENTS, list(zip(*done, strict=True)))
        if n:
            yield batch(SEGMENTS, list(zip((conv, task, number, n, "".join(text), starts, ends), strict=True)))

    return dealt.mapInArrow(run, "conv_id long, task int, segment long, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>")


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted string."""
    for part in formatted.split(END)[:-1]:
        if not part.startswith(TURN):
            raise ValueError("a turn does not start with its mark")
        role, text = part[len(TURN) :].split(TEXT)
        yield unescape(role), unescape(text)


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_segments", pa.int64())])


def digests(segments: DataFrame) -> DataFrame:
    """Per conversation what its formatted segments hold, read back through the template and the loss mask."""

    def run(batches):
        conv, open_ = None, False
        for rows in pieces(batches, 16):
            done = []
            for conv_id, n, formatted, starts, ends in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "n_turns", "formatted", "loss_starts", "loss_ends")), strict=True):
                if open_ and conv_id != conv:
                    done.append((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, n_segments))
                    open_ = False
                if not open_:
                    conv, open_, n_turns, loss_chars, chars, n_segments = conv_id, True, 0, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                seen = 0
                for role, text in parse(formatted):
                    turns.update(f"{role}\n{text}\n".encode())
                    seen += 1
                if seen != n:
                    raise ValueError(f"conversation {conv_id}: {seen} of {n} turns")
                for start, end in zip(starts, ends, strict=True):
                    text = unescape(formatted[start:end])
                    loss.update(text.encode())
                    loss_chars += len(text)
                n_turns, chars, n_segments = n_turns + n, chars + len(formatted), n_segments + 1
            if done:
                yield batch(DIGESTS, list(zip(*done, strict=True)))
        if open_:
            yield batch(DIGESTS, list(zip((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, n_segments), strict=True)))

    dealt = segments.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "task", "segment")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_segments long")


def write_chat(records: DataFrame, root: str, segment: int = SEGMENT) -> None:
    """Write the formatted conversations of ``records`` (conv_id, place, record) as Parquet below ``root``."""
    format_turns(canonical(records), segment).write.parquet(root)


def conversation_records(conversations: DataFrame) -> DataFrame:
    """Rows of a conversation table (conv_id, turn, role, text) as records of the layout ``turn``."""
    record = record_of(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.select("conv_id", F.col("turn").alias("place"), record.alias("record"))


#: A conversation whose texts hold escapes and marks, as a record of another layout.
PROBE = r"\### Assistant: </turn> ok"


def probe_record(spark: SparkSession) -> DataFrame:
    record = json.dumps({"messages": [{"role": "user", "content": PROBE}, {"role": ASSISTANT, "content": PROBE}]})
    return spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("place"), F.lit(record).alias("record"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = conversation_records(table(spark, sf_dir, "conversations")).unionByName(probe_record(spark))
    root = output_root(spark, "chat")
    write_chat(records, root)
    return digests(spark.read.parquet(root)).drop("n_segments")


QUERIES = {"op12_chat_format": op12_chat_format}

SQL = {
    "op12_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(role, '\', '\\'), '<|', '<\|') AS er, replace(replace(text, '\', '\\'), '<|', '<\|') AS et FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|>') + length(er) + length('<|text|>') + length(et) + length('<|end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
}
