r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context, and only that reply lies under the loss mask. Turns that follow the
last reply (or a conversation without one) become one more example without a
mask, so that no turn is lost.

Template of a turn: ``<turn>role\ntext</turn>\n``. Inside a role or text ``\``
and ``<`` get a backslash, and a role's line ends are written ``\n``; a bare
``<`` therefore only ever starts a marker, and :func:`read_example` reverses it.

Defined results: turns are ordered by turn, role, text with nulls first; null
roles and texts are empty; rows that repeat count as turns; rows with a null
conv_id form one conversation; an empty table gives no example. Other columns
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.text import map_arrow

EXAMPLE_CHARS = 1 << 22  # characters of examples in one Arrow batch
SCHEMA = "conv_id long, example int, text string, loss_start int, loss_end int"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<turn>((?:[^\\<\n]|\\.)*)\n((?:[^\\<]|\\.)*)</turn>\n", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    out = text.replace("\\", "\\\\").replace("<", "\\<")
    return out.replace("\n", "\\n") if role else out


def unescape(text: str, role: bool = False) -> str:
    return _ESCAPED.sub(lambda m: "\n" if role and m[1] == "n" else m[1], text)


def read_example(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted example."""
    return [(unescape(r, True), unescape(t)) for r, t in _TURN.findall(text)]


def _examples(turns: list[tuple[str, str]]) -> Iterator[tuple[str, int | None, int | None]]:
    context, length, pending = [], 0, False
    for role, text in turns:
        head, body = f"<turn>{escape(role, True)}\n", escape(text)
        start = length + len(head)
        context.append(f"{head}{body}</turn>\n")
        length += len(context[-1])
        pending = role != "assistant"
        if not pending:
            yield "".join(context), start, start + len(body)
    if pending:
        yield "".join(context), None, None


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
    rows: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for found in batches:
        for conv_id, turns in zip(found.column("conv_id").to_pylist(), found.column("turns"), strict=True):
            for k, (text, start, end) in enumerate(_examples([(x["role"], x["text"]) for x in turns.as_py()])):
                rows.append((conv_id, k, text, start, end))
                size += len(text)
                if size > EXAMPLE_CHARS:
                    yield batch()
                    rows, size = [], 0
    if rows:
        yield batch()


def expand(conversations: DataFrame) -> DataFrame:
    """Examples: conv_id, example (from 0), text, loss_start, loss_end (code points; null without a target)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return map_arrow(grouped, _expand, SCHEMA)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns, losses = [], []
        for text, start, end in zip(*(batch.column(c).to_pylist() for c in ("last", "loss_start", "loss_end")), strict=True):
            turns.append(read_example(text))
            losses.append(unescape(text[start:end]) if start is not None else "")
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("example"), pa.array([len(x) for x in turns], pa.int64()), pa.array(["".join(f"{r}\n{t}\n" for r, t in x) for x in turns]), pa.array(losses, pa.string()), pa.array([len(x) for x in batch.column("last").to_pylist()], pa.int64())],
            ["conv_id", "example", "n_turns", "turns", "loss", "formatted_chars"],
        )


def summarise(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from its examples."""
    read = map_arrow(examples.withColumnRenamed("text", "last").select("conv_id", "example", "last", "loss_start", "loss_end"), _read, "conv_id long, example int, n_turns long, turns string, loss string, formatted_chars long")
    # the example with the most turns is the last; only it is carried on as a whole
    own = read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max_by(F.sha2("turns", 256), "example").alias("turns_sha256"),
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"])).alias("loss"),
        F.sum("formatted_chars").alias("formatted_chars"),
    )
    return own.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


QUERY_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, 15 + length(replace(replace(replace(role, '\', '\\'), '<', '\<'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<', '\<')) AS chars FROM c),
p AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) = 1 AS is_last FROM f)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
