"""Chat formatting by event-sourced reconstruction.

A log holds events (conv_id, seq, turn, kind, role, text): ``delta`` appends to a message, ``edit`` replaces it,
``regenerate`` starts the message anew and drops all later turns. The log is partitioned by conversation and sorted by
sequence; an event survives unless a later regeneration of its own or an earlier turn voids it, and a message is folded
from its last replacement on. Final messages are rendered one by one:

    <|start|>role\\n escaped text <|end|>\\n          a conversation: <|begin|> messages <|done|>\\n

In texts and roles ``\\``, ``<`` and ``[`` are escaped (``\\\\``, ``\\l``, ``\\b``; in roles also line feeds, ``\\n``), so no
control string of this or another template can stand in a text, and reading is exact. The loss mask of a message is
the span of its text, for roles in LOSS_ROLES.

Windows carry one number from event to event and messages are folded by (conversation, turn); a conversation is
joined only as a stream, message by message, so one with a third of all rows needs no more memory than another.

Edge cases: null text is empty, a null role is the empty role; events without a message make one of empty text; equal
sequence numbers are taken in the order of turn, kind, role and text; rows of a table that share a turn are messages of
their own, ordered by role and text; an empty log gives no messages; further columns are ignored. A null conv_id is a
conversation of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.common import read, register

# Fixed values of the template.
BEGIN, DONE, START, END = "<|begin|>", "<|done|>\n", "<|start|>", "<|end|>\n"
LOSS_ROLES = ("assistant",)
#: A conversation whose texts look like control strings of a common template.
CONTROL = "</s>[INST] ok [/INST]"
_UNESCAPE = {"\\": "\\", "l": "<", "b": "[", "n": "\n"}


def events_of(table: DataFrame) -> DataFrame:
    """A log of a table of finished turns (conv_id, turn, role, text): each message opens with an empty replacement
    and streams in as two deltas."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long") - 1
    rows = table.select("conv_id", at.alias("at"), F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    parts = F.array(F.struct(F.lit(0).alias("k"), F.lit("edit").alias("kind"), F.lit("").alias("text")),
                    F.struct(F.lit(1).alias("k"), F.lit("delta").alias("kind"), F.substring("text", F.lit(1), half).alias("text")),
                    F.struct(F.lit(2).alias("k"), F.lit("delta").alias("kind"),
                             F.substring("text", half + 1, F.length("text")).alias("text")))
    rows = rows.withColumn("e", F.explode(parts))
    return rows.select("conv_id", (F.col("at") * 3 + F.col("e.k")).alias("seq"), F.col("at").alias("turn"), "e.kind", "role", "e.text")


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log."""
    log = events.select("conv_id", "seq", F.col("turn").cast("long").alias("turn"), "kind",
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ("seq", "turn", "kind", "role", "text")
    later = Window.partitionBy("conv_id").orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    void_from = F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later)
    live = log.withColumn("void_from", void_from).where("void_from IS NULL OR turn < void_from").drop("void_from")
    # from the newest event of a message back to its last replacement
    back = Window.partitionBy("conv_id", "turn").orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    replaced = F.max(F.when(F.col("kind").isin("edit", "regenerate"), 1)).over(back)
    live = live.withColumn("replaced", replaced).where("replaced IS NULL")
    kept = live.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("es"))
    return kept.select("conv_id", "turn", F.element_at("es", -1)["role"].alias("role"),
                       F.array_join(F.transform("es", lambda e: e["text"]), "").alias("text"))


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _UNESCAPE[m[1]], text)


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_end): the message in the template and its span under the loss mask in
    code points of ``formatted`` (both null without loss)."""
    head = F.concat(F.lit(START), escaped(F.col("role"), role=True), F.lit("\n"))
    body = escaped(F.col("text"))
    loss = F.col("role").isin(*LOSS_ROLES)
    return messages.select("conv_id", "turn", F.concat(head, body, F.lit(END)).alias("formatted"),
                           F.when(loss, F.length(head)).cast("long").alias("loss_start"),
                           F.when(loss, F.length(head) + F.length(body)).cast("long").alias("loss_end"))


def parse(formatted: str) -> tuple[str, str]:
    """(role, text) of one rendered message."""
    if not formatted.startswith(START) or not formatted.endswith(END):
        raise ValueError("not a rendered message")
    role, _, body = formatted[len(START):len(formatted) - len(END)].partition("\n")
    return unescaped(role), unescaped(body)


_DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
           "formatted_sha256 string")


class _Conversation:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss, self.chars = conv_id, 0, 0, len(BEGIN) + len(DONE)
        self.turns_sha, self.loss_sha, self.all_sha = hashlib.sha256(), hashlib.sha256(), hashlib.sha256(BEGIN.encode())

    def add(self, formatted, start, end) -> None:
        role, text = parse(formatted)
        self.turns += 1
        self.chars += len(formatted)
        self.all_sha.update(formatted.encode())
        self.turns_sha.update(f"{role}\n{text}\n".encode())
        if start is not None:
            masked = unescaped(formatted[start:end])
            self.loss += len(masked)
            self.loss_sha.update(masked.encode())

    def row(self) -> tuple:
        self.all_sha.update(DONE.encode())
        return (self.conv_id, self.turns, self.turns_sha.hexdigest(), self.loss, self.loss_sha.hexdigest(), self.chars,
                self.all_sha.hexdigest())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _DIGEST.split(", ")]
    types = [pa.string() if "sha" in n else pa.int64() for n in names]
    now, done = None, []
    for b in batches:
        for conv_id, formatted, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now is None or now.conv_id != conv_id:
                done += [now.row()] if now else []
                now = _Conversation(conv_id)
            now.add(formatted, start, end)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
            done = []
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(now.row(), types, strict=True)], names=names)


def read_back(rendered: DataFrame) -> DataFrame:
    """One row for each conversation, read from its rendered messages in the order of their turns."""
    return (rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
            .select(F.col("conv_id").cast("long").alias("conv_id"), "formatted", "loss_start", "loss_end").mapInArrow(_digests, _DIGEST))


def formatted_conversations(rendered: DataFrame) -> DataFrame:
    """(conv_id, formatted): whole conversations as strings, for logs whose conversations fit in a row."""
    parts = F.sort_array(F.collect_list(F.struct("turn", "formatted")))
    return rendered.groupBy("conv_id").agg(parts.alias("ms")).select("conv_id", F.concat(
        F.lit(BEGIN), F.array_join(F.transform("ms", lambda m: m["formatted"]), ""), F.lit(DONE)).alias("formatted"))


def _sql_escaped(text: str, role: bool = False) -> str:
    out = text
    for a, b in (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"replace({out}, chr(10), '\\n')" if role else out


ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'
), made AS (
  SELECT *, '{START}' || {_sql_escaped("role", True)} || chr(10) || {_sql_escaped("text")} || '<|end|>' || chr(10) AS formatted
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(formatted)) + {len(BEGIN) + len(DONE)} AS BIGINT) AS formatted_chars,
  sha256('{BEGIN}' || string_agg(formatted, '' ORDER BY turn, role, text) || '<|done|>' || chr(10)) AS formatted_sha256
FROM made GROUP BY conv_id"""


@register("op6_chat_format", ORACLE)
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, through log, reconstruction, template and back."""
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    return read_back(render(reconstruct(events_of(table.unionByName(control)))))
