"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations in sequence.  Kinds: ``message`` (a whole message), ``delta`` (text
streamed onto the end of a message), ``edit`` (a message's text, replaced) and ``regenerate`` (a
message begun anew; every later message of the conversation logged before it is dropped).  Folding by
``conv_id`` and ``message`` in order of ``seq``: events that a later regeneration of an earlier message
overtook go; of each message the last message, edit or regeneration counts, with the deltas after it.

Rendering escapes control strings reversibly and marks turns:

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

where in TEXT a backslash is doubled and ``<|`` becomes ``<\\|``, and in ROLE a line feed becomes a
backslash and n as well; so ``<|`` only occurs in marks.  One row is one turn (a fragment): a
conversation's formatted text is its fragments in order, and the loss mask covers the escaped TEXT of
assistant turns, given as start and end in code points of the fragment.

Everything runs on columns; windows over a conversation spill to disk, and no row holds more than a
message.  ``read_back`` streams sorted fragments and parses them again with constant memory.

Defined results: null text is empty, null role is an empty role, an event of null kind is a message; a
null conversation is a conversation; a delta or edit to a message never begun begins it with its own
role; of events with equal ``seq`` the order is by kind, role and text; repeated rows of a plain table
are turns of their own; columns of other names are not read; texts of any length are folded by windows that spill; an empty
log gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from claimlens.llm.common import ready

START, END = "<|im_start|>", "<|im_end|>\n"


def turns_as_events(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A plain table of turns as a log of whole messages, in order of turn, role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    plain = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return plain.withColumn("seq", F.row_number().over(order).cast("long")) \
        .select("conv_id", "seq", F.col("seq").alias("message"), F.lit("message").alias("kind"), "role", "text")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of a log (conv_id, seq, message, kind, role, text)."""
    e = events.select("conv_id", "seq", "message", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"),
                      F.coalesce("text", F.lit("")).alias("text")).filter("seq is not null and message is not null")
    earlier = Window.partitionBy("conv_id").orderBy("message").rangeBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("redone", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier)).filter("redone is null or redone < seq").drop("redone")
    first = Window.partitionBy("conv_id", "message").orderBy("seq", "kind", "role", "text")
    whole = F.col("kind") != "delta"
    e = e.withColumn("at", F.row_number().over(first))
    e = e.withColumn("base", F.max(F.when(whole, F.col("at"))).over(Window.partitionBy("conv_id", "message"))).filter("base is null or at >= base")
    parts = F.array_sort(F.collect_list(F.struct("at", "role", "text")))
    return e.groupBy("conv_id", "message").agg(parts.alias("parts")) \
        .select("conv_id", "message", F.col("parts")[0]["role"].alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, message, role, formatted fragment, and the loss span in it (equal ends: none)."""
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    start = F.length(head)
    return messages.select("conv_id", "message", F.concat(head, escape(F.col("text")), F.lit(END)).alias("formatted"), start.alias("loss_start"),
                           (start + F.when(F.col("role") == "assistant", F.length(escape(F.col("text")))).otherwise(0)).alias("loss_end"))


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def unescape_text(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def parse(fragment: str) -> tuple[str, str]:
    """Role and text of a fragment; it must be one whole turn."""
    m = _TURN.fullmatch(fragment)
    if not m or "<|" in m[1] or "<|" in m[2]:
        raise ValueError("not one formatted turn")
    return unescape(m[1]), unescape_text(m[2])


def read_back(fragments: DataFrame) -> DataFrame:
    """Per conversation, from the rendered text alone: turns and their digest, characters and digest of
    the text under the loss mask, and characters formatted."""
    ready(fragments.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def row():
            return pa.RecordBatch.from_pydict({"conv_id": [conv], "n_turns": [state[0]], "turns_sha256": [state[1].hexdigest()], "loss_chars": [state[2]],
                                               "loss_sha256": [state[3].hexdigest()], "formatted_chars": [state[4]]}, schema=schema)

        for b in batches:
            done = []
            for c, f, a, z in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        done.append(row())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(f)
                loss = unescape_text(f[a:z])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(f)
            yield from pa.Table.from_batches(done, schema).combine_chunks().to_batches()
        if state is not None:
            yield row()

    kind = dict(fragments.dtypes)["conv_id"]
    schema = pa.schema([("conv_id", pa.string() if kind == "string" else pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    rows = fragments.withColumn("conv_id", F.col("conv_id").cast("string" if kind == "string" else "long"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "message").select("conv_id", "formatted", "loss_start", "loss_end")
    return ordered.mapInArrow(run, f"conv_id {'string' if kind == 'string' else 'long'}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversations(fragments: DataFrame) -> DataFrame:
    """Whole formatted conversations, a row each."""
    parts = F.array_sort(F.collect_list(F.struct("message", "formatted")))
    return fragments.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["formatted"]), "").alias("formatted"))
