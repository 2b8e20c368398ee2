"""Chat formatting with a grammar round trip.

Grammar of the rendered text (``turn*``), with one production for each kind of role:

    user       <s>[INST] text [/INST]
    assistant  <s>text</s>
    other      <s><<SYS>>role<|>text<</SYS>>

The parser is deterministic: after ``<s>`` the next control string tells the production, and the text
ends at the first closing string of it. Rendering first tries the text as it is, reparses it, and
compares the recovered turn with the source; if they differ, the text's control strings get one more
backslash after their first character (``<\\s>``), which the parser takes off again, until the turn
comes back identical. As each turn is a prefix that the parser consumes on its own, turns are rendered and
reparsed where they are read, in any order. Only a conversation's digests need its turns in order: they are
sequential hashes, so a conversation is streamed through one task, which does nothing but hash.

The loss mask covers exactly the assistant texts, in code points of the rendered turn.

Defined results: a null role or text is the empty one; an empty role is an ``other`` turn; turns are
ordered by turn (nulls first), then by role and text, so repeated rows are repeated turns; a null
conversation id is one conversation. Of the input only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BOS, EOS, OPEN, CLOSE, SYS, ENDSYS, BAR = "<s>", "</s>", "[INST] ", " [/INST]", "<<SYS>>", "<</SYS>>", "<|>"
#: A control string, with any backslashes that escapes have put after its first character.
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|\|>)")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: f"{m[1]}\\{m[2]}{m[3]}", text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: f"{m[1]}{m[2][1:]}{m[3]}", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A rendered turn, and where its text begins and ends in it; escaped only as far as reparsing needs."""
    kind, body = role, text
    while True:
        if role == "user":
            head, tail = BOS + OPEN, CLOSE
        elif role == "assistant":
            head, tail = BOS, EOS
        else:
            head, tail = f"{BOS}{SYS}{kind}{BAR}", ENDSYS
        out = head + body + tail
        try:
            got, end = parse_turn(out, 0)
        except ValueError:
            got, end = None, -1
        if got is not None and end == len(out) and got[:2] == (role, text):
            return out, len(head), len(head) + len(body)
        kind, body = escape(kind), escape(body)


def parse_turn(rendered: str, at: int) -> tuple[tuple[str, str, int, int], int]:
    """The turn that begins at ``at``, as (role, text, where its text begins, and ends), and where it ends."""
    if not rendered.startswith(BOS, at):
        raise ValueError(f"no turn at {at}")
    at += len(BOS)
    if rendered.startswith(OPEN, at):
        role, at, tail = "user", at + len(OPEN), CLOSE
    elif rendered.startswith(SYS, at):
        bar = rendered.find(BAR, at)
        if bar < 0:
            raise ValueError(f"no role at {at}")
        role, at, tail = unescape(rendered[at + len(SYS) : bar]), bar + len(BAR), ENDSYS
    else:
        role, tail = "assistant", EOS
    end = rendered.find(tail, at)
    if end < 0:
        raise ValueError(f"unclosed turn at {at}")
    return (role, unescape(rendered[at:end]), at, end), end + len(tail)


def parse(rendered: str) -> Iterator[tuple[str, str, int, int]]:
    at = 0
    while at < len(rendered):
        turn, at = parse_turn(rendered, at)
        yield turn


def render(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: (conv_id, turn, formatted, loss_from, loss_to).

    ``formatted`` in order of ``turn`` is the conversation; ``loss_from`` and ``loss_to`` bound the
    text under the loss mask in it, null where the turn has none.
    """
    rows = conversations.select(F.col(key).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    @F.arrow_udf("struct<formatted: string, loss_from: long, loss_to: long>")
    def rendered(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for roles, texts in parts:
            at = 0
            for part in slices(texts):
                out = []
                for role, text in zip(roles[at : at + len(part)].to_pylist(), part.to_pylist()):
                    made, begin, end = render_turn(role, text)
                    out.append((made, begin, end) if role == "assistant" else (made, None, None))
                at += len(part)
                made, begin, end = zip(*out) if out else ((), (), ())
                yield pa.StructArray.from_arrays([pa.array(made, pa.string()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["formatted", "loss_from", "loss_to"])

    return rows.select("conv_id", "turn", rendered("role", "text").alias("r")).select("conv_id", "turn", "r.*")


def recovered(rendered: DataFrame) -> DataFrame:
    """(conv_id, turn, said, loss_at, n, chars): the turns that a rendered row parses to, from its text alone.

    ``said`` holds role, line break, text and line break of each; ``loss_at`` is where the text under the loss mask
    begins in it, null without one; ``n`` counts the turns and ``chars`` the rendered characters.
    """

    @F.arrow_udf("struct<said: string, loss_at: long, n: long, chars: long>")
    def parsed(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, begins, ends in parts:
            at = 0
            for part in slices(texts):
                out, to = [], at + len(part)
                for formatted, begin, end in zip(part.to_pylist(), begins[at:to].to_pylist(), ends[at:to].to_pylist()):
                    turns = list(parse(formatted))
                    said = "".join(f"{role}\n{text}\n" for role, text, _, _ in turns)
                    if begin is not None and unescape(formatted[begin:end]) != turns[0][1]:  # what the mask covers, by its offsets
                        raise ValueError("the loss mask does not cover the assistant's text")
                    out.append((said, None if begin is None else len(turns[0][0]) + 1, len(turns), len(formatted)))
                at = to
                said, loss, n, chars = zip(*out) if out else ((), (), (), ())
                yield pa.StructArray.from_arrays([pa.array(said, pa.string()), pa.array(loss, pa.int64()), pa.array(n, pa.int64()), pa.array(chars, pa.int64())], ["said", "loss_at", "n", "chars"])

    return rendered.select("conv_id", "turn", parsed("formatted", "loss_from", "loss_to").alias("r")).select("conv_id", "turn", "r.*")


def read_back(rendered: DataFrame) -> DataFrame:
    """Reparse rendered conversations: one row of digests for each, from the rendered text alone.

    Columns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in schema.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, out = None, None, []
        close = lambda: (last, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        for batch in parts:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                for conv, said, loss_at, n, chars in zip(*[part.column(c).to_pylist() for c in ("conv_id", "said", "loss_at", "n", "chars")]):
                    if state is None or conv != last:
                        if state is not None:
                            out.append(close())
                        last, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    state[0] += n
                    state[1].update(said.encode())
                    if loss_at is not None:
                        state[2] += len(said) - 1 - loss_at
                        state[3].update(said[loss_at:-1].encode())
                    state[4] += chars
                if len(out) >= 1024:
                    yield batch_of(out)
                    out = []
        if state is not None:
            out.append(close())
        if out:
            yield batch_of(out)

    # Each conversation's turns in one partition and in order, to be streamed; they are never collected.
    rows = recovered(rendered).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "said")
    return rows.mapInArrow(hashed, schema)
