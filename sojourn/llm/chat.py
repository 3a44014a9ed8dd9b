r"""Chat formatting with typed content parts.

A turn's content is an array of parts (`PART`). A visitor flattens them in order: text is escaped, each image, audio and
document part becomes a placeholder, and its reference and expanded token count are recorded. A turn is rendered as

    <|im_start|>role\ncontent<|im_end|>\n

Inside texts every ``<``, backslashes, ``|`` gets one more backslash, so no control string survives in a text and the step
can be undone. Roles also have backslash and newline escaped. Rendering needs no shuffle: a conversation is the concatenation
of its turns' segments in the order of (turn, segment).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Expanded tokens: one for each image patch of this many pixels a side, audio frames a second, tokens a page.
PATCH, FRAMES, PAGE = 28, 25, 576


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def text_part(text: Column) -> Column:
    """One text part, as turns with plain texts have it."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"), null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages")))


def visit(part: Column) -> Column:
    """What a part becomes: its placeholder, or for text and any unknown kind the escaped text."""
    out = escape(F.coalesce(part["text"], F.lit("")))
    for kind, mark in PLACEHOLDERS.items():
        out = F.when(part["kind"] == kind, F.lit(mark)).otherwise(out)
    return out


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder stands for; 0 for text, whose tokens the tokenizer counts."""
    patches = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    count = F.when(part["kind"] == "image", patches).when(part["kind"] == "audio", F.ceil(part["seconds"] * FRAMES)).when(part["kind"] == "document", part["pages"] * PAGE)
    return F.coalesce(count, F.lit(0)).cast("long")


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per turn: conv_id, turn, segment, loss_start, loss_end (code points in the segment; null but for the assistant),
    attachments array<struct<at, kind, ref, tokens>>, expanded_tokens.

    Null role or parts count as empty, null conv_id is a conversation of its own, an empty table gives no rows; further columns
    are ignored. Repeated rows are repeated turns.
    """
    content = F.array_join(F.transform(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), visit), "")
    shown = F.filter(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), lambda p: p["kind"].isin(*PLACEHOLDERS))
    head = F.concat(F.lit(START), escape_role(F.coalesce(F.col(role), F.lit(""))), F.lit("\n"))
    out = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), head.alias("head"), content.alias("content"), (F.col(role) == "assistant").alias("learn"),
                       F.transform(shown, lambda p, i: F.struct(i.alias("at"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"))).alias("attachments"))
    start = F.when(F.col("learn"), F.char_length("head"))
    return out.select("conv_id", "turn", F.concat("head", "content", F.lit(END + "\n")).alias("segment"), start.cast("long").alias("loss_start"), (start + F.char_length("content")).cast("long").alias("loss_end"), "attachments",
                      F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"))


def parse_segment(segment: str) -> tuple[str, str]:
    """Role and text of a rendered turn; placeholders stay in the text. What isn't a rendered turn is a text without a role."""
    end = segment.find("\n")
    if end < 0 or not (segment.startswith(START) and segment.endswith(END + "\n") and end < len(segment) - len(END) - 1):
        return "", segment
    return unescape_role(segment[len(START) : end]), unescape(segment[end + 1 : -len(END) - 1])


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running digests over rows that come sorted by conversation: memory holds one turn, whatever a conversation's length."""
    none, key, state, out = object(), None, None, []
    key = none

    def close() -> None:
        if key is not none:
            out.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def batch() -> pa.RecordBatch:
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*out), kinds)], names=names)

    for b in batches:
        for conv, segment, start, end in zip(*(b.column(n).to_pylist() for n in ("conv_id", "segment", "loss_start", "loss_end"))):
            if conv != key or key is none:
                close()
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse_segment(segment)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if start is not None:
                learnt = unescape(segment[start:end])
                state[2] += len(learnt)
                state[3].update(learnt.encode())
            state[4] += len(segment)
        if len(out) >= 5000:
            yield batch()
            out.clear()
    close()
    if out:
        yield batch()


def read_back(segments: DataFrame) -> DataFrame:
    """Parse rendered turns and return each conversation's counts and digests (`READ`), turns in the order of (turn, segment), nulls first."""
    rows = segments.select("conv_id", "turn", "segment", "loss_start", "loss_end")
    return rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "segment").mapInArrow(_read, READ)


