"""Chat formatting: a visitor flattens typed parts, a template marks turns, control strings are escaped reversibly.

A turn's content is an array of typed parts (struct<type, text, ref>), one text part for a plain text, and always goes through
``flatten_parts``. Rows of a conversation are ordered by turn (null first), then role, text and references; a null text or role is
empty; rows that repeat a turn all stay; a null conv_id is a conversation of its own. An empty table gives no conversations, a
long text one long segment, and other columns are not read. Each turn is one segment

    <|turn|>role NEWLINE content <|end|> NEWLINE

in which a backslash stands inside every control string of a text, behind its first character, so that none is left whole; backslashes
are doubled, and one stands before a line end inside a role. Placeholders of attachments are put in after that and stay whole, so the
same characters in a text differ from one. The loss mask covers the content of assistant turns, counted without placeholders.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.llm.common import partitions, read_table

START, END = "<|turn|>", "<|end|>\n"
LEARNED = "assistant"
#: Tokens that stand for one attachment of a type, whatever its size: parts don't carry sizes. Parts of any type but these and text are ``other``.
EXPANDED = {"image": 576, "audio": 188, "document": 256, "other": 256}

_CONTROL = re.compile(r"\\|<(?=\||/?s>)|\[(?=/?INST\])")
_PLACE = r"<\|(?:" + "|".join(EXPANDED) + r"):[0-9]+\|>"
_ESCAPED = re.compile(r"\\(\\?)")
_SEGMENT = re.compile(r"<\|turn\|>((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.|<(?!\|)|" + _PLACE + r")*)<\|end\|>\n", re.DOTALL)
_PLACES = re.compile("(" + _PLACE + ")")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The segment of a turn of plain text and the code points [start, end) of it that are learned."""
    return segment_of(role, escape(text))


def segment_of(role: str, body: str) -> tuple[str, int, int]:
    """The same for content that ``flatten_parts`` made, with escaped texts."""
    head = START + escape(role).replace("\n", "\\\n") + "\n"
    return head + body + END, len(head), len(head) + (len(body) if role == LEARNED else 0)


def read_segment(segment: str) -> tuple[str, str]:
    """The role and text of a rendered turn, with placeholders."""
    role, pieces = read_pieces(segment)
    return role, "".join(pieces)


def read_pieces(segment: str) -> tuple[str, list[str]]:
    """The role of a rendered turn and its content: texts at even places, placeholders at odd ones."""
    found = _SEGMENT.fullmatch(segment)
    if found is None:
        raise ValueError("not a turn: " + segment[:80])
    return unescape(found[1]), split_content(found[2])


def split_content(body: str) -> list[str]:
    """Texts and, between them, placeholders. Escaped texts hold none."""
    return [x if k % 2 else unescape(x) for k, x in enumerate(_PLACES.split(body))]


def text_part(text: Column) -> Column:
    """The parts of a plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref")))


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL.pattern, r"$0\\")


def flatten_parts(parts: Column) -> Column:
    """Visit typed parts in order: a struct of the text with placeholders, attachment references and expanded token count.

    Text parts give their text, escaped; neighbours are joined before that, so no control string arises between them. Image,
    audio and document parts give ``<|type:n|>``, n from 0 in order, and parts of any other type, or none, ``<|other:n|>``; a part without a reference
    gives its text instead. Null parts are none, and a null array gives an empty text.
    """
    tokens = F.create_map(*[x for k, v in EXPANDED.items() for x in (F.lit(k), F.lit(v))])
    start = F.struct(F.lit("").alias("text"), F.lit("").alias("open"), F.array().cast("array<string>").alias("refs"), F.lit(0).cast("long").alias("attachment_tokens"))
    closed = lambda state: F.concat(state["text"], _escaped(state["open"]))

    def visit(state: Column, part: Column) -> Column:
        kind = F.when(part["type"].isin(*EXPANDED), part["type"]).otherwise("other")
        attached = F.struct(
            F.concat(closed(state), F.lit("<|"), kind, F.lit(":"), F.size(state["refs"]).cast("string"), F.lit("|>")).alias("text"),
            F.lit("").alias("open"),
            F.array_append(state["refs"], F.coalesce(part["ref"], part["text"], F.lit(""))).alias("refs"),
            (state["attachment_tokens"] + F.element_at(tokens, kind)).alias("attachment_tokens"),
        )
        joined = F.concat(state["open"], F.coalesce(part["text"], F.lit(""))).alias("open")
        plain = F.struct(state["text"].alias("text"), joined, state["refs"].alias("refs"), state["attachment_tokens"].alias("attachment_tokens"))
        return F.when(part.isNull(), state).when(part["type"] == "text", plain).otherwise(attached)

    def finish(state: Column) -> Column:
        return F.struct(closed(state).alias("text"), state["refs"].alias("refs"), state["attachment_tokens"].alias("attachment_tokens"))

    return F.aggregate(F.coalesce(parts, F.array().cast("array<struct<type:string,text:string,ref:string>>")), start, visit, finish)


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn of (conv_id, turn, role, parts): conv_id, turn, its segment, the learned span inside it, references and expanded token count."""

    @F.pandas_udf("segment string, loss_start long, loss_end long")
    def rendered(role: pd.Series, body: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([segment_of(r, b) for r, b in zip(role, body)], columns=["segment", "loss_start", "loss_end"])

    role = F.coalesce(F.col("role"), F.lit("")).alias("role")
    flat = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role, flatten_parts(F.col("parts")).alias("f"))
    return flat.select("conv_id", "turn", rendered(F.col("role"), F.col("f.text")).alias("s"), "f.refs", "f.attachment_tokens").select("conv_id", "turn", "s.*", "refs", "attachment_tokens")


DIGEST = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long, attachments_sha256 string"


def digest_conversations(segments: DataFrame) -> DataFrame:
    """Read conversations back from their segments, a turn at a time, so that a long one needs no more memory than a batch.

    attachments_sha256 covers each turn's number, placeholders with the lengths of the texts before them, and references; it is
    what tells a placeholder from the same characters in a text.
    """

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def new() -> tuple:
            return 0, 0, 0, 0, 0, hashlib.sha256(), hashlib.sha256(), hashlib.sha256()

        def row() -> tuple:
            return key, n, turns.hexdigest(), loss, learned.hexdigest(), chars, attached, tokens, places.hexdigest()

        started, key = False, None
        n, chars, loss, attached, tokens, turns, learned, places = new()
        for batch in batches:
            done = []
            for conv, segment, start, end, refs, more in zip(*(batch[c] for c in ("conv_id", "segment", "loss_start", "loss_end", "refs", "attachment_tokens"))):
                if not started or conv != key:
                    if started:
                        done.append(row())
                    started, key = True, conv
                    n, chars, loss, attached, tokens, turns, learned, places = new()
                role, pieces = read_pieces(segment)
                turns.update(f"{role}\n{''.join(pieces)}\n".encode())
                kept = "".join(split_content(segment[start:end])[::2])
                learned.update(kept.encode())
                for text, place, ref in zip(pieces[::2], pieces[1::2], refs):
                    places.update(f"{n}\n{len(text)}\n{place}\n{len(ref)}\n{ref}\n".encode())
                n, chars, loss, attached, tokens = n + 1, chars + len(segment), loss + len(kept), attached + len(refs), tokens + more
            yield _frame(done)
        if started:
            yield _frame([row()])

    # As text, an id that may be null goes through pandas whole.
    segments = segments.withColumn("conv_id", F.col("conv_id").cast("string"))
    dealt = segments.repartition(partitions(segments.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "segment", "refs")
    return dealt.mapInPandas(digests, DIGEST).withColumn("conv_id", F.col("conv_id").cast("long"))


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in DIGEST.split(", ")])


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    told = turns.unionByName(more).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
    # The table has no attachments, and the SQL no columns for them.
    return digest_conversations(format_turns(told)).drop("n_attachments", "attachment_tokens", "attachments_sha256")


_SQL_ESCAPE = r"regexp_replace(regexp_replace(regexp_replace({x}, '\\', '\\\\', 'g'), '<(\||/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g')"


def sql() -> str:
    """The same rows for DuckDB."""
    body, head = _SQL_ESCAPE.format(x="text"), "replace(" + _SQL_ESCAPE.format(x="role") + r", chr(10), '\' || chr(10))"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, {len(START) + 1 + len(END)} + length({head}) + length({body}) AS chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = '{LEARNED}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = '{LEARNED}'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id"""
