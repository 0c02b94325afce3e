"""Chat formatting by a grammar round trip, in DataFrame functions only.

Grammar of the output::

    conversation := turn*
    turn         := "### " role ": " body "</turn>" LF
    role         := letters, digits and "_"  |  "\\" hex of its UTF-8 bytes
    body         := text without control strings that doesn't start with "\\"  |  "\\" escaped text

A text that holds a control string, ``</turn>`` or ``### ``, or starts with a
backslash, is escaped. Each turn is then rendered and parsed by the grammar;
where the parse isn't the turn itself, its text is escaped as well. The whole
conversation is parsed last; should that differ, all its texts are escaped. In escaped
text a backslash is doubled, and ``</turn>`` and ``### `` become ``\\t`` and
``\\h``, so no control string is left and the way back is unique.

Defined cases: null role or text count as empty; rows of one conversation are
ordered by turn (nulls first), then role and text, and repeated rows are
repeated turns; an empty table gives no rows; a null conv_id is a conversation
of its own; other columns are ignored. A conversation is one output row, so
its turns meet in one task by definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

END = "</turn>\\n"  # as SQL literal


def _escape(x: str) -> str:
    return rf"concat('\\', replace(replace(replace({x}, '\\', '\\\\'), '</turn>', '\\t'), '### ', '\\h'))"


def _unescape(x: str) -> str:
    return (
        rf"if(startswith({x}, '\\'), array_join(transform(split(substr({x}, 2), '\\\\\\\\'),"
        rf" y -> replace(replace(y, '\\h', '### '), '\\t', '</turn>')), '\\'), {x})"
    )


def _parse(x: str) -> str:
    """SQL for the turns of formatted text ``x``: an array of (role, text)."""
    cut = "locate(': ', s, 5)"
    role = f"substr(s, 5, {cut} - 5)"
    return (
        f"transform(filter(split({x}, '{END}'), s -> s <> ''), s -> named_struct("
        rf"'role', if(startswith({role}, '\\'), decode(unhex(substr({role}, 2)), 'UTF-8'), {role}),"
        f" 'text', {_unescape(f'substr(s, {cut} + 2)')}))"
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans, turns.

    spans: (turn index, start, length) in code points of the assistants' bodies,
    the part under the loss mask. turns: what the parser reads from formatted.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    plain = rows.withColumn("__r", F.expr("if(role rlike '^[A-Za-z0-9_]+$', role, concat('\\\\', hex(encode(role, 'UTF-8'))))"))
    told = plain.withColumn("__try", F.expr(rf"if(startswith(text, '\\') or contains(text, '</turn>') or contains(text, '### '), {_escape('text')}, text)"))
    tried = told.withColumn("__one", F.expr("concat('### ', __r, ': ', __try, '</turn>\\n')"))
    turn = tried.withColumn(
        "__body",
        F.expr(f"if({_parse('__one')} = array(named_struct('role', role, 'text', text)), __try, {_escape('text')})"),
    )
    conv = (
        turn.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "__r", "__body"))).alias("__t"))
        .withColumn("__f", F.expr("array_join(transform(__t, x -> concat('### ', x.__r, ': ', x.__body, '</turn>\\n')), '')"))
        .withColumn("__ok", F.expr(f"{_parse('__f')} = transform(__t, x -> named_struct('role', x.role, 'text', x.text))"))
    )
    body = f"if(__ok, x.__body, {_escape('x.text')})"
    return (
        conv.withColumn("__b", F.expr(f"transform(__t, x -> named_struct('role', x.role, 'r', x.__r, 'body', {body}))"))
        .withColumn("formatted", F.expr("array_join(transform(__b, x -> concat('### ', x.r, ': ', x.body, '</turn>\\n')), '')"))
        .withColumn("turns", F.expr(_parse("formatted")))
        .withColumn("__len", F.expr("transform(__b, x -> 14 + char_length(x.r) + char_length(x.body))"))
        .withColumn(
            "spans",
            F.expr(
                "filter(aggregate(arrays_zip(__b, __len), named_struct('at', 0, 'k', 0, 'out', cast(array() as array<struct<turn:int,start:int,length:int,role:string>>)),"
                " (a, z) -> named_struct('at', a.at + z.__len, 'k', a.k + 1, 'out', array_append(a.out, named_struct("
                "'turn', a.k, 'start', a.at + 6 + char_length(z.__b.r), 'length', char_length(z.__b.body), 'role', z.__b.role))),"
                " a -> a.out), s -> s.role = 'assistant')"
            ),
        )
        .select("conv_id", "formatted", "spans", "turns")
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(
        r"SELECT -7L AS conv_id, turn, role, '\\### Assistant: </turn> ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    # the text under the loss mask, cut from the formatted text itself
    said = F.expr(f"array_join(transform(transform(spans, s -> substr(formatted, s.start + 1, s.length)), b -> {_unescape('b')}), '')")
    return (
        format_chats(told.unionByName(extra))
        .select("conv_id", "turns", said.alias("__loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.expr("array_join(transform(turns, x -> concat(x.role, '\\n', x.text, '\\n')), '')"), 256).alias("turns_sha256"),
            F.char_length("__loss").cast("long").alias("loss_chars"),
            F.sha2("__loss", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
t AS (SELECT *, CASE WHEN starts_with(text, '\') OR contains(text, '</turn>') OR contains(text, '### ')
                THEN '\' || replace(replace(replace(text, '\', '\\'), '</turn>', '\t'), '### ', '\h') ELSE text END AS body,
             CASE WHEN regexp_full_match(role, '[A-Za-z0-9_]+') THEN role ELSE '\' || hex(role) END AS r FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(r) + length(body))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""
