"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; an array
aggregation merges adjacent turns of one role into a block, in which a control
string keeps them apart; blocks are concatenated, and a second aggregation adds
up where each turn ends.

    <|im_start|>user\n first <|im_turn|> second <|im_end|>\n        (no spaces)

All control strings begin with ``<|``.  Texts and roles are escaped (``&`` to
``&amp;``, then ``<|`` to ``&lt;|``; a role's line feeds to ``&nl;``), so no
text can hold one, and unescaping gives the text back.  The loss mask is a list
of code point spans of the output that cover the assistant turns.

Defined cases.  Null text or role: empty.  Equal turn numbers: ordered by role,
then text; repeated rows are turns of their own.  A null turn number sorts
first, a null conversation id is a conversation.  Empty table: empty result.
Only the four named columns are read.  A conversation is one output string, so
it has to fit into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TURN, END = "<|im_start|>", "<|im_turn|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


BLOCKS = """
aggregate(turns, cast(array() AS array<struct<role:string,bodies:array<string>>>), (blocks, t) ->
  CASE WHEN try_element_at(blocks, -1).role = t.role
    THEN concat(slice(blocks, 1, size(blocks) - 1), array(named_struct('role', t.role, 'bodies', concat(try_element_at(blocks, -1).bodies, array(t.body)))))
    ELSE concat(blocks, array(named_struct('role', t.role, 'bodies', array(t.body)))) END)
"""
#: The end of every turn's body in its conversation, from the parts (lead, body) in order.
STOPS = """
aggregate(parts, cast(array() AS array<int>), (stops, p) ->
  concat(stops, array(coalesce(try_element_at(stops, -1), 0) + char_length(p.lead) + char_length(p.body))))
"""


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): the formatted conversation and the spans (start, stop) to learn from."""
    none = F.lit("")
    role, text = F.coalesce(F.col(role_col), none), F.coalesce(F.col(text_col), none)
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), escape(text).alias("body")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv_id", F.expr(BLOCKS).alias("blocks"))
    head = lambda r: F.concat(F.lit(START), F.replace(escape(r), F.lit("\n"), F.lit("&nl;")), F.lit("\n"))
    first = lambda b, i: F.concat(F.when(i > 0, F.lit(END)).otherwise(none), head(b["role"]))
    parts = F.flatten(F.transform("blocks", lambda b, i: F.transform(b["bodies"], lambda x, j: F.struct(b["role"].alias("role"), F.when(j > 0, F.lit(TURN)).otherwise(first(b, i)).alias("lead"), x.alias("body")))))
    chats = chats.select("conv_id", parts.alias("parts")).select("conv_id", "parts", F.expr(STOPS).alias("stops"))
    formatted = F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["lead"], p["body"])), ""), F.lit(END))
    placed = F.zip_with("parts", "stops", lambda p, stop: F.struct(p["role"].alias("role"), (stop - F.char_length(p["body"])).alias("start"), stop.alias("stop")))
    spans = F.transform(F.filter(placed, lambda p: p["role"] == learn), lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop")))
    return chats.select("conv_id", formatted.alias("formatted"), spans.alias("loss"))


def read_chats(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, learned): the turns (role, text) and the unescaped texts under the loss mask, from the output alone."""
    blocks = F.filter(F.split("formatted", r"\Q<|im_end|>\E\n"), lambda b: b != "")
    bodies = F.transform(
        blocks,
        lambda b: F.struct(
            unescape(F.replace(F.substring_index(F.substring(b, F.lit(len(START) + 1), F.char_length(b)), "\n", 1), F.lit("&nl;"), F.lit("\n"))).alias("role"),
            F.split(F.substring(b, F.instr(b, F.lit("\n")) + 1, F.char_length(b)), r"\Q<|im_turn|>\E").alias("texts"),
        ),
    )
    turns = F.flatten(F.transform(bodies, lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), unescape(t).alias("text")))))
    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"])))
    return chats.select("conv_id", "formatted", turns.alias("turns"), learned.alias("learned"))


def digests(chats: DataFrame) -> DataFrame:
    """The digest columns of formatted chats, read back from the output."""
    back = read_chats(chats)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS was,
    replace(replace(text, '&', '&amp;'), '<|', '&lt;|') AS body,
    '<|im_start|>' || replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&nl;') || chr(10) AS head
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  (sum(length(body) + CASE WHEN was IS NULL THEN length(head) WHEN was = role THEN length('<|im_turn|>') ELSE length('<|im_end|>') + 1 + length(head) END) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
