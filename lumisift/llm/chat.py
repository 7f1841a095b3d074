"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events (conv_id, seq, msg, kind, role, text): `delta` adds text to message msg, `edit`
replaces it, `regenerate` begins it anew. An edit or a regeneration also ends the later messages
that were logged before it. Logs are dealt by conversation, sorted by sequence and folded into
final messages, which are rendered with a template and a loss mask over the assistants' texts.

The template is <|turn|>role<|says|>text<|end|> for each message. In roles and texts a backslash
is put behind every backslash and behind the first character of every control string, those of
this template (anything that begins <|) and of common others (<s>, [INST], <<SYS>> and their
ends); unescaping drops a backslash and keeps what follows it. So markers are never forged, and
the messages are read back exactly from the formatted string.

Mask entries are (turn, start, end): code points of that turn's stretch of the string, so a reader
goes through a long conversation once. One conversation is one row of output; its events are
sorted as a stream that can spill, and only its final texts are gathered.

Null texts and roles are empty. Rows with a null conv_id are one conversation. Repeated rows and
rows that share a turn are turns of their own, in order of turn, role and text. Of events that
share a seq, the one of the later message counts as later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: First characters of control strings, each by what follows it.
_CONTROL = r"\\|<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"
RESETS = ("edit", "regenerate")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def as_events(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as a log with one delta for each row."""
    own = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return own.withColumn("msg", place).select("conv_id", F.col("msg").alias("seq"), "msg", F.lit("delta").alias("kind"), "role", "text")


def streamed(events: DataFrame) -> DataFrame:
    """The same conversations as a chat service logs them: each text comes in two deltas; an answer's first draft is
    regenerated, what another turn says is mistyped first and then edited."""
    half = (F.length("text") / 2).cast("int")
    first, second = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    answer = F.col("role") == "assistant"
    event = lambda n, kind, text: F.struct(F.lit(n).alias("n"), kind.alias("kind"), text.alias("text"))
    log = F.array(
        event(0, F.lit("delta"), F.concat(F.lit("draft "), second)),
        event(1, F.when(answer, "regenerate").otherwise("edit"), F.when(answer, "").otherwise(first)),
        event(2, F.lit("delta"), F.when(answer, first).otherwise("")),
        event(3, F.lit("delta"), second),
    )
    return events.withColumn("e", F.explode(log)).select("conv_id", (4 * F.col("seq") + F.col("e.n")).alias("seq"), "msg", "e.kind", "role", "e.text")


def folded(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, msg, role (of the message's first event that stays), text."""
    since = Window.partitionBy("conv_id").orderBy(F.desc("seq"), F.desc("msg"), "kind", "text").rowsBetween(Window.unboundedPreceding, -1)
    reset = F.min(F.when(F.col("kind").isin(*RESETS), F.col("msg"))).over(since)
    kept = events.withColumn("reset", reset).where("reset is null or reset > msg")
    parts = F.sort_array(F.collect_list(F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"))))
    whole = kept.groupBy("conv_id", "msg").agg(F.min_by(F.coalesce("role", F.lit("")), "seq").alias("role"), parts.alias("parts"))
    return whole.select("conv_id", "msg", "role", F.array_join(F.col("parts.text"), "").alias("text"))


def rendered(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask."""
    role, text = escaped(F.col("role")), escaped(F.col("text"))
    head = F.concat(F.lit(TURN), role, F.lit(SAYS))
    lines = messages.select("conv_id", "msg", F.concat(head, text, F.lit(END)).alias("line"), F.when(F.col("role") == "assistant", F.length(head)).alias("start"), F.length(text).alias("chars"))
    turns = lines.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("msg", "line", "start", "chars"))).alias("turns"))
    spans = F.transform("turns", lambda t, i: F.struct((i + 1).alias("turn"), t["start"].alias("start"), (t["start"] + t["chars"]).alias("end")))
    return turns.select("conv_id", F.array_join(F.col("turns.line"), "").alias("formatted"), F.filter(spans, lambda s: s["start"].isNotNull()).alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From formatted and loss_mask alone: conv_id, turns (role, text), and the text under the mask, unescaped."""
    lines = F.slice(F.split("formatted", r"\Q" + TURN + r"\E", -1), 2, 2_000_000_000)
    cut = formatted.withColumn("lines", lines)
    at = lambda line: F.instr(line, SAYS)
    turns = F.transform("lines", lambda s: F.struct(
        unescaped(F.substring(s, F.lit(1), at(s) - 1)).alias("role"),
        unescaped(F.substring(s, at(s) + len(SAYS), F.length(s) - at(s) - len(SAYS) - len(END) + 1)).alias("text")))
    under = F.transform("loss_mask", lambda m: unescaped(F.substring(F.element_at("lines", m["turn"]), m["start"] + 1 - len(TURN), m["end"] - m["start"])))
    return cut.select("conv_id", "formatted", turns.alias("turns"), F.array_join(under, "").alias("loss_text"))


def digests(formatted: DataFrame) -> DataFrame:
    back = read_back(formatted)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def formatted(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text), logged as a service would, folded and rendered."""
    return rendered(folded(streamed(as_events(rows))))


#: The same digests in SQL, without a log: rows by turn, escapes as replacements.
_ESCAPED = "replace({0}, '\\', '\\\\')"
for _control in ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"):
    _ESCAPED = f"replace({_ESCAPED}, '{_control}', '{_control[0]}\\{_control[1:]}')"
ORACLE_SQL = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum({len(TURN + SAYS + END)} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id
"""
