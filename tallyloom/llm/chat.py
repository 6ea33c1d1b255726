"""Chat formatting from an event log: fold the events of every message, render, read back.

A log holds one row per event, of the kinds

* ``delta``: a streamed piece that goes behind the text so far,
* ``edit``: a new text in place of the one so far,
* ``regenerate``: the message begins anew, empty; the deltas behind it fill it,
* ``remove``: the message goes, until a later event brings it back.

Events of a message are sorted by their sequence number and folded: what stands
before its last edit, regeneration or removal does not count, so the fold is one
cut and one join of texts. Messages are grouped by conversation and message, so
that a conversation with most of the rows is spread; only ``assemble``, which
makes one text of a conversation, brings its messages together.

All of it is DataFrame functions; no Python runs on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The marks of a turn, by role. No control string holds "<" or "["
# behind its first character, which the escape relies on.
MARKS = {
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("<s> ", " </s>"),
    "system": ("[SYS] ", " [/SYS]"),
}
ROLE_OPEN, ROLE_CLOSE, OTHER_CLOSE = "[ROLE] ", "[/ROLE] ", " [END]"
# What may follow "<" and "[" in a control string, as patterns.
ANGLE_TAILS = r"/?s>|unk>|\|endoftext\|>|\|im_start\|>|\|im_end\|>"
SQUARE_TAILS = r"/?INST\]|/?SYS\]|/?ROLE\]|END\]"
#: The role that is learnt.
LEARNT = "assistant"

_CONTROL = rf"<(?=\\*(?:{ANGLE_TAILS}))|\[(?=\\*(?:{SQUARE_TAILS}))"
_ESCAPED = rf"(<)\\(?=\\*(?:{ANGLE_TAILS}))|(\[)\\(?=\\*(?:{SQUARE_TAILS}))"
_TURN_START = r"(?=\[INST\]|<s>|\[SYS\]|\[ROLE\])"


def escape(text: Column) -> Column:
    """Break every control string by a backslash behind its first character; one that is broken already gets one more."""
    return F.regexp_replace(text, _CONTROL, "$0\\\\")


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given."""
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def reconstruct(log: DataFrame, conversation: str, message: str, sequence: str, kind: str, role: str, text: str) -> DataFrame:
    """The messages that a log leaves: ``conversation``, ``message``, ``role``, ``text``.

    ``message`` tells the messages of a conversation apart and orders them; it
    may be of any type that can be sorted, structs included. Events that are
    alike in every field count once, as logs may deliver an event again. Events
    with one sequence number are taken in the order of kind, role and text, a
    null number comes first. A null kind is a delta, a null text is empty; other
    unknown kinds raise. A message has the role of its last event that names
    one, else the empty role. A null conversation or message is one like any
    other. An empty log has no messages; other columns of the log are left out.
    """
    known = F.col("e.kind").isin("delta", "edit", "regenerate", "remove")
    wrong = F.raise_error(F.concat(F.lit("an event of the unknown kind "), F.col("e.kind"))).cast("string")
    event = F.struct(
        F.col(sequence).alias("sequence"),
        F.coalesce(F.col(kind), F.lit("delta")).alias("kind"),
        F.col(role).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    events = log.select(F.col(conversation).alias("conversation"), F.col(message).alias("message"), event.alias("e"))
    events = events.withColumn("e", F.col("e").withField("kind", F.when(known, F.col("e.kind")).otherwise(wrong)))
    folded = events.groupBy("conversation", "message").agg(F.array_sort(F.collect_set("e")).alias("events"))
    starts = F.filter("events", lambda e: e["kind"] != "delta")
    named = F.filter("events", lambda e: e["role"].isNotNull())
    folded = folded.select(
        "conversation",
        "message",
        "events",
        F.array_size(starts).alias("n_starts"),
        F.try_element_at(starts, F.lit(-1)).alias("start"),
        F.coalesce(F.try_element_at(named, F.lit(-1))["role"], F.lit("")).alias("role"),
    )
    # The last start and the deltas behind it: the array is sorted, so it is cut once.
    size = F.array_size("events")
    first = F.when(F.col("n_starts") == 0, F.lit(1)).otherwise(F.array_position("events", F.col("start")).cast("int"))
    folded = folded.withColumn("kept", F.slice("events", first, size - first + 1))
    gone = (F.col("n_starts") > 0) & (F.col("start.kind") == "remove")
    pieces = F.transform("kept", lambda e: F.when(e["kind"].isin("delta", "edit"), e["text"]).otherwise(F.lit("")))
    alive = folded.filter(~(gone & (F.array_size("kept") == 1)))
    return alive.select("conversation", "message", "role", F.array_join(pieces, "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """Every message as a piece of the formatted text, and where its learnt part lies in the piece.

    Takes the rows of ``reconstruct``, one by one. Adds ``piece`` and, for the
    role that is learnt, ``loss_start`` and ``loss_length`` in code points, from
    0; they are null for others. Roles without marks of their own are written
    out, escaped as well.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    rows = messages.select("conversation", "message", role.alias("role"), text.alias("text")).withColumn(
        "body", escape(F.col("text"))
    )
    other = F.concat(F.lit(ROLE_OPEN), escape(F.col("role")), F.lit(ROLE_CLOSE), F.col("body"), F.lit(OTHER_CLOSE))
    piece = None
    for name, (before, behind) in MARKS.items():
        marked = F.concat(F.lit(before), F.col("body"), F.lit(behind))
        piece = F.when(F.col("role") == name, marked) if piece is None else piece.when(F.col("role") == name, marked)
    learnt = F.col("role") == LEARNT
    return rows.select(
        "conversation",
        "message",
        piece.otherwise(other).alias("piece"),
        F.when(learnt, F.lit(len(MARKS[LEARNT][0]))).alias("loss_start"),
        F.when(learnt, F.length("body")).alias("loss_length"),
    )


def assemble(rendered: DataFrame) -> DataFrame:
    """One row per conversation: ``formatted``, its pieces in order, and ``loss``.

    ``loss`` is an array of spans of ``formatted``: ``start`` and ``length`` in
    code points, ``byte_start`` and ``byte_length`` in bytes of UTF-8. This is
    the one place that needs a whole conversation in a row, as its text is one.
    """
    before = Window.partitionBy("conversation").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    behind_mark = len(MARKS[LEARNT][0])
    placed = rendered.withColumns(
        {
            "chars": F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)),
            "bytes": F.coalesce(F.sum(F.octet_length("piece")).over(before), F.lit(0)),
            "loss_bytes": F.octet_length("piece") - sum(len(mark) for mark in MARKS[LEARNT]),
        }
    )
    span = F.struct(
        (F.col("chars") + F.col("loss_start")).alias("start"),
        F.col("loss_length").cast("long").alias("length"),
        (F.col("bytes") + behind_mark).alias("byte_start"),
        F.col("loss_bytes").cast("long").alias("byte_length"),
    )
    entry = F.struct("message", "piece", F.when(F.col("loss_start").isNotNull(), span).alias("span"))
    whole = placed.groupBy("conversation").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    spans = F.filter(F.transform("entries", lambda e: e["span"]), lambda s: s.isNotNull())
    return whole.select(
        "conversation",
        F.array_join(F.transform("entries", lambda e: e["piece"]), "").alias("formatted"),
        spans.alias("loss"),
    )


def format_log(log: DataFrame, conversation: str, message: str, sequence: str, kind: str, role: str, text: str) -> DataFrame:
    """From the log to one formatted text per conversation: ``reconstruct``, ``render``, ``assemble``."""
    return assemble(render(reconstruct(log, conversation, message, sequence, kind, role, text)))


def _inner(piece: Column, before: str, behind: str) -> Column:
    return F.substring(piece, F.lit(len(before) + 1), F.length(piece) - len(before) - len(behind))


def _read_turn(piece: Column) -> Column:
    """Role and text of one piece; the marks tell the role."""
    close = F.instr(piece, F.lit(ROLE_CLOSE))
    role = F.lit(None).cast("string")
    text = F.lit(None).cast("string")
    for name, (before, behind) in MARKS.items():
        marked = piece.startswith(before)
        role = F.when(marked, F.lit(name)).otherwise(role)
        text = F.when(marked, _inner(piece, before, behind)).otherwise(text)
    named = F.substring(piece, F.lit(len(ROLE_OPEN) + 1), close - len(ROLE_OPEN) - 1)
    rest = F.substring(piece, close + len(ROLE_CLOSE), F.length(piece) - close - len(ROLE_CLOSE) - len(OTHER_CLOSE) + 1)
    return F.struct(
        F.coalesce(role, unescape(named)).alias("role"), unescape(F.coalesce(text, rest)).alias("text")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What a formatted text says: ``turns`` (role, text) and ``learnt``, the texts under the loss mask.

    Takes ``conversation``, ``formatted`` and ``loss``. The text is split where
    marks open a turn, as texts hold no marks; the mask is read by its byte
    spans, each from the bytes of the text, which are made once.
    """
    pieces = F.filter(F.split("formatted", _TURN_START), lambda piece: piece != "")
    # The outer array binds the bytes to a name, else they were made for every span.
    learnt = F.transform(
        F.array(F.col("formatted").cast("binary")),
        lambda whole: F.transform(
            F.col("loss"),
            lambda span: unescape(
                F.substring(whole, span["byte_start"].cast("int") + 1, span["byte_length"].cast("int")).cast("string")
            ),
        ),
    )[0]
    return formatted.select(
        "conversation",
        F.transform(pieces, _read_turn).alias("turns"),
        learnt.alias("learnt"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def turn_log(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """A log that would leave the rows of a turn table: ``conversation, message, sequence, kind, role, text``.

    A reply of the assistant is streamed as a draft of its first line, then
    regenerated and streamed in two pieces; any other turn is a first wording,
    its first line, edited to the final one. ``message`` orders rows by turn
    (null first), ties by role and digest of the text; equal rows stay two
    messages. ``turns`` has to be a stored table, as rows get their number in it.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = turns.select(
        F.col(conversation).alias("conversation"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        body.alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    head = F.substring_index("text", "\n", 1)
    tail = F.substring(F.col("text"), F.length("head") + 1, F.length("text"))
    rows = rows.withColumn("head", head).withColumn("tail", tail)

    def event(number: int, kind: str, said: Column) -> Column:
        return F.struct(F.lit(number).alias("sequence"), F.lit(kind).alias("kind"), said.alias("text"))

    streamed = F.array(
        event(0, "delta", F.col("head")),
        event(1, "regenerate", F.lit("")),
        event(2, "delta", F.col("head")),
        event(3, "delta", F.col("tail")),
    )
    typed = F.array(event(0, "delta", F.col("head")), event(1, "edit", F.col("text")))
    events = F.explode(F.when(F.col("role") == LEARNT, streamed).otherwise(typed))
    message = F.struct("turn", "role", F.md5("text").alias("digest"), "row")
    return rows.select("conversation", message.alias("message"), "role", events.alias("e")).select(
        "conversation", "message", "e.sequence", "e.kind", "role", "e.text"
    )


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what ``read_back`` finds, one row per conversation."""
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = F.array_join("learnt", "")
    return read_back(formatted).select(
        F.col("conversation").alias("conv_id"),
        F.array_size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.coalesce(F.length(learnt), F.lit(0)).cast("long").alias("loss_chars"),
        F.sha2(F.coalesce(learnt, F.lit("")), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def tricky_turns(spark: SparkSession) -> DataFrame:
    """Conversation -7: two turns whose text is made of control strings."""
    return spark.sql(
        "select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')"
        " as t(conv_id, turn, role, text)"
    )


#: The rows of the query in DuckDB: escapes are counted, not made.
ORACLE = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
  select *,
    len(regexp_extract_all(text, '<\\\\*(?:{ANGLE_TAILS})|\\[\\\\*(?:{SQUARE_TAILS})')) as escapes,
    len(regexp_extract_all(role, '<\\\\*(?:{ANGLE_TAILS})|\\[\\\\*(?:{SQUARE_TAILS})')) as role_escapes,
    case role {" ".join(f"when '{name}' then {len(a) + len(b)}" for name, (a, b) in MARKS.items())} end as marks
  from turns
)
select conv_id,
  count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, md5(text))) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, md5(text)) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(text) + escapes + coalesce(marks, {len(ROLE_OPEN) + len(ROLE_CLOSE) + len(OTHER_CLOSE)} + length(role) + role_escapes))::bigint
    as formatted_chars
from sized group by conv_id
"""
