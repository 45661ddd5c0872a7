"""Chat formatting with typed content parts, in DataFrame functions alone.

A turn's content is an array of parts.  A visitor flattens them in order: a text part
becomes its escaped text; an image, audio or document part becomes a placeholder, and
its reference and expanded token count are recorded in the order of the placeholders.

A conversation becomes one string of turns::

    <|turn|>ROLE\\nCONTENT<|end|>\\n

Control strings inside texts and roles are escaped reversibly: ``<`` before ``|``,
``s>`` or ``/s>`` becomes ``%3C``, ``[`` before ``INST]`` or ``/INST]`` becomes ``%5B``,
and ``%`` before what would read as an escape becomes ``%25``; beginnings of these at a
text's end count as such, as anything may follow there.  A newline in a role is ``%0A``.

The loss mask is a list of spans in code points: the content of every assistant turn.

Defined results: null text is empty; null or unknown kinds of part and null arrays give
no content; a null role is empty.  Turns are ordered by turn, then role, then content;
repeated rows are turns each.  A row with a null conv_id is a conversation of its own,
of one turn.  A conversation is one row, as its digest needs it whole.  Empty table: no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
#: Expanded sizes: pixels a side of an image patch, audio tokens a second, tokens a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512
KINDS = ("image", "audio", "document")
TRAINED = "assistant"


def escape(text: Column) -> Column:
    x = F.regexp_replace(text, r"%(?=25|3C|5B|0A|[0235]?\z)", "%25")
    x = F.regexp_replace(x, r"<(?=\||/?s>|/?s?\z)", "%3C")
    return F.regexp_replace(x, r"\[(?=/?INST\]|/?(?:I(?:N(?:ST?)?)?)?\z)", "%5B")


def unescape(text: Column) -> Column:
    for code, char in (("%3C", "<"), ("%5B", "["), ("%0A", "\n"), ("%25", "%")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def text_part(text: Column) -> Column:
    """A content of one text part."""
    fields = [F.lit("text").alias("kind"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")]
    return F.array(F.struct(*fields))


def expanded(part: Column) -> Column:
    """Tokens that a placeholder stands for; unknown sizes count as one."""
    image = F.ceil(part["width"] / F.lit(PATCH)) * F.ceil(part["height"] / F.lit(PATCH))
    tokens = F.when(part["kind"] == "image", image).when(part["kind"] == "audio", F.ceil(part["seconds"] * AUDIO_RATE)).when(part["kind"] == "document", part["pages"] * PAGE_TOKENS)
    return F.greatest(F.coalesce(tokens.cast("long"), F.lit(1).cast("long")), F.lit(1).cast("long"))


def visit(part: Column) -> Column:
    """A part's content."""
    kind = part["kind"]
    return F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).when(kind.isin(*KINDS), F.concat(F.lit("<|"), kind, F.lit("|>"))).otherwise(F.lit(""))


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, parts array<PART>) -> one row per conversation.

    conv_id, formatted, loss (array of start, chars), attachments (array of turn_no, kind,
    ref, tokens; in the order of their placeholders), extra_tokens.
    """
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), F.concat_ws("", F.transform(parts, visit)).alias("content"), F.filter(parts, lambda p: p["kind"].isin(*KINDS)).alias("media"))
    head = F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("%0A")), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("piece", F.concat("head", "content", F.lit(END + "\n")))
    # Rows without a conversation are kept apart, so that no task gets all of them.
    rows = rows.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    order = Window.partitionBy("conv_id", "alone").orderBy("turn", "role", "content")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("at", F.coalesce(F.sum(F.char_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    span = F.when(F.col("role") == TRAINED, F.struct((F.col("at") + F.char_length("head")).alias("start"), F.char_length("content").cast("long").alias("chars")))
    media = F.transform("media", lambda p: F.struct(F.col("n").alias("turn_no"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded(p).alias("tokens")))
    one = rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list(F.struct("n", "piece", span.alias("span"), media.alias("media")))).alias("t"))
    one = one.select("conv_id", F.array_join("t.piece", "").alias("formatted"), F.filter("t.span", lambda s: s.isNotNull()).alias("loss"), F.flatten("t.media").alias("attachments"))
    return one.withColumn("extra_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, m: a + m["tokens"] - 1))


def read_parts(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, texts, kinds) and attachments: the parts again.

    A turn has one text more than placeholders: the texts around them, of which some may be
    empty.  The kinds of all turns in order are those of the attachments.
    """
    marker = rf"<\|({'|'.join(KINDS)})\|>"

    def turn(body: Column) -> Column:
        role, content = _role(body), _content(body)
        return F.struct(unescape(role).alias("role"), F.transform(F.split(content, marker, -1), unescape).alias("texts"), F.regexp_extract_all(content, F.lit(marker), F.lit(1)).alias("kinds"))

    return formatted.select("conv_id", F.transform(_bodies(), turn).alias("turns"), "attachments")


def _bodies() -> Column:
    return F.transform(F.filter(F.split("formatted", r"<\|turn\|>", -1), lambda _, i: i > 0), lambda x: F.substring_index(x, END, 1))


def _role(body: Column) -> Column:
    return F.substring_index(body, "\n", 1)


def _content(body: Column) -> Column:
    return F.substr(body, F.char_length(_role(body)) + 2)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), loss_text and sizes, parsed from the formatted string and its mask alone.

    Placeholders stay in the texts as they are.
    """
    turns = F.transform(_bodies(), lambda body: F.struct(unescape(_role(body)).alias("role"), unescape(_content(body)).alias("text")))
    loss = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["chars"].cast("int"))))
    return formatted.select("conv_id", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"), F.char_length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"), "extra_tokens")


def digests(back: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments, extra_tokens."""
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars", "n_attachments", "extra_tokens")
