"""Chat formatting: typed content parts, a template with reversible escapes, loss spans, attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

# Marks of the template.  Inside texts each gets one more backslash in front; a mark of the template
# itself has none, as it follows a line end or starts the string.
CONTROL = r"(### |</turn>|<\|(?:image|audio|document)\|>)"
KINDS = ("image", "audio", "document")
PART_TYPE = "array<struct<kind:string,text:string,reference:string,amount:double>>"
# Tokens that one placeholder stands for: per image tile, per second of sound, per document page.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\*)" + CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\*)" + CONTROL, "$1$2")


def part_text(part: Column) -> Column:
    """The visitor of one part: text is escaped, an attachment becomes its placeholder, others nothing."""
    shown = F.when(part["kind"] == "text", escape(F.coalesce(part["text"], F.lit(""))))
    for kind in KINDS:
        shown = shown.when(part["kind"] == kind, F.lit(f"<|{kind}|>"))
    return shown.otherwise(F.lit(""))


def part_tokens(part: Column) -> Column:
    """How many tokens the placeholder of one part expands to; null amounts count as one unit."""
    units = F.ceil(F.coalesce(part["amount"], F.lit(1.0)))
    count = F.when(F.lit(False), F.lit(0).cast("bigint"))
    for kind, each in TOKENS_PER_UNIT.items():
        count = count.when(part["kind"] == kind, units * each)
    return count.otherwise(F.lit(0).cast("bigint"))


def format_turns(turns: DataFrame) -> DataFrame:
    """One formatted record per conversation.

    ``turns`` has conv_id, turn, role and parts (``PART_TYPE``).  Returns conv_id, n_turns,
    ``formatted``, ``loss_spans`` (code-point start and length of every assistant text, in order),
    ``attachments`` (kind, reference, start of the placeholder's turn text, place in it, tokens) and
    ``expanded_tokens``.

    A turn is ``### role:``, a line end, its parts, a line end, ``</turn>`` and a line end.  Roles are
    url-encoded, so they cannot hold a colon or line end; null counts as empty.  Null parts give an
    empty text.  Turns sort by turn (null last), then role and text; repeated rows are turns of their
    own.  Null conv_id is one conversation.  A conversation is one output row, so it has to fit a task.
    """
    role = F.coalesce(F.url_encode(F.coalesce("role", F.lit(""))), F.lit(""))
    parts = F.coalesce(F.col("parts"), F.array().cast(PART_TYPE))
    shown = turns.select(
        "conv_id", "turn", role.alias("role"),
        F.array_join(F.transform(parts, part_text), "").alias("text"),
        F.transform(
            F.filter(parts, lambda p: p["kind"].isin(*KINDS)),
            lambda p, i: F.struct(
                p["kind"].alias("kind"), p["reference"].alias("reference"), i.alias("place"), part_tokens(p).alias("tokens")
            ),
        ).alias("files"),
    )
    piece = F.concat(F.lit("### "), "role", F.lit(":\n"), "text", F.lit("\n</turn>\n"))
    order = [F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    whole = Window.partitionBy("conv_id").orderBy(*order)
    before = F.coalesce(F.sum("chars").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    placed = (
        shown.withColumn("piece", piece)
        .withColumn("chars", F.length("piece").cast("bigint"))
        .withColumn("number", F.row_number().over(whole))
        .withColumn("start", before + F.length("role") + 6)
    )
    collected = placed.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(
            F.collect_list(F.struct("number", "piece", "start", F.length("text").cast("bigint").alias("length"), "role", "files"))
        ).alias("turns"),
    )
    files = F.flatten(
        F.transform(
            "turns",
            lambda t: F.transform(
                t["files"],
                lambda f: F.struct(
                    f["kind"].alias("kind"), f["reference"].alias("reference"), t["start"].alias("start"),
                    f["place"].alias("place"), f["tokens"].alias("tokens"),
                ),
            ),
        )
    )
    spans = F.transform(
        F.filter("turns", lambda t: t["role"] == "assistant"),
        lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")),
    )
    return collected.select(
        "conv_id", "n_turns",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        spans.alias("loss_spans"), files.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, f: a + f["tokens"]))


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a formatted string without attachments."""
    pieces = F.filter(F.split(formatted, r"(?<!\\)</turn>\n"), lambda p: p != "")

    def turn(p):
        head = F.instr(p, ":\n")
        return F.struct(
            F.url_decode(F.substring(p, F.lit(5), head - 5)).alias("role"),
            unescape(F.substring(p, head + 2, F.length(p) - head - 2)).alias("text"),
        )

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing in between."""
    return F.array_join(
        F.transform(
            spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
        ),
        "",
    )


def text_parts(text: Column) -> Column:
    """A turn with nothing but text, as typed parts."""
    none = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
            none.cast("string").alias("reference"), none.cast("double").alias("amount"),
        )
    )


def op4_chat_formatting(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    turns = rows.unionByName(extra).select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))
    made = format_turns(turns).select("conv_id", "formatted", "loss_spans")
    read = made.select(
        "conv_id", read_turns(F.col("formatted")).alias("turns"), F.length("formatted").cast("bigint").alias("formatted_chars"),
        read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, regexp_replace(text, '(\\*)(### |</turn>|<\|(?:image|audio|document)\|>)', '\\\1\2', 'g') AS shown FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, shown) AS told,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS LAST, role, shown), '') AS loss,
         sum(length(role) + length(shown) + 15) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""
