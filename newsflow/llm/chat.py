"""Chat formatting with typed content parts, in column expressions only.

A turn's content is an array of parts. Each kind of part has its visitor, which gives the piece of
text that stands for it and, for attachments, a reference with the number of tokens it expands to.
The template marks turns with control strings; the same strings inside texts and roles are escaped
so that they can be restored exactly.
"""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from newsflow.llm.common import table

TURN, BODY, END = "<|turn|>", "<|body|>", "</s>"
#: Placeholder of each kind of attachment, and tokens for each if the part doesn't say.
PLACEHOLDERS = {"image": ("<|image|>", 576), "audio": ("<|audio|>", 188),
                "document": ("<|document|>", 1024)}
#: What other templates use for control is escaped too, so a format can be fed to their models.
CONTROL = r"\||/?s>|/?INST\]|/?SYS>"

PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()),
                     T.StructField("ref", T.StringType()), T.StructField("n_tokens", T.LongType())])


def escape(text: Column) -> Column:
    """One more ``!`` after the bracket that opens a control string, however many there are."""
    return F.regexp_replace(text, rf"([<\[])(!*)(?={CONTROL})", "$1!$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])!(!*)(?={CONTROL})", "$1$2")


def text_part(text: Column) -> Column:
    """Content of a single text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"),
                            null.cast("string").alias("ref"),
                            null.cast("bigint").alias("n_tokens")))


def visit(part: Column) -> Column:
    """Text that stands for a part. A null part or text is empty; so is an unknown kind's."""
    shown = F.when(part["type"] == "text", escape(F.coalesce(part["text"], F.lit(""))))
    for kind, (placeholder, _) in PLACEHOLDERS.items():
        shown = shown.when(part["type"] == kind, F.lit(placeholder))
    return F.coalesce(shown, F.lit(""))


def flatten(content: Column) -> Column:
    """A turn's text with placeholders in the order of its parts."""
    return F.coalesce(F.array_join(F.transform(content, visit), ""), F.lit(""))


def attachments(content: Column) -> Column:
    """Kind, reference and expanded token count of each attachment, in order."""
    def record(part):
        default = F.lit(None).cast("bigint")
        for kind, (_, tokens) in PLACEHOLDERS.items():
            default = F.when(part["type"] == kind, F.lit(tokens).cast("bigint")).otherwise(default)
        return F.struct(part["type"].alias("type"), part["ref"].alias("ref"),
                        F.coalesce(part["n_tokens"], default).alias("n_tokens"))

    kinds = list(PLACEHOLDERS)
    return F.transform(F.filter(F.coalesce(content, F.array().cast(T.ArrayType(PART))),
                                lambda part: part["type"].isin(kinds)), record)


def format_chats(turns: DataFrame, loss_roles=("assistant",)) -> DataFrame:
    """One row per conversation from rows of ``conv_id``, ``turn``, ``role`` and ``content``.

    ``formatted`` is the concatenation of ``segments``; those with ``loss`` make up the loss mask.
    ``attachments`` lists references in the order of their placeholders. Turns are ordered by
    number, role and text; null numbers come first, equal rows stay as often as they are there. A
    null role is the empty one; rows with a null conversation form one. A conversation is one row
    of the result, so it has to fit into a task's memory, as every reader of the format needs.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    turn = F.struct(F.col("turn"), role.alias("role"), flatten(F.col("content")).alias("body"),
                    attachments(F.col("content")).alias("files"))

    def segments(t):
        return F.array(
            F.struct(F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY)).alias("text"),
                     F.lit(False).alias("loss")),
            F.struct(t["body"].alias("text"), t["role"].isin(list(loss_roles)).alias("loss")),
            F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")))

    return (turns.select("conv_id", turn.alias("_t"))
            .groupBy("conv_id").agg(F.array_sort(F.collect_list("_t")).alias("_turns"))
            .select("conv_id", F.flatten(F.transform("_turns", segments)).alias("segments"),
                    F.flatten(F.transform("_turns", lambda t: t["files"])).alias("attachments"))
            .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")))


def read_back(formatted: Column) -> Column:
    """Roles and texts of the turns of a format; placeholders stay in the texts."""
    turns = F.filter(F.split(formatted, r"<\|turn\|>"), lambda t: t != "")

    def turn(t):
        parts = F.split(t, r"<\|body\|>", 2)
        body = F.get(parts, 1)
        return F.struct(unescape(F.get(parts, 0)).alias("role"),
                        unescape(body.substr(F.lit(1), F.length(body) - len(END) - 1)).alias("text"))

    return F.transform(turns, turn)


def loss_text(segments: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]),
                                    lambda s: unescape(s["text"])), "")


def op6_chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(control).alias("text"))
    done = format_chats(rows.unionByName(added)
                        .select("conv_id", "turn", "role", text_part(F.col("text")).alias("content")))
    shown = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (done.select("conv_id", "formatted", read_back(F.col("formatted")).alias("_turns"),
                        loss_text(F.col("segments")).alias("_loss"))
            .select("conv_id", F.size("_turns").cast("bigint").alias("n_turns"),
                    F.sha2(F.array_join(shown, ""), 256).alias("turns_sha256"),
                    F.length("_loss").cast("bigint").alias("loss_chars"),
                    F.sha2("_loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("bigint").alias("formatted_chars")))


#: The same in SQL, from the tables alone: roles and texts need no reading back there.
OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (
  SELECT *, regexp_replace(regexp_replace(text, '([<\[]!*)(\||/?s>|/?INST\]|/?SYS>)',
                                          '\1' || chr(1) || '\2', 'g'), chr(1), '!', 'g') AS body
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body))
    AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body)
                  FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + length(role) + 8 + length(body) + 5) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id"""
