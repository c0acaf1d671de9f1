"""Chat formatting: turns become one string with loss spans, from a declarative template.

format_chats(rows, template) -> one row per conversation, built from DataFrame functions only.

Turn order is checked by a finite-state machine over roles. The text of a turn is escaped, so that it can
never hold one of the template's control strings, and can be read back exactly:

    backslash            -> backslash 0
    control string c...  -> its first character, backslash 1, the rest
    newline in a role    -> backslash 2

Every backslash of the output thus begins a code, and no control string survives inside a text.

Defined cases. Null text or role: empty. Null turn: before all others. Rows of the same turn: by role, then
text; repeated rows all stay. Null conv_id: a conversation of its own. Empty table: no rows. An order of roles
that the machine refuses: valid is false, error_turn is the index of the first refused turn, and the
conversation is formatted all the same. Columns other than the four named ones are ignored.

A conversation is one string in the output, so its rows meet in one task: the size of a conversation is bound by
that of a string, and nothing else is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import table


@dataclass(frozen=True)
class ChatTemplate:
    """start and stop enclose a turn, after_role stands between role and text; loss: the roles that are trained on;
    control: further strings that may not occur inside a text; steps: state -> {role: next state}."""

    start: str = "<s>[INST]"
    after_role: str = "[/INST]"
    stop: str = "</s>"
    loss: tuple[str, ...] = ("assistant",)
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    steps: tuple[tuple[str, str, str], ...] = (
        ("begin", "system", "opened"),
        ("begin", "user", "asked"),
        ("opened", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("answered", "user", "asked"),
    )
    final: tuple[str, ...] = ("answered",)


DEFAULT = ChatTemplate()


def escape(text: Column, template: ChatTemplate = DEFAULT) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\0"))
    for c in template.control:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\1{c[1:]}"))
    return text


def unescape(text: Column) -> Column:
    for code, plain in (("\\2", "\n"), ("\\1", ""), ("\\0", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _next(state: Column, role: Column, template: ChatTemplate) -> Column:
    out = F.lit("refused")
    for at, on, to in template.steps:
        out = F.when((state == at) & (role == on), F.lit(to)).otherwise(out)
    return out


def format_chats(rows: DataFrame, template: ChatTemplate = DEFAULT) -> DataFrame:
    """conv_id, n_turns, formatted string, segments array<struct<text, loss>>, loss_spans array<struct<start, end>>
    (code points of formatted, end exclusive), valid boolean, error_turn int (null if none)."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = rows.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            role.alias("role"),
            text.alias("text"),
            F.replace(escape(role, template), F.lit("\n"), F.lit("\\2")).alias("role_out"),
            escape(text, template).alias("out"),
        ).alias("t"),
    )
    # Where each text begins, as a running sum, so that a conversation takes time in proportion to its length.
    fixed = len(template.start) + len(template.after_role) + len(template.stop)
    before = Window.partitionBy("conv_id").orderBy("t.turn", "t.role", "t.text").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("t.role_out") + F.length("t.out") + fixed
    at = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("t.role_out") + len(template.start) + len(template.after_role)
    turns = turns.select("conv_id", F.struct("t.turn", "t.role", "t.text", "t.role_out", "t.out", at.cast("int").alias("at")).alias("t"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def parts(t: Column) -> Column:
        head = F.concat(F.lit(template.start), t["role_out"], F.lit(template.after_role))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(t["out"].alias("text"), t["role"].isin(*template.loss).alias("loss")),
            F.struct(F.lit(template.stop).alias("text"), F.lit(False).alias("loss")),
        )

    walked = F.aggregate(
        "turns",
        F.struct(F.lit("begin").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("error")),
        lambda acc, t: F.struct(
            _next(acc["state"], t["role"], template).alias("state"),
            (acc["at"] + 1).alias("at"),
            F.coalesce(acc["error"], F.when(_next(acc["state"], t["role"], template) == "refused", acc["at"])).alias("error"),
        ),
    )
    spans = F.transform(F.filter("turns", lambda t: t["role"].isin(*template.loss)), lambda t: F.struct(t["at"].alias("start"), (t["at"] + F.length(t["out"])).alias("end")))
    chats = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", parts)).alias("segments"), spans.alias("loss_spans"), walked.alias("fsm"))
    return chats.select(
        "conv_id",
        "n_turns",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        "loss_spans",
        (F.col("fsm.error").isNull() & F.col("fsm.state").isin(*template.final)).alias("valid"),
        F.col("fsm.error").alias("error_turn"),
    )


def read_back(formatted: Column, template: ChatTemplate = DEFAULT) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    body = F.split(formatted, _quoted(template.start))
    return F.transform(
        F.slice(body, F.lit(2), F.size(body)),
        lambda turn: F.struct(
            unescape(F.substring_index(turn, template.after_role, 1)).alias("role"),
            unescape(F.substring(turn, F.length(F.substring_index(turn, template.after_role, 1)) + len(template.after_role) + 1, F.length(turn) - F.length(F.substring_index(turn, template.after_role, 1)) - len(template.after_role) - len(template.stop))).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted, then read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    clash = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(clash).alias("text"))
    chats = format_chats(rows.unionByName(own))
    digest = chats.select(
        "conv_id",
        read_back(F.col("formatted")).alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "error_turn",
    )
    return digest.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
        F.col("error_turn").cast("long").alias("error_turn"),
    )


def _sql() -> str:
    def esc(column: str) -> str:
        out = f"replace({column}, '\\', '\\0')"
        for c in DEFAULT.control:
            out = f"replace({out}, '{c}', '{c[0]}\\1{c[1:]}')"
        return out

    fixed = len(DEFAULT.start) + len(DEFAULT.after_role) + len(DEFAULT.stop)
    return f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
numbered AS (
  SELECT *, row_number() OVER w - 1 AS i, lag(role) OVER w AS prev, lead(role) OVER w AS next
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
checked AS (
  SELECT *, CASE WHEN role = 'system' THEN prev IS NULL
                 WHEN role = 'user' THEN prev IS NULL OR prev IN ('assistant', 'system')
                 WHEN role = 'assistant' THEN prev = 'user' ELSE FALSE END AS fits FROM numbered)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({fixed} + length(replace({esc("role")}, chr(10), '\\2')) + length({esc("text")})) AS BIGINT) AS formatted_chars,
  bool_and(fits) AND max(role) FILTER (WHERE next IS NULL) = 'assistant' AS valid,
  CAST(min(i) FILTER (WHERE NOT fits) AS BIGINT) AS error_turn
FROM checked GROUP BY conv_id"""


QUERIES = {"op3_chat_format": op3_chat_format}
ORACLE_SQL = {"op3_chat_format": _sql()}
