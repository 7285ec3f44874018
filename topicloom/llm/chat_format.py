"""Chat formatting with Spark expressions only: one string and one loss mask per conversation.

The turns of a conversation are collected as structs and sorted, adjacent turns of one role are merged by
array functions into a block, and the blocks are concatenated. Control strings inside texts get one
backslash after their first character (one more if some are there already), so what the template writes
and what a text holds can always be told apart and ``parse`` returns the very turns that went in.

The collected group is one conversation, which is also one output row: its size is that of the row asked
for. Nothing else is gathered.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import starts


@dataclass(frozen=True)
class Template:
    """``open role newline [before] text (joint text)* [after] close`` for each block of one role.

    ``controls`` are the strings to escape in texts and roles. Each must start with a character that no
    control holds anywhere else, and none may be the start of another.
    """

    open: str = "<s>"
    close: str = "</s>"
    joint: str = "[+]"
    wraps: dict[str, tuple[str, str]] = field(default_factory=lambda: {"user": ("[INST] ", " [/INST]")})
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "[+]")
    learn: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        first = {c[0] for c in self.controls}
        if any(set(c[1:]) & first or "\\" in c for c in self.controls):
            raise ValueError("a control's first character may stand only at the start of controls")
        if any(a != b and b.startswith(a) for a in self.controls for b in self.controls):
            raise ValueError("one control starts another")

    @property
    def pattern(self) -> str:
        """A control with any number of backslashes after its first character."""
        first = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        rest = "|".join(sorted({re.escape(c[1:]) for c in self.controls}))
        return rf"([{first}])(\\*)({rest})"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.pattern, r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.pattern.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")

    def wrap(self, role: Column, side: int) -> Column:
        out = F.lit("")
        for name, sides in self.wraps.items():
            out = F.when(role == name, F.lit(sides[side])).otherwise(out)
        return out


def role_out(t: Template, role: Column) -> Column:
    return F.replace(F.replace(t.escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def role_in(t: Template, role: Column) -> Column:
    return t.unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def chat_format(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", template: Template | None = None) -> DataFrame:
    """One row per conversation: ``<key>``, ``formatted`` and ``loss_mask`` (array of start, length).

    The mask counts code points of ``formatted``, from 0, and covers the texts of the roles to learn and
    nothing else. Null text or role counts as empty; rows without a key make one conversation; null turns
    come first, and rows of one turn are ordered by role, then text; repeated rows stay. No rows in, no
    rows out. Other columns are ignored.
    """
    t = template or Template()
    empty = F.lit("")
    rows = turns.select(
        F.col(key).alias("k"), F.struct(F.col(order).alias("o"), F.coalesce(F.col(role), empty).alias("r"), F.coalesce(F.col(text), empty).alias("t")).alias("x")
    )
    sorted_ = rows.groupBy("k").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    changes = F.filter(
        F.sequence(F.lit(1), F.size("xs")), lambda i: (i == 1) | (F.element_at("xs", i)["r"] != F.element_at("xs", F.greatest(i - 1, F.lit(1)))["r"])
    )
    cut = sorted_.withColumn("at", changes)
    blocks = F.transform(
        "at",
        lambda s, i: F.slice("xs", s, F.coalesce(F.get("at", i + 1), F.size("xs") + 1) - s),
    )
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    no = F.lit(False)

    def pieces(b: Column) -> Column:
        who = F.element_at(b, 1)["r"]
        texts = F.transform(
            b,
            lambda x, i: F.array(
                piece(F.when(i > 0, F.lit(t.joint)).otherwise(empty), no), piece(t.escape(x["t"]), who.isin(*t.learn))
            ),
        )
        return F.concat(
            F.array(piece(F.concat(F.lit(t.open), role_out(t, who), F.lit("\n"), t.wrap(who, 0)), no)),
            F.flatten(texts),
            F.array(piece(F.concat(t.wrap(who, 1), F.lit(t.close)), no)),
        )

    parts = cut.withColumn("blocks", blocks).select("k", F.flatten(F.transform("blocks", pieces)).alias("p"))
    parts = parts.withColumn("start", starts(F.transform("p", lambda x: F.length(x["s"]).cast("long"))))
    spans = F.zip_with("p", "start", lambda x, s: F.struct(s.alias("start"), F.length(x["s"]).cast("long").alias("length"), x["loss"].alias("loss")))
    return parts.select(
        F.col("k").alias(key),
        F.array_join(F.transform("p", lambda x: x["s"]), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["length"])).alias("loss_mask"),
    )


def parse(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation, in order: array of role, text."""
    t = template or Template()
    blocks = F.split(formatted, re.escape(t.close))
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(b: Column) -> Column:
        head = F.substring_index(b, "\n", 1)
        who = role_in(t, F.substring(head, len(t.open) + 1, 2**31 - 1))
        before, after = t.wrap(who, 0), t.wrap(who, 1)
        skip = F.length(head) + 1 + F.length(before)
        body = F.substring(b, skip + 1, F.length(b) - skip - F.length(after))
        return F.transform(F.split(body, re.escape(t.joint)), lambda x: F.struct(who.alias("role"), t.unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def under_mask(formatted: Column, mask: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    t = template or Template()
    return F.array_join(F.transform(mask, lambda m: t.unescape(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(
        f"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '{said}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(turn, role)"
    )
    out = chat_format(turns.unionByName(extra))
    out = out.withColumn("turns", parse(F.col("formatted"))).withColumn("loss", under_mask(F.col("formatted"), F.col("loss_mask")))
    utf8_hex = lambda s: F.sha2(F.encode(s, "UTF-8"), 256)
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        utf8_hex(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        utf8_hex(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = {
    "op2_chat_format": r"""
        WITH r AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (
            SELECT *, length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|\+\])', '\1\\\2\3', 'g')) AS n,
                   coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role, false) AS joined
            FROM r)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(n + CASE WHEN joined THEN 3 ELSE 8 + length(role) + CASE WHEN role = 'user' THEN 15 ELSE 0 END END) AS BIGINT)
                   AS formatted_chars
        FROM e GROUP BY conv_id""",
}
QUERIES = {"op2_chat_format": op2_chat_format}
