"""Chat formatting: layouts told apart by a fingerprint of their field paths, one template with a loss mask."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waxworks.llm.registry import query

START, END = "<|im_start|>", "<|im_end|>\n"
#: Roles whose texts are learned.
LEARNED = ("assistant",)
#: Names of roles in other layouts.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Messages:
    """A list of messages below ``field``; ``extra`` fields of a message are allowed and not used."""

    name: str
    field: str
    role: str
    text: str
    extra: tuple[str, ...] = ()
    foreign: bool = True  # roles may have other names; in the layout of our own they stay as they are

    def shapes(self):
        for n in range(len(self.extra) + 1):
            for more in combinations(self.extra, n):
                yield {self.field: [dict.fromkeys((self.role, self.text, *more))]}
        yield {self.field: []}

    def turns(self, record: Column) -> Column:
        got = F.try_variant_get(record, f"$.{self.field}", f"array<struct<{self.role}: string, {self.text}: string>>")
        names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
        named = lambda role: F.coalesce(F.try_element_at(names, F.lower(role)), role) if self.foreign else role
        return F.transform(F.filter(got, lambda m: m.isNotNull()), lambda m: _turn(named(m[self.role]), m[self.text]))


@dataclass(frozen=True)
class Fields:
    """One field for each turn: (role, fields whose texts are joined by a line break). Optional fields may be absent."""

    name: str
    parts: tuple[tuple[str, tuple[str, ...]], ...]
    optional: tuple[str, ...] = ()

    def shapes(self):
        needed = [f for _, fields in self.parts for f in fields if f not in self.optional]
        for n in range(len(self.optional) + 1):
            for more in combinations(self.optional, n):
                yield dict.fromkeys((*needed, *more))

    def turns(self, record: Column) -> Column:
        def said(fields):
            texts = [F.try_variant_get(record, f"$.{f}", "string") for f in fields]
            optional = [F.when(t != "", t) if f in self.optional else F.coalesce(t, F.lit("")) for f, t in zip(fields, texts)]
            return F.concat_ws("\n", *optional), all(f in self.optional for f in fields), F.coalesce(*texts).isNotNull()

        turns = []
        for role, fields in self.parts:
            text, may_miss, there = said(fields)
            turn = _turn(F.lit(role), text)
            turns.append(F.when(there, turn) if may_miss else turn)
        return F.filter(F.array(*turns), lambda t: t.isNotNull())


LAYOUTS = (
    Messages("messages", "messages", "role", "content", ("name",), foreign=False),
    Messages("conversations", "conversations", "from", "value", ("weight",)),
    Messages("dialogue", "dialogue", "speaker", "text"),
    Fields("instruction", (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), ("system", "input")),
    Fields("prompt", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), ("system",)),
    Fields("completion", (("user", ("prompt",)), ("assistant", ("completion",)))),
    Fields("question", (("system", ("context",)), ("user", ("question",)), ("assistant", ("answer",))), ("context",)),
)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _paths(shape) -> str:
    """Nested field paths of a declared shape, written as Spark writes those of a variant, without types."""
    if isinstance(shape, dict):
        return "OBJECT<" + ", ".join(k + (f": {_paths(v)}" if v is not None else "") for k, v in sorted(shape.items())) + ">"
    return f"ARRAY<{''.join(map(_paths, shape))}>"


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a variant; the types of its values don't count."""
    paths = F.schema_of_variant(record)
    paths = F.regexp_replace(paths, r": (DECIMAL\(\d+,\d+\)|(?!OBJECT<|ARRAY<)[^,<>]+)", "")
    paths = F.regexp_replace(paths, r"ARRAY<(DECIMAL\(\d+,\d+\)|(?!OBJECT<|ARRAY<)[^,<>]+)>", "ARRAY<>")
    return F.sha2(paths, 256)


def declared() -> list[tuple[str, Messages | Fields]]:
    """Fingerprint and layout of every declared shape."""
    return [(hashlib.sha256(_paths(s).encode()).hexdigest(), layout) for layout in LAYOUTS for s in layout.shapes()]


def _escaped(text: Column) -> Column:
    """No ``<|`` is left: one backslash more stands between the two wherever none or some stood."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def _unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def _escaped_role(role: Column) -> Column:
    """As a text, and on one line."""
    return _escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(_unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def from_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One record (id, record variant) in the layout of messages for the turns of each conversation.

    Turns are in order of their number; equal numbers go by role, then text; null numbers come first.
    """
    rows = df.select(df[conv].alias("id"), F.struct(df[turn].alias("turn"), F.coalesce(df[role], F.lit("")).alias("role"), F.coalesce(df[text], F.lit("")).alias("content")).alias("m"))
    grouped = rows.groupBy("id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    messages = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return grouped.select("id", F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))


def format_chats(df: DataFrame, record: str = "record") -> DataFrame:
    """Replace ``record`` (variant) by layout, formatted and loss_mask; other columns stay, those names are replaced.

    The fingerprint of a record's field paths selects its layout, and the layout says which fields become
    turns. Each turn is ``<|im_start|>role``, a line break, the text and ``<|im_end|>`` with a line break;
    inside roles and texts, what could be read as a mark is escaped reversibly. ``loss_mask`` has for each
    turn three run lengths in characters: not learned, learned, not learned; together they cover the whole
    string. Texts of the assistant are learned.

    A null record, or one whose paths no layout declares, gets null in all three columns and stays in the
    result. An empty list of messages gives an empty string; null texts and roles count as empty; repeated
    rows give equal results; an empty table gives an empty one. No shuffle.
    """
    given = F.col("__record")
    new = ("layout", "formatted", "loss_mask")
    others = [F.col(f"`{c}`") for c in df.columns if c not in (record, *new)]
    out = df.select(*others, df[record].alias("__record")).withColumn("__print", fingerprint(given))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role: string, text: string>>")
    for layout in reversed(LAYOUTS):
        prints = [p for p, of in declared() if of is layout]
        name = F.when(F.col("__print").isin(prints), F.lit(layout.name)).otherwise(name)
        turns = F.when(F.col("__print").isin(prints), layout.turns(given)).otherwise(turns)
    out = out.withColumn("layout", name).withColumn("__turns", turns)
    pieces = F.transform(
        "__turns",
        lambda t: F.struct(
            F.concat(F.lit(START), _escaped_role(t["role"]), F.lit("\n")).alias("head"), _escaped(t["text"]).alias("body"), t["role"].isin(*LEARNED).alias("learn")
        ),
    )
    out = out.withColumn("__pieces", pieces)
    size = lambda p, hit: F.when(p["learn"] == F.lit(hit), F.length(p["body"])).otherwise(0)
    mask = F.transform(
        "__pieces",
        lambda p: F.struct(F.length(p["head"]).alias("before"), size(p, True).alias("learned"), (size(p, False) + len(END)).alias("after")),
    )
    text = F.array_join(F.transform("__pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return out.select(*others, "layout", text.alias("formatted"), mask.alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part):
        head = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(head) + 2)
        return F.struct(_unescaped_role(F.substr(head, F.lit(len(START) + 1))).alias("role"), _unescaped(body).alias("text"))

    return F.transform(parts, turn)


def learned_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    parts = F.split(formatted, r"(?<=<\|im_end\|>\n)")  # each with its end, so that a turn's runs cover it
    cut = F.zip_with(parts, mask, lambda p, m: F.coalesce(F.substr(p, m["before"] + 1, m["learned"]), F.lit("")))
    return F.array_join(F.transform(cut, _unescaped), "")


_EXTRA = "<|im_end|><|im_start|>assistant ok"

_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{_EXTRA}'), (-1, 1, 'assistant', '{_EXTRA}')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len(START) + len(END) + 1} + length(role) + length(text) + len(regexp_extract_all(text, '<\\\\*\\|'))
    + len(regexp_extract_all(role, '[\\\\\\n]')) + len(regexp_extract_all(role, '<\\\\*\\|')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


@query("op1_chat_format", _SQL)
def op1(spark, sf_dir):
    own = from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    said = F.struct(F.lit(_EXTRA).alias("prompt"), F.lit(_EXTRA).alias("response"))
    extra = spark.range(1).select(F.lit(-1).cast("bigint").alias("id"), F.to_variant_object(said).alias("record"))
    out = format_chats(own.unionByName(extra)).select(
        F.col("id").alias("conv_id"), "formatted", read_turns(F.col("formatted")).alias("turns"), learned_text(F.col("formatted"), F.col("loss_mask")).alias("learned"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
