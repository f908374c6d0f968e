"""Chat formatting by schema fingerprints (native functions only).

A record is a JSON text in one of many layouts. Its nested field paths, without the types of
the leaves, are hashed; the hash selects a declared mapping that turns the record into
canonical turns ``array<struct<role,text>>``. Records built from rows are fingerprinted by a JSON
copy with emptied leaves, and the mapping reads their texts from the struct, so neither texts nor
turns meet a parser and its size limits. Turns are written with a marked template in
which control strings inside texts are escaped reversibly.

Edge cases: null or broken JSON, and layouts nobody declared, get ``layout`` null and no turns
(the row stays). A null text is an empty text, a null role an empty role. Repeated rows are
repeated turns, ties are ordered by turn, role, text. Empty tables give empty results. Extra
columns are carried or ignored, never read. A JSON text beyond ``LIMIT`` characters that does not parse may
be whole but too large for Spark's parser, which is an error, as is a row's record that does not parse.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
#: Shorter JSON texts are below the limits of Spark's parsers (20,000,000 characters in a string).
LIMIT = 15_000_000

#: Strings that a template of this or another family reads as control.
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
START, END = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class Layout:
    """A mapping: records with the field paths of ``example`` become the turns of ``turns`` (SQL over ``payload``),
    or of ``of_record`` (SQL over the struct ``record``)."""

    name: str
    example: str
    turns: str
    of_record: str | None = None


def _of_json(field: str) -> str:
    return f"get_json_object(payload, '$.{field}')"


def _of_record(field: str) -> str:
    return f"record.{field}"


def _pairs(*items: tuple[str, str]) -> tuple[str, str]:
    return tuple("array(" + ", ".join(f"named_struct('role', '{r}', 'text', {at(f)})" for r, f in items) + ")" for at in (_of_json, _of_record))


def _listed(field: str, role: str, text: str, names: str = "r") -> tuple[str, str]:
    parsed = f"from_json(payload, '{field} array<struct<`{role}`:string,`{text}`:string>>').{field}"
    renamed = f"CASE m.`{role}` {names} ELSE m.`{role}` END" if names != "r" else f"m.`{role}`"
    return tuple(f"transform({x}, m -> named_struct('role', {renamed}, 'text', m.`{text}`))" for x in (parsed, _of_record(field)))


def _with_input(at) -> str:
    return (f"array(named_struct('role', 'user', 'text', concat_ws('\\n', {at('instruction')}, nullif({at('input')}, ''))), "
            f"named_struct('role', 'assistant', 'text', {at('output')}))")


LAYOUTS = [
    Layout("messages", '{"messages":[{"role":"a","content":"b"}]}', *_listed("messages", "role", "content")),
    Layout("shared", '{"conversations":[{"from":"a","value":"b"}]}',
           *_listed("conversations", "from", "value", "WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant'")),
    Layout("prompt", '{"prompt":"a","response":"b"}', *_pairs(("user", "prompt"), ("assistant", "response"))),
    Layout("completion", '{"prompt":"a","completion":"b"}', *_pairs(("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", '{"instruction":"a","output":"b"}', *_pairs(("user", "instruction"), ("assistant", "output"))),
    Layout("system_instruction", '{"system":"a","instruction":"b","output":"c"}',
           *_pairs(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", '{"instruction":"a","input":"b","output":"c"}', _with_input(_of_json), _with_input(_of_record)),
]
#: Fields of the struct ``record``; a record's layout says which of them it has.
RECORD = {"messages": "array<struct<role:string,content:string>>", "conversations": "array<struct<from:string,value:string>>"} | dict.fromkeys(
    ("prompt", "response", "completion", "system", "instruction", "input", "output"), "string")


def fingerprint(payload: str | Column) -> Column:
    """Hash of the nested field paths of a JSON text; leaf types don't count, null for broken JSON."""
    shape = F.expr(f"schema_of_variant(try_parse_json({payload}))") if isinstance(payload, str) else F.schema_of_variant(F.try_parse_json(payload))
    leaf = r"(?<=: |ARRAY<|^)(?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|VARIANT|DATE|BINARY|TIMESTAMP(?:_NTZ)?|DECIMAL\(\d+,\s*\d+\))(?=[,>]|$)"
    return F.sha2(F.regexp_replace(shape, leaf, "*"), 256)


def canonical(records: DataFrame, layouts: list[Layout] | None = None, of_record: bool = False) -> DataFrame:
    """Adds ``schema_id``, ``layout`` and ``turns`` to records with a JSON column ``payload``.

    ``of_record``: payloads have emptied leaves, and the texts are in the struct ``record``.
    """
    layouts = [x for x in (LAYOUTS if layouts is None else layouts) if x.of_record or not of_record]
    broken = F.raise_error(F.lit("a record does not parse, or is larger than the parser takes")).cast("string")
    unread = F.lit(True) if of_record else F.length("payload") > LIMIT
    d = records.withColumn("schema_id", F.coalesce(fingerprint("payload"), F.when(unread, broken)))
    name, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for x in reversed(layouts):
        # the example is a literal: its hash is folded once, when the plan is optimized
        same = F.col("schema_id") == fingerprint(F.lit(x.example))
        name = F.when(same, F.lit(x.name)).otherwise(name)
        turns = F.when(same, F.expr(x.of_record if of_record else x.turns).cast(TURNS)).otherwise(turns)
    whole = F.transform(turns, lambda t: F.struct(F.coalesce(t.role, F.lit("")).alias("role"), F.coalesce(t.text, F.lit("")).alias("text")))
    return d.withColumn("layout", name).withColumn("turns", F.coalesce(whole, F.array().cast(TURNS)))


def _controls() -> str:
    def quoted(s):
        return "".join("\\" + c if c in "<>|[]/" else c for c in s)

    return "|".join(f"(?<={quoted(c[0])})(?={quoted(c[1:])})" for c in CONTROLS)


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one behind the first character of every control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(_controls()), F.lit("\\\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def format_turns(d: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``runs``: for each turn the characters of its head, text and tail, and whether the text is trained on.

    The runs are the loss mask in run lengths: they follow each other without gaps, and only
    the texts of assistant turns are under the mask. A line break in a role is escaped.
    """
    role = lambda t: F.replace(escape(t.role), F.lit("\n"), F.lit("\\\n"))
    made = F.transform(F.col("turns"), lambda t: F.struct(
        F.concat(F.lit(START), role(t), F.lit("\n")).alias("head"), escape(t.text).alias("body"), (t.role == "assistant").alias("loss")))
    d = d.withColumn("_made", made)
    formatted = F.array_join(F.transform("_made", lambda m: F.concat(m.head, m.body, F.lit(END))), "")
    runs = F.transform("_made", lambda m: F.struct(
        F.length(m.head).alias("head"), F.length(m.body).alias("text"), F.lit(len(END)).alias("tail"), m.loss.alias("loss")))
    return d.withColumn("formatted", formatted).withColumn("runs", runs).drop("_made")


def read_back(d: DataFrame) -> DataFrame:
    """Adds ``turns_read`` and ``loss_read`` (texts under the mask), both taken from ``formatted`` and ``runs`` only."""
    parts = F.split(F.col("formatted"), F.lit(r"<\|im_end\|>\n"), F.lit(-1))
    parts = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    d = d.withColumn("_parts", parts)
    head = r"(?s)^<\|im_start\|>((?:[^\\\n]|\\.)*+)\n(.*)$"
    turns = F.transform("_parts", lambda p: F.struct(
        unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_extract(p, head, 2)).alias("text")))
    masked = F.filter(F.arrays_zip(F.col("_parts").alias("part"), F.col("runs").alias("run")), lambda z: z["run"]["loss"])
    loss = F.transform(masked, lambda z: unescape(F.substr(z["part"], z["run"]["head"] + F.lit(1), z["run"]["text"])))
    return d.withColumn("turns_read", turns).withColumn("loss_read", loss).drop("_parts")


def records_of_rows(rows: DataFrame) -> DataFrame:
    """Conversation rows as one record each (struct ``record``), in the layout that publishers use for such a shape.

    One user and one assistant turn are a prompt record, with a system turn before them an
    instruction record; other conversations of known roles are message lists of either kind,
    and unknown roles always the plain message list. ``payload`` is the record as JSON with
    empty leaves; list elements that are equal then stand there once.
    """
    listed = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    d = rows.groupBy("conv_id").agg(listed.alias("t"))
    roles = F.transform("t", lambda x: x.role)
    at = lambda i: F.col("t")[i]["text"]
    other = F.transform("t", lambda x: F.struct(
        F.when(x.role == "user", "human").when(x.role == "assistant", "gpt").otherwise(x.role).alias("from"), x.text.alias("value")))
    plain = F.transform("t", lambda x: F.struct(x.role.alias("role"), x.text.alias("content")))
    lit = lambda *a: F.array(*map(F.lit, a))
    kinds = [
        (roles == lit("user", "assistant"), {"prompt": at(0), "response": at(1)}),
        (roles == lit("system", "user", "assistant"), {"system": at(0), "instruction": at(1), "output": at(2)}),
        ((F.pmod(F.col("conv_id"), F.lit(2)) == 0) & (F.size(F.array_except(roles, lit("system", "user", "assistant"))) == 0), {"conversations": other}),
        (F.lit(True), {"messages": plain}),
    ]

    def emptied(field: str, value: Column) -> Column:
        names = {"messages": ("role", "content"), "conversations": ("from", "value")}.get(field)
        return F.array_distinct(F.transform(value, lambda m: F.struct(*[F.left(m[n], F.lit(0)).alias(n) for n in names]))) if names else F.left(value, F.lit(0))

    payload = record = None
    for when, fields in reversed(kinds):
        made = F.struct(*[fields.get(f, F.lit(None)).cast(kind).alias(f) for f, kind in RECORD.items()])
        leaves = F.to_json(F.struct(*[emptied(f, v).alias(f) for f, v in fields.items()]))
        record = made if record is None else F.when(when, made).otherwise(record)
        payload = leaves if payload is None else F.when(when, leaves).otherwise(payload)
    return d.select("conv_id", payload.alias("payload"), record.alias("record"))


def digest(d: DataFrame) -> DataFrame:
    """The read-back turns and masked texts of each conversation as counts and hashes."""
    turns = F.array_join(F.transform("turns_read", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(F.col("loss_read"), "")
    return d.select(
        "conv_id",
        F.size("turns_read").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


def added_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts consist of another template's control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")


def format_conversations(rows: DataFrame) -> DataFrame:
    """Conversation rows to records, canonical turns, formatted texts and their digests."""
    return digest(read_back(format_turns(canonical(records_of_rows(rows), of_record=True))))
