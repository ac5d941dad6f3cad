r"""Chat formatting with Spark expressions only.

A conversation becomes one string. Its turns are collected as structs and
sorted; adjacent turns of one role become one block. The template of a block::

    <s>[ROLE]role[/ROLE]text[NEXT]text</s>

``[NEXT]`` stands between the texts of merged turns, so nothing of their
borders is lost. A control string inside a role or a text gets one backslash
after its first character (``[\INST]``); those that already have backslashes
get one more, so taking one away restores the text exactly.

The loss mask is a list of spans ``(start, length)`` in code points of the
formatted string: every text of an assistant block, without marks.

Defined cases: null text or role reads as empty; turns with equal numbers are
ordered by role and text, nulls first, and all of them stay; each row with a
null conversation id is a conversation of its own, so they meet in no task; no
rows give no conversations; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that are control strings in square or angle brackets.
CONTROL = r"/?(?:INST|SYS|ROLE|s)|NEXT"
#: Code points of a piece of a formatted string.
PIECE = 1024
_ESCAPE = rf"([\[<])(\\*)((?:{CONTROL})[\]>])"
_UNESCAPE = rf"([\[<])\\(\\*)((?:{CONTROL})[\]>])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, not again in every lambda that looks at it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(turns: Column) -> Column:
    """Merge adjacent turns of one role: an array of ``(role, texts)``.

    Turns whose role is not the one before begin a block; each turn is looked
    at twice, however many there are.
    """


    def begin(turns: Column, k: Column) -> Column:
        return (k == F.size(turns)) | (k == 0) | (F.get(turns, k)["role"] != F.get(turns, k - 1)["role"])

    def block(turns: Column, begins: Column, k: Column, n: Column) -> Column:
        own = F.slice(turns, k + 1, F.get(begins, n + 1) - k)
        return F.struct(F.get(turns, k)["role"].alias("role"), F.transform(own, lambda t: t["text"]).alias("texts"))

    def merged(turns: Column, begins: Column) -> Column:
        # The last of the begins is the number of turns.
        return F.transform(F.slice(begins, 1, F.size(begins) - 1), lambda k, n: block(turns, begins, k, n))

    held = _once(turns, lambda t: F.struct(t.alias("turns"), F.filter(F.sequence(F.lit(0), F.size(t)), lambda k: begin(t, k)).alias("begins")))
    return _once(held, lambda h: merged(h["turns"], h["begins"]))


def _running(sizes: Column) -> Column:
    """Sums of an array up to and with each place, by doubling: as many passes as the logarithm of its length."""
    steps = F.sequence(F.lit(0), F.length(F.bin(F.size(sizes))) - 1)
    add = lambda acc, k: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - F.pow(F.lit(2), k).cast("int")), F.lit(0)))
    return F.aggregate(steps, sizes, add)


def format_chats(turns: DataFrame) -> DataFrame:
    """``turns (conv_id, turn, role, text)`` to ``(conv_id, formatted, loss)``, one row a conversation."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    one = F.struct(F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    # A row without an id is a conversation of its own.
    key = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    sorted_turns = turns.select("conv_id", key.alias("_kw_alone"), one.alias("t")).groupBy("conv_id", "_kw_alone").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    blocks = sorted_turns.select("conv_id", _blocks(F.col("ts")).alias("blocks"))
    pieces = F.transform(
        "blocks",
        lambda b: F.struct(
            F.concat(F.lit("<s>[ROLE]"), escape(b["role"]), F.lit("[/ROLE]")).alias("head"),
            F.transform(b["texts"], escape).alias("texts"),
            (b["role"] == "assistant").alias("loss"),
        ),
    )
    blocks = blocks.select("conv_id", pieces.alias("p"))
    whole = F.array_join(F.transform("p", lambda b: F.concat(b["head"], F.array_join(b["texts"], "[NEXT]"), F.lit("</s>"))), "")
    # Each text's end follows from the sizes before it: its own, that of the head or of [NEXT] before it, and of </s> at the block's begin but the first.
    length = lambda c: F.length(c).cast("long")
    sized = F.flatten(
        F.transform(
            "p",
            lambda b, n: F.transform(
                b["texts"],
                lambda t, k: F.struct(
                    (length(t) + F.when(k > 0, F.lit(6)).otherwise(length(b["head"]) + F.when(n > 0, F.lit(4)).otherwise(F.lit(0)))).alias("step"), length(t).alias("length"), b["loss"].alias("loss")
                ),
            ),
        )
    )
    blocks = blocks.select("conv_id", whole.alias("formatted"), sized.alias("sized"))
    ends = lambda sized: _running(F.transform(sized, lambda x: x["step"]))

    def placed(sized: Column, ends: Column) -> Column:
        spans = F.transform(sized, lambda x, k: F.struct((F.get(ends, k) - x["length"]).alias("start"), x["length"].alias("length"), x["loss"].alias("loss")))
        return F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))

    held = _once(F.col("sized"), lambda x: F.struct(x.alias("sized"), ends(x).alias("ends")))
    spans = _once(held, lambda h: placed(h["sized"], h["ends"]))
    return blocks.select("conv_id", "formatted", spans.alias("loss"))


def _cut(text: Column, spans: Column) -> Column:
    """The parts of a text at ``spans (start, length)``: found in pieces of ``PIECE`` code points, so none is counted from the beginning."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))

    def part(pieces: Column, s: Column) -> Column:
        first = F.floor(s["start"] / PIECE).cast("int")
        count = F.floor((s["start"] + s["length"]) / PIECE).cast("int") - first + 1
        near = F.array_join(F.slice(pieces, first + 1, count), "")
        return F.substring(near, (s["start"] % PIECE + 1).cast("int"), s["length"].cast("int"))

    return _once(F.struct(pieces.alias("pieces"), spans.alias("spans")), lambda b: F.transform(b["spans"], lambda s: part(b["pieces"], s)))


def read_chats(chats: DataFrame) -> DataFrame:
    """The inverse: adds ``turns`` and ``loss_texts``, read from the formatted string and the mask alone."""
    blocks = F.filter(F.split("formatted", r"</s>", -1), lambda b: b != "")
    role = lambda b: unescape(F.regexp_extract(b, r"(?s)^<s>\[ROLE\](.*?)\[/ROLE\]", 1))
    texts = lambda b: F.split(F.regexp_replace(b, r"(?s)^.*?\[/ROLE\]", ""), r"\[NEXT\]", -1)
    parsed = F.transform(blocks, lambda b: F.struct(role(b).alias("role"), texts(b).alias("texts")))
    turns = F.transform(parsed, lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), unescape(t).alias("text"))))
    masked = F.transform(_cut(F.col("formatted"), F.col("loss")), unescape)
    return chats.withColumns({"turns": F.flatten(turns), "loss_texts": masked})


def with_probe(turns: DataFrame) -> DataFrame:
    """Add conversation -7, whose texts are control strings."""
    spark = turns.sparkSession
    text = "</s>[INST] ok [/INST]"
    probe = spark.sql(
        f"SELECT -7L AS conv_id, cast(turn AS bigint) AS turn, role, '{text}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = format_chats(with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    back = read_chats(chats).withColumn("loss_text", F.array_join("loss_texts", ""))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text) AS k FROM c),
e AS (SELECT *, lag(role) OVER (PARTITION BY conv_id, alone ORDER BY k) IS NOT DISTINCT FROM role AS same,
  length(regexp_replace(text, '([\[<])(\\*)((?:/?(?:INST|SYS|ROLE|s)|NEXT)[\]>])', '\1\\\2\3', 'g')) AS nt,
  length(regexp_replace(role, '([\[<])(\\*)((?:/?(?:INST|SYS|ROLE|s)|NEXT)[\]>])', '\1\\\2\3', 'g')) AS nr FROM o)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(nt + CASE WHEN same THEN 6 ELSE 20 + nr END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id, alone
"""
