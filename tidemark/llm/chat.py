"""Chat formatting with Spark expressions only: turn rows to one training text per conversation with a loss mask.

Template of a run of adjacent turns of one role (``[NEXT]`` stands between the texts of a merged run)::

    [INST]role[/INST]first text[NEXT]second text</s>

A conversation is ``<s>`` followed by its runs. Control strings inside roles and texts are escaped with ``ESCAPE``
and a letter, so the parts of a text can be told from the template and every text comes back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import own_columns

#: The template's control strings, the escape sign (U+241B) and each one's letter after it.
BOS, EOS, OPEN, CLOSE, NEXT = "<s>", "</s>", "[INST]", "[/INST]", "[NEXT]"
ESCAPE = "␛"
LETTERS = {BOS: "b", EOS: "e", OPEN: "o", CLOSE: "c", NEXT: "n"}
ESCAPED_ESCAPE = ESCAPE + "x"
#: Running sums grow within blocks of so many turns, and over blocks, so that a long conversation takes about linear time.
BLOCK = 1024


def escape(text: Column) -> Column:
    """No control string is left in the result. The escape sign itself goes first, so that the change is reversible."""
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPED_ESCAPE))
    for control, letter in LETTERS.items():
        text = F.replace(text, F.lit(control), F.lit(ESCAPE + letter))
    return text


def unescape(text: Column) -> Column:
    for control, letter in LETTERS.items():
        text = F.replace(text, F.lit(ESCAPE + letter), F.lit(control))
    return F.replace(text, F.lit(ESCAPED_ESCAPE), F.lit(ESCAPE))


def _blocks(values: Column) -> Column:
    """An array cut into arrays of BLOCK values."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))


def _running(values: Column) -> Column:
    """0 and the running sums of an array of long."""
    return F.aggregate(values, F.array(F.lit(0).cast("long")), lambda sums, v: F.concat(sums, F.array(F.element_at(sums, -1) + v)))


def _tail(t: Column) -> Column:
    return F.when(t.closes, F.lit(len(EOS))).otherwise(0)


def _sizes(turns: Column) -> Column:
    """Code points that each turn adds: what stands before its text, the text, and the end of its run."""
    header = lambda t: F.when(t.n == 1, F.lit(len(BOS))).otherwise(0) + len(OPEN) + F.char_length(escape(t.role)) + len(CLOSE)
    lead = lambda t: F.when(t.opens, header(t)).otherwise(len(NEXT))
    return F.transform(turns, lambda t: (lead(t) + F.char_length(t.body) + _tail(t)).cast("long"))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, runs, formatted, loss_spans.

    ``turns`` has conv_id, turn, role, text. Turn structs are ordered by (turn, role, text), nulls first, so ties and
    repeated rows have a defined order; repeated rows are turns of their own. A null text or role is empty, a null
    conv_id is a conversation of its own. ``runs`` is the merged form: array<struct<role, texts>>. ``loss_spans`` is
    array<struct<start, stop>>: code points of ``formatted`` that the loss covers, one span per turn of ``loss_role``,
    without template and separators. Everything is built from the sorted array of a conversation's turns; as its text is
    one value, one conversation is one row. An empty table gives no rows.
    """
    base = own_columns(turns, conv_id="long", turn="long", role="string", text="string")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = base.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("sorted"))
    other = lambda t, i: ~F.get(F.col("sorted"), i).role.eqNullSafe(t.role)
    marked = grouped.withColumn("turns", F.transform("sorted", lambda t, i: F.struct((i + 1).alias("n"), t.role.alias("role"), escape(t.text).alias("body"), t.text.alias("text"), ((i == 0) | other(t, F.greatest(i - 1, F.lit(0)))).alias("opens"), other(t, i + 1).alias("closes"))))
    merged = marked.withColumns({"starts": F.filter("turns", lambda t: t.opens), "sizes": _sizes(F.col("turns"))})
    runs = F.transform("starts", lambda s, i: F.struct(s.role.alias("role"), F.slice("turns", s.n, F.coalesce(F.get(F.col("starts"), i + 1).n, F.size("turns") + 1) - s.n).alias("turns")))
    placed = merged.withColumns({"runs": runs, "inside": F.transform(_blocks(F.col("sizes")), _running)})
    bases = _running(F.transform("inside", lambda block: F.element_at(block, -1)))
    parts = F.zip_with("inside", bases, lambda block, base: F.transform(F.slice(block, F.lit(2), F.coalesce(F.size(block), F.lit(1)) - 1), lambda end: end + base))
    ends = F.flatten(F.filter(parts, lambda part: part.isNotNull()))
    span = lambda t, end: F.when(t.role == loss_role, F.struct((end - _tail(t) - F.char_length(t.body)).alias("start"), (end - _tail(t)).alias("stop")))
    block = lambda r: F.concat(F.lit(OPEN), escape(r.role), F.lit(CLOSE), F.array_join(F.transform(r.turns, lambda t: t.body), NEXT), F.lit(EOS))
    return placed.select(
        "conv_id",
        F.transform("runs", lambda r: F.struct(r.role.alias("role"), F.transform(r.turns, lambda t: t.text).alias("texts"))).alias("runs"),
        F.concat(F.lit(BOS), F.array_join(F.transform("runs", block), "")).alias("formatted"),
        F.filter(F.zip_with("turns", ends, span), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text as array<struct<role, text>>: the inverse of the template."""
    blocks = F.split(F.substr(formatted, F.lit(len(BOS) + 1)), r"\Q</s>\E")
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    role = lambda b: unescape(F.substr(F.substring_index(b, CLOSE, 1), F.lit(len(OPEN) + 1)))
    texts = lambda b: F.split(F.substr(b, F.char_length(F.substring_index(b, CLOSE, 1)) + len(CLOSE) + 1), r"\Q[NEXT]\E")
    return F.flatten(F.transform(blocks, lambda b: F.transform(texts(b), lambda t: F.struct(role(b).alias("role"), unescape(t).alias("text")))))


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped span by span, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s.start + 1).cast("int"), (s.stop - s.start).cast("int")))), "")


def op7_chat_formatting(spark, sf_dir: str) -> DataFrame:
    turns = own_columns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), conv_id="long", turn="long", role="string", text="string")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    chats = format_chats(turns.unionByName(planted))
    read = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        digest(F.col("loss")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _escape_sql(text: str) -> str:
    for found, put in ({ESCAPE: ESCAPED_ESCAPE} | {c: ESCAPE + x for c, x in LETTERS.items()}).items():
        text = f"replace({text}, '{found}', '{put}')"
    return text


OP7_SQL = """
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over () as r from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]', -2 union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]', -1),
esc as (
  select *, ESCAPED_ROLE as erole, ESCAPED_TEXT as etext,
    row_number() over w as n, lag(role) over w is distinct from role as opens, lead(role) over w is distinct from role as closes
  from rows window w as (partition by conv_id order by turn nulls first, role nulls first, text nulls first, r))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
  (3 + sum(length(etext) + case when opens then 13 + length(erole) else 6 end + case when closes then 4 else 0 end))::bigint as formatted_chars
from esc group by conv_id
""".replace("ESCAPED_ROLE", _escape_sql("role")).replace("ESCAPED_TEXT", _escape_sql("text"))
