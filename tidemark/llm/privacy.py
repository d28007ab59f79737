"""Information-theoretic sanitisation, in DataFrame functions only.

Emails, ip addresses, card and phone numbers are protected entities. The corpus tells which other words give one away
(Sanchez and Batet, "C-sanitized", 2016): with counts of documents, an entity c has the information IC(c) = ln(N / n(c)),
and a term t that is near it in n(c, t) documents reveals PMI(c, t) = ln(N n(c, t) / (n(c) n(t))) of it. The share
PMI / IC is at most 1, for a term that is met near c only. A term whose largest share exceeds ``REMOVE`` is removed,
one above ``GENERALISE`` is replaced by its kind, wherever it stands in a document that holds an entity, or in any document.
Evidence is counted in different surroundings: however often a text is copied, it is one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_az, own_columns
from tidemark.plans.staging import stage

#: Words on either side of an entity that count as near, different surroundings that a term needs, disclosure thresholds.
NEAR, EVIDENCE, GENERALISE, REMOVE = 10, 3, 0.6, 0.9
KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
#: Copies of the term list in its join with words, so that a word of a third of all rows is dealt over as many keys.
SALTS = 16

#: The contract's patterns in a form that takes linear time: a run is entered at its start only and never given back.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
_HINTS = {"email": "text like '%@%'", "ip": "text like '%.%'", "card": "text rlike '[0-9]'", "phone": "text like '%+%'"}
_LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: An entity stands in a marked text as U+0001, a letter for its kind, its hash in letters, U+0001.
_MARKS = "qrst"
_TOKEN = rf"\x01[{_MARKS}][a-p]+\x01"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def accepted(kind: str, match: Column) -> Column:
    """Whether a match of the kind's pattern is one of the kind."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        digits = F.translate(match, " -", "")
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _sums_before(steps: Column, block: int = 128) -> Column:
    """Sum of all earlier elements, for each element of an array that is a variable; sums of blocks keep this near linear."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def upto(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    n_blocks = F.ceil(F.size(steps) / block).cast("int")
    blocks = F.transform(upto(n_blocks), lambda b: total(F.slice(steps, b * block + 1, F.lit(block))))
    bases = let(blocks, lambda sums: F.transform(upto(n_blocks), lambda b: total(F.slice(sums, F.lit(1), b))))
    return let(bases, lambda base: F.transform(upto(F.size(steps)), lambda i: F.get(base, F.floor(i / block).cast("int")) + total(F.slice(steps, F.floor(i / block).cast("int") * block + 1, i % block))))


def _matches(text: Column, pattern: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the matches in a text and of the gaps before, between and after them; null without a match."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return let(found, lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda g: body(m, g))))


def places(text: Column, pattern: Column) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches, in code points, end exclusive."""

    def body(m: Column, g: Column) -> Column:
        sizes = F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda gap, match: F.struct(F.length(gap).cast("long").alias("gap"), F.length(match).cast("long").alias("n"), match.alias("value")))
        return let(sizes, lambda s: let(F.transform(s, lambda x: x["gap"] + x["n"]), lambda steps: F.zip_with(s, _sums_before(steps), lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["n"]).alias("end"), x["value"].alias("value")))))

    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return F.coalesce(_matches(text, pattern, body), empty)


def replaced(text: Column, pattern: Column, by: Callable[[Column], Column]) -> Column:
    """The text with every match replaced by ``by`` of it; where that is null the match stays."""

    def body(m: Column, g: Column) -> Column:
        return F.array_join(F.flatten(F.zip_with(g, m, lambda gap, match: F.array(gap, F.when(match.isNull(), F.lit("")).otherwise(F.coalesce(by(match), match))))), "")

    return F.coalesce(_matches(text, pattern, body), text)


def _entity(kind: str, match: Column) -> Column:
    """The mark of an entity: the same for the same address or number, however it is written."""
    value = F.regexp_replace(match, "[^0-9]", "") if kind in ("card", "phone") else lower_az(match)
    return F.concat(F.lit("\x01" + _MARKS[KINDS.index(kind)]), F.translate(F.lower(F.hex(F.xxhash64(value))), "0123456789", "ghijklmnop"), F.lit("\x01"))


def _all_replaced(text: Column, by: Callable[[str, Column], Column]) -> Column:
    """Emails, ips, cards and phones replaced, in this order, each kind in what the one before has left."""

    def one(kind: str, before: Column) -> Column:
        return let(before, lambda t: replaced(t, F.lit(PATTERNS[kind]), lambda m: F.when(accepted(kind, m), by(kind, m))))

    return functools.reduce(lambda before, kind: one(kind, before), PATTERNS, text)


def base_spans(docs: DataFrame, texts: bool = False) -> DataFrame:
    """row, doc_id, found (array of start, no, end; no is the place in ``KINDS``) and, where any is found or with ``texts``, text; staged."""
    base = own_columns(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    none = F.array().cast("array<struct<start:bigint,no:int,end:bigint>>")

    def spans(no: int, kind: str) -> Column:
        right = F.filter(places(F.col("text"), F.lit(PATTERNS[kind])), lambda s: accepted(kind, s["value"]))
        return F.when(F.expr(_HINTS[kind]), F.transform(right, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("no"), s["end"].alias("end")))).otherwise(none)

    found = base.select("doc_id", "text", F.array_sort(F.concat(*[spans(no, kind) for no, kind in enumerate(PATTERNS)])).alias("found"))
    return stage(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "found", F.when((F.size("found") > 0) | F.lit(texts), F.col("text")).alias("text")), "privacy-base")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(lower_az(text), F.lit(f"{_LETTER}+"), F.lit(0))


def disclosure(docs: DataFrame, marked: DataFrame, near: int = NEAR, evidence: int = EVIDENCE) -> DataFrame:
    """term, share: the largest share of an entity's information that a term reveals, of terms with enough evidence.

    ``marked`` has row and marked, the texts with entities as marks. All counts are of documents; pairs are of an entity
    and the words at most ``near`` places away, so their number grows with the texts and not with its square.
    """
    tokens = F.regexp_extract_all(lower_az(F.col("marked")), F.lit(f"{_TOKEN}|{_LETTER}+"), F.lit(0))

    def is_mark(x: Column) -> Column:
        return F.startswith(x, F.lit("\x01"))

    def around(t: Column) -> Column:
        at = F.filter(F.transform(t, lambda x, i: F.when(is_mark(x), i + 1)), F.isnotnull)
        low = lambda i: F.greatest(F.lit(1), i - near)
        return F.transform(at, lambda i: F.struct(F.element_at(t, i).alias("entity"), F.filter(F.slice(t, low(i), i + near + 1 - low(i)), lambda x: ~is_mark(x)).alias("near")))

    met = stage(marked.select("row", F.explode(let(tokens, around)).alias("c")).select("row", "c.entity", "c.near"), "privacy-near")
    pairs = met.select("row", "entity", F.xxhash64("near").alias("place"), F.explode(F.array_distinct("near")).alias("term"))
    joint = pairs.groupBy("entity", "term").agg(F.count_distinct("row").alias("both"), F.count_distinct("place").alias("places"))
    entities = met.groupBy("entity").agg(F.count_distinct("row").alias("n_entity"))
    candidates = stage(joint.where(F.col("places") >= evidence).join(entities, "entity"), "privacy-pairs")
    everywhere = own_columns(docs, text="string").select(F.explode(F.array_distinct(_words(F.coalesce("text", F.lit(""))))).alias("term"))
    counts = everywhere.groupBy("term").agg(F.count("*").alias("n_term"))  # before the join, so that it meets each term once
    n = F.lit(float(docs.count()))
    pmi, ic = F.log(n * F.col("both") / (F.col("n_entity").cast("double") * F.col("n_term"))), F.log(n / F.col("n_entity"))
    return candidates.join(counts, "term").where(ic > 0).groupBy("term").agg(F.max(pmi / ic).alias("share"))


def _shape(word: Column) -> Column:
    """What a generalised word is replaced by."""
    return F.when(word.rlike("^[0-9]+$"), F.lit("[NUMBER]")).when(word.rlike("[0-9]"), F.lit("[CODE]")).otherwise(F.lit("[WORD]"))


def sanitise(docs: DataFrame, near: int = NEAR, evidence: int = EVIDENCE, generalise: float = GENERALISE, remove: float = REMOVE, everywhere: bool = False) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end by start; spans has the terms too), sanitised; one row for each of ``docs``.

    Offsets are code points, end exclusive. ``base`` has the emails, ips, cards and phones, which may overlap one another;
    terms never overlap them. ``sanitised`` is the text with entities and terms replaced, null where it stays as it is;
    in it an overlapping entity of a later kind is what the earlier one leaves, and U+0001 becomes a space. Null texts
    are empty, and texts of any length are read whole. Terms are looked for in texts that hold an entity, with
    ``everywhere`` in all others too: there they give away an entity that is not named. Repeated rows have the same
    result each; a null doc_id stays null. An empty table gives no rows. Other columns are not read.
    """
    found = base_spans(docs, everywhere)
    held = F.size("found") > 0
    clean = F.translate("text", "\x01", " ")
    texts = _all_replaced(clean, _entity).alias("marked"), _all_replaced(clean, lambda kind, m: F.repeat(F.lit(" "), F.length(m))).alias("masked")
    marked = stage(found.where(held).select("row", *texts), "privacy-marked")
    others = found.where(~held & F.lit(everywhere)).select("row", clean.alias("marked"), clean.alias("masked"))  # not staged a second time
    shares = disclosure(docs, marked.select("row", "marked"), near, evidence)
    actions = shares.where(F.col("share") >= generalise).select("term", F.when(F.col("share") >= remove, F.lit(5)).otherwise(F.lit(4)).alias("no"))
    salted = stage(actions.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "privacy-terms")
    words = marked.unionAll(others).select("row", F.explode(F.array_distinct(_words(F.col("masked")))).alias("term"), F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"))
    flagged = stage(words.join(salted, ["term", "salt"]).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("term", "no"))).alias("flags")), "privacy-flags")
    changed = marked.join(flagged, "row", "left").unionAll(others.join(flagged, "row"))

    def action(word: Column) -> Column:
        return F.get(F.filter("flags", lambda f: f["term"] == lower_az(word)), 0)["no"]

    pattern = F.concat(F.lit(f"(?i)(?<!{_LETTER})(?:"), F.array_join(F.transform("flags", lambda f: f["term"]), "|"), F.lit(f")(?!{_LETTER})"))
    terms = F.transform(places(F.col("masked"), pattern), lambda s: F.struct(s["start"].alias("start"), action(s["value"]).alias("no"), s["end"].alias("end")))
    text = F.when(F.col("flags").isNull(), F.col("marked")).otherwise(replaced(F.col("marked"), pattern, lambda m: F.when(action(m) == 5, F.lit("[REMOVED]")).otherwise(_shape(m))))
    for kind, mark in zip(KINDS, _MARKS):
        text = F.regexp_replace(text, rf"\x01{mark}[a-p]+\x01", f"[{kind.upper()}]")
    results = changed.select("row", F.when(F.col("flags").isNotNull(), terms).alias("terms"), text.alias("sanitised"))  # before the join, which moves no unread text
    rows = found.select("row", "doc_id", "found").join(results, "row", "left")
    spans = F.when(F.col("terms").isNull(), F.col("found")).otherwise(F.array_sort(F.concat("found", "terms")))

    def named(array: Column) -> Column:
        return F.transform(array, lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["no"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return rows.select("doc_id", named(F.col("found")).alias("base"), named(spans).alias("spans"), "sanitised")


def op12_pii(spark, sf_dir: str) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(name: str) -> Column:
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    rows = sanitise(spark.read.parquet(f"{sf_dir}/documents.parquet"), everywhere=True)
    return rows.select("doc_id", *map(count, KINDS[:4]), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
