"""Personal data: exact patterns, and information-theoretic sanitisation around them. DataFrame operations only.

Four kinds of protected entities are found by pattern. The words of all
documents are then counted, and with the entities they share a document with;
a term's disclosure is the information it gives about one entity: the pointwise
mutual information log2(p(entity | term) / p(entity)) over all documents.
Terms that point at one entity in several documents, with p(entity | term) and
information above their thresholds, are spans of the kind ``term``: generalised
where other terms share their role, removed where they give the entity away.

Long strings of mixed letters and digits (keys, passwords, tokens) are terms that
reveal the documents that hold them, and so their holder: log2(documents / those
with the string) bits. Beyond the same threshold they are spans of the kind ``secret``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import forget, stored, text_key

#: Kinds in the order of the result.
KINDS = ("email", "ip", "card", "phone")
# The patterns match what the plain ones do, written so that long runs cost linear time:
# a run is entered at its first character only, and possessive groups need no stack.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these can't hold a match.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM = r"\p{L}{3,}"
#: 16 letters and digits or more without a break, some of each kind.
SECRET = r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digits pass the Luhn check."""
    each = F.split(F.reverse(digits), "")
    value = F.transform(F.filter(each, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$")
    if kind == "card":
        n = F.char_length(_digits(match))
        return F.when(n.between(13, 19), luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(_digits(match)).between(9, 15)
    return F.lit(True)


SPAN = "array<struct<start:int,end:int,match:string>>"


def base_spans(text: Column, kind: str) -> Column:
    hinted = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])
    return F.when(hinted, F.filter(spans_of(text, PATTERNS[kind]), lambda s: valid(kind, s["match"]))).otherwise(F.array().cast(SPAN))


def _let(value: Column, body) -> Column:
    """body(value), where the value is computed once however often body and its lambdas read it."""
    return F.transform(F.array(value), body)[0]


def masked(text: Column, base: Column) -> Column:
    """The text with a space for each code point of a base span."""

    def fill(text):
        def step(acc, s):
            gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
            blank = F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(acc["at"], s["start"]), F.lit(0)))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, blank).alias("out"))

        spans = F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))

    return F.when(F.size(base) == 0, text).otherwise(_let(text, fill))


#: Matches whose places are added up in one go; lists of a block grow by copying.
BLOCK = 128


def spans_of(text: Column, pattern: str) -> Column:
    """All matches of a text as (start, end, match), in code points. Places are summed within blocks, so a long text costs linear time."""
    empty = F.array().cast(SPAN)

    def one_block(at, block):
        def step(acc, x):
            start = acc["at"] + x["gap"]
            end = start + F.char_length(x["m"])
            one = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match"))
            return F.struct(end.alias("at"), F.concat(acc["all"], F.array(one)).alias("all"))

        return F.aggregate(block, F.struct(at.alias("at"), empty.alias("all")), step, lambda acc: acc["all"])

    def all_blocks(pieces):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int")), lambda b: F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(pieces) == 0, empty).otherwise(_let(blocks, from_blocks))

    def from_blocks(blocks):
        length = lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + F.char_length(x["m"]))
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, block: F.concat(acc, F.array(F.element_at(acc, -1) + length(block))))
        return F.flatten(F.zip_with(F.slice(starts, F.lit(1), F.size(blocks)), blocks, one_block))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = _let(matches, lambda ms: F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(ms)), ms, lambda p, m: F.struct(F.char_length(p).alias("gap"), m.alias("m"))))
    return _let(pieces, all_blocks)


def terms_of(text: Column) -> Column:
    """All terms of a text as (start, end, term), in lower case."""
    return F.transform(spans_of(text, TERM), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lower(s["match"]).alias("term")))


def _named(kind: str) -> Column:
    return F.transform(F.col(kind), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit("remove").alias("action")))


def _secrets(rows: DataFrame, total: int, min_bits: float) -> DataFrame:
    """row, secrets (start, end): strings of SECRET that few enough texts hold."""
    each = rows.where("size(opaque) > 0")
    held = each.select("sig", F.explode(F.array_distinct(F.transform("opaque", lambda s: s["match"]))).alias("match")).distinct()
    known = held.groupBy("match").agg(F.count("*").alias("n")).where(F.log2(F.lit(float(max(total, 1))) / F.col("n")) >= min_bits).select("match")
    found = each.select("row", F.explode("opaque").alias("s")).select("row", "s.*").join(stored(known, "secrets").hint("merge"), "match", "left_semi")
    return found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("secrets"))


def find(docs: DataFrame, min_docs: int = 3, min_share: float = 0.5, min_bits: float = 5.0, remove_bits: float = 9.0, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, base, terms and secrets (arrays of kind, start, end, action), and the text if asked.

    Null texts count as empty. Spans are in code points, end exclusive. Base spans
    are the patterns' valid matches; a match that fails its test is dropped
    without another try. Terms and secrets are those of whole texts outside base
    spans; terms, entities and both together are counted once per distinct text,
    over all documents (repeated rows and copies are no further evidence), and each
    occurrence of a term that gives away an entity is a span in all documents of
    that entity. Every row gets its spans, repeated or not. Without any entity
    there are no terms; a table of fewer than 2 ** min_bits texts has neither terms
    nor secrets. Other columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), *[base_spans(text, k).alias(k) for k in KINDS])
    every, any_base = F.concat(*KINDS), " or ".join(f"size({k}) > 0" for k in KINDS)
    opaque = F.when(F.col("text").rlike(SECRET), spans_of(masked(F.col("text"), every), SECRET)).otherwise(F.array().cast(SPAN))
    rows = stored(found.select("*", opaque.alias("opaque"), text_key(F.col("text")).alias("sig"), F.monotonically_increasing_id().alias("row")), "spans")
    lead = stored(rows.groupBy("sig").agg(F.min("row").alias("row")).select("row"), "lead")
    total = lead.count()
    texts = rows.join(lead.hint("merge"), "row", "left_semi")  # each distinct text once
    entities_of = F.explode(F.array_distinct(F.transform(every, lambda s: F.lower(s["match"])))).alias("entity")
    of_entity = texts.where(any_base).select(entities_of).groupBy("entity").agg(F.count("*").alias("n_entity"))
    # Entities in too few texts, or in so many that no term can give min_bits about them, have no telling terms.
    known = stored(of_entity.where((F.col("n_entity") >= min_docs) & (F.log2(F.lit(float(max(total, 1))) / F.col("n_entity")) >= min_bits)), "entities")
    most = known.agg(F.max("n_entity")).first()[0] or 0
    # Partial sums are taken before each exchange, so a frequent entity or term costs a row for each task.
    each = F.array_distinct(F.transform(F.regexp_extract_all(masked(F.col("text"), every), F.lit(TERM), F.lit(0)), F.lower))
    # Terms have no spaces: one string of a text's terms is dealt, less than its text or an array, whose items are padded.
    listed = rows.select("row", F.array_join(each, " ").alias("each")).where("each != ''").join(lead.hint("merge"), "row", "left_semi")
    of_term = stored(listed.select(F.explode(F.split("each", " ")).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")).where(F.col("n_term") >= min_docs), "terms")
    # Terms too common for min_share with any entity. They are those in more than a 64th of all texts at the most, and
    # broadcast if there are few of them; their rows would be dropped by the thresholds below in any case.
    common = of_term.where((F.col("n_term") * F.lit(min_share) > most) & (F.col("n_term") * 64 > total)).select("term")
    few = common.limit(100_001).count() <= 100_000
    uncommon = (lambda d: d.join(F.broadcast(common), "term", "left_anti")) if few else lambda d: d
    entities = rows.where(any_base).select("row", entities_of)
    by_doc = entities.join(known.select("entity").hint("merge"), "entity").groupBy("row").agg(F.collect_list("entity").alias("entities"))
    of_doc = rows.where(any_base).join(by_doc.hint("merge"), "row").select("row", "entities", masked(F.col("text"), every).alias("text"))
    beside = stored(of_doc.select("row", "entities", terms_of(F.col("text")).alias("t")), "beside")
    distinct = uncommon(beside.join(lead.hint("merge"), "row", "left_semi").select("entities", F.explode(F.array_distinct(F.col("t.term"))).alias("term")))
    pairs = stored(distinct.select(F.explode("entities").alias("entity"), "term").groupBy("entity", "term").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs), "pairs")
    likely = pairs.join(of_term.hint("merge"), "term").join(known.hint("merge"), "entity")
    share = F.col("n") / F.col("n_term")
    bits = F.log2(share * F.lit(float(total)) / F.col("n_entity"))
    telling = stored(likely.where((share >= min_share) & (bits >= min_bits)).select("entity", "term", F.when(bits >= remove_bits, "remove").otherwise("generalise").alias("action")), "telling")
    near = uncommon(beside.select("row", "entities", F.explode("t").alias("t")).select("row", "t.*", "entities")).select("row", "start", "end", "term", F.explode("entities").alias("entity"))
    spans = near.join(telling.hint("merge"), ["entity", "term"]).select("row", "start", "end", "action").groupBy("row", "start", "end").agg(F.max("action").alias("action"))
    by_row = stored(spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "action"))).alias("terms")), "by-row")
    secrets = stored(_secrets(rows, total, min_bits), "by-row")
    forget(lead, known, of_term, beside, pairs, telling)
    joined = rows.join(by_row.hint("merge"), "row", "left").join(secrets.hint("merge"), "row", "left").withColumn("base", F.concat(*[_named(k) for k in KINDS]))
    marked = lambda c, kind, action: F.transform(F.coalesce(c, F.array()), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), action(s).alias("action")))
    terms = marked(F.col("terms"), "term", lambda s: s["action"])
    return joined.select("doc_id", "base", terms.alias("terms"), marked(F.col("secrets"), "secret", lambda s: F.lit("remove")).alias("secrets"), *["text"] * keep_text)


def described(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, **how) -> DataFrame:
    """doc_id and text, each span replaced: entities and secrets by [KIND], terms to generalise by [TERM], terms to remove by nothing."""
    found = find(docs, keep_text=True, **how)
    spans = F.array_sort(F.transform(F.concat("base", "terms", "secrets"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when((s["kind"] == "term") & (s["action"] == "remove"), "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).alias("by"))))

    def step(acc, s):  # a span that begins inside the one before only lengthens it
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, F.when(s["start"] >= acc["at"], s["by"]).otherwise("")).alias("out"))

    text = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text"))))
    return found.select("doc_id", text.alias("text"))
