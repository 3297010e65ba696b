"""PII by patterns, and information-theoretic sanitisation of the terms that give it away.

Personal data are found by pattern in every text. Each value is a protected entity e; the terms t
of its documents are weighed by corpus co-occurrence: with N documents, n(t) of them holding the
term, n(e) the entity and n(t,e) both, anywhere in the text,

    disclosure(t, e) = PMI(t; e) / IC(e) = 1 - ln(n(t) / n(t,e)) / ln(N / n(e)),

1 where the term never stands without the entity. Terms at ``generalise_at`` or more are replaced
by a class, at ``remove_at`` or more dropped, wherever they stand outside personal data in the
documents that hold the entity. Terms are words of at least three letters or digits; all counts
are over all rows.

Only DataFrame functions run. One scan finds the spans (written once, with the texts that have
any), one counts terms. Entities without support leave before terms meet entities; partial
aggregation comes before every count's shuffle, and only texts with personal data are joined.

Defined results: a null text counts as empty: no span, and null stays null in the sanitised text;
rows that repeat a document are sanitised alike; entities in one document or in all give no
information and no term; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewell.llm.common import Workspace, fresh_name

KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT = 3
GENERALISE_AT = 0.8
REMOVE_AT = 0.95

# The base patterns, with possessive repeats and start conditions that change no
# match but keep long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"
WORD = r"(?<![\p{L}\p{N}])[\p{L}\p{N}]{3,}+(?![\p{L}\p{N}])"
SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return value.rlike(_IP)
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def located(text: Column, pattern: str | Column, kind: str) -> Column:
    """All matches of a pattern with their places in code points, leftmost and not overlapping.

    The pieces between matches and the matches themselves give every offset as a running sum. It
    runs inside groups of about the square root of their number, and then over the groups: a
    running sum copies what it holds at every step, which over all matches at once would be quadratic.
    """
    matches, pieces = F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(F.length(p).cast("bigint").alias("gap"), m.alias("value")))
    zero = F.lit(0).cast("bigint")
    begin = F.struct(zero.alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(held: Column, pair: Column) -> Column:
        start = held["at"] + pair["gap"]
        end = start + F.length(pair["value"])
        span = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["value"].alias("value")))
        return F.struct(end.alias("at"), F.concat(held["spans"], span).alias("spans"))

    def grouped(all_: Column) -> Column:
        size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(all_)))).cast("int")
        starts = F.sequence(F.lit(0), ((F.size(all_) - 1) / size).cast("int"))
        return F.transform(starts, lambda k: F.aggregate(F.slice(all_, k * size + 1, size), begin, step))

    def shifted(groups: Column) -> Column:
        offsets = F.aggregate(groups, F.array(zero), lambda held, g: F.concat(held, F.array(F.element_at(held, -1) + g["at"])))
        moved = lambda g, by: F.transform(g["spans"], lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value")))
        return F.flatten(F.zip_with(groups, F.slice(offsets, F.lit(1), F.size(groups)), moved))

    # each intermediate array is the element of a one-element array, so that it is made once
    once = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    found = once(pairs, lambda all_: F.when(F.size(all_) > 0, once(grouped(all_), shifted)))
    return F.coalesce(found, F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of all kinds, by kind as listed, then start."""
    none = F.array().cast(SPAN)
    likely = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    has_digit = text.rlike("[0-9]")
    found = [
        F.when(likely.get(kind, has_digit), F.filter(located(text, pattern, kind), _validator(kind))).otherwise(none)
        for kind, pattern in PATTERNS.items()
    ]
    return F.concat(*found)


def _validator(kind: str):
    return lambda span: _valid(kind, span["value"])


def _entity(span: Column) -> Column:
    """What two spellings of one value share."""
    return F.concat_ws(":", span["kind"], F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"])))


def _scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, print, spans, entities, text) of every row; print tells texts of one id apart, and
    only rows with entities have their text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("print"), text.alias("text")).withColumn("spans", base_spans(F.col("text")))
    return base.select("doc_id", "print", "spans", F.array_distinct(F.transform("spans", _entity)).alias("entities"), F.when(F.size("spans") > 0, F.col("text")).alias("text"))


def _words(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def _same_text(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["of"]) & (a["print"] == b["of_print"])


def _per_text(rows: DataFrame, **collected: Column) -> DataFrame:
    return rows.groupBy(F.col("doc_id").alias("of"), F.col("print").alias("of_print")).agg(*[c.alias(n) for n, c in collected.items()])


def _holding(scanned: DataFrame, supported: DataFrame) -> DataFrame:
    """(doc_id, print, spans, text, entities) of the rows with supported entities, and those alone."""
    rows = scanned.where(F.size("entities") > 0).select("doc_id", "print", F.explode("entities").alias("entity"))
    kept = _per_text(rows.join(supported.select("entity"), "entity", "left_semi"), entities=F.collect_set("entity"))
    held = scanned.where(F.size("entities") > 0).drop("entities")
    return held.join(kept, _same_text(held, kept)).select("doc_id", "print", "spans", "text", "entities")


def _pairs(holding: DataFrame) -> DataFrame:
    """(doc_id, print, term, entity) of every term and entity of a row."""
    terms = holding.select("doc_id", "print", "entities", F.explode(_words(F.col("text"))).alias("term"))
    return terms.select("doc_id", "print", "term", F.explode("entities").alias("entity"))


def disclosing_terms(docs: DataFrame, holding: DataFrame, supported: DataFrame, min_support: int, at_least: float) -> DataFrame:
    """(term, entity, disclosure) of the pairs at or over the threshold."""
    pairs = _pairs(holding).groupBy("term", "entity").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= min_support)
    words = docs.select(F.explode(_words(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("term"))
    per_term = words.groupBy("term").agg(F.count("*").alias("n_t"))
    total = docs.agg(F.count("*").alias("n"))
    joined = pairs.join(supported, "entity").join(per_term, "term").crossJoin(F.broadcast(total))  # one row
    disclosure = 1 - F.log(F.col("n_t") / F.col("n_te")) / F.log(F.col("n") / F.col("n_e"))
    return joined.where(F.col("n_e") < F.col("n")).select("term", "entity", disclosure.alias("disclosure")).where(F.col("disclosure") >= at_least)


def _placed(holding: DataFrame, telling: DataFrame, remove_at: float) -> DataFrame:
    """(of, of_print, found): every place outside personal data of the telling terms of a text."""
    # of several entities of a text the one that a term discloses most counts
    most = _pairs(holding).join(telling, ["term", "entity"]).groupBy("doc_id", "print", "term").agg(F.max("disclosure").alias("disclosure"))
    kind = F.when(F.col("disclosure") >= remove_at, F.lit("removed")).otherwise(F.lit("generalised"))
    terms = _per_text(most, kinds=F.map_from_entries(F.collect_list(F.struct("term", kind.alias("kind")))))
    texts = holding.dropDuplicates(["doc_id", "print"])
    rows = texts.join(terms, _same_text(texts, terms)).select("of", "of_print", "text", "spans", "kinds")
    spelled = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), lambda w: F.map_contains_key(F.col("kinds"), F.lower(w)))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(spelled, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    rows = rows.withColumn("pattern", pattern)
    free = F.filter(located(F.col("text"), F.col("pattern"), "term"), lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    found = F.transform(free, lambda t: F.struct(F.element_at("kinds", F.lower(t["value"])).alias("kind"), t["start"].alias("start"), t["end"].alias("end"), F.lower(t["value"]).alias("value")))
    return rows.select("of", "of_print", found.alias("found"))


def private_spans(docs: DataFrame, min_support: int = MIN_SUPPORT, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """(doc_id, print, spans, terms): base spans of every row and the disclosing terms of its text."""
    space = Workspace(docs.sparkSession)
    scanned = space.save(_scanned(docs), "scanned")
    supported = scanned.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= min_support)
    holding = space.save(_holding(scanned, supported), "holding")
    telling = space.save(disclosing_terms(docs, holding, supported, min_support, generalise_at), "telling")
    placed = _placed(holding, telling, remove_at)
    joined = scanned.join(placed, _same_text(scanned, placed), "left")
    return joined.select("doc_id", "print", "spans", F.coalesce("found", F.array().cast(SPAN)).alias("terms"))


def sanitised_text(text: Column, spans: Column) -> Column:
    """``text`` with base spans replaced by their kind, generalised terms by TERM, others dropped."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).cast("bigint").alias("reach"), F.lit("").alias("out"))

    def step(held: Column, span: Column) -> Column:
        label = F.when(span["kind"] == "removed", F.lit("")).when(span["kind"] == "generalised", F.lit("[TERM]")).otherwise(F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]")))
        kept = F.substring(text, (held["reach"] + 1).cast("int"), F.greatest(span["start"] - held["reach"], F.lit(0).cast("bigint")).cast("int"))
        out = F.when(span["start"] < held["reach"], held["out"]).otherwise(F.concat(held["out"], kept, label))
        return F.struct(F.greatest(held["reach"], span["end"]).alias("reach"), out.alias("out"))

    tail = lambda held: F.concat(held["out"], F.substring(text, (held["reach"] + 1).cast("int"), F.length(text)))
    return F.aggregate(ordered, begin, step, tail)


def sanitise(docs: DataFrame, **limits: float) -> DataFrame:
    """The documents, with all their columns, with sanitised texts."""
    found = private_spans(docs, **limits)
    a, b, c = (fresh_name(docs, n) for n in ("of", "print", "spans"))
    unique = found.select(F.col("doc_id").alias(a), F.col("print").alias(b), F.concat("spans", "terms").alias(c)).where(F.size(c) > 0).dropDuplicates([a, b])
    text = docs["text"].cast("string")
    joined = docs.join(unique, docs["doc_id"].eqNullSafe(unique[a]) & (F.xxhash64(F.coalesce(text, F.lit(""))) == unique[b]), "left")
    new = F.when(unique[c].isNull() | text.isNull(), text).otherwise(sanitised_text(text, unique[c]))
    return joined.select(*[new.alias("text") if x == "text" else docs[x] for x in docs.columns])
