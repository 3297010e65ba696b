"""Extraction documents of a model: each is checked whole, and what can be put right is put right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewell.functions import text as T
from notewell.operators.editing import stripped

# Bounds of an extraction; what goes beyond is an error, but for tags, evidence, aliases and details, which are cut.
MAX_SECTIONS, MAX_SECTION_CHARS, MIN_BODY = 100, 50_000, 200
MAX_ENTITIES, MAX_RELATIONS, MAX_ISSUES = 500, 500, 100
MAX_DETAIL, MAX_EVIDENCE, MAX_ALIASES, MAX_ENTITY_TAGS = 2_000, 200, 20, 20
MIN_TAGS, MAX_TAGS = 2, 8
SLUG = r"\A[a-z0-9-]{1,80}\z"
NOT_IN_NAMES = r'[/\\:*?"<>|]'
ENTITY_TOKEN = r"\{\{E:([^}]{1,120})\}\}"
KINDS, SALIENCES = ("entity", "concept"), ("primary", "secondary", "passing")
NO_HEADING = "Resume"


def _filled(value: Column) -> Column:
    return F.coalesce(stripped(value), F.lit(""))


def _slug(value: Column, size: int = 80) -> Column:
    return F.regexp_replace(T.slug(F.coalesce(value, F.lit("")), size), "-+$", "")


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING and so on; empty for what isn't there."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), F.lit(""))


def _list(value: Column, path: str) -> Column:
    """The elements of a list; what isn't a list is an empty one."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))


def _objects(values: Column, most: int) -> Column:
    """The objects among the first ``most`` elements; whatever else stands there is skipped."""
    return F.filter(F.slice(values, 1, most), lambda x: _kind(x) == "OBJECT")


def _texts(values: Column) -> Column:
    return F.transform(F.filter(values, lambda x: _kind(x) == "STRING"), lambda x: F.variant_get(x, "$", "string"))


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "string")


def _with(value: Column, **fields: Column) -> Column:
    """An object with some fields set, or left alone where their new value is null; all others stay."""
    new = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields.items()]), lambda e: e["value"].isNotNull()))
    old = F.coalesce(F.try_variant_get(value, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    return F.to_variant_object(F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new))


def _variants(values: Column) -> Column:
    return F.to_variant_object(values)


def canonical(body: Column) -> Column:
    """JSON without white space, keys in order at every level; null for what isn't JSON."""
    return F.to_json(F.try_parse_json(body))


def digest(body: Column) -> Column:
    """SHA-256 of the canonical form: equal for documents that differ in key order and white space only."""
    return F.sha2(canonical(body).cast("binary"), 256)


def _share(value: Column, default: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(default))))


def _said(*cases: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(when, F.lit(what)) for what, when in cases]))


def _entity(e: Column) -> Column:
    name = F.trim(F.regexp_replace(_filled(_field(e, "name")), NOT_IN_NAMES, "-"))
    own = _filled(_field(e, "slug"))
    kind, salience = _field(e, "kind"), _field(e, "salience")
    return F.struct(
        e.alias("raw"),
        name.alias("name"),
        F.when(own.rlike(SLUG), own).otherwise(_slug(F.when(own != "", own).otherwise(name))).alias("slug"),
        F.when(kind.isin(*KINDS), kind).otherwise(KINDS[0]).alias("kind"),
        F.when(salience.isin(*SALIENCES), salience).otherwise(SALIENCES[-1]).alias("salience"),
        F.substring(_field(e, "evidence"), 1, MAX_EVIDENCE).alias("evidence"),
        F.array_distinct(F.filter(F.transform(_texts(F.slice(_list(e, "$.tags"), 1, MAX_ENTITY_TAGS)), lambda t: _slug(t, 40)), lambda t: t != "")).alias("tags"),
        F.filter(F.transform(_texts(F.slice(_list(e, "$.aliases"), 1, MAX_ALIASES)), stripped), lambda a: a != "").alias("aliases"),
    )


def _known_tokens(markdown: Column, slugs: Column) -> Column:
    """Markdown in which the tokens of entities that don't exist are plain words."""
    prose, names, whole = F.split(markdown, ENTITY_TOKEN), F.regexp_extract_all(markdown, F.lit(ENTITY_TOKEN), F.lit(1)), F.regexp_extract_all(markdown, F.lit(ENTITY_TOKEN), F.lit(0))
    shown = F.zip_with(names, whole, lambda n, w: F.when(F.array_contains(slugs, n), w).otherwise(F.replace(n, F.lit("-"), F.lit(" "))))
    return F.array_join(F.flatten(F.zip_with(prose, shown, lambda p, s: F.array(p, F.coalesce(s, F.lit(""))))), "")


def validated(documents: DataFrame) -> DataFrame:
    """``documents`` (body, …) with ``ok``, ``errors``, ``warnings``, ``extraction`` and ``document``.

    ``extraction`` has the known fields of the corrected document; ``document`` is all of it as canonical
    JSON, with every field that the rules don't name as it came. Elements of another kind than their list's
    are skipped.

    One row's expressions: nothing is shuffled. A body that isn't an object with a note has one error.
    Of entities with one slug the first stays; relations between entities that aren't there, or of one
    with itself, are dropped; tokens of such entities become words. Warnings name a kind once.
    """
    held = documents.withColumn("_p", F.try_parse_json("body"))
    p = F.col("_p")
    note = F.try_variant_get(p, "$.note", "variant")
    held = held.withColumns({"_n": note, "_s": _list(p, "$.note.sections"), "_e": _list(p, "$.entities"), "_r": _list(p, "$.relations"), "_i": _list(p, "$.issues"), "_t": _texts(_list(p, "$.note.tags"))})
    own_title, own_summary, own_date = (F.try_variant_get("_p", f"$.note.{c}", "string") for c in ("title", "summary", "doc_date"))

    sized = F.transform(_objects(F.col("_s"), MAX_SECTIONS), lambda s: F.struct(s.alias("raw"), F.when(_filled(_field(s, "heading")) == "", NO_HEADING).otherwise(_field(s, "heading")).alias("heading"), _field(s, "markdown").alias("markdown"), F.char_length(_filled(_field(s, "markdown"))).alias("size")))
    held = held.withColumns({"_sized": sized, "_named": F.transform(_objects(F.col("_e"), MAX_ENTITIES), _entity)})
    held = held.withColumn("_usable", F.filter("_named", lambda e: (e["name"] != "") & (e["slug"] != "")))
    held = held.withColumn("_slugs", F.transform("_usable", lambda e: e["slug"]))
    held = held.withColumns({
        "_kept": F.filter("_sized", lambda s: (s["size"] > 0) & (s["size"] <= MAX_SECTION_CHARS)),
        "_good": F.filter("_usable", lambda e, k: F.array_position("_slugs", e["slug"]) == k + 1),
        "_linked": F.filter(
            F.transform(_objects(F.col("_r"), MAX_RELATIONS), lambda r: F.struct(r.alias("raw"), _filled(_field(r, "from")).alias("from"), _filled(_field(r, "to")).alias("to"), _share(_field(r, "confidence"), 0.5).alias("confidence"))),
            lambda r: F.array_contains("_slugs", r["from"]) & F.array_contains("_slugs", r["to"]) & (r["from"] != r["to"]),
        ),
        "_coded": F.transform(_objects(F.col("_i"), MAX_ISSUES), lambda i: F.struct(F.substring(_filled(_field(i, "code")), 1, 80).alias("code"), F.coalesce(_field(i, "detail"), F.lit("")).alias("detail"))),
        "_tags": F.array_distinct(F.filter(F.transform("_t", lambda t: _slug(t, 40)), lambda t: t != "")),
        "_own": _filled(F.try_variant_get("_p", "$.note.slug", "string")), "_title": _filled(own_title), "_date": _filled(own_date),
    })
    held = held.withColumns({
        "_shown": F.transform("_kept", lambda s: F.struct(s["raw"].alias("raw"), s["heading"].alias("heading"), _known_tokens(s["markdown"], F.col("_slugs")).alias("markdown"))),
        "_body": F.aggregate("_kept", F.lit(0), lambda n, s: n + s["size"]),
        "_slug": F.when(F.col("_own").rlike(SLUG), F.col("_own")).otherwise(_slug(F.when(F.col("_own") != "", F.col("_own")).otherwise(F.col("_title")))),
        "_dated": F.when(F.col("_date").rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.col("_date")),
    })

    whole = _kind(F.col("_n")) == "OBJECT"
    issues_kind = _kind(F.try_variant_get("_p", "$.issues", "variant"))
    errors = _said(
        ("no title", F.col("_title") == ""), ("no slug", F.col("_slug") == ""), ("no sections", F.size("_s") == 0), ("too many sections", F.size("_s") > MAX_SECTIONS),
        ("section too long", F.exists("_sized", lambda s: s["size"] > MAX_SECTION_CHARS)), ("no usable section", F.size("_kept") == 0), ("short body", F.col("_body") < MIN_BODY),
        ("too few tags", F.size("_tags") < MIN_TAGS), ("too many entities", F.size("_e") > MAX_ENTITIES), ("too many relations", F.size("_r") > MAX_RELATIONS),
        ("issues not a list", ~issues_kind.isin("ARRAY", "VOID", "")), ("too many issues", F.size("_i") > MAX_ISSUES),
    )
    plain = F.transform("_shown", lambda s: s["markdown"])
    warnings = _said(
        ("slug corrected", ~F.col("_own").rlike(SLUG) & (F.col("_slug") != "")), ("empty section", F.exists("_sized", lambda s: s["size"] == 0)), ("no summary", _filled(own_summary) == ""),
        ("tags cut", F.size("_tags") > MAX_TAGS), ("date ignored", (F.col("_date") != "") & F.col("_dated").isNull()), ("nameless entity", F.exists("_named", lambda e: e["name"] == "")),
        ("name cleaned", F.exists("_named", lambda e: _filled(_field(e["raw"], "name")).rlike(NOT_IN_NAMES))), ("entity without slug", F.exists("_named", lambda e: (e["name"] != "") & (e["slug"] == ""))),
        ("entity repeated", F.size("_good") < F.size("_usable")), ("tokens without entity", plain != F.transform("_kept", lambda s: s["markdown"])), ("wikilink", F.exists(plain, lambda m: F.contains(m, F.lit("[[")))),
        ("relations dropped", F.size("_linked") < F.size(_objects(F.col("_r"), MAX_RELATIONS))), ("issue without code", F.exists("_coded", lambda i: i["code"] == "")),
        ("detail cut", F.exists("_coded", lambda i: (i["code"] != "") & (F.char_length(i["detail"]) > MAX_DETAIL))),
    )
    without_raw = lambda values, *names: F.transform(values, lambda x: F.struct(*[x[n].alias(n) for n in names]))
    good = F.transform("_good", lambda e: F.struct(*[e[n].alias(n) for n in ("name", "slug", "kind", "salience")], F.coalesce(e["evidence"], F.lit("")).alias("evidence"), e["tags"].alias("tags"), e["aliases"].alias("aliases")))
    told = F.transform(F.filter("_coded", lambda i: i["code"] != ""), lambda i: F.struct(i["code"].alias("code"), F.substring(i["detail"], 1, MAX_DETAIL).alias("detail")))
    tags, sure = F.slice("_tags", 1, MAX_TAGS), _share(F.try_variant_get("_p", "$.confidence", "string"), 0.0)
    corrected = F.struct(
        F.struct(own_title.alias("title"), F.col("_slug").alias("slug"), own_summary.alias("summary"), F.col("_dated").alias("doc_date"), tags.alias("tags"), without_raw("_shown", "heading", "markdown").alias("sections")).alias("note"),
        good.alias("entities"), without_raw("_linked", "from", "to", "confidence").alias("relations"), told.alias("issues"), sure.alias("confidence"),
    )
    as_variant = lambda x: x.cast("variant")
    sections = F.transform("_shown", lambda s: _with(s["raw"], heading=as_variant(s["heading"]), markdown=as_variant(s["markdown"])))
    entities = F.transform("_good", lambda e: _with(e["raw"], **{n: as_variant(e[n]) for n in ("name", "slug", "kind", "salience", "evidence", "tags", "aliases")}))
    relations = F.transform("_linked", lambda r: _with(r["raw"], **{n: as_variant(r[n]) for n in ("from", "to", "confidence")}))
    noted = _with(
        F.col("_n"), slug=F.when(~F.col("_own").rlike(SLUG), as_variant(F.col("_slug"))), tags=as_variant(tags), sections=_variants(sections),
        doc_date=F.coalesce(as_variant(F.col("_dated")), F.parse_json(F.lit("null"))),
    )
    document = F.to_json(_with(p, note=noted, entities=_variants(entities), relations=_variants(relations), issues=F.to_variant_object(told), confidence=as_variant(sure)))
    made = held.withColumn("errors", F.when(whole, errors).otherwise(F.array(F.lit("no note"))))
    made = made.withColumns({"ok": F.size("errors") == 0, "warnings": F.when(whole, warnings).otherwise(F.array().cast("array<string>")), "extraction": F.when(whole, corrected), "document": F.when(whole, document)})
    return made.drop(*[c for c in made.columns if c.startswith("_") and c not in documents.columns])


# Fixed value: one fence around a whole answer.
FENCED = r"(?s)\A```(?:json)?[ \t]*\n(.*)\n```\z"
MARKS = "\ufeff"


def parsed_answers(answers: DataFrame) -> DataFrame:
    """``answers`` (answer, …) with ``body``, ``problem`` and ``digest``: the JSON object that a model's answer is.

    Nothing is put right but the wrapping: white space and byte-order marks around it, one fence around
    all of it, and an object that holds an object ``extraction`` alone. What else is refused: ``empty``, ``not JSON`` or
    ``not an object``. The body is canonical JSON.
    """
    bare = stripped(F.ltrim(stripped(F.coalesce("answer", F.lit(""))), F.lit(MARKS)))
    text = F.when(bare.rlike(FENCED), stripped(F.regexp_extract(bare, FENCED, 1))).otherwise(bare)
    held = answers.withColumn("_text", text).withColumn("_v", F.try_parse_json(F.when(F.col("_text") != "", F.col("_text"))))
    alone = (F.size(F.map_keys(F.try_variant_get("_v", "$", "map<string,variant>"))) == 1) & (_kind(F.try_variant_get("_v", "$.extraction", "variant")) == "OBJECT")
    inner = F.when((_kind(F.col("_v")) == "OBJECT") & F.coalesce(alone, F.lit(False)), F.try_variant_get("_v", "$.extraction", "variant")).otherwise(F.col("_v"))
    held = held.withColumn("_o", inner)
    problem = F.when(F.col("_text") == "", "empty").when(F.col("_v").isNull(), "not JSON").when(_kind(F.col("_o")) != "OBJECT", "not an object")
    held = held.withColumn("problem", problem).withColumn("body", F.when(F.col("problem").isNull(), F.to_json("_o")))
    return held.withColumn("digest", F.sha2(F.col("body").cast("binary"), 256)).drop("_text", "_v", "_o")
