"""JSON documents against a JSON Schema, compiled to one column expression over VARIANT values, and whole reviews against
their schema, their contract and their numbers.

The compiler takes type (one or several), enum, required, properties, additionalProperties (false), items, minItems, maxItems,
minLength, anyOf and local references. Every broken rule is a row with its path, so a document is parsed once and nothing of
it goes to a Python worker."""

import json
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import findings as N
from ..session import cut, once, spread
from ..sources.files import strict_json
from . import checks as C
from . import numeric as A

_ERRORS = "array<struct<path:string,rule:string,detail:string>>"


def schema_errors(document: Column, schema: dict) -> Column:
    """array of (path, rule, detail) of a JSON text's broken rules: path by points, empty for the whole; detail is what is
    missing or too much. A text that is no strict JSON (strict_json) breaks the rule json."""
    no_json = F.array(_error([], "json")).cast(_ERRORS)
    return _let(strict_json(document), lambda v: F.when(v.isNull(), no_json).otherwise(_errors(v, schema, [], schema.get("$defs", {}))))


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _error(path: list, rule: str, detail: Column | None = None) -> Column:
    """An error at a path of names and of columns that number an array's items."""
    parts: list = []
    for p in path:
        if parts and isinstance(p, str) and isinstance(parts[-1], str):
            parts[-1] += f".{p}"
        else:
            parts.append(p)
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts] or [F.lit("")]
    where = columns[0] if len(columns) == 1 else F.concat_ws(".", *columns)
    return F.struct(where.alias("path"), F.lit(rule).alias("rule"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"))


def _told(rules: list[tuple[Column, Column]]) -> Column:
    """The errors whose conditions hold; those of a missing value are null and do not."""
    return F.array_compact(F.array(*(F.when(broken, error) for broken, error in rules)))


#: What the JSON text of a value of each type begins with or is; a number without a fraction is an integer.
_TYPES = {"string": r"\"", "object": r"\{", "array": r"\[", "null": "null$", "boolean": "(?:true|false)$", "integer": r"-?[0-9]+(?:\.0+)?$", "number": "-?[0-9]"}


def _errors(value: Column, schema: dict, path: list, defs: dict) -> Column:
    """The errors of a value; an empty array for one that is missing."""
    if "$ref" in schema:
        return _errors(value, defs[schema["$ref"].rpartition("/")[2]], path, defs)
    if "anyOf" in schema:
        return _let(value, lambda v: _told([(reduce(and_, (F.size(_errors(v, s, path, defs)) > 0 for s in schema["anyOf"])), _error(path, "anyOf"))]))
    if "properties" in schema or "items" in schema:
        told = schema | ({"type": []} if _by_members(schema) else {})
        return _let(value, lambda v: F.concat(*_scalar(v, told, path), *_inner(v, schema, path, defs)))
    return _scalar(value, schema, path)[0] if len(schema) else F.array().cast(_ERRORS)


def _by_members(schema: dict) -> bool:
    """Whether a value's type is told by its members or items being there, so that it needn't be written as text."""
    return schema.get("type") == ("object" if "properties" in schema else "array") and not ("properties" in schema and "items" in schema)


def _scalar(value: Column, schema: dict, path: list) -> list[Column]:
    """Errors of a value's type, text and length."""
    kinds = schema.get("type", [])
    kinds, length = [kinds] if isinstance(kinds, str) else kinds, schema.get("minLength", 0)

    def rules(text: Column) -> Column:
        is_a = text.startswith('"') if kinds == ["string"] else text.rlike(f"^(?:{'|'.join(_TYPES[k] for k in kinds)})")
        out = [(~is_a, _error(path, "type"))] if kinds else []
        if "enum" in schema:
            out.append((~text.isin(*(json.dumps(x, ensure_ascii=False) for x in schema["enum"])), _error(path, "enum")))
        if length == 1:
            out.append((text == '""', _error(path, "minLength")))
        elif length:
            out.append((text.startswith('"') & (F.length(F.try_variant_get(value, "$", "string")) < length), _error(path, "minLength")))
        return F.when(reduce(or_, (broken for broken, _ in out)), _told(out)).otherwise(F.array().cast(_ERRORS))

    n = bool(kinds) + ("enum" in schema) + bool(length)
    text = F.to_json(value)
    return [] if not n else [rules(text) if n == 1 else _let(text, rules)]


def _inner(value: Column, schema: dict, path: list, defs: dict) -> list[Column]:
    """Errors of an object's members and of an array's items."""
    none, out = F.array().cast(_ERRORS), []
    other = F.when(value.isNotNull(), F.array(_error(path, "type")).cast(_ERRORS)).otherwise(none) if _by_members(schema) else none
    if known := schema.get("properties"):

        def members(m: Column) -> Column:
            names, keys = (F.split(F.lit(" ".join(x)), " ") for x in (schema.get("required", ()), known)), F.map_keys(m)
            required, all_names = names
            parts = [F.transform(F.array_except(required, keys), lambda n: _error(path, "required", n))] if schema.get("required") else []
            if schema.get("additionalProperties") is False:
                extra = F.array_join(F.array_sort(F.array_except(keys, all_names)), " ")
                parts.append(_told([(F.size(F.array_except(keys, all_names)) > 0, _error(path, "additionalProperties", extra))]))
            parts += [_errors(F.try_element_at(m, F.lit(name)), own, [*path, name], defs) for name, own in known.items() if own]
            return F.when(m.isNotNull(), F.concat(*parts)).otherwise(other)

        out.append(_let(F.try_variant_get(value, "$", "map<string,variant>"), members))
    if "items" in schema:

        def items(a: Column) -> Column:
            parts = [F.flatten(F.transform(a, lambda x, i: _errors(x, schema["items"], [*path, i.cast("string")], defs)))]
            sizes = [(F.size(a) < schema["minItems"], _error(path, "minItems"))] if "minItems" in schema else []
            sizes += [(F.size(a) > schema["maxItems"], _error(path, "maxItems"))] if "maxItems" in schema else []
            return F.when(a.isNotNull(), F.concat(*parts, *([_told(sizes)] if sizes else []))).otherwise(other)

        out.append(_let(F.try_variant_get(value, "$", "array<variant>"), items))
    return out


def _text(least: int = 0) -> dict:
    return {"type": "string"} | ({"minLength": least} if least else {})


def _one_of(*values: str) -> dict:
    return {"type": "string", "enum": [*values]}


def _list(items: dict, **more) -> dict:
    return {"type": "array", "items": items, **more}


def _closed(**properties: dict) -> dict:
    """An object with all of these properties and no other."""
    return {"type": "object", "properties": properties, "required": [*properties], "additionalProperties": False}


def review_schema() -> dict:
    """The schema of a rater's review: findings with places, sources, links and a typed numeric check, coverage, completion.
    Names, values and limits are fixed."""
    some, maybe, whole = _text(1), {"type": ["string", "null"]}, {"type": ["integer", "null"]}
    quantity = _closed(**dict.fromkeys(("value", "source_id", "unit", "sample", "denominator", "context", "rounding_half_width"), some), scale=_one_of("number", "proportion", "percent"))
    quantities = lambda least: _list({"$ref": "#/$defs/quantity"}, maxItems=100, **({"minItems": least} if least else {}))
    told = dict.fromkeys(("observed_discrepancy", "possible_explanation", "suggested_correction"), some)
    checks = [
        _closed(kind=_one_of("arithmetic"), operation=_text(), quantities=quantities(1), reported={"$ref": "#/$defs/quantity"}, computed_value=some, tolerance=some, **told),
        _closed(kind=_one_of("cross_source"), quantities=quantities(2), comparability=some, **told),
        _closed(kind=_one_of("underdetermined"), question=some, quantities=quantities(0), missing_information=_list(some, minItems=1), status=_one_of("unresolved")),
    ]
    correspondence = {"type": ["string", "null"], "enum": ["text", "visual", "unresolved", "retrieved_external", "url_only", None]}
    source = _closed(
        id=some, type=_one_of("text", "table", "figure", "equation", "section", "reference", "external", "parsed_artifact"), label=maybe, path=maybe, page=whole,
        page_label=maybe, section=maybe, text_quote=maybe, url=maybe, object_id=maybe, correspondence=correspondence, verification_note=maybe,
    )
    link = _closed(claim_text=_text(), source_object_ids=_list(_text()), relation=_one_of("supports", "contradicts", "partial", "cannot_verify"), note=maybe)
    level = _one_of("high", "medium", "low")
    finding = _closed(
        id=_text(), category=_text(), finding_summary=some,
        issue_type=_one_of("manuscript_issue", "parser_artifact", "reference_integrity", "bibliography_maintenance", "copyedit_issue", "cannot_verify"),
        severity=level, confidence=level, location=_closed(page=whole, page_label=maybe, section=maybe, text_quote=maybe, precision=_one_of("exact", "partial", "missing")),
        claim_text=_text(), assessment=_one_of("yes", "no", "partially", "cannot_verify"), cannot_verify_reason=maybe, evidence_summary=_text(),
        source_objects=_list({"$ref": "#/$defs/source"}), claim_evidence_links=_list({"$ref": "#/$defs/link"}),
        numeric_check={"anyOf": [*checks, {"type": "null"}]}, suggested_fix=_text(),
    )
    done = _closed(
        version={"type": "integer", "enum": [1]}, state=_one_of("complete", "not_applicable", "partial", "failed"), scope_description=some,
        checks_completed=_list(some), missing_checks=_list(some), evidence_limitations=_list(some),
    )
    covered = _closed(
        item_id=_text(), source_object_ids=_list(_text()), claim=maybe, check_performed=_text(),
        status=_one_of("checked_no_issue", "linked_finding", "cannot_verify", "not_applicable", "not_checked"), reason=maybe, finding_ids=_list(_text()),
        attempted={"type": "boolean"}, importance=_one_of("central", "peripheral"), scope=_one_of("exhaustive", "sampled"),
    )
    whole_review = _closed(
        reviewer=some, paper_id=some, run_status=_one_of("ok", "partial", "cannot_verify", "failed"), summary=_text(), findings=_list(finding), notes=_list(_text()),
        completion={"anyOf": [done, {"type": "null"}]}, coverage=_list(covered),
    )
    return whole_review | {"$defs": {"quantity": quantity, "source": source, "link": link}}


def roster_schema() -> dict:
    """The schema of a roster of raters: names, values and defaults are fixed; members that are not named here may stand."""
    some, flag = _text(1), {"type": "boolean"}
    rater = {
        "type": "object", "required": ["name", "prompt", "output", "id_prefix", "normalization_role"],
        "properties": dict.fromkeys(("name", "prompt", "output", "id_prefix"), some) | {
            "normalization_role": _one_of("manuscript", "crossref", "reference", "copyedit"), "stage": _one_of("preflight", "review"),
            "selection_policy": _one_of("mandatory", "optional"), "search": flag, "enabled": flag,
        },
    }
    return {"type": "object", "required": ["reviewers"], "properties": {"reviewers": _list(rater, minItems=1)}}


def roster_errors(rosters: DataFrame) -> DataFrame:
    """(roster, place, error) of rosters (roster, document as JSON text): what breaks the schema; else names, prompts, outputs and
    prefixes that are blank or, ends trimmed, stand twice, at each place but the first, and a roster without an enabled rater.
    All of it is told in the document's row."""
    c, told = F.col, lambda place, error: F.struct(place.alias("place"), error.alias("error"))
    parts = ("name", "prompt", "output", "id_prefix")
    shape = "reviewers array<struct<name:string,prompt:string,output:string,id_prefix:string,enabled:boolean>>"

    def unsound(r: Column, part: str) -> Column:
        """Values sorted with their places, so that a value stands after its first."""
        rows = F.array_sort(F.transform(r, lambda x, i: F.struct(F.trim(x[part]).alias("value"), i.alias("i"))))
        error = lambda a, x, k: F.when(x["value"] == "", "blank").when((k > 0) & (x["value"] == F.get(a, k - 1)["value"]), "duplicate")
        place = lambda x: F.concat_ws(".", F.lit("reviewers"), x["i"].cast("string"), F.lit(part))
        return F.filter(_let(rows, lambda a: F.transform(a, lambda x, k: told(place(x), error(a, x, k)))), lambda e: e["error"].isNotNull())

    rows = once(rosters.select("roster", "document"), e=schema_errors(c("document"), roster_schema()))
    rows = once(rows, r=F.when(F.size("e") == 0, F.from_json("document", shape)["reviewers"]))
    broken = F.transform("e", lambda e: told(e["path"], F.concat_ws(" ", e["rule"], e["detail"])))
    idle = F.when(~F.exists("r", lambda x: F.coalesce(x["enabled"], F.lit(True))), F.array(told(F.lit("reviewers"), F.lit("none enabled"))))
    held = F.concat(*(unsound(c("r"), p) for p in parts), F.coalesce(idle, F.array().cast("array<struct<place:string,error:string>>")))
    return once(rows, all=F.when(F.size("e") > 0, broken).otherwise(held)).select("roster", F.inline("all"))


_FINDING = (
    "id:string,category:string,finding_summary:string,issue_type:string,severity:string,confidence:string,assessment:string,cannot_verify_reason:string,"
    "location:struct<page:int,page_label:string,section:string,text_quote:string,precision:string>,numeric_check:string,"
    "source_objects:array<struct<id:string,path:string,page:int,url:string,text_quote:string,correspondence:string>>,claim_evidence_links:array<struct<source_object_ids:array<string>>>"
)
_NUMERIC = f"kind string, operation string, quantities array<{A.QUANTITY}>, reported {A.QUANTITY}, computed_value string, tolerance string, comparability string, status string, missing_information array<string>"
#: A number as it stands in a quote, with a per cent after it if there is one.
_QUOTED = r"(?<![\w.+,\-−])([-+−]?(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|\.\d+)(?:[eE][-+]?\d+)?(?!\w|[.,]\d)(?:\s*(?i:%|percent\b))?)"


def _number(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, r"(?i)\s*(?:%|percent)$", ""), ",", "")
    return F.regexp_replace(bare, "−", "-").try_cast("double")


def numeric_errors(checks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, error), each once, of typed numeric checks (keys, check as in the review's schema, unverifiable, sources): kinds
    that are none, quantities of undeclared or unresolved sources, values, signs or per cents that a source's quote does not
    hold, sums that are no discrepancy, and what an open or a cross-source check must tell."""
    c = F.col
    every = F.filter(F.concat(F.coalesce("check.quantities", F.array().cast(f"array<{A.QUANTITY}>")), F.array("check.reported")), lambda q: q.isNotNull())
    rows = checks.withColumn("_q", every).withColumn("_check", F.struct(*(f"check.{x}" for x in ("kind", "operation", "quantities", "reported", "computed_value", "tolerance"))).cast(A.CHECK))
    typed, kind = c("check.kind").isin("arithmetic", "cross_source", "underdetermined"), c("check.kind")
    rows = rows.withColumn("_verdict", F.when(kind == "arithmetic", A.verdicts(c("_check"))["status"]))
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    whole = {
        "untyped": ~F.coalesce(typed, F.lit(False)),
        "underdetermined": (kind == "underdetermined") & (~c("unverifiable") | ~c("check.status").eqNullSafe(F.lit("unresolved")) | (F.coalesce(F.size("check.missing_information"), F.lit(0)) <= 0)),
        "no discrepancy": (kind == "arithmetic") & ~c("unverifiable") & (c("_verdict") != "arithmetic_discrepancy"),
        "cross source": (kind == "cross_source") & ((F.size("_q") < 2) | blank(c("check.comparability"))),
    }
    told = lambda df, rules: df.select(*keys, F.explode(F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]))).alias("error"))
    each = rows.where(typed).select(*keys, kind.alias("kind"), "unverifiable", "sources", F.explode("_q").alias("q"))
    each = each.withColumn("s", F.get(F.filter("sources", lambda s: s["id"] == c("q.source_id")), F.lit(0)))
    compared = c("kind").isin("arithmetic", "cross_source") & c("s").isNotNull()
    quoted = compared & (c("s.correspondence") == "text")
    quote = F.coalesce("s.text_quote", F.lit(""))
    polar = (c("kind") == "cross_source") & c("q.value").isin("+", "-", "−")
    alone = F.regexp(quote, F.concat(F.lit(r"(?<![\w.+,\-−])\Q"), "q.value", F.lit(r"\E(?![\w.+,%\-−])")))
    found = F.filter(F.regexp_extract_all(quote, F.lit(_QUOTED), 1), lambda x: _number(x) == _number(c("q.value")))
    each = each.withColumn("_found", found)
    value = quoted & ~polar
    single = {
        "undeclared source": c("s").isNull(),
        "unresolved source": compared & ~c("unverifiable") & F.coalesce(c("s.correspondence").isin("unresolved", "url_only"), F.lit(True)),
        "sign not in quote": quoted & polar & ~alone,
        "not a number": value & _number(c("q.value")).isNull(),
        "not in quote": value & _number(c("q.value")).isNotNull() & (F.size("_found") == 0),
        "percent scale": value & (F.size("_found") > 0) & F.forall("_found", lambda x: x.rlike("(?i)(?:%|percent)$")) & (c("q.scale") != "percent"),
    }
    return told(rows, whole).unionByName(told(each, single)).distinct()


def review_errors(reviews: DataFrame, roster: DataFrame, pages: DataFrame) -> DataFrame:
    """(paper_id, rater, stage, place, error) of reviews (paper_id, rater, document as JSON text).

    A document that breaks the schema is told of that alone; one that keeps it is held against its identity and the contract
    of findings (roster (rater, id_prefix), pages (paper_id, page_count)), and one that keeps that against its numbers."""
    c, key = F.col, ["paper_id", "rater"]
    reviews = spread(reviews, *key)
    broken = cut(once(reviews, e=schema_errors(c("document"), review_schema())).select(*key, F.explode("e").alias("e")))
    rule = F.concat_ws(" ", "e.rule", "e.detail")
    out = broken.select(*key, F.lit("schema").alias("stage"), c("e.path").alias("place"), rule.alias("error"))
    shape = f"reviewer string, paper_id string, findings array<struct<{_FINDING}>>"
    sound = reviews.join(broken.select(*key).distinct(), key, "left_anti").select(*key, F.from_json("document", shape).alias("d"))
    others = {"reviewer": c("d.reviewer") != c("rater"), "paper": c("d.paper_id") != c("paper_id")}
    identity = sound.select(*key, F.explode(F.array_compact(F.array(*[F.when(r, F.lit(n)) for n, r in others.items()]))).alias("error"))
    rows = sound.select(*key, F.explode("d.findings").alias("f")).join(pages.select("paper_id", "page_count"), "paper_id", "left")
    flat = rows.select(*key, "f.*", "f.location.*", "page_count").drop("location")
    sources = rows.select(*key, "f.id", F.explode("f.source_objects").alias("s")).select(*key, "id", c("s.id").alias("source_id"), "s.url", "s.path", "s.page")
    links = rows.select(*key, "f.id", F.posexplode("f.claim_evidence_links").alias("link", "l")).select(*key, "id", "link", F.explode_outer("l.source_object_ids").alias("source_id"))
    contract = C.finding_errors(flat, roster, sources, links)
    stage = lambda df, name, place: df.select(*key, F.lit(name).alias("stage"), place.alias("place"), "error")
    held = cut(stage(identity, "contract", F.lit("")).unionByName(stage(contract, "contract", c("id"))))
    counted = rows.join(held.select(*key).distinct(), key, "left_anti").where("f.numeric_check IS NOT NULL")
    checks = counted.select(
        *key, "f.id", F.from_json("f.numeric_check", _NUMERIC).alias("check"), c("f.source_objects").alias("sources"),
        N.unverifiable_in_contract(c("f.assessment"), c("f.issue_type"), c("f.category")).alias("unverifiable"),
    )
    return out.unionByName(held).unionByName(stage(numeric_errors(checks, [*key, "id"]), "numeric", c("id")))
