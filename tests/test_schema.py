"""The schema compiler against a plain validator on perturbed reviews; whole reviews and their numbers on literals."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from inkstone.operators import schema as S


def plain(value, schema, defs, path=()):
    """Broken rules of a value, as (path, rule, detail), by recursion."""
    if "$ref" in schema:
        schema = defs[schema["$ref"].split("/")[-1]]
    at = ".".join(map(str, path))
    if "anyOf" in schema:
        return set() if any(not plain(value, s, defs, path) for s in schema["anyOf"]) else {(at, "anyOf", None)}
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    is_a = {
        "string": isinstance(value, str), "object": isinstance(value, dict), "array": isinstance(value, list), "null": value is None,
        "boolean": isinstance(value, bool), "number": number, "integer": number and float(value).is_integer(),
    }
    out, kinds = set(), schema.get("type", [])
    if kinds and not any(is_a[k] for k in ([kinds] if isinstance(kinds, str) else kinds)):
        out.add((at, "type", None))
    if "enum" in schema and not any(isinstance(x, bool) == isinstance(value, bool) and x == value for x in schema["enum"]):
        out.add((at, "enum", None))
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.add((at, "minLength", None))
    if isinstance(value, dict) and "properties" in schema:
        out |= {(at, "required", k) for k in schema.get("required", []) if k not in value}
        extra = sorted(set(value) - set(schema["properties"]))
        if extra and schema.get("additionalProperties") is False:
            out.add((at, "additionalProperties", " ".join(extra)))
        for k, v in value.items():
            if k in schema["properties"]:
                out |= plain(v, schema["properties"][k], defs, (*path, k))
    if isinstance(value, list):
        for i, v in enumerate(value):
            out |= plain(v, schema.get("items", {}), defs, (*path, i))
        if len(value) < schema.get("minItems", 0):
            out.add((at, "minItems", None))
        if len(value) > schema.get("maxItems", 1 << 30):
            out.add((at, "maxItems", None))
    return out


def quantity(value, source="s1", **more):
    return {"value": value, "source_id": source, "unit": "usd", "sample": "all", "denominator": "n", "context": "c", "rounding_half_width": "0", "scale": "number"} | more


TOLD = {"observed_discrepancy": "o", "possible_explanation": "p", "suggested_correction": "s"}


def arithmetic(*values, reported="9", computed="5"):
    return {"kind": "arithmetic", "operation": "sum", "quantities": [quantity(v) for v in values], "reported": quantity(reported), "computed_value": computed, "tolerance": "0", **TOLD}


def finding(n=1, **more):
    source = {"id": "s1", "type": "text", "label": None, "path": "pages/p1.txt", "page": 2, "page_label": None, "section": None, "text_quote": "we use 2, 3 and 9 or 15%; + and -4", "url": None, "object_id": "O", "correspondence": "text", "verification_note": None}
    link = {"claim_text": "c", "source_object_ids": ["s1"], "relation": "supports", "note": None}
    return {
        "id": f"N-{n:03d}", "category": "c", "finding_summary": "sum is off", "issue_type": "manuscript_issue", "severity": "high", "confidence": "low",
        "location": {"page": 2, "page_label": None, "section": None, "text_quote": None, "precision": "exact"}, "claim_text": "c", "assessment": "no", "cannot_verify_reason": None,
        "evidence_summary": "e", "source_objects": [source], "claim_evidence_links": [link], "numeric_check": arithmetic("2", "3"), "suggested_fix": "f",
    } | more


def review(*findings, **more):
    return {"reviewer": "numerical_auditor", "paper_id": "p", "run_status": "ok", "summary": "s", "findings": [*findings], "notes": [], "completion": None, "coverage": []} | more


def perturbed(rng, value):
    """A copy with one value somewhere dropped, renamed, or replaced by one of another kind."""
    value = copy.deepcopy(value)
    at, key = value, None
    while True:
        keys = list(at) if isinstance(at, dict) else range(len(at))
        key = rng.choice(list(keys))
        if isinstance(at[key], (dict, list)) and at[key] and rng.random() < 0.8:
            at = at[key]
        else:
            break
    what = rng.randrange(4)
    if what == 0:
        del at[key]
    elif what == 1 and isinstance(at, dict):
        at["more" + str(rng.randrange(3))] = at.pop(key) if rng.random() < 0.5 else 1
    else:
        at[key] = rng.choice([None, "", "x", 7, 1.5, True, [], {}, ["a"], {"kind": "arithmetic"}, "text", "high"])
    return value


def test_compiled_schema_like_recursion(spark):
    rng, schema = random.Random(2), S.review_schema()
    completion = {"version": 1, "state": "complete", "scope_description": "all", "checks_completed": ["a"], "missing_checks": [], "evidence_limitations": []}
    covered = {"item_id": "i", "source_object_ids": [], "claim": None, "check_performed": "c", "status": "not_checked", "reason": "r", "finding_ids": [], "attempted": True, "importance": "central", "scope": "sampled"}
    cross = {"kind": "cross_source", "quantities": [quantity("2"), quantity("3")], "comparability": "same", **TOLD}
    unsure = {"kind": "underdetermined", "question": "q", "quantities": [], "missing_information": ["n"], "status": "unresolved"}
    whole = review(finding(1), finding(2, numeric_check=cross), finding(3, numeric_check=unsure), finding(4, numeric_check=None), completion=completion, coverage=[covered], notes=["é \"quoted\""])
    documents = [whole, review(), [], 3, None, "x", review(finding(1, numeric_check=arithmetic(*["1"] * 101))), review(completion=completion | {"version": 1.0})]
    while len(documents) < 400:
        document = whole
        for _ in range(rng.choice([1, 1, 2, 4])):
            document = perturbed(rng, document)
        documents.append(document)
    frame = spark.createDataFrame([(i, json.dumps(d, ensure_ascii=rng.random() < 0.5)) for i, d in enumerate(documents)], "i int, d string")
    rows = frame.select("i", F.explode(S.schema_errors(F.col("d"), schema)).alias("e")).select("i", "e.*").collect()
    got = {}
    for r in rows:
        got.setdefault(r["i"], set()).add((r["path"], r["rule"], r["detail"]))
    want = {i: found for i, d in enumerate(documents) if (found := plain(d, schema, schema["$defs"]))}
    assert got == want and 0 not in want and len({rule for found in want.values() for _, rule, _ in found}) == 6


def test_sizes_and_lengths(spark):
    schema = {"type": "object", "properties": {"a": {"type": "array", "items": {"type": ["string", "null"], "minLength": 3}, "minItems": 2, "maxItems": 3}, "b": {}}}
    documents = [{"a": ["abc", None]}, {"a": ["éé"]}, {"a": ["abc"] * 4}, {"a": 3, "b": 1, "c": 2}, {}]
    frame = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "i int, d string")
    rows = frame.select("i", F.explode(S.schema_errors(F.col("d"), schema)).alias("e")).select("i", "e.path", "e.rule").collect()
    assert {tuple(r) for r in rows} == {(1, "a", "minItems"), (1, "a.0", "minLength"), (2, "a", "maxItems"), (3, "a", "type")}


@pytest.mark.parametrize("text", ['{"a": 1, "a": 2}', "{", "", None])
def test_no_json(spark, text):
    frame = spark.createDataFrame([(text,)], "d string")
    assert [tuple(e) for e in frame.select(S.schema_errors(F.col("d"), {"type": "object"}).alias("e")).first()["e"]] == [("", "json", None)]


def test_whole_reviews(spark):
    source = finding()["source_objects"][0]
    cross = lambda *values, **more: {"kind": "cross_source", "quantities": [quantity(v) for v in values], "comparability": "same", **TOLD} | more
    unsure = {"kind": "underdetermined", "question": "q", "quantities": [], "missing_information": ["n"], "status": "unresolved"}
    open_ = {"assessment": "cannot_verify", "cannot_verify_reason": "no data"}
    cases = {
        "sound": (review(finding()), set()),
        "schema": (review(finding(severity="dire", id=3)), {("schema", "findings.0.severity", "enum"), ("schema", "findings.0.id", "type")}),
        "contract": (review(finding(id="X-1")), {("contract", "X-1", "id")}),
        "identity": (review(finding(), reviewer="other"), {("contract", "", "reviewer")}),
        "compatible": (review(finding(numeric_check=arithmetic("2", "3", reported="9", computed="5") | {"tolerance": "4"})), {("numeric", "N-001", "no discrepancy")}),
        "not in quote": (review(finding(numeric_check=arithmetic("2", "7", computed="9"))), {("numeric", "N-001", "no discrepancy"), ("numeric", "N-001", "not in quote")}),
        "undeclared": (review(finding(numeric_check=cross("2", "3") | {"quantities": [quantity("2"), quantity("3", "s9")]})), {("numeric", "N-001", "undeclared source")}),
        "percent": (review(finding(numeric_check=cross("2", "15"))), {("numeric", "N-001", "percent scale")}),
        "percent kept": (review(finding(numeric_check=cross("2", "3") | {"quantities": [quantity("2"), quantity("15", scale="percent")]})), set()),
        "signs": (review(finding(numeric_check=cross("+", "-"))), {("numeric", "N-001", "sign not in quote")}),
        "no number": (review(finding(numeric_check=cross("2", "many"))), {("numeric", "N-001", "not a number")}),
        "unresolved": (review(finding(numeric_check=cross("2", "3"), source_objects=[source | {"correspondence": "unresolved"}])), {("numeric", "N-001", "unresolved source")}),
        "open": (review(finding(numeric_check=unsure, **open_)), set()),
        "open told as closed": (review(finding(numeric_check=unsure)), {("numeric", "N-001", "underdetermined")}),
        "blank reason": (review(finding(numeric_check=cross("2", "3") | {"comparability": " "})), {("numeric", "N-001", "cross source")}),
    }
    rows = [(k, "numerical_auditor", json.dumps(d | {"paper_id": k})) for k, (d, _) in cases.items()]
    reviews = spark.createDataFrame(rows, "paper_id string, rater string, document string")
    pages = spark.createDataFrame([(k, 5) for k in cases], "paper_id string, page_count int")
    found = S.review_errors(reviews, spark.createDataFrame([("numerical_auditor", "N")], "rater string, id_prefix string"), pages).collect()
    assert {k: {(r["stage"], r["place"], r["error"]) for r in found if r["paper_id"] == k} for k in cases} == {k: want for k, (_, want) in cases.items()}


def test_rosters(spark):
    rater = lambda n, **more: {"name": f"r{n}", "prompt": f"p{n}", "output": f"o{n}", "id_prefix": f"X{n}", "normalization_role": "manuscript"} | more
    cases = {
        "sound": ({"reviewers": [rater(1, stage="preflight", search=True, note=3), rater(2, enabled=False)]}, set()),
        "empty": ({"reviewers": []}, {("reviewers", "minItems")}),
        "none": ({}, {("", "required reviewers")}),
        "values": ({"reviewers": [rater(1, normalization_role="x", selection_policy="some", search=1, output="")]}, {(f"reviewers.0.{k}", e) for k, e in (("normalization_role", "enum"), ("selection_policy", "enum"), ("search", "type"), ("output", "minLength"))}),
        "twice": ({"reviewers": [rater(1), rater(2, name=" r1", id_prefix="X1"), rater(3, prompt="  ")]}, {("reviewers.1.name", "duplicate"), ("reviewers.1.id_prefix", "duplicate"), ("reviewers.2.prompt", "blank")}),
        "idle": ({"reviewers": [rater(1, enabled=False)]}, {("reviewers", "none enabled")}),
    }
    frame = spark.createDataFrame([(k, json.dumps(d)) for k, (d, _) in cases.items()], "roster string, document string")
    found = S.roster_errors(frame).collect()
    assert {k: {(r["place"], r["error"]) for r in found if r["roster"] == k} for k in cases} == {k: want for k, (_, want) in cases.items()}
