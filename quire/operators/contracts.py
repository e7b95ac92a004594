"""Contracts of JSON records as rules: what is missing, or of another kind than it must be."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """The value at `path` must be of a kind. absent: the code for one that isn't there ('' allows that, and null too unless
    `null_too`)."""

    path: str
    kind: str
    code: str
    absent: str = ""
    severity: str = "error"
    null_too: bool = False


class Items(NamedTuple):
    """The first `most` items of the list at `path` must be objects, and their fields of a kind: (field, kind, code, null too)."""

    path: str
    most: int
    code: str
    fields: tuple[tuple[str, str, str, bool], ...] = ()


#: Codes, paths and bounds (fixed values).
CONTENT = (
    "CONTENT_NOT_OBJECT",
    (
        Rule("$.sections", "array", "CONTENT_SECTIONS_NOT_LIST", "CONTENT_SECTIONS_MISSING", null_too=True), Rule("$.references", "array", "CONTENT_REFERENCES_NOT_LIST", null_too=True),
        Rule("$._meta", "object", "CONTENT_META_NOT_OBJECT", severity="warning"), Rule("$.title_info", "object", "CONTENT_TITLE_INFO_NOT_OBJECT", severity="warning"),
    ),
    ("$.sections", "CONTENT_SECTIONS_EMPTY"),
    (Items("$.sections", 50, "CONTENT_SECTION_NOT_OBJECT", (("paragraphs", "array", "CONTENT_SECTION_PARAGRAPHS_NOT_LIST", True), ("images", "array", "CONTENT_SECTION_IMAGES_NOT_LIST", True))),),
)
FORMAT = (
    "FORMAT_NOT_OBJECT",
    (
        *(Rule(f"$.{key}", "array", f"FORMAT_{key.upper()}_NOT_LIST", f"FORMAT_{key.upper()}_MISSING", null_too=True) for key in ("sections", "paragraphs", "tables")),
        Rule("$._meta", "object", "FORMAT_META_NOT_OBJECT", severity="warning"),
    ),
    ("$.sections", "FORMAT_SECTIONS_EMPTY"),
    (Items("$.sections", 20, "FORMAT_SECTION_NOT_OBJECT"), Items("$.paragraphs", 50, "FORMAT_PARAGRAPH_NOT_OBJECT", (("runs", "array", "FORMAT_PARAGRAPH_RUNS_NOT_LIST", False),))),
)
REPORT_STATUS = {"failed": "未通过", "passed_with_warnings": "通过但有警告", "passed": "通过"}


def kind(value: Column) -> Column:
    """object, array, string, boolean, integer, number or null of a variant; null where there is none."""
    name = F.schema_of_variant(value)
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "BIGINT", "integer")
        .when(name == "VOID", "null").when(name.isNotNull(), "number")
    )


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _issue(code, path, severity="error") -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(code).alias("code"), lit(path).alias("path"), lit(severity).alias("severity"))


def _broken(value: Column, rule: Rule) -> Column:
    k = kind(value)
    wrong = k.isNotNull() & (k != rule.kind) & ((k != "null") | F.lit(rule.null_too))
    out = F.when(wrong, _issue(rule.code, rule.path, rule.severity))
    return out.when(k.isNull(), _issue(rule.absent, rule.path)) if rule.absent else out


def _rows(df: DataFrame, keys: list[str], json: str, of_object, not_object: str) -> DataFrame:
    """keys, code, path and severity of each issue; what isn't JSON, or isn't an object, has that issue alone."""
    v = F.col("__v")
    t = df.select(*keys, F.try_parse_json(json).alias("__v"))
    issues = F.when(F.coalesce(kind(v) == "object", F.lit(False)), F.array_compact(of_object(v))).otherwise(F.array(_issue(not_object, "$")))
    return t.select(*keys, F.inline(issues))


def validate(df: DataFrame, keys: list[str], json: str, contract: tuple, whole: bool = False) -> DataFrame:
    """keys, code, path and severity of each breach of a contract (CONTENT or FORMAT) by the JSON texts of a column. whole:
    all items of a list are looked at, not the contract's first ones."""
    not_object, rules, (listed, empty), lists = contract

    def of_items(group: Items):
        def of_item(x: Column, i: Column) -> Column:
            place = F.concat(F.lit(f"{group.path}["), i.cast("string"), F.lit("]"))
            fields = [F.when((kind(_at(x, f"$.{name}")) != want) & ((kind(_at(x, f"$.{name}")) != "null") | F.lit(null_too)), _issue(code, F.concat(place, F.lit(f".{name}")))) for name, want, code, null_too in group.fields]
            none = F.lit(None).cast("struct<code:string,path:string,severity:string>")
            return F.when(F.coalesce(kind(x) != "object", F.lit(True)), F.array(_issue(group.code, place))).otherwise(F.array(none, *fields))

        return of_item

    def found(v: Column) -> Column:
        out = F.array(*[_broken(_at(v, r.path), r) for r in rules], F.when(F.coalesce(F.size(F.try_variant_get(v, listed, "array<variant>")), F.lit(0)) <= 0, _issue(empty, listed)))
        for group in lists:
            items = F.coalesce(F.try_variant_get(v, group.path, "array<variant>"), F.array().cast("array<variant>"))
            items = items if whole else F.slice(items, 1, group.most)
            out = F.concat(out, F.flatten(F.transform(items, of_items(group))))
        return out

    return _rows(df, keys, json, found, not_object)


def validate_manifest(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """The same for a manifest: counts must be an object of integers from 0 on."""

    def found(v: Column) -> Column:
        counts = F.try_variant_get(v, "$.counts", "map<string,variant>")
        wrong = lambda x: F.coalesce(~kind(x["value"]).isin("integer", "boolean") | (F.try_variant_get(x["value"], "$", "bigint") < 0), F.lit(True))
        bad = F.transform(F.filter(F.map_entries(counts), wrong), lambda x: _issue("MANIFEST_COUNT_INVALID", F.concat(F.lit("$.counts."), x["key"])))
        return F.when(F.coalesce(kind(_at(v, "$.counts")) == "object", F.lit(False)), bad).otherwise(F.array(_issue("MANIFEST_COUNTS_NOT_OBJECT", "$.counts")))

    return _rows(df, keys, json, found, "MANIFEST_NOT_OBJECT")


def validate_report(df: DataFrame, keys: list[str], json: str, most: int | None = 100) -> DataFrame:
    """The same for a report: passed, status, label, counts and issues must be there and agree; issues (the first `most`, None: all) must
    have a code, a severity and a message."""

    def found(v: Column) -> Column:
        text = lambda path: F.coalesce(F.trim(F.try_variant_get(v, path, "string")), F.lit(""))
        passed, listed = F.coalesce(kind(_at(v, "$.passed")) == "boolean", F.lit(False)), F.coalesce(kind(_at(v, "$.issues")) == "array", F.lit(False))
        status, label = text("$.status"), text("$.result_label")
        items = F.coalesce(F.try_variant_get(v, "$.issues", "array<variant>"), F.array().cast("array<variant>"))
        warned = F.exists(items, lambda x: F.coalesce(F.try_variant_get(x, "$.severity", "string") == "warning", F.lit(False)))
        expected = F.when(~F.try_variant_get(v, "$.passed", "boolean"), "failed").when(warned, "passed_with_warnings").otherwise("passed")
        labels = F.create_map(*[F.lit(x) for pair in REPORT_STATUS.items() for x in pair])
        known = status.isin(*REPORT_STATUS)
        whole = F.array(
            F.when(~passed, _issue("QA_REPORT_PASSED_NOT_BOOL", "$.passed")),
            F.when(status == "", _issue("QA_REPORT_STATUS_MISSING", "$.status")).when(~known, _issue("QA_REPORT_STATUS_INVALID", "$.status")),
            F.when(label == "", _issue("QA_REPORT_RESULT_LABEL_MISSING", "$.result_label")),
            F.when(kind(_at(v, "$.result_label")).isNotNull() & (kind(_at(v, "$.result_label")) != "null") & (label == ""), _issue("QA_REPORT_RESULT_LABEL_EMPTY", "$.result_label")),
            F.when(F.coalesce(kind(_at(v, "$.counts")) != "object", F.lit(True)), _issue("QA_REPORT_COUNTS_NOT_OBJECT", "$.counts")),
            F.when(~listed, _issue("QA_REPORT_ISSUES_NOT_LIST", "$.issues")),
            F.when(listed & passed & known & (status != expected), _issue("QA_REPORT_STATUS_MISMATCH", "$.status")),
            F.when(listed & passed & (label != "") & (label != F.try_element_at(labels, expected)), _issue("QA_REPORT_RESULT_LABEL_MISMATCH", "$.result_label")),
        )

        def of_item(x: Column, i: Column) -> Column:
            place = F.concat(F.lit("$.issues["), i.cast("string"), F.lit("]"))
            fields = [F.when(F.coalesce(F.trim(F.try_variant_get(x, f"$.{f}", "string")), F.lit("")) == "", _issue(f"QA_REPORT_ISSUE_{f.upper()}_MISSING", F.concat(place, F.lit(f".{f}")))) for f in ("code", "severity", "message")]
            return F.when(F.coalesce(kind(x) != "object", F.lit(True)), F.array(_issue("QA_REPORT_ISSUE_NOT_OBJECT", place))).otherwise(F.array(*fields))

        return F.concat(whole, F.flatten(F.transform(items if most is None else F.slice(items, 1, most), of_item)))

    return _rows(df, keys, json, found, "QA_REPORT_NOT_OBJECT")


def validate_events(df: DataFrame, keys: list[str], json: str, stream: str) -> DataFrame:
    """keys and the first problem of each line of an event log (JSON) that isn't a good event of its stream; blank lines are
    none. stream: the column with the stream's name."""
    v = F.try_parse_json(json)
    need = ("timestamp", "stream", "title", "body", "tags", "source")
    t = df.where(F.trim(F.col(json)) != "").select(*keys, F.col(stream).alias("__s"), v.alias("__v"))
    v = F.col("__v")
    problem = F.when(v.isNull(), "invalid JSON").when(kind(v) != "object", "not an object")
    for key in need:
        problem = problem.when(kind(_at(v, f"$.{key}")).isNull(), f"missing {key}")
    problem = (
        problem.when(F.coalesce(F.try_variant_get(v, "$.stream", "string") != F.col("__s"), F.lit(True)), "other stream")
        .when(kind(_at(v, "$.tags")) != "array", "tags are no list")
        .when(F.try_to_timestamp(F.try_variant_get(v, "$.timestamp", "string")).isNull(), "bad timestamp")
    )
    return t.select(*keys, problem.alias("problem")).where("problem IS NOT NULL")


def new_event(stream: Column, title: Column, body: Column, tags: Column, source: Column, timestamp: Column) -> Column:
    """An event as one JSON text, null if title, body or source is blank; tags are parted by commas."""
    names = F.filter(F.transform(F.split(tags, ","), lambda x: F.trim(x)), lambda x: x != "")
    made = F.to_json(F.struct(timestamp.alias("timestamp"), stream.alias("stream"), F.trim(title).alias("title"), F.trim(body).alias("body"), names.alias("tags"), F.trim(source).alias("source")))
    return F.when((F.trim(title) != "") & (F.trim(body) != "") & (F.trim(source) != ""), made)
