"""Declared schemas for documents whose producers can't be trusted: defaults filled in, misfits put aside with the reasons."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a value's own type may be for each declared kind, as ``schema_of_variant`` names it.
_TYPES = {"string": "^STRING$", "int": r"^(BIGINT|DECIMAL\(.*|DOUBLE|FLOAT)$", "number": r"^(BIGINT|DECIMAL\(.*|DOUBLE|FLOAT)$", "boolean": "^BOOLEAN$", "list": "^ARRAY<", "map": "^OBJECT<", "object": "^OBJECT<"}
_SPARK = {"string": "string", "int": "bigint", "number": "double", "boolean": "boolean"}


@dataclass(frozen=True)
class Field:
    """One field of a document. An absent one takes its ``default`` and must have one; JSON null is a value, of ``nullable`` fields only.

    kind: string, int, number, boolean, any (kept as it is), list (of ``items``), map (from strings to ``items``, a string or
    number kind) or object (of ``fields``). ``pattern``, ``least``, ``most`` and ``choices`` bound a value; a list's own
    ``least`` and ``most`` bound its length.
    """

    name: str
    kind: str
    default: Any = None
    nullable: bool = False
    items: Field | None = None
    fields: tuple[Field, ...] = ()
    pattern: str | None = None
    least: float | None = None
    most: float | None = None
    choices: tuple[str, ...] = ()

    @property
    def type(self) -> str:
        if self.kind == "any":
            return "variant"
        if self.kind == "list":
            return f"array<{self.items.type}>"
        if self.kind == "map":
            return f"map<string,{self.items.type}>"
        if self.kind == "object":
            return f"struct<{','.join(f'`{f.name}`:{f.type}' for f in self.fields)}>"
        return _SPARK[self.kind]


def _member(doc: Column, name: str) -> Column:
    """A member of an object; null if it is absent, a variant null if it is JSON null."""
    return F.try_variant_get(doc, f"$['{name}']", "variant")


def _element(value: Column) -> Column:
    """An element of a list or map, which is never absent."""
    return F.coalesce(value, F.parse_json(F.lit("null")))


def _has_kind(value: Column, kind: str) -> Column:
    if kind == "any":
        return F.lit(True)
    found = F.schema_of_variant(value).rlike(_TYPES[kind])
    return found & (F.try_variant_get(value, "$", "double") % 1 == 0) if kind == "int" else found


def _parts(value: Column, field: Field) -> Column:
    """A list's or map's elements as variants."""
    return F.try_variant_get(value, "$", "array<variant>" if field.kind == "list" else "map<string,variant>")


def _typed(value: Column, field: Field) -> Column:
    """``value``, a variant of the right kind, as the declared type."""
    if field.kind == "any":
        return value
    if field.kind == "list":
        return F.transform(_parts(value, field), lambda x: _filled(_element(x), field.items))
    if field.kind == "map":
        return F.transform_values(_parts(value, field), lambda _, x: _filled(_element(x), field.items))
    if field.kind == "object":
        return F.struct(*(_filled(_member(value, f.name), f).alias(f.name) for f in field.fields))
    return F.try_variant_get(value, "$", _SPARK[field.kind])


def _default(field: Field) -> Column:
    if field.default is None:
        return F.lit(None).cast(field.type)
    if field.kind in ("list", "map", "object", "any"):
        import json

        return F.parse_json(F.lit(json.dumps(field.default))) if field.kind == "any" else F.from_json(F.lit(json.dumps(field.default)), field.type)
    return F.lit(field.default).cast(field.type)


def _filled(value: Column, field: Field) -> Column:
    if field.kind == "any":
        return F.coalesce(value, _default(field))
    return F.when(value.isNull(), _default(field)).when(~F.is_variant_null(value), _typed(value, field))


def _faults(value: Column, field: Field, path: Column) -> Column:
    """What is wrong with a value, each as ``path: fault``; a nested one has the path of its place."""
    says = lambda what: F.concat(path, F.lit(f": {what}"))
    none = F.array().cast("array<string>")
    if field.kind == "any":
        return none
    missing = none if field.default is not None else F.array(says("missing"))
    no_value = none if field.nullable else F.array(says(f"not a {field.kind}"))
    own = []  # (condition, fault) on a value of the right kind
    if field.kind in _SPARK:
        x = F.try_variant_get(value, "$", _SPARK[field.kind])
        if field.least is not None:
            own.append((x < field.least, f"below {field.least:g}"))
        if field.most is not None:
            own.append((x > field.most, f"above {field.most:g}"))
        if field.pattern is not None:
            own.append((~x.rlike(field.pattern), "malformed"))
        if field.choices:
            own.append((~x.isin(*field.choices), "not one of " + " ".join(field.choices)))
    elif field.kind == "list":
        size = F.size(_parts(value, field))
        if field.least is not None:
            own.append((size < field.least, f"fewer than {field.least:g}"))
        if field.most is not None:
            own.append((size > field.most, f"more than {field.most:g}"))
    told = F.array_compact(F.array(*(F.when(cond, says(what)) for cond, what in own))) if own else none
    if field.kind == "list" and field.items.kind != "any":
        told = F.concat(told, F.flatten(F.transform(_parts(value, field), lambda x, i: _faults(_element(x), field.items, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
    elif field.kind == "map":
        each = F.map_entries(_parts(value, field))
        told = F.concat(told, F.flatten(F.transform(each, lambda e: _faults(_element(e.value), field.items, F.concat(path, F.lit("."), e.key)))))
    elif field.kind == "object":
        told = F.concat(told, *(_faults(_member(value, f.name), f, F.concat(path, F.lit(f".{f.name}"))) for f in field.fields))
    return F.when(value.isNull(), missing).when(F.is_variant_null(value), no_value).when(~_has_kind(value, field.kind), F.array(says(f"not a {field.kind}"))).otherwise(told)


def conform(df: DataFrame, fields: tuple[Field, ...], column: str = "document") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of ``df``, whose ``column`` holds JSON documents as text.

    valid: the other columns and one for each field, absent ones at their default. rejected: all columns of ``df`` and
    ``reasons``, one per fault, with its path. A text that isn't JSON, or is null, is rejected whole; members that no
    field names are dropped. A value of another type is a fault, never converted; a whole number is an int however it is written. A column that
    is called like a field is left out of valid.
    """
    parsed = df.withColumn("_doc", F.try_parse_json(column))
    whole = F.coalesce(F.schema_of_variant("_doc").rlike("^OBJECT<|^OBJECT$"), F.lit(False))
    faults = F.concat(*(_faults(_member(F.col("_doc"), f.name), f, F.lit(f.name)) for f in fields))
    judged = parsed.withColumn("reasons", F.when(~whole, F.array(F.lit("document: not a JSON object"))).otherwise(faults))
    others = [c for c in df.columns if c != column and c not in {f.name for f in fields}]
    valid = judged.where(F.size("reasons") == 0).select(*others, *(_filled(_member(F.col("_doc"), f.name), f).alias(f.name) for f in fields))
    return valid, judged.where(F.size("reasons") > 0).select(*df.columns, "reasons")


_TEXT = Field("", "string")
#: The fields of a page's signals, their kinds and defaults.
PAGE_SIGNALS = (
    Field("url", "string", pattern=r"^[A-Za-z][A-Za-z0-9+.-]*://[^/\s]+"), Field("status", "int"), Field("ms", "number"), Field("bytes", "number"),
    Field("title", "string", ""), Field("description", "string", ""), Field("h1", "list", [], items=_TEXT),
    Field("headings", "list", [], items=Field("", "object", fields=(Field("level", "int"), Field("text", "string")))),
    Field("words", "int", 0), Field("lang", "string", ""), Field("canonical", "string", ""), Field("metaRobots", "string", ""), Field("xRobotsTag", "string", ""),
    Field("jsonLdTypes", "list", [], items=_TEXT), Field("jsonLd", "list", [], items=Field("", "any", nullable=True)), Field("jsonLdErrors", "int", 0),
    Field("openGraph", "map", {}, items=_TEXT), Field("images", "int", 0), Field("imagesWithAlt", "int", 0), Field("scripts", "int", 0), Field("appShell", "boolean", False),
    Field("questionHeadings", "int", 0), Field("hasDate", "boolean", False), Field("hasAuthor", "boolean", False), Field("socialLinks", "list", [], items=_TEXT),
    Field("internalLinks", "list", [], items=_TEXT), Field("excerpt", "string", ""), Field("structureRead", "boolean", False), Field("lead", "string", ""),
    Field("passages", "list", [], items=_TEXT), Field("lists", "int", 0), Field("tables", "int", 0), Field("nosnippetBlocks", "int", 0),
)
#: A proposed set of sub-queries: their kinds, how long they are and how many.
FANOUT_KINDS = ("equivalent", "follow_up", "generalization", "specification", "canonicalization", "entailment", "comparison")
FANOUT_PLAN = (
    Field("queries", "list", least=1, most=12, items=Field("", "object", fields=(
        Field("type", "string", choices=FANOUT_KINDS), Field("query", "string", pattern=r"(?s)^.{3,240}$"), Field("covers", "string", ""),
    ))),
)
