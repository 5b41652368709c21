"""A projection config compiled to columns, once, before anything runs.

A config has `fields`, each with `path` (the output name) and maybe `from` (a path into the record, `path` by
default), `normalize`, `type` and `required`; `on_missing`: null, omit or error; and `include_confidence`.  Paths
are names with dots, [i] and []: `a.b`, `a[0]`, `a[]`, `a[].b`, `a[0].b`.  Unknown paths are null.  Catalyst then
reads only what the config names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldweave.functions.normalize import normalize_phone, normalize_skill

_STEP = re.compile(r"([^.\[\]]+)(\[(\d*)\])?").fullmatch


def compile_path(schema: T.StructType, path: str) -> tuple[Column, T.DataType | None]:
    """(column, its type); the type is None, and the column null, for a path that the schema doesn't have."""
    unknown = F.lit(None), None
    here: Column | None = None
    kind: T.DataType = schema
    steps = [_STEP(s) for s in path.split(".")]
    for n, step in enumerate(steps):
        if not step or not isinstance(kind, T.StructType) or step[1] not in kind.names:
            return unknown
        kind = kind[step[1]].dataType
        here = F.col(f"`{step[1]}`") if here is None else here.getField(step[1])
        if step[2] is None:
            continue
        if not isinstance(kind, T.ArrayType):
            return unknown
        if step[3]:
            here, kind = F.get(here, F.lit(int(step[3]))), kind.elementType
            continue
        return _mapped(here, kind.elementType, steps[n + 1 :]) or unknown
    return here, kind


def _mapped(array: Column, inner: T.DataType, steps: list) -> tuple[Column, T.DataType] | None:
    """Attributes of each element without nulls; below [] a path has names only."""
    names = []
    for step in steps:
        if not step or step[2] is not None or not isinstance(inner, T.StructType) or step[1] not in inner.names:
            return None
        names.append(step[1])
        inner = inner[step[1]].dataType

    def attribute(x: Column) -> Column:
        for n in names:
            x = x.getField(n)
        return x

    return F.filter(F.transform(array, attribute), lambda x: x.isNotNull()), T.ArrayType(inner)


def _normalized(c: Column, kind: T.DataType, how: str | None, country: str) -> tuple[Column, T.DataType]:
    many, text = isinstance(kind, T.ArrayType), T.StringType()
    if how == "E164":
        return normalize_phone(c.cast("string"), country), text
    if how in ("canonical", "lowercase"):
        f = normalize_skill if how == "canonical" else F.lower
        return (F.transform(c, lambda x: f(x.cast("string"))), T.ArrayType(text)) if many else (f(c.cast("string")), text)
    if how == "anonymize":
        if many:
            return F.transform(c, lambda _: F.lit("[Redacted Skill]")), T.ArrayType(text)
        if isinstance(kind, T.StringType):
            words = F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 0)
            initials = F.array_join(F.transform(words, lambda w: F.concat(F.left(w, F.lit(1)), F.lit("."))), " ")
            return F.when(c.isNotNull(), F.when(F.size(words) >= 2, initials).otherwise(F.lit("C. A."))), text
    return c, kind


def _typed(c: Column, kind: T.DataType, to: str | None) -> Column:
    many = isinstance(kind, T.ArrayType)
    if to == "string":
        if many:
            inner = kind.elementType
            first = (lambda x: x.getField(inner.names[0])) if isinstance(inner, T.StructType) else (lambda x: x)
            return F.when(c.isNotNull(), F.array_join(F.filter(F.transform(c, lambda x: first(x).cast("string")), lambda s: s != ""), ", "))
        return c.cast("string")
    if to == "string[]":
        return F.transform(c, lambda x: x.cast("string")) if many else F.when(c.isNotNull(), F.array(c.cast("string")))
    if to == "number":
        return (F.get(c, F.lit(0)) if many else c).cast("string").try_cast("double")
    if to == "number[]":
        return F.filter(F.transform(c if many else F.array(c), lambda x: x.cast("string").try_cast("double")), lambda x: x.isNotNull())
    if to == "boolean":
        one = F.get(c, F.lit(0)) if many else c
        inner = kind.elementType if many else kind
        if isinstance(inner, T.StringType):
            yes = F.lower(one).isin("true", "1", "yes", "y")
        elif isinstance(inner, T.BooleanType):
            yes = one
        elif isinstance(inner, T.NumericType):
            yes = one != 0
        else:
            yes = one.isNotNull()
        return F.when(c.isNotNull(), F.coalesce(yes, F.lit(False)))
    return c


def project(df: DataFrame, config: dict, country: str = "IN") -> DataFrame:
    """df with the columns that config asks for.

    on_missing null: missing values are null.  error: a missing required value fails the query with its path.  omit: the result is
    one column `record`, a JSON object without the missing keys.
    """
    policy, targets, columns = config.get("on_missing", "null"), [], []
    for rule in config.get("fields", []):
        path = rule.get("path")
        if not path:
            continue
        if path in targets:
            raise ValueError(f"Self-conflicting config: target path '{path}' is mapped multiple times")
        targets.append(path)
        source = rule.get("from") or path
        value, kind = compile_path(df.schema, source)
        if kind is None:
            value, kind = F.lit(None).cast("string"), T.StringType()
        value, kind = _normalized(value, kind, rule.get("normalize"), country)
        value = _typed(value, kind, rule.get("type"))
        if isinstance(kind, T.ArrayType) and rule.get("type") not in ("string", "number", "boolean"):
            value = F.when(F.size(value) > 0, value)
        if policy == "error" and rule.get("required"):
            value = F.when(F.isnull(value), F.raise_error(F.lit(f"Required projected field '{path}' (from '{source}') is missing"))).otherwise(value)
        columns.append(value.alias(path))
    if config.get("include_confidence", True):
        if "overall_confidence" in df.columns:
            columns.append(F.col("overall_confidence"))
        if "provenance" in df.columns:
            columns.append(_provenance(config, df.schema["provenance"].dataType).alias("provenance"))
    out = df.select(*columns)
    return out.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in out.columns])).alias("record")) if policy == "omit" else out


def _provenance(config: dict, kind: T.ArrayType) -> Column:
    """Entries whose field is part of a projected source path, under the first such target's name."""
    rules = [(r["path"], r.get("from") or r["path"]) for r in config.get("fields", []) if r.get("path")]

    def renamed(field: Column) -> Column:
        out = F.lit(None).cast("string")
        for path, source in reversed(rules):
            out = F.when(F.contains(F.lit(source), field), F.lit(path)).otherwise(out)
        return out

    names = kind.elementType.names
    made = F.transform("provenance", lambda p: F.struct(*[(renamed(p["field"]) if n == "field" else p[n]).alias(n) for n in names]))
    return F.filter(made, lambda p: p["field"].isNotNull())
