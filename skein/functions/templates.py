"""Templates such as ``concept:{input.title | lowercase}``, compiled to columns; no Python runs over the rows.

The columns ``input`` and ``ensemble`` (VARIANT) hold the data. What can't be rendered in a row doesn't fail the job: every
compiled part has a value and an error, which is null where the value holds.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arrays in arrays are rendered to this depth.
DEPTH = 3


@dataclass(frozen=True)
class Scope:
    """What accessors refer to; ``variables`` are items bound by loops."""

    adapter_id: str
    context_id: str
    ensemble: bool = False
    variables: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Value:
    """``kind``: variant, string or strings (an array of strings)."""

    column: Column
    error: Column
    kind: str = "variant"


class TemplateError(ValueError):
    """The template itself is wrong."""


def no_error() -> Column:
    return F.lit(None).cast("string")


def kind_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def get(v: Column, path: list[str]) -> Column:
    steps = "".join("['" + p.replace("'", "\\'") + "']" for p in path)
    return F.try_variant_get(v, "$" + steps, "variant")


def accessor(name: str, scope: Scope) -> Value:
    """``input.a.b``, ``ensemble.a.b``, ``adapter_id`` or ``context_id``; a missing path is an error of the row."""
    if name in ("adapter_id", "context_id"):
        return Value(F.lit(getattr(scope, name)), no_error(), "string")
    root, _, path = name.partition(".")
    if root not in ("input", "ensemble") or not path:
        raise TemplateError(f"unknown template accessor: {name}")
    if root == "ensemble" and not scope.ensemble:
        raise TemplateError("ensemble accessor used but no ensemble response available")
    steps = path.split(".")
    if root == "input" and steps[0] in scope.variables:
        v = F.col(scope.variables[steps[0]])
        v = get(v, steps[1:]) if steps[1:] else v
    else:
        v = get(F.col(root), steps)
    return Value(v, F.when(v.isNull(), F.lit(f"{root} field not found: {name}")))


def variant_text(v: Column, depth: int = DEPTH) -> tuple[Column, Column]:
    """(text, whether it can't be rendered): objects can't."""
    t = kind_of(v)
    plain = F.when(t == "STRING", F.try_variant_get(v, "$", "string")).when(F.is_variant_null(v), F.lit("")).otherwise(F.to_json(v))
    if depth == 0:
        return plain, t.startswith("OBJECT") | t.startswith("ARRAY")
    items = F.try_variant_get(v, "$", "array<variant>")
    listed = F.array_join(F.transform(items, lambda x: variant_text(x, depth - 1)[0]), ",")
    bad = F.when(t.startswith("ARRAY"), F.exists(items, lambda x: variant_text(x, depth - 1)[1])).otherwise(t.startswith("OBJECT"))
    return F.when(t.startswith("ARRAY"), listed).otherwise(plain), bad


def text(v: Value) -> Value:
    if v.kind == "string":
        return v
    if v.kind == "strings":
        return Value(F.array_join(v.column, ","), v.error, "string")
    c, bad = variant_text(v.column)
    return Value(c, F.coalesce(v.error, F.when(bad, F.lit("cannot render object as string in template"))), "string")


def strings(v: Value, name: str) -> Value:
    """The strings of an array, others left out."""
    if v.kind == "strings":
        return v
    wrong = F.lit(f"{name} filter requires an array value")
    if v.kind == "string":
        return Value(F.array().cast("array<string>"), F.coalesce(v.error, wrong), "strings")
    items = F.filter(F.try_variant_get(v.column, "$", "array<variant>"), lambda x: kind_of(x) == "STRING")
    return Value(F.transform(items, lambda x: F.try_variant_get(x, "$", "string")), F.coalesce(v.error, F.when(~kind_of(v.column).startswith("ARRAY"), wrong)), "strings")


def apply_filter(v: Value, spec: str) -> Value:
    name, _, arg = (x.strip() for x in spec.partition(":"))
    given = ":" in spec
    if name == "lowercase":
        wrong = F.lit("lowercase filter requires a string value")
        if v.kind == "strings":
            return Value(F.lit(""), F.coalesce(v.error, wrong), "string")
        if v.kind == "string":
            return Value(F.lower(v.column), v.error, "string")
        return Value(F.lower(F.try_variant_get(v.column, "$", "string")), F.coalesce(v.error, F.when(kind_of(v.column) != "STRING", wrong)), "string")
    if name == "sort":
        s = strings(v, "sort")
        return Value(F.array_sort(s.column), s.error, "strings")
    if name == "join":
        s = strings(v, "join")
        return Value(F.array_join(s.column, arg if given else ","), s.error, "string")
    if name == "default":
        if v.kind == "strings":
            return v
        if v.kind == "string":
            return Value(F.when(v.column == "", F.lit(arg)).otherwise(v.column), v.error, "string")
        blank = F.is_variant_null(v.column) | ((kind_of(v.column) == "STRING") & (F.try_variant_get(v.column, "$", "string") == ""))
        return Value(F.when(blank, F.lit(arg).cast("variant")).otherwise(v.column), v.error)
    raise TemplateError(f"unknown template filter: {name}")


def expression(expr: str, scope: Scope) -> Value:
    name, *filters = expr.split("|")
    v = accessor(name.strip(), scope)
    for f in filters:
        v = apply_filter(v, f.strip())
    return text(v)


def render(template: str, scope: Scope) -> Value:
    """A template with its ``{...}`` replaced; text outside stays as it is."""
    parts, errors, rest = [], [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        expr, close, rest = rest.partition("}")
        if not close:
            raise TemplateError(f"unclosed template expression in: {template}")
        v = expression(expr.strip(), scope)
        parts += [F.lit(before), v.column]
        errors.append(v.error)
    parts.append(F.lit(rest))
    return Value(F.concat(*parts), F.coalesce(*errors) if errors else no_error(), "string")
