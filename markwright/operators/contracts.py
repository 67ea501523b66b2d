"""Record contracts: JSON records against a schema, compiled into column predicates over VARIANT.

The schema is walked while the plan is built; Spark evaluates the resulting predicates, so a record is parsed once and no
Python runs. Covered: type, required, enum, const, minLength, pattern, minimum, maximum, properties, additionalProperties
false, items, uniqueItems, minItems, maxItems, anyOf, oneOf, not and local $ref. A type mismatch ends the checks of its
node. additionalProperties given as a schema is not checked.

A schema whose references lead back into themselves is followed to the records' own depth. Some levels are compiled in
one expression. Where no such reference stands under anyOf, oneOf or not, a record's problems are those of its parts, and
one aggregate over each record goes from the parts of a level to those of the next. Else what a record holds below comes
out as rows (record, reference, path, value), level by level, until no record goes deeper; then the levels are judged from
the deepest up, each reading the problems of the parts below it. A reference that leads back to itself without going
deeper into the value has no meaning and is refused.

Spark computes an expression again wherever it stands, and a part taken out of a variant is built anew, so members of
members are found by one path from a value that is bound, and what is used more than once is bound by let().
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwright.sources.files import cut

#: Places at which one expression may stop at a reference that leads back; more of them make fewer rounds and larger plans.
STOPS = 8
PART = "array<struct<ref:string,path:string,value:variant>>"
PROBLEM = "array<struct<path:string,message:string>>"


def _none() -> Column:
    return F.array().cast(PROBLEM)


def _joined(found: list[Column]) -> Column:
    """Arrays of problems as one; concat() takes several times as long inside lambdas, where Spark generates no code."""
    return found[0] if len(found) == 1 else F.flatten(F.array(*found)) if found else _none()


def _problem(condition: Column, path: Column, message: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(message).alias("message")))).otherwise(_none())


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x computed once."""
    return F.element_at(F.transform(F.array(x), use), 1)


def kind_of(v: Column) -> Column:
    """The JSON type of a variant: object, array, string, integer (also 3.0), number, boolean, null."""
    number = F.try_variant_get(v, "$", "double")
    named = lambda s: (
        F.when(s == "BIGINT", "integer").when(v.isNull() | (s == "VOID"), "null").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array")
        .when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(number == F.floor(number), "integer").otherwise("number")
    )
    return let(F.schema_of_variant(v), named)


def _is(kind: Column, wanted: str) -> Column:
    return kind.isin("integer", "number") if wanted == "number" else kind == wanted


def _equals(v: Column, kind: Column, value: Any) -> Column:
    if isinstance(value, bool):
        return _is(kind, "boolean") & (F.try_variant_get(v, "$", "boolean") == value)
    if isinstance(value, int | float):
        return _is(kind, "number") & (F.try_variant_get(v, "$", "double") == float(value))
    if isinstance(value, str):
        return _is(kind, "string") & (F.try_variant_get(v, "$", "string") == value)
    return F.to_json(v) == json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def step(key: str) -> str | None:
    """A key as a step of a variant's path; None if no form of steps can hold it."""
    forms = (("['", "']", "'?"), ('["', '"]', '"?'), (".", "", ".["))
    return next((f"{head}{key}{tail}" for head, tail, barred in forms if key and not set(key) & set(barred)), None)


class Place:
    """Where a value stands in a record: keys lead to it from a variant; its path for problems."""

    def __init__(self, base: Column, path: Column, keys: tuple[str, ...] = ()):
        self.base, self.origin, self.keys = base, path, keys

    @property
    def path(self) -> Column:
        return F.concat(self.origin, F.lit("".join(f"/{key}" for key in self.keys))) if self.keys else self.origin

    def get(self, kind: str) -> Column:
        """The value as a type; null if it is not of it or not there, but a JSON null is a variant."""
        steps = [step(key) for key in self.keys]
        if None in steps:
            raise ValueError(f"no path of a variant leads to the key {self.keys[steps.index(None)]!r}")
        return F.try_variant_get(self.base, "$" + "".join(steps), kind)

    @property
    def value(self) -> Column:
        return self.get("variant") if self.keys else self.base

    @property
    def is_object(self) -> Column:
        return self.get("struct<>").isNotNull()

    def member(self, key: str) -> Place:
        return Place(self.base, self.origin, (*self.keys, key))

    def bound(self, use: Callable[[Place], Column]) -> Column:
        """use() of the place, with the value taken out once."""
        return let(self.value, lambda x: use(Place(x, self.path)))

    def item(self, x: Column, i: Column) -> Place:
        return Place(x, F.concat(self.path, F.lit("/"), i.cast("string")))


def target_of(root: dict, ref: str) -> dict:
    target: Any = root
    for part in ref.removeprefix("#").strip("/").split("/"):
        target = target[part] if part else target
    return target


def branches(schema: dict) -> Iterator[dict]:
    """The schemas that judge the same value."""
    for name in ("anyOf", "oneOf"):
        yield from (b for b in schema.get(name, ()) if isinstance(b, dict))
    if isinstance(schema.get("not"), dict):
        yield schema["not"]


def parts(schema: dict) -> Iterator[dict]:
    """The schemas that judge parts of the value."""
    yield from schema.get("properties", {}).values()
    if isinstance(schema.get("items"), dict):
        yield schema["items"]


def refs_in(schema: dict, deeper: bool = True) -> set[str]:
    """The references that stand in a schema, with or without those of parts of the value."""
    if "$ref" in schema:
        return {schema["$ref"]}
    inner = [*branches(schema), *(parts(schema) if deeper else ())]
    return set().union(*(refs_in(s, deeper) for s in inner))


def reached(root: dict, schema: dict, deeper: bool = True) -> set[str]:
    """The references that a schema comes to, followed far enough."""
    seen: set[str] = set()
    todo = refs_in(schema, deeper)
    while todo:
        seen |= todo
        todo = set().union(*(refs_in(target_of(root, r), deeper) for r in todo)) - seen
    return seen


def leading_back(root: dict) -> set[str]:
    """The references that can come to stand inside themselves."""
    every = reached(root, root)
    for ref in every:
        if ref in reached(root, target_of(root, ref), False):
            raise ValueError(f"{ref} leads back to itself without going deeper into the value")
    return {ref for ref in every if ref in reached(root, target_of(root, ref))}


def back_in_branches(root: dict, back: set[str]) -> bool:
    """Whether a reference that leads back stands under anyOf, oneOf or not, or behind a reference there."""

    def found(schema: dict) -> bool:
        return any(reached(root, b) & back for b in branches(schema)) or any(map(found, parts(schema)))

    return any(map(found, (root, *(target_of(root, ref) for ref in reached(root, root)))))


def of_object(schema: dict) -> bool:
    """Whether a schema is for objects; its items count for nothing then."""
    return schema.get("type") == "object" or "properties" in schema or "required" in schema


class Walk:
    """How far references are followed in one expression: those that lead back, `times` times; then stop() has the say, or what lies there is judged elsewhere."""

    def __init__(self, root: dict, back: set[str], times: int, stop: Callable[[str, Place], Column] | None):
        self.root, self.back, self.times, self.stop = root, back, times, stop

    def stops_in(self, schema: dict) -> bool:
        """Whether a schema, followed far enough, refers to what leads back."""
        return bool(reached(self.root, schema) & self.back)

    def silent(self, schema: dict) -> bool:
        """Whether a schema is a place to stop at that is judged elsewhere."""
        return self.stop is None and isinstance(self.enter(schema)[0], str)

    def enter(self, schema: dict) -> tuple[dict | str, Walk]:
        """The schema behind references, or the reference to stop at, and the walk from there."""
        walk = self
        while "$ref" in schema:
            ref = schema["$ref"]
            if ref in walk.back:
                if not walk.times:
                    return ref, walk
                walk = Walk(walk.root, walk.back, walk.times - 1, walk.stop)
            schema = target_of(walk.root, ref)
        return schema, walk


def compile_parts(schema: dict, at: Place, walk: Walk) -> list[Column]:
    """Arrays of the places where the walk stops in a variant: (ref, path, value)."""
    if not walk.stops_in(schema):
        return []
    schema, walk = walk.enter(schema)
    if isinstance(schema, str):
        part = lambda x: F.when(x.isNotNull(), F.array(F.struct(F.lit(schema).alias("ref"), at.path.alias("path"), x.alias("value")))).otherwise(F.array()).cast(PART)
        return [let(at.value, part)]
    found = [c for branch in branches(schema) for c in compile_parts(branch, at, walk)]
    for key, s in schema.get("properties", {}).items():
        found += compile_parts(s, at.member(key), walk)
    if schema.get("items") and not of_object(schema) and walk.stops_in(schema["items"]):
        each = lambda x, i: F.concat(*compile_parts(schema["items"], at.item(x, i), walk))
        found.append(F.coalesce(F.flatten(F.transform(at.get("array<variant>"), each)), F.array().cast(PART)))
    return found


def compile_schema(schema: dict, at: Place, walk: Walk) -> Column:
    """The problems of a value that is there, as an array."""
    schema, walk = walk.enter(schema)
    if isinstance(schema, str):
        return walk.stop(schema, at) if walk.stop else _none()
    fine = lambda s: F.size(compile_schema(s, at, walk)) == 0

    def of_kind(ok: Column, found: list[Column], wanted: str) -> Column:
        wrong = F.concat(F.lit("is of type "), kind_of(at.value), F.lit(f", not {wanted}"))
        return F.when(ok, F.coalesce(_joined(found), _none())).otherwise(F.array(F.struct(at.path.alias("path"), wrong.alias("message"))))

    kind = schema.get("type")
    if of_object(schema):
        problems = of_kind(at.is_object, _of_object(schema, at, walk), "object")
    elif kind == "array" or "items" in schema:
        problems = let(at.get("array<variant>"), lambda items: of_kind(items.isNotNull(), _of_array(schema, items, at, walk), "array"))
    elif kind:
        problems = let(kind_of(at.value), lambda k: of_kind(_is(k, kind), _of_scalar(schema, k, at), kind))
    elif _of_scalar(schema, at.value, at):
        problems = let(kind_of(at.value), lambda k: _joined(_of_scalar(schema, k, at)))
    else:
        problems = _none()
    for name, message in (("oneOf", "does not match exactly one branch"), ("not", "matches the forbidden schema"), ("anyOf", "matches no branch")):
        if name == "not" and isinstance(schema.get("not"), dict):
            broken = fine(schema["not"])
        elif name in schema and name != "not":
            n = F.lit(0)
            for branch in schema[name]:
                n = n + fine(branch).cast("int")
            broken = n != 1 if name == "oneOf" else n == 0
        else:
            continue
        problems = F.when(broken, F.array(F.struct(at.path.alias("path"), F.lit(message).alias("message")))).otherwise(problems)
    return problems


def _of_object(schema: dict, at: Place, walk: Walk) -> list[Column]:
    properties, required = schema.get("properties", {}), schema.get("required", [])
    found: list[Column] = []
    for key in [*properties, *(k for k in required if k not in properties)]:
        inner, absent = at.member(key), _problem(F.lit(True), at.path, f'lacks "{key}"') if key in required else _none()
        if key not in properties or walk.silent(properties[key]):
            if key in required and step(key) is None:
                found.append(F.when(F.array_contains(F.json_object_keys(F.to_json(at.value)), key), _none()).otherwise(absent))
            elif key in required:
                found.append(F.when(inner.is_object | inner.value.isNotNull(), _none()).otherwise(absent))
        elif isinstance(s := walk.enter(properties[key])[0], dict) and of_object(s):
            # An object need not be taken out to see that it is there.
            found.append(F.when(inner.is_object | inner.value.isNotNull(), compile_schema(properties[key], inner, walk)).otherwise(absent))
        else:
            found.append(inner.bound(lambda x: F.when(x.value.isNull(), absent).otherwise(compile_schema(properties[key], x, walk))))  # noqa: B023
    if schema.get("additionalProperties") is False:
        extra = F.array_except(F.json_object_keys(F.to_json(at.value)), F.array(*map(F.lit, properties)).cast("array<string>"))
        found.append(F.transform(extra, lambda k: F.struct(at.path.alias("path"), F.concat(F.lit('has no place for "'), k, F.lit('"')).alias("message"))))
    return found


def _of_array(schema: dict, items: Column, at: Place, walk: Walk) -> list[Column]:
    found: list[Column] = []
    if schema.get("items") and not walk.silent(schema["items"]):
        found.append(F.flatten(F.transform(items, lambda x, i: compile_schema(schema["items"], at.item(x, i), walk))))
    texts = F.transform(items, lambda x: F.coalesce(F.to_json(x), F.lit("null")))
    if schema.get("uniqueItems") is True:
        found.append(_problem(F.size(F.array_distinct(texts)) < F.size(texts), at.path, "items are not unique"))
    if isinstance(schema.get("minItems"), int):
        found.append(_problem(F.size(items) < schema["minItems"], at.path, f"fewer than {schema['minItems']} items"))
    if isinstance(schema.get("maxItems"), int):
        found.append(_problem(F.size(items) > schema["maxItems"], at.path, f"more than {schema['maxItems']} items"))
    return found


def _of_scalar(schema: dict, kind: Column, at: Place) -> list[Column]:
    v, found = at.value, []
    if "enum" in schema:
        allowed = F.lit(False)
        for value in schema["enum"]:
            allowed = allowed | _equals(v, kind, value)
        found.append(_problem(~allowed, at.path, "not one of the allowed values"))
    if "const" in schema:
        found.append(_problem(~_equals(v, kind, schema["const"]), at.path, f"not {json.dumps(schema['const'])}"))
    text, number = F.when(_is(kind, "string"), F.try_variant_get(v, "$", "string")), F.when(_is(kind, "number"), F.try_variant_get(v, "$", "double"))
    if isinstance(schema.get("minLength"), int):
        found.append(_problem(F.length(text) < schema["minLength"], at.path, f"shorter than {schema['minLength']}"))
    if isinstance(schema.get("pattern"), str):
        found.append(_problem(~text.rlike(schema["pattern"]), at.path, f"does not match {schema['pattern']}"))
    bounds = []
    if "minimum" in schema:
        bounds.append(lambda n: _problem(n < float(schema["minimum"]), at.path, f"below {schema['minimum']}"))
    if "maximum" in schema:
        bounds.append(lambda n: _problem(n > float(schema["maximum"]), at.path, f"above {schema['maximum']}"))
    if bounds:
        found.append(let(number, lambda n: _joined([bound(n) for bound in bounds])))
    return found


def check_record_contract(df: DataFrame, key: str, json_col: str, schema: dict) -> DataFrame:
    """(key, path, message): a row for each problem; JSON that can't be parsed has one."""
    back = leading_back(schema)
    whole = df.select(F.col(key).alias("key"), F.col(json_col).alias("text"), F.try_parse_json(json_col).alias("value"))
    value = F.col("value")
    bad = F.array(F.struct(F.lit("").alias("path"), F.lit("not JSON").alias("message")))
    judged = lambda problems: F.when(value.isNull(), bad).otherwise(problems)
    if not back:
        return whole.select(F.col("key").alias(key), F.inline(judged(compile_schema(schema, Place(value, F.lit("")), Walk(schema, back, 0, None)))))
    if not back_in_branches(schema, back):
        return whole.select(F.col("key").alias(key), F.inline(judged(_by_levels(schema, back, value, F.col("text")))))

    # How often what leads back is followed in one expression, so that it stops at some STOPS places at most.
    wide = max(_stops(schema, ref, back) for ref in back)
    times = next(t for t in range(1, 65) if wide ** (t + 1) > STOPS or t == STOPS)
    known = lambda ref, place: F.coalesce(F.try_element_at("below", F.concat(F.lit(f"{ref} "), place.path)), _none())
    at = Place(value, F.col("path"))
    walk = Walk(schema, back, times, known)

    def by_ref(use: Callable[[dict], Column]) -> Column:
        out = F.lit(None)
        for ref in sorted(back):
            out = F.when(F.col("ref") == ref, use(target_of(schema, ref))).otherwise(out)
        return out

    def places(s: dict) -> Column:
        found = compile_parts(s, at, walk)
        return F.concat(*found) if found else F.array().cast(PART)

    # The whole record is a part of its own, without a reference.
    start = cut(whole.select(F.monotonically_increasing_id().alias("id"), "key", F.lit("").alias("path"), "value"))
    levels, places_of = [start], lambda: places(schema)
    while True:
        deeper = levels[-1].where("value IS NOT NULL").select("id", F.inline(places_of()))
        deeper = cut(deeper.groupBy("id", "ref", "path").agg(F.any_value("value").alias("value")))
        if deeper.isEmpty():
            break
        levels.append(deeper)
        places_of = lambda: by_ref(places)
    below = None
    for level in reversed(levels[1:]):
        judge = by_ref(lambda s: compile_schema(s, at, walk))
        rows = cut(_with_below(level, below).select("id", "ref", "path", judge.alias("problems")))
        below = rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "ref", "path"), "problems"))).alias("below"))
    problems = judged(compile_schema(schema, at, walk))
    return _with_below(start, below).select(F.col("key").alias(key), F.inline(problems))


def _by_levels(schema: dict, back: set[str], value: Column, text: Column) -> Column:
    """The problems of a record whose parts are judged each for itself, a level of them at a time."""
    wide = max(_stops(schema, ref, back) for ref in back)
    times = next(t for t in range(64) if wide ** (t + 2) > STOPS or t + 1 == STOPS)
    walk, none = Walk(schema, back, times, None), F.array().cast(PART)

    def behind(ref: str) -> dict:
        """A part's schema, so that where its walk stops lies deeper in the value."""
        s = target_of(schema, ref)
        while "$ref" in s:
            s = target_of(schema, s["$ref"])
        return s

    def each(at: Column, use: Callable[[dict, Place], Column], otherwise: Column) -> Column:
        def judged(part: Column) -> Column:
            out = otherwise
            for ref in sorted(back | {"#"}):
                out = F.when(part["ref"] == ref, use(behind(ref), Place(part["value"], part["path"]))).otherwise(out)
            return out

        return F.flatten(F.transform(at, judged))

    def next_level(state: Column, _: Column) -> Column:
        problems = _joined([state["problems"], each(state["at"], lambda s, place: compile_schema(s, place, walk), _none())])
        deeper = each(state["at"], lambda s, place: F.flatten(F.array(none, *compile_parts(s, place, walk))), none)
        return F.when(F.size(state["at"]) == 0, state).otherwise(F.struct(problems.alias("problems"), deeper.alias("at")))

    record = F.array(F.struct(F.lit("#").alias("ref"), F.lit("").alias("path"), value.alias("value"))).cast(PART)
    # Each level lies deeper in the value, so there are no more of them than brackets are opened, and the record's own.
    levels = F.array_repeat(F.lit(0), F.regexp_count(text, F.lit(r"[\[{]")) + 1)
    return F.aggregate(levels, F.struct(_none().alias("problems"), record.alias("at")), next_level, lambda state: state["problems"])


def _with_below(level: DataFrame, below: DataFrame | None) -> DataFrame:
    none = F.lit(None).cast(f"map<string,{PROBLEM}>").alias("below")
    return level.select("*", none) if below is None else level.join(below, "id", "left")


def _stops(root: dict, ref: str, back: set[str]) -> int:
    """At how many places a reference's schema, followed once, refers to what leads back."""

    def count(schema: dict) -> int:
        if schema.get("$ref") in back:
            return 1
        while "$ref" in schema:
            schema = target_of(root, schema["$ref"])
        return sum(count(s) for s in (*branches(schema), *parts(schema)))

    return count(target_of(root, ref))
