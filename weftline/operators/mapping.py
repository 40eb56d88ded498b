"""Declarative mapping of dynamic JSON records to messages: schemas, paths, field rules, and how well a schema still fits."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import text as X
from weftline.functions.arrow import arrow_column

#: The fields of a message, those that must be mapped, transforms by field shape, and the depth of profiles.
FIELDS = ("message_id", "conversation_id", "conversation", "sender", "sender_id", "text", "sent_at", "sent_by_me", "revision")
REQUIRED = ("message_id", "conversation_id", "sent_at")
TEXT_TRANSFORMS, TIME_TRANSFORMS = ("", "html_text", "trim"), ("", "unix_ms", "unix_s", "iso8601")
DEPTH = 6
#: Fixed value: one step of a path: a masked key, a key up to the next step, or all items, values or members.
STEP = r"\.<[^<>]+>|\.(?:(?!\[\]|\{\}|<>)[^.<])+|\[\]|\{\}|<>"
#: Fixed value: times as text.
ISO_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
#: Old names of version 1 schemas.
RENAMED_V1 = {"storage": "kind", "database_prefix": "namespace_prefix", "store": "container"}


@dataclass(frozen=True)
class FieldRule:
    """Where a field comes from: the first path that isn't empty, cut, transformed, looked up, or a default."""

    paths: tuple[str, ...]
    transform: str = ""
    split: tuple[str, int] | None = None
    default: str = ""
    required: bool = False
    lookup: dict[str, Any] | None = None


@dataclass(frozen=True)
class Schema:
    """A mapping schema, checked."""

    name: str
    source: str
    revision: int
    kind: str
    namespace_prefix: str
    container: str
    each: str
    require: tuple[dict[str, Any], ...] = ()
    fields: dict[str, FieldRule] = field(default_factory=dict)


def load_schema(body: dict[str, Any]) -> Schema:
    """A schema from its JSON, version 1 brought up to date; ValueError names what is wrong."""
    known = {"version", "target", "name", "source", "revision", "records", "require", "fields", "fingerprint", "checked_at", "notes"}
    if extra := set(body) - known:
        raise ValueError(f"unknown keys {sorted(extra)}")
    if body.get("target", "message/1") != "message/1" or body.get("version") not in (1, 2):
        raise ValueError("unknown target or version")
    if not re.fullmatch(r"[a-z0-9][a-z0-9-]{0,63}", body.get("name", "")):
        raise ValueError("a name is lower case letters, digits and hyphens")
    records = {RENAMED_V1.get(k, k) if body["version"] == 1 else k: v for k, v in body.get("records", {}).items()}
    if bad := set(records) - {"kind", "namespace_prefix", "container", "each"}:
        raise ValueError(f"unknown record keys {sorted(bad)}")
    fields = {}
    for name, rule in body.get("fields", {}).items():
        if name not in FIELDS:
            raise ValueError(f"unknown field {name}")
        allowed = TIME_TRANSFORMS if name == "sent_at" else TEXT_TRANSFORMS
        if rule.get("transform", "") not in allowed:
            raise ValueError(f"{name}: transform {rule['transform']!r}, expected one of {allowed}")
        cut = rule.get("split")
        fields[name] = FieldRule(tuple(rule["paths"]), rule.get("transform", ""), (cut["separator"], cut["index"]) if cut else None, rule.get("default", ""), bool(rule.get("required")), rule.get("lookup"))
        for path in rule["paths"]:
            parse_path(path)
    if missing := [f for f in REQUIRED if f not in fields]:
        raise ValueError(f"fields {missing} must be mapped")
    return Schema(body["name"], body.get("source", body["name"]), int(body.get("revision", 0)), records.get("kind", ""), records.get("namespace_prefix", ""), records.get("container", ""), records.get("each", "$"), tuple(body.get("require", ())), fields)


def parse_path(path: str) -> list[tuple[str, str]]:
    """Steps of a path behind `$` (the item) or `^` (the record): ('key', name), ('items', ''), ('values', ''), ('members', '') or ('masked', '<id>')."""
    m = re.fullmatch(rf"[$^]((?:{STEP})*)", path)
    if not m:
        raise ValueError(f"bad path {path!r}")
    steps = []
    for step in re.findall(STEP, m[1]):
        if step[0] == ".":
            steps.append(("masked" if step[1] == "<" else "key", step[1:]))
        else:
            steps.append({"[]": ("items", ""), "{}": ("values", ""), "<>": ("members", "")}[step])
    return steps


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """A function of a column whose expression is evaluated, and compiled, once however often the function names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def child(value: Column, name: str, to: str = "variant") -> Column:
    """A property of an object; null where there is none."""
    quoted = f"['{name}']" if "'" not in name else f'["{name}"]'
    return F.try_variant_get(value, f"${quoted}", to)


def tagged(value: Column, kind: str, to: str = "variant") -> Column:
    """What a value that JSON has no shape for holds: {"$date": ms}, {"$bigint": text}, {"$map": [[key, value]]}, {"$set": [values]}."""
    return child(value, f"${kind}", to)


def _children(value: Column, kind: str, name: str) -> Column:
    """ARRAY of the values one step below a value, in order."""
    none = F.array().cast("array<variant>")
    if kind == "key":
        return F.array(child(value, name))
    if kind == "items":
        return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), none)
    if kind == "members":
        return F.coalesce(tagged(value, "set", "array<variant>"), none)
    held = F.try_variant_get(value, "$", "map<string,variant>")
    if kind == "masked":
        return F.coalesce(F.map_values(F.map_filter(held, lambda k, _: X.mask_key(k) == name)), none)
    entries = F.transform(tagged(value, "map", "array<variant>"), lambda e: F.try_variant_get(e, "$[1]", "variant"))
    return F.coalesce(entries, F.map_values(held), none)  # where JSON has objects only, an object is a map


def reached(value: Column, path: str) -> Column:
    """ARRAY of the values that a path reaches, in order, missing ones left out: one evaluator for all steps."""
    def below(found: Column, step: tuple[str, str]) -> Column:
        return F.filter(F.flatten(F.transform(found, lambda v: _children(v, *step))), lambda v: v.isNotNull())

    return functools.reduce(below, parse_path(path), F.array(value))


def first_at(value: Column, path: str) -> Column:
    """The first value that a path reaches."""
    steps = parse_path(path)
    if any(kind != "key" or "'" in name for kind, name in steps):
        return F.get(reached(value, path), F.lit(0))
    return F.try_variant_get(value, "$" + "".join(f"['{name}']" for _, name in steps), "variant")


def expand(records: DataFrame, path: str, value: str = "value", item: str = "item") -> DataFrame:
    """One row an item that `each` points at, the record beside it."""
    if all(kind == "key" for kind, _ in parse_path(path)):
        return records.withColumn(item, first_at(F.col(value), path)).where(F.col(item).isNotNull())
    return records.withColumn(item, F.explode(reached(F.col(value), path)))


def plain_number(number: Column) -> Column:
    """A number as text, in as few digits as tell it apart and without an exponent, as scripts in browsers write it."""
    def written(text: Column) -> Column:
        part = F.regexp_extract_all(text, F.lit(r"-?\d+"), F.lit(0))  # digit, digits behind the point, exponent
        return F.when(F.contains(text, F.lit("E")), let(part, lambda p: wide(text, p))).otherwise(F.regexp_replace(text, r"\.0$", ""))

    def wide(text: Column, part: Column) -> Column:
        bare = F.struct(F.regexp_replace(F.concat(F.ltrim(part[0], F.lit("-")), part[1]), "0+$", "").alias("digits"), part[2].cast("int").alias("power"), F.when(text.startswith("-"), "-").otherwise("").alias("sign"))
        return let(bare, lambda b: F.concat(b["sign"], spread(b["digits"], b["power"])))

    def spread(digits: Column, power: Column) -> Column:
        whole = F.when(power + 1 >= F.length(digits), F.rpad(digits, power + 1, F.lit("0"))).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits))))
        return F.when(power >= 0, whole).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))

    return let(number.cast("string"), written)


def text_of(value: Column) -> Column:
    """A value's text: strings, big integers, and numbers; an empty string for anything else."""
    def told(v: Column) -> Column:
        number = plain_number(F.try_variant_get(v, "$", "double"))
        return let(F.schema_of_variant(v), lambda kind: F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), number).when(kind.startswith("OBJECT"), tagged(v, "bigint", "string")))

    return F.coalesce(let(value, told), F.lit(""))


def scalar(value: Column, path: str) -> Column:
    """The text of the first value that a path reaches."""
    return text_of(first_at(value, path))


def _segment(text: Column, rule: FieldRule) -> Column:
    return F.coalesce(F.get(F.split(text, re.escape(rule.split[0])), F.lit(rule.split[1])), F.lit("")) if rule.split else text


def _ruled(rule: FieldRule, item: Column, record: Column) -> Column:
    """The first path's text that isn't empty once it is cut and transformed; else null."""
    found = [F.lit(None).cast("string")]
    for path in rule.paths:
        text = _segment(scalar(record if path[0] == "^" else item, path), rule)
        if rule.transform == "html_text":
            text = X.html_to_text(text)
        elif rule.transform == "trim":
            text = F.trim(text)
        found.append(F.nullif(text, F.lit("")))
    return F.coalesce(*found)


def read_time(value: Column, transform: str) -> Column:
    """A time from a date, or by transform from epoch seconds, milliseconds or ISO 8601; null where it is none or not after 1970."""
    after_1970 = lambda millis: let(millis, lambda ms: F.when(ms > 0, F.timestamp_millis(F.floor(ms))))

    def told(v: Column) -> Column:
        if transform == "iso8601":
            return let(text_of(v), lambda t: F.when(t.rlike(ISO_TIME), F.try_to_timestamp(t)))
        return after_1970(text_of(v).try_cast("double") * (1000 if transform == "unix_s" else 1)) if transform else F.lit(None).cast("timestamp")

    return let(value, lambda v: F.coalesce(after_1970(tagged(v, "date", "double")), told(v)))


def read_flag(value: Column, rule: FieldRule) -> Column:
    """True for a true boolean, and for a cut segment that reads `true`; the text `true` alone is none."""
    def said(v: Column) -> Column:
        flag = F.coalesce(F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")), F.lit(False))
        return flag | (_segment(text_of(v), rule) == "true") if rule.split else flag

    return let(value, said)


def kind_of(value: Column) -> Column:
    """The kind of a value: object, array, string, bool, number, null, date, bigint, map, set; undefined where there is none."""
    def named(v: Column, kind: Column) -> Column:
        tag = functools.reduce(lambda found, name: found.when(tagged(v, name).isNotNull(), name), ("bigint", "map", "set"), F.when(tagged(v, "date").isNotNull(), "date")).otherwise("object")
        return (
            F.when(kind.isNull(), "undefined").when(kind.startswith("OBJECT"), tag).when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
            .when(kind == "BOOLEAN", "bool").when(kind == "VOID", "null").otherwise("number")
        )

    return let(value, lambda v: let(F.schema_of_variant(v), lambda kind: named(v, kind)))


def condition(value: Column, rule: dict[str, Any]) -> Column:
    """A condition on a record: `in`, `not_in`, `kind_not`; a missing value is of kind undefined."""
    text = scalar(value, rule["path"])
    kept = F.lit(True)
    if "in" in rule:
        kept = kept & text.isin(*map(str, rule["in"]))
    if "not_in" in rule:
        kept = kept & ~text.isin(*map(str, rule["not_in"]))
    if "kind_not" in rule:
        unwanted = rule["kind_not"] if isinstance(rule["kind_not"], list) else [rule["kind_not"]]
        kept = kept & ~kind_of(first_at(value, rule["path"])).isin(*unwanted)
    return kept


def lookup_table(records: DataFrame, rule: dict[str, Any]) -> DataFrame:
    """match, found: values by key of the records of another container; the last record wins."""
    where = rule["location"]
    held = records.where((F.col("kind") == where["kind"]) & (F.col("container") == where["container"]))
    keyed = expand(held, where.get("each", "$")).select(scalar(F.col("item"), rule["match"]).alias("match"), F.coalesce(*(F.nullif(scalar(F.col("item"), p), F.lit("")) for p in rule["values"])).alias("found"), "seq")
    return keyed.where("match <> '' and found is not null").groupBy("match").agg(F.max_by("found", "seq").alias("found"))


def apply_schema(records: DataFrame, schema: Schema) -> DataFrame:
    """Messages of the records (kind, namespace, container, seq, value VARIANT) that a schema selects; `kept` tells which are whole.

    Records with a `decode_err`, where there is such a column, are left out.     Items that fail a condition or lack a required field stay with kept = false, so `tally` can count them.
    """
    if "decode_err" in records.columns:
        records = records.where("decode_err is null")
    chosen = records.where((F.col("kind") == schema.kind) & (F.col("container") == schema.container) & F.col("namespace").startswith(schema.namespace_prefix))
    items = expand(chosen, schema.each)
    kept = F.lit(True)
    for rule in schema.require:
        kept = kept & condition(F.col("value") if rule["path"][0] == "^" else F.col("item"), rule)
    out = items.withColumn("kept", kept)
    for name, rule in schema.fields.items():
        shape = {"sent_at": "time", "sent_by_me": "flag"}.get(name, "text")
        told = [first_at(F.col("value") if p[0] == "^" else F.col("item"), p) for p in rule.paths]
        if shape == "time":
            out = out.withColumn(name, F.coalesce(*(read_time(v, rule.transform) for v in told), F.lit(None).cast("timestamp")))
        elif shape == "flag":
            out = out.withColumn(name, functools.reduce(lambda a, b: a | b, (read_flag(v, rule) for v in told), F.lit(False)))
        else:
            text = _ruled(rule, F.col("item"), F.col("value"))
            if rule.lookup:
                wanted = scalar(F.col("item"), rule.lookup["key_path"]) if "key_path" in rule.lookup else F.col(rule.lookup["key_field"])
                out = out.withColumn("_match", wanted).join(lookup_table(records, rule.lookup).withColumnRenamed("match", "_match"), "_match", "left")
                out = out.withColumn(name, F.coalesce(text, "found", F.lit(rule.default))).drop("found", "_match")
            else:
                out = out.withColumn(name, F.coalesce(text, F.lit(rule.default)))
        if rule.required or name in REQUIRED:
            blank = F.col(name).isNull() if shape == "time" else (F.coalesce(F.col(name), F.lit("")) == "")
            out = out.withColumn("kept", F.col("kept") & ~blank)
    return out.withColumn("uid", X.stable_id(F.lit(schema.source), F.col("conversation_id"), F.col("message_id"))).withColumn("source", F.lit(schema.source))


def tally(records: DataFrame, mapped: DataFrame, schema: Schema) -> DataFrame:
    """One row: records, those of the schema's store, items, kept."""
    there = records.agg(F.count("*").alias("records"), F.count_if((F.col("kind") == schema.kind) & (F.col("container") == schema.container)).alias("in_store"))
    return there.join(mapped.agg(F.count("*").alias("items"), F.count_if("kept").alias("kept")))


def _paths(bodies: pa.Array) -> pa.Array:
    import json

    def mask(key: str) -> str:
        if re.search(r"[ \t\n]", key):
            return "<text>"
        data = re.fullmatch(r"\d+|[0-9a-fA-F]{16,}", key) or re.search(r"[@:/]|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", key) or len(key.encode()) > 32
        return "<id>" if data else key

    def walk(value: Any, path: str, depth: int, out: set[tuple[str, str]]) -> None:
        kind = {dict: "object", list: "array", str: "string", bool: "bool", int: "number", float: "number"}.get(type(value), "null")
        tag = next(iter(value), "") if isinstance(value, dict) and len(value) == 1 else ""
        if tag in ("$date", "$bigint", "$map", "$set"):
            out.add((path, tag[1:]))
            for inner in value[tag] if depth < DEPTH and tag in ("$map", "$set") and isinstance(value[tag], list) else ():
                walk(inner[1] if tag == "$map" and isinstance(inner, list) and len(inner) > 1 else inner, path + ("{}" if tag == "$map" else "<>"), depth + 1, out)
            return
        out.add((path, kind))
        if depth < DEPTH and isinstance(value, dict):
            for key, inner in value.items():
                walk(inner, f"{path}.{mask(key)}", depth + 1, out)
        elif depth < DEPTH and isinstance(value, list):
            for inner in value:
                walk(inner, f"{path}[]", depth + 1, out)

    rows = []
    for body in bodies.to_pylist():
        found: set[tuple[str, str]] = set()
        try:
            walk(json.loads(body) if body else None, "$", 0, found)
        except ValueError:
            found = set()
        rows.append([{"path": p, "kind": k} for p, k in sorted(found)])
    return pa.array(rows, type=pa.list_(pa.struct([("path", pa.string()), ("kind", pa.string())])))


def shape_profile(records: DataFrame, store: str, body: str) -> DataFrame:
    """store, path, kind, n: in how many records every masked path has every kind."""
    paths = arrow_column(_paths, T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("kind", T.StringType())])), body)
    return records.select(F.col(store).alias("store"), F.explode(paths).alias("p")).groupBy("store", "p.path", "p.kind").agg(F.count("*").alias("n"))


def shape_drift(before: DataFrame, now: DataFrame) -> DataFrame:
    """store, path, drift: paths missing now, or whose kinds have nothing in common with before."""
    kinds = lambda p, name: p.groupBy("store", "path").agg(F.sort_array(F.collect_set("kind")).alias(name))
    both = kinds(before, "old").join(kinds(now, "new"), ["store", "path"], "left")
    return both.where(F.col("new").isNull() | ~F.arrays_overlap("old", "new")).select("store", "path", F.when(F.col("new").isNull(), "missing").otherwise("changed").alias("drift"))


def compare_schemas(a: DataFrame, b: DataFrame, accept: float = 0.9) -> DataFrame:
    """One row: identities of two mappings, how many they share, and whether the second may replace the first."""
    left, right = a.select("uid").distinct(), b.select("uid").distinct().withColumn("other", F.lit(1))
    counted = left.withColumn("one", F.lit(1)).join(right, "uid", "full").agg(F.count("one").alias("n_a"), F.count("other").alias("n_b"), F.count_if(F.col("one").isNotNull() & F.col("other").isNotNull()).alias("shared"))
    return counted.withColumn("accepted", F.when(F.col("n_a") > 0, F.col("shared") / F.col("n_a") >= accept).otherwise(False))


def uid_changes(old: DataFrame, new: DataFrame, item: str = "seq") -> DataFrame:
    """old_uid, new_uid of items that both mappings read but name differently."""
    met = old.select(item, F.col("uid").alias("old_uid")).join(new.select(item, F.col("uid").alias("new_uid")), item)
    return met.where("old_uid <> new_uid").select("old_uid", "new_uid").distinct()
