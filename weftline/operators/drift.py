"""Schemas that drift between files (problem 3): what changed from file to file, and one table of all files.

Bodies are compared as trees by a keyed edit distance: children of an object are told apart by their keys, and the same key
in both is the same child. What is left over in an object is paired at least cost: a key gone and a key come with equal
values are a rename, and so are two with objects that keep a key, if that costs less than removing one and adding the other. Subtrees removed
from one object and added equal in another are moved. Costs: a node added or removed 1, a rename 1, a move 1 (2 with
another key), a change of kind 1 and the nodes below. A value changed below a renamed key counts 1 in choosing pairs, as
it makes the rename less likely, but is no change of shape. Elements of arrays are not compared, only their kinds.

The report of changes (`p3_found`) is a projection of the script: it knows renames of equal subtrees only, so others, and
moves, are `removed` and `added` there.

The scripts of a series are compiled into a projection of its files: renames and moves link paths, and linked paths get
the one of them that most files of the same schema name have. Values whose kind differs between files get a common one.

Files of one series follow each other by `saved_at`. The files are sorted over all partitions by series and time, each
partition compares neighbours, and only the first and last file of each partition meet again. So a series that is a third
of all rows is spread like any other.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.arrow import arrow_column
from weftline.plans.lineage import cut
from weftline.plans.sizes import small_side
from weftline.sources.tables import table

_INVALID = object()


def _no_constant(name: str) -> None:
    raise ValueError(name)


def parse(body: str | None) -> Any:
    """The JSON value of a body, or `_INVALID`. NaN and Infinity are no JSON."""
    if not body:
        return _INVALID
    try:
        return json.loads(body, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return _INVALID


def kind(value: Any) -> str:
    """The JSON kind of a value."""
    if isinstance(value, bool):
        return "boolean"
    return {dict: "object", list: "array", str: "string", int: "number", float: "number"}.get(type(value), "null")


def canonical(value: Any) -> Any:
    """A hashable form in which equal JSON values are equal: key order, null-valued keys and 1 against 1.0 don't matter."""
    if isinstance(value, dict):
        return ("object", frozenset((k, canonical(v)) for k, v in value.items() if v is not None))
    if isinstance(value, list):
        return ("array", tuple(canonical(v) for v in value))
    return (kind(value), value)


def size(value: Any) -> int:
    """Nodes of a subtree."""
    if isinstance(value, dict):
        return 1 + sum(size(v) for v in value.values() if v is not None)
    return 1


def _likeness(a: str, b: str) -> int:
    """Common characters at both ends of two keys, to pair renames when several values are equal."""
    a, b = a.lower(), b.lower()
    front = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    back = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    return min(front + back, len(a), len(b))


def best_pairs(gains: dict[tuple[str, str], int]) -> dict[str, str]:
    """Pairs of two sides, each used once, of the greatest total gain: found by augmenting paths of greatest gain."""
    beside: dict[str, list[str]] = {}
    for left, right in gains:
        beside.setdefault(left, []).append(right)
    of: dict[str, str] = {}  # right: its left
    while True:
        held = set(of.values())
        best = {left: (0, None) for left in beside if left not in held}
        reached: dict[str, tuple[int, str]] = {}
        queue = list(best)
        while queue:
            left = queue.pop(0)
            for right in beside[left]:
                gain = best[left][0] + gains[left, right]
                if of.get(right) != left and (right not in reached or gain > reached[right][0]):
                    reached[right] = (gain, left)
                    back = of.get(right)
                    if back is not None and (back not in best or gain - gains[back, right] > best[back][0]):
                        best[back] = (gain - gains[back, right], right)
                        queue.append(back)
        ends = [(gain, right) for right, (gain, _) in reached.items() if right not in of]
        gain, right = max(ends, key=lambda e: e[0], default=(0, None))
        if gain <= 0:
            return {left: right for right, left in of.items()}
        while right is not None:
            left = reached[right][1]
            before = best[left][1]
            of[right] = left
            right = before


class Comparison:
    """Two JSON values compared: the edit script of least cost, and the report of changes."""

    def __init__(self, old: Any, new: Any):
        self.canon: dict[int, Any] = {}
        self.sizes: dict[int, int] = {}
        self.distances: dict[tuple[int, int], int] = {}
        self.script: list[list] = []
        self.report: list[tuple[str, str]] = []
        self.gone: list[tuple[str, Any, list]] = []
        self.come: list[tuple[str, Any, list]] = []
        self.compare(old, new, "", "", True)
        self.move()

    def form(self, value: Any) -> Any:
        if id(value) not in self.canon:
            self.canon[id(value)] = canonical(value)
        return self.canon[id(value)]

    def size(self, value: Any) -> int:
        if id(value) not in self.sizes:
            self.sizes[id(value)] = size(value)
        return self.sizes[id(value)]

    def distance(self, a: Any, b: Any) -> int:
        """Cost of making one value of the other, changed values included."""
        known = self.distances.get((id(a), id(b)))
        if known is None:
            known = self.distances[id(a), id(b)] = self._distance(a, b)
        return known

    def _distance(self, a: Any, b: Any) -> int:
        if kind(a) != kind(b):
            return self.size(a) + self.size(b) - 1
        if not isinstance(a, dict):
            return int(self.form(a) != self.form(b))
        a, b = _keyed(a), _keyed(b)
        gone, come = [k for k in a if k not in b], [k for k in b if k not in a]
        pairs = self.pairs(a, b, gone, come)
        cost = sum(self.distance(a[k], b[k]) for k in a if k in b) + sum(1 + self.distance(a[g], b[c]) for g, c in pairs.items())
        return cost + sum(self.size(a[k]) for k in gone if k not in pairs) + sum(self.size(b[k]) for k in set(come) - set(pairs.values()))

    def pairs(self, a: dict, b: dict, gone: list[str], come: list[str]) -> dict[str, str]:
        """Keys gone and come of one object that are a rename."""
        if not gone or not come:
            return {}
        pairs: dict[str, str] = {}
        same: dict[Any, tuple[list[str], list[str]]] = {}
        for i, (keys, values) in enumerate(((gone, a), (come, b))):
            for key in keys:
                same.setdefault(self.form(values[key]), ([], []))[i].append(key)
        for left, right in same.values():
            taken: set[str] = set()
            for *_, g, c in sorted((-_likeness(g, c), i, j, g, c) for i, g in enumerate(left) for j, c in enumerate(right)):
                if g not in pairs and c not in taken:
                    pairs[g] = c
                    taken.add(c)
        taken = set(pairs.values())
        # an object that keeps a key may be the same under another name
        by_key: dict[str, list[str]] = {}
        for c in come:
            if c not in taken and isinstance(b[c], dict):
                for key in _keyed(b[c]):
                    by_key.setdefault(key, []).append(c)
        gains: dict[tuple[str, str], int] = {}
        for g in gone:
            if g not in pairs and isinstance(a[g], dict):
                for c in dict.fromkeys(c for key in _keyed(a[g]) for c in by_key.get(key, ())):
                    gain = self.size(a[g]) + self.size(b[c]) - 1 - self.distance(a[g], b[c])
                    if gain > 0:
                        gains[g, c] = gain
        return pairs | best_pairs(gains)

    def compare(self, a: Any, b: Any, path: str, new_path: str, listed: bool) -> None:
        """One value that is the same child in both; `listed`: no key above it was renamed with changes below."""
        if kind(a) != kind(b):
            self.script.append([path, "retyped", new_path if new_path != path else None, self.size(a) + self.size(b) - 1])
            if listed:
                self.report.append((path, "retyped"))
        elif isinstance(a, dict):
            self.objects(_keyed(a), _keyed(b), f"{path}." if path else "", f"{new_path}." if new_path else "", listed)
        elif isinstance(a, list):
            kinds = [{kind(v) for v in x if v is not None} for x in (a, b)]
            if all(kinds) and kinds[0] != kinds[1]:
                self.script.append([f"{path}[]", "retyped", f"{new_path}[]" if new_path != path else None, 1])
                if listed:
                    self.report.append((f"{path}[]", "retyped"))

    def objects(self, a: dict, b: dict, under: str, new_under: str, listed: bool) -> None:
        gone, come = [k for k in a if k not in b], [k for k in b if k not in a]
        pairs = self.pairs(a, b, gone, come)
        exact = {g for g, c in pairs.items() if self.form(a[g]) == self.form(b[c])}
        for key in a:
            path = under + key
            if key in b:
                self.compare(a[key], b[key], path, new_under + key, listed)
            elif key in pairs:
                self.script.append([path, "renamed", new_under + pairs[key], 1])
                if key not in exact:
                    self.compare(a[key], b[pairs[key]], path, new_under + pairs[key], False)
                if listed:
                    self.report += [(path, "renamed")] if key in exact else [(path, "removed"), (under + pairs[key], "added")]
            else:
                self.script.append([path, "removed", None, self.size(a[key])])
                self.gone.append((path, a[key], self.script[-1]))
                if listed:
                    self.report.append((path, "removed"))
        renamed = set(pairs.values())
        for key in come:
            if key not in renamed:
                path = new_under + key
                self.script.append([path, "added", None, self.size(b[key])])
                self.come.append((path, b[key], self.script[-1]))
                if listed:
                    self.report.append((path, "added"))

    def move(self) -> None:
        """Subtrees removed here and added equal there become moves, the largest first."""
        if not self.gone or not self.come:
            return
        places: dict[Any, tuple[list, list]] = {}
        for i, side in enumerate((self.gone, self.come)):
            for path, value, entry in side:
                self._places(path, value, entry, i, (), places)
        both = [x for x in places.items() if x[1][0] and x[1][1]]
        used: tuple[set[str], set[str]] = (set(), set())
        for _, (old, new) in sorted(both, key=lambda x: -x[1][0][0][2]):
            steps = ((_last(o[0]) != _last(n[0]), -_likeness(o[0], n[0]), o, n) for o in old for n in new)
            for other_key, _, o, n in sorted(steps, key=lambda s: s[:2] + (s[2][0], s[3][0])):
                cost = 1 + other_key
                if cost < 2 * o[2] and not any({x[0], *x[3]} & used[i] for i, x in enumerate((o, n))):
                    for i, x in enumerate((o, n)):
                        used[i].add(x[0])
                        x[1][3] -= x[2]
                    self.script.append([o[0], "moved", n[0], cost])
        self.script = [entry for entry in self.script if entry[3] > 0]

    def _places(self, path: str, value: Any, entry: list, side: int, above: tuple[str, ...], out: dict) -> None:
        if isinstance(value, (dict, list)) and value:
            out.setdefault(self.form(value), ([], []))[side].append((path, entry, self.size(value), above))
        if isinstance(value, dict):
            for key, inner in _keyed(value).items():
                self._places(f"{path}.{key}", inner, entry, side, (*above, path), out)


def _keyed(value: dict) -> dict:
    """An object without its null values."""
    return {k: v for k, v in value.items() if v is not None}


def _last(path: str) -> str:
    return path.rpartition(".")[2]


def edit_script(old: Any, new: Any) -> list[tuple[str, str, str | None, int]]:
    """(path, change, new path, cost) of least total cost from one value to another: renamed, removed, added, retyped, moved."""
    return [tuple(entry) for entry in Comparison(old, new).script]


def reported(old: Any, new: Any) -> list[tuple[str, str]]:
    """(path, change) as the report has them."""
    return Comparison(old, new).report


def _entries(old: Any, new: Any) -> list[tuple[str, str, str | None, int | None]]:
    """The script, and the report as entries without a cost."""
    found = Comparison(old, new)
    return [*map(tuple, found.script), *((path, change, None, None) for path, change in found.report)]


CHANGES = "series string, file_id long, path string, change string, new_path string, cost int"
_SCRIPT = pa.list_(pa.struct([("path", pa.string()), ("change", pa.string()), ("new_path", pa.string()), ("cost", pa.int32())]))


def _script_of(pairs: pa.Array) -> pa.Array:
    out = []
    for old, new in zip(*(pairs.field(i).to_pylist() for i in range(2))):
        out.append([dict(zip(("path", "change", "new_path", "cost"), c)) for c in _entries(parse(old), parse(new))])
    return pa.array(out, type=_SCRIPT)


def series() -> Column:
    """The series of a file: its profile and schema name."""
    return F.to_json(F.struct(F.col("profile"), F.col("schema_name")), {"ignoreNullFields": "false"})


def scripts(files: DataFrame) -> DataFrame:
    """series, file_id, path, change, new_path, cost: the edit script from the file before in its series to each file. See `compared`."""
    return compared(files).where("cost is not null")


def changes(files: DataFrame) -> DataFrame:
    """file_id, path, change: the report of changes between each file and the one before in its series. See `compared`."""
    return compared(files).where("cost is null").select("file_id", "path", "change")


def compared(files: DataFrame) -> DataFrame:
    """series, file_id, path, change, new_path, cost: scripts, and the report of changes as rows without a cost.

    `files` has file_id, profile, schema_name, saved_at, body. Bodies that are null, empty or no JSON are skipped as if not
    saved. A null profile or schema name is a value of its own. Files saved at the same time follow by file_id; a null time
    comes first. A file saved again unchanged has no change. Very long bodies are parsed whole. An empty table gives no rows.
    """
    keyed = files.select(series().alias("series"), F.col("saved_at").cast("timestamp").alias("saved_at"), "file_id", "body").where(F.length("body") > 0)
    ordered = keyed.repartitionByRange("series", F.col("saved_at").asc_nulls_first(), "file_id").sortWithinPartitions("series", F.col("saved_at").asc_nulls_first(), "file_id")
    both = cut(ordered.mapInArrow(_tagged, f"{CHANGES}, saved_at timestamp, side int, body string"))
    inner = both.where("side is null").select("series", "file_id", "path", "change", "new_path", "cost")
    edges = both.where("side is not null").select("series", "saved_at", "file_id", "side", "body")
    # at most two rows a partition: the last of one and the first of the next are neighbours too
    by_time = Window.partitionBy("series").orderBy(F.col("saved_at").asc_nulls_first(), "file_id", "side")
    joints = edges.withColumn("before", F.lag("body").over(by_time)).where("side = 0 and before is not null")
    script = arrow_column(_script_of, T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("change", T.StringType()), T.StructField("new_path", T.StringType()), T.StructField("cost", T.IntegerType())])), F.struct("before", "body"))
    return inner.unionByName(joints.select("series", "file_id", F.explode(script).alias("c")).select("series", "file_id", "c.path", "c.change", "c.new_path", "c.cost"))


def _tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over a sorted partition: scripts of its neighbours (side null), and its first and last file (side 0, 1)."""
    names = ["series", "file_id", "path", "change", "new_path", "cost", "saved_at", "side", "body"]
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.timestamp("us", tz="UTC"), pa.int32(), pa.string())

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=names)

    first, last = None, None
    for batch in batches:
        out = []
        for series, at, file_id, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
            value = parse(body)
            if value is _INVALID:
                continue
            if first is None:
                first = (series, file_id, None, None, None, None, at, 0, body)
            elif series == last[0]:
                out += [(series, file_id, *change, None, None, None) for change in _entries(last[1], value)]
            last = (series, value, at, file_id, body)
        if out:
            yield rows(out)
    if first is not None:
        yield rows([first, (last[0], last[3], None, None, None, None, last[2], 1, last[4])])


def canonical_paths(files: DataFrame, script: DataFrame) -> DataFrame:
    """series, path, common: paths that a series renamed or moved, with the path that stands for all those linked with it.

    That is the one that most files of the same schema name have, of whatever profile: so series that drifted apart agree.
    """
    linked = script.where("new_path is not null and change in ('renamed', 'moved')").select("series", F.col("path").alias("a"), F.col("new_path").alias("b")).distinct()
    both = cut(linked.unionByName(linked.select("series", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    held = arrow_column(_paths, T.ArrayType(T.StringType()), "body")
    counts = files.where(F.length("body") > 0).select("schema_name", F.explode(held).alias("path")).groupBy("schema_name", "path").agg(F.count("*").alias("n"))
    named = files.select(series().alias("series"), "schema_name").distinct()
    paths = both.select("series", F.col("a").alias("path")).distinct().join(named, "series")
    met = paths.join(counts.withColumnRenamed("schema_name", "_name"), (paths["path"] == counts["path"]) & paths["schema_name"].eqNullSafe(F.col("_name")), "left")
    ranked = cut(met.select("series", paths["path"], F.struct(F.coalesce("n", F.lit(0)).alias("n"), paths["path"].alias("path")).alias("rank")))
    # the greatest rank among all that are linked: each round looks one link further for those that still grow
    while True:
        near = both.join(ranked.select("series", F.col("path").alias("b"), F.col("rank").alias("there")), ["series", "b"]).groupBy("series", F.col("a").alias("path")).agg(F.max("there").alias("there"))
        grown = ranked.join(near, ["series", "path"]).select("series", "path", F.greatest("rank", "there").alias("rank"), (F.col("there") > F.col("rank")).alias("grew"))
        # a jump besides: what the path named now already knows
        known = grown.select("series", F.col("path").alias("named"), F.col("rank").alias("further"))
        ahead = grown.withColumn("named", F.col("rank.path")).join(known, ["series", "named"], "left")
        ranked = cut(ahead.select("series", "path", F.greatest("rank", F.coalesce("further", "rank")).alias("rank"), (F.col("grew") | (F.coalesce("further", "rank") > F.col("rank"))).alias("grew")))
        if ranked.where("grew").isEmpty():
            return ranked.select("series", "path", F.col("rank.path").alias("common")).where("path <> common")
        ranked = ranked.drop("grew")


def _inner_paths(value: Any, path: str, out: list[str]) -> None:
    for key, inner in value.items():
        if inner is not None:
            out.append(f"{path}{key}")
            if isinstance(inner, dict):
                _inner_paths(inner, f"{path}{key}.", out)


def _paths(bodies: pa.Array) -> pa.Array:
    out = []
    for body in bodies.to_pylist():
        value, paths = parse(body), []
        if isinstance(value, dict):
            _inner_paths(value, "", paths)
        out.append(paths)
    return pa.array(out, type=pa.list_(pa.string()))


def _common(path: str, mapping: dict[str, str], known: dict[str, str]) -> str:
    """The common name of a path: that of the path itself below the common name of what holds it."""
    if path not in known:
        known[path] = path  # paths that were moved into each other end here
        named = mapping.get(path, path)
        head, dot, last = named.rpartition(".")
        named = f"{_common(head, mapping, known)}.{last}" if dot else named
        known[path] = mapping.get(named, named)
    return known[path]


def _flat(value: Any, mapping: dict[str, str], known: dict[str, str]) -> list[tuple[str, str, str]]:
    """(common path, kind, JSON text) of the leaves and arrays of an object; a path's own value comes before one renamed to it."""
    flat: list[tuple[str, str, str, str]] = []

    def walk(node: dict, under: str) -> None:
        for key, inner in node.items():
            if isinstance(inner, dict) and inner:
                walk(inner, f"{under}{key}.")
            elif inner is not None:
                flat.append((_common(under + key, mapping, known), under + key, kind(inner), json.dumps(inner, ensure_ascii=False, sort_keys=True)))

    walk(value, "")
    out: dict[str, tuple[str, str]] = {}
    for target, here, of_kind, text in sorted(flat, key=lambda f: f[0] != f[1]):
        out[here if target in out else target] = (of_kind, text)
    return [(path, *found) for path, found in out.items()]


_LEAF = pa.list_(pa.struct([("path", pa.string()), ("kind", pa.string()), ("text", pa.string())]))


def _leaves(bodies: pa.Array, renames: pa.Array) -> pa.Array:
    out: list[list[dict] | None] = []
    tables: dict[tuple, tuple[dict[str, str], dict[str, str]]] = {}
    for body, renamed in zip(bodies.to_pylist(), renames.to_pylist()):
        value = parse(body)
        if not isinstance(value, dict):
            out.append(None)
            continue
        mapping, known = tables.setdefault(tuple(renamed or ()), (dict(renamed or ()), {}))
        out.append([dict(zip(("path", "kind", "text"), leaf)) for leaf in _flat(value, mapping, known)])
    return pa.array(out, type=_LEAF)


def common_kind(kinds: Column) -> Column:
    """The kind that all of several can be written as: an array of what isn't one, else a string; `json` with objects, which stay as they are."""
    has = lambda name: F.array_contains(kinds, F.lit(name))
    return F.when(F.size(kinds) == 1, kinds[0]).when(has("object"), "json").when(has("array"), "array").otherwise("string")


def consistent(files: DataFrame, script: DataFrame) -> DataFrame:
    """Every file with `fields`, its values as JSON text under paths, and of kinds, that are the same in all files of a schema name.

    Renames and moves of a series hold for its own files alone. Invalid bodies have null fields; the row stays. Two values
    that claim one path keep the path's own and the other's old one. Where the kinds of a path differ between files, scalars
    become strings, and single values arrays of one; objects stay as they are.
    """
    renamed = canonical_paths(files, script).groupBy("series").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "common")))).alias("_renames"))
    leaf = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "kind", "text")])
    keyed = files.withColumn("_series", series()).join(small_side(cut(renamed.withColumnRenamed("series", "_series"))), "_series", "left")
    flat = cut(keyed.withColumn("_leaves", arrow_column(_leaves, T.ArrayType(leaf), "body", "_renames")).drop("body", "_renames", "_series"))
    kinds = flat.select("schema_name", F.explode("_leaves").alias("l")).groupBy("schema_name", "l.path").agg(F.array_sort(F.collect_set("l.kind")).alias("kinds")).where(F.size("kinds") > 1)
    # only paths of several kinds are looked up: few, and none of them is a row of the files
    mixed = kinds.select("schema_name", F.struct("path", common_kind(F.col("kinds")).alias("kind")).alias("e")).groupBy(F.col("schema_name").alias("_name")).agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("_kinds"))
    mixed = small_side(cut(mixed))
    wanted = lambda l: F.try_element_at("_kinds", l["path"])
    text = lambda l: (
        F.when((wanted(l) == "array") & (l["kind"] != "array"), F.concat(F.lit("["), l["text"], F.lit("]")))
        .when((wanted(l) == "string") & (l["kind"] != "string"), F.concat(F.lit('"'), l["text"], F.lit('"'))).otherwise(l["text"])
    )
    met = flat.join(mixed, flat["schema_name"].eqNullSafe(mixed["_name"]), "left")
    return met.withColumn("fields", F.map_from_entries(F.transform("_leaves", lambda l: F.struct(l["path"], text(l))))).drop("_leaves", "_kinds", "_name")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "schema_files")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(_files(spark, sf_dir))


def p3_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts(_files(spark, sf_dir)).select("file_id", "path", "change", "new_path", "cost")


def p3_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return consistent(files, scripts(files))
