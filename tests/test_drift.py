"""Edit scripts between schemas, and series of files."""

from __future__ import annotations

import json
import random
from datetime import UTC, datetime, timedelta

import pytest

from weftline.operators import drift

SCHEMA = "file_id long, profile string, schema_name string, saved_at timestamp, body string"


def changes(old, new):
    return sorted(drift.reported(old, new))


@pytest.mark.parametrize(("old", "new", "expected"), [
    ({"a": 1}, {"a": 2}, []), ({"a": 1}, {"a": "1"}, [("a", "retyped")]), ({"a": 1}, {"a": True}, [("a", "retyped")]), ({"a": 1}, {"b": 1.0}, [("a", "renamed")]),
    ({"a": True}, {"b": 1}, [("a", "removed"), ("b", "added")]), ({"a": {"x": 1, "y": None}}, {"b": {"x": 1.0}}, [("a", "renamed")]), ({"a": None, "b": 1}, {"b": 1}, []),
    ({"f": {"t": {"paths": ["x"]}}}, {"f": {"t": {"paths": [{"p": "x"}]}}}, [("f.t.paths[]", "retyped")]), ({"p": ["x"]}, {"p": []}, []), ({"p": ["x"]}, {"p": {"first": "x"}}, [("p", "retyped")]),
    ({"a": {"b": 1}}, {"c": {"b": 2}}, [("a", "removed"), ("c", "added")]), ({"a": 1}, {"A": 1}, [("a", "renamed")]), ({"k": [1, "a"]}, {"k": ["b", 2.5]}, []), ({}, {}, []),
    ({"a": [], "b": []}, {"c": []}, [("a", "renamed"), ("b", "removed")]),
])
def test_report(old, new, expected):
    assert changes(old, new) == expected


def brute(old, new, path=""):
    """The report as it is defined, written apart: no distance, no pairs but of equal values."""
    def same(a, b):
        strip = lambda v: {k: strip(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else [strip(x) for x in v] if isinstance(v, list) else (drift.kind(v), v)
        return strip(a) == strip(b)

    if drift.kind(old) != drift.kind(new):
        return [(path, "retyped")]
    if isinstance(old, list):
        kinds = [{drift.kind(v) for v in x if v is not None} for x in (old, new)]
        return [(path + "[]", "retyped")] if all(kinds) and kinds[0] != kinds[1] else []
    if not isinstance(old, dict):
        return []
    old, new = ({k: v for k, v in x.items() if v is not None} for x in (old, new))
    join = lambda k: f"{path}.{k}" if path else k
    out = [c for k in old if k in new for c in brute(old[k], new[k], join(k))]
    gone, come = [k for k in old if k not in new], [k for k in new if k not in old]
    for k in list(gone):
        match = next((c for c in come if same(old[k], new[c])), None)
        if match is not None:
            out.append((join(k), "renamed"))
            gone.remove(k)
            come.remove(match)
    return out + [(join(k), "removed") for k in gone] + [(join(k), "added") for k in come]


@pytest.mark.parametrize(("old", "new", "script"), [
    ({"a": {"k": {"z": 1}}, "b": {}}, {"a": {}, "b": {"k": {"z": 1}}}, [("a.k", "moved", "b.k", 1)]),
    ({"a": {"x": {"k": 1}}, "b": {}}, {"a": {}, "b": {"y": {"k": 1}}}, [("a.x", "moved", "b.y", 2)]),
    ({"a": {"k": {"z": 1, "y": 2}, "w": 3}, "b": {}}, {"b": {"n": {"k": {"z": 1, "y": 2}}}}, [("a", "removed", None, 2), ("b.n", "added", None, 1), ("a.k", "moved", "b.n.k", 1)]),
    ({"a": {"x": 1, "y": 2, "z": 3}}, {"c": {"x": 1, "y": 2, "w": 9}}, [("a", "renamed", "c", 1), ("a.z", "removed", None, 1), ("c.w", "added", None, 1)]),
    ({"a": {"x": 1}}, {"a": "x"}, [("a", "retyped", None, 2)]), ({"a": 1}, {"b": 2}, [("a", "removed", None, 1), ("b", "added", None, 1)]),
    ({"f": {"p": ["x"]}, "g": 1}, {"g": 1, "h": {"p": ["x"]}}, [("f", "renamed", "h", 1)]),
])
def test_scripts_of_least_cost(old, new, script):
    assert drift.edit_script(old, new) == script
    assert sorted(drift.reported(old, new)) == sorted(brute(old, new))


def trees(rng, depth=2):
    if depth == 0 or rng.random() < 0.4:
        return rng.choice([1, 2, "x", True, [1], ["x"]])
    return {k: trees(rng, depth - 1) for k in rng.sample("abcdef", rng.randrange(4))}


def cheapest(a, b):
    """Least cost over all pairings of keys gone and come that are allowed: equal values, and objects that keep a key."""
    allowed = lambda x, y: drift.canonical(x) == drift.canonical(y) or (isinstance(x, dict) and isinstance(y, dict) and set(x) & set(y))
    if drift.kind(a) != drift.kind(b):
        return drift.size(a) + drift.size(b) - 1
    if not isinstance(a, dict):
        return int(drift.canonical(a) != drift.canonical(b))
    gone, come = [k for k in a if k not in b], [k for k in b if k not in a]

    def rest(i, left):
        if i == len(gone):
            return sum(drift.size(b[c]) for c in left)
        return min([drift.size(a[gone[i]]) + rest(i + 1, left), *(1 + cheapest(a[gone[i]], b[c]) + rest(i + 1, left - {c}) for c in left if allowed(a[gone[i]], b[c]))])

    return sum(cheapest(a[k], b[k]) for k in a if k in b) + rest(0, frozenset(come))


def test_distance_against_all_pairings():
    rng = random.Random(11)
    for _ in range(400):
        old, new = ({k: trees(rng) for k in rng.sample("abcdef", rng.randrange(1, 5))} for _ in range(2))
        assert drift.Comparison(old, new).distance(old, new) == cheapest(old, new), (old, new)


def test_reports_of_random_trees_and_of_the_test_data(spark, data):
    rng = random.Random(12)
    for _ in range(400):
        old, new = ({k: trees(rng, 3) for k in rng.sample("abcdef", rng.randrange(1, 5))} for _ in range(2))
        count = lambda rows: sorted((p.rpartition(".")[0] if c == "renamed" else p, c) for p, c in rows if c in ("renamed", "retyped"))
        assert count(drift.reported(old, new)) == count(brute(old, new))
    files = spark.read.parquet(f"{data}/schema_files.parquet").collect()
    expected, before = [], {}
    for r in sorted(files, key=lambda r: (r["saved_at"], r["file_id"])):
        value = drift.parse(r["body"])
        if value is not drift._INVALID:
            name = r["profile"], r["schema_name"]
            expected += [(r["file_id"], *c) for c in brute(before[name], value)] if name in before else []
            before[name] = value
    assert sorted(map(tuple, drift.p3_found(spark, data).collect())) == sorted(expected)


def test_best_pairs_against_all():
    from itertools import permutations

    rng = random.Random(13)
    for _ in range(200):
        gains = {(g, c): rng.randrange(1, 9) for g in "abcd" for c in "wxyz" if rng.random() < 0.6}
        found = drift.best_pairs(gains)
        best = max(sum(gains.get(p, 0) for p in zip("abcd", right)) for right in permutations("wxyz"))
        assert sum(gains[p] for p in found.items()) == best and len(set(found.values())) == len(found)


def table(spark, rows):
    files = spark.createDataFrame([(i, p, s, datetime(2026, 1, 1, tzinfo=UTC) + timedelta(minutes=i), json.dumps(b)) for i, (p, s, b) in enumerate(rows)], SCHEMA)
    return {r["file_id"]: {k: json.loads(v) for k, v in (r["fields"] or {}).items()} for r in drift.consistent(files, drift.scripts(files)).collect()}


def test_renames_stay_in_their_series(spark):
    found = table(spark, [("p", "A", {"x": 5}), ("p", "A", {"y": 5}), ("p", "A", {"y": 6}), ("q", "B", {"x": "unrelated"}), ("q", "A", {"x": 7})])
    assert found == {0: {"y": 5}, 1: {"y": 5}, 2: {"y": 6}, 3: {"x": "unrelated"}, 4: {"x": 7}}


def test_long_chains_of_renames_have_one_name(spark):
    found = table(spark, [("p", "A", {f"k{i}": {"v": 1, "w": i}}) for i in range(40)] + [("p", "A", {"k39": {"v": 1, "w": 39}})])
    assert {tuple(sorted(f)) for f in found.values()} == {("k39.v", "k39.w")}


def test_kinds_are_made_one(spark):
    found = table(spark, [("p", "A", {"v": 1, "t": "a", "o": {"x": 1}}), ("q", "A", {"v": "1.5", "t": ["a", "b"], "o": {}}), ("q", "B", {"v": 2, "t": True}), ("p", "A", {"v": True, "t": 3})])
    assert found == {0: {"v": "1", "t": ["a"], "o.x": 1}, 1: {"v": "1.5", "t": ["a", "b"], "o": {}}, 2: {"v": 2, "t": True}, 3: {"v": "true", "t": [3]}}


def test_invalid_json():
    assert all(drift.parse(b) is drift._INVALID for b in (None, "", "  ", '{"a": 1', '{"a": NaN}', "[1,]"))


@pytest.fixture
def files(spark):
    rng = random.Random(3)
    rows, key = [], 0
    for series in range(7):
        body = {"version": 1, "fields": {"text": {"paths": ["$.a"]}}}
        for step in range(120 if series == 0 else rng.randrange(1, 9)):
            key += 1
            shape = rng.randrange(6)
            name = rng.choice(["text", "body", "Text"])
            body = {"version": rng.choice([1, "1", 1.5]), "fields": {name: {rng.choice(["paths", "from"]): ["$.a"] if shape else [{"p": 1}]}}} | ({"extra": step} if shape == 2 else {})
            text = json.dumps(body)
            rows.append((rng.randrange(10**6), None if series == 5 else f"p{series}", "chatgpt", datetime(2026, 1, 1, tzinfo=UTC) + timedelta(minutes=step), text[: len(text) // 2] if shape == 3 else None if shape == 4 and step % 2 else text))
    rng.shuffle(rows)
    return rows


def test_series_in_any_partitioning(spark, files):
    expected, before = [], {}
    for file_id, profile, schema, saved, body in sorted(files, key=lambda r: (str(r[1]), r[2], r[3], r[0])):
        value = drift.parse(body)
        if value is drift._INVALID:
            continue
        if (profile, schema) in before:
            expected += [(file_id, p, c) for p, c in changes(before[profile, schema], value)]
        before[profile, schema] = value
    df = spark.createDataFrame(files, SCHEMA)
    found = [tuple(r) for r in drift.changes(df).collect()]
    assert sorted(found) == sorted(expected)
    table = drift.consistent(df, drift.scripts(df))
    assert table.count() == len(files)
    assert all("body" not in r.asDict() for r in table.take(1))


def test_empty_and_extra_columns(spark, files):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(files, SCHEMA)
    assert drift.scripts(df.limit(0)).count() == 0
    clashing = df.withColumn("series", F.lit("x")).withColumn("path", F.lit(1)).withColumn("side", F.lit(2))
    assert drift.scripts(clashing).count() == drift.scripts(df).count()
    assert drift.consistent(df.limit(0), drift.scripts(df.limit(0))).count() == 0


def test_nulls_and_ties(spark):
    at = datetime(2026, 1, 1, tzinfo=UTC)
    rows = [(2, "p", "s", at, '{"a": 1}'), (1, "p", "s", at, '{"b": 2}'), (3, "p", "s", None, '{"c": 3}'), (None, "p", "s", at, '{"a": 1}'), (4, None, None, None, '{"a": 1}'), (4, None, None, None, '{"a": 1}'), (9, "p", "s", at, "[1]"), (10, "p", "s", at, '"x"')]
    found = drift.scripts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert ("", "retyped", 9) in {(r["path"], r["change"], r["file_id"]) for r in found} and all(r["file_id"] != 3 for r in found)


def test_a_very_long_body(spark):
    body = json.dumps({f"k{i}": list(range(20)) for i in range(20_000)})
    rows = [(1, "p", "s", datetime(2026, 1, 1, tzinfo=UTC), body), (2, "p", "s", datetime(2026, 1, 2, tzinfo=UTC), body.replace("k19999", "z"))]
    assert [(r["path"], r["change"]) for r in drift.scripts(spark.createDataFrame(rows, SCHEMA)).collect()] == [("k19999", "renamed")]
    deep = "[" * 100_000 + "]" * 100_000
    assert drift.scripts(spark.createDataFrame([(1, "p", "s", datetime(2026, 1, 1, tzinfo=UTC), deep)] * 2, SCHEMA)).count() == 0
