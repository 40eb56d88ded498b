"""Mixing: shares, caps on repeats, nesting, odd inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import mix, tokenize

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        source = rng.choices(["a", "b", "c", None, "x"], [60, 25, 5, 5, 5])[0]
        rows.append((i, source, " ".join(rng.choice(["lote", "prazo", "é", "42"]) for _ in range(rng.randrange(1, 40)))))
    rows += [(1000, "a", None), (1001, "b", ""), (3, "a", "repetido")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def targets(spark, *rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def shares(report):
    return {r["source"]: r.asDict() for r in report.collect()}


def test_shares_and_caps(spark, docs):
    used, report = mix.mix(docs, targets(spark, ("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 4), ("nothing", 0.1, 3)))
    found = shares(report)
    present = 0.5 + 0.3 + 0.2
    for source, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(found[source]["actual_share"] - share / present) < 0.02
    assert found["nothing"]["used_tokens"] == 0
    most = {r["source"]: r["m"] for r in used.groupBy("source").agg(F.max("uses").alias("m")).collect()}
    assert most["a"] <= 2 and most["b"] <= 1 and most["c"] <= 4
    assert used.where("source is null or source = 'x' or n_tokens = 0").count() == 0


@pytest.mark.parametrize("total", [2_000, 10_000, 1_000_000])
def test_given_totals(spark, docs, total):
    used, report = mix.mix(docs, targets(spark, ("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 1)), total_tokens=total)
    found = shares(report)
    have = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum(tokenize.token_count("text")).alias("n")).collect()}
    caps = {"a": 2 * have["a"], "b": have["b"], "c": have["c"]}
    reached = sum(r["used_tokens"] for r in found.values())
    assert reached <= min(total, sum(caps.values())) and reached >= min(total, sum(caps.values())) - 3 * 60
    assert all(found[s]["used_tokens"] <= caps[s] for s in caps)


def test_larger_budgets_hold_smaller_ones(spark, docs):
    wanted = targets(spark, ("a", 0.6, 1), ("b", 0.4, 1))
    small, large = ({r["doc_id"] for r in mix.mix(docs, wanted, total_tokens=n)[0].collect()} for n in (3_000, 6_000))
    assert small and small < large


def test_edges(spark, docs):
    wanted = targets(spark, ("a", 1.0, 1))
    used, report = mix.mix(docs.limit(0), wanted)
    assert used.count() == 0 and shares(report)["a"]["actual_share"] == 0
    used, report = mix.mix(docs, wanted.limit(0))
    assert used.count() == 0 and report.count() == 0
    clashing = docs.withColumn("uses", F.lit(9)).withColumn("_hash", F.lit(1)).withColumn("n_tokens", F.lit(0))
    assert mix.mix(clashing, wanted)[0].columns == ["doc_id", "source", "n_tokens", "uses"]
    odd = targets(spark, ("a", 0.5, None), ("b", None, 1), (None, 0.2, 1), ("c", 0.5, 0))
    assert {r["source"] for r in mix.mix(docs, odd)[0].select("source").distinct().collect()} <= {"a"}
