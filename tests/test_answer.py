"""Retrieval from question to evidence, models plugged in, and saved schemas."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import answer
from weftline.operators import search as R
from weftline.plans.schemas import SchemaStore

NOW = datetime(2026, 9, 26, tzinfo=UTC)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        (0, "git", "corrige o lote atrasado HORTA-26", [1.0, 0.0]), (1, "git", "corrige o lote atrasado HORTA-26", [1.0, 0.0]), (2, "browser", "planilha de custos", [0.9, 0.1]), (3, "browser", "outra coisa HORTA-62", [0.0, 1.0]),
        (4, "teams", "ok valeu", [1.0, 0.0]), (5, "file", "commit 3c9d01f do lote", [0.2, 0.8]),
    ]
    unit = [(i, s, t, [float(x) for x in np.array(v) / np.linalg.norm(v)]) for i, s, t, v in rows]
    events = spark.createDataFrame([(i, s, NOW + timedelta(minutes=i), t, {"sender": "Ana"}) for i, s, t, _ in unit], "record_id long, source string, occurred_at timestamp, content string, metadata map<string,string>")
    chunks = spark.createDataFrame([(i, i, t, v) for i, _, t, v in unit], "chunk_id long, record_id long, text string, embedding array<double>")
    return events, chunks


def ranks(hits):
    return [r["record_id"] for r in hits.orderBy("rank").collect()]


def test_hybrid_drops_chatter_and_repeats(corpus):
    found = ranks(answer.retrieve("lote atrasado", corpus[1], corpus[0], [1.0, 0.0], top_k=3))
    assert found[0] == 0 and 1 not in found and 4 not in found


def test_identifiers_skip_gates(corpus):
    assert ranks(answer.retrieve("o que foi o HORTA-62?", corpus[1], corpus[0], [1.0, 0.0])) == [3]
    assert ranks(answer.retrieve("o que foi o commit 3c9d01f?", corpus[1], corpus[0], [1.0, 0.0])) == [5]


def test_gates_reject_far_questions_unless_scoped(corpus):
    far = [-1.0, 0.0]
    assert ranks(answer.retrieve("assunto nenhum", corpus[1], corpus[0], far, mode="vector")) == []
    assert ranks(answer.retrieve("assunto nenhum", corpus[1], corpus[0], far, scoped=True, mode="vector"))


def test_neighbours_follow_a_cue(corpus):
    assert set(ranks(answer.retrieve("o que houve depois da planilha de custos", corpus[1], corpus[0], [0.9, 0.1], top_k=1))) > {2}


@pytest.mark.parametrize("mode", answer.MODES)
def test_modes(corpus, mode):
    assert ranks(answer.retrieve("planilha custos", corpus[1], corpus[0], [0.99, 0.1], top_k=2, mode=mode))
    with pytest.raises(ValueError, match="mode"):
        answer.rank_for("x", corpus[1], [1.0, 0.0], 1, "other")


def test_answers_cite_what_was_shown(corpus):
    hits = answer.retrieve("lote atrasado", corpus[1], corpus[0], [1.0, 0.0], top_k=2)
    reply, cited, notes = answer.answer("lote?", hits, lambda prompt: "veja [1] e [7]" if "[1]" in prompt else "")
    assert reply == "veja [1] e [7]" and cited == [1] and len(notes) <= 2
    assert answer.answer("lote?", hits)[0] == ""


def test_equal_texts_meet_the_model_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def model(texts):
        seen.add(len(texts))
        return np.array([[len(t)] for t in texts])

    rows = spark.createDataFrame([(i, "abc" if i % 2 else "de") for i in range(10)], "id long, text string")
    assert sorted({(r["text"], r["embedding"][0]) for r in answer.embedded(rows, model).collect()}) == [("abc", 3.0), ("de", 2.0)] and seen.value == 2


def test_names_that_leave_nothing_are_dropped(spark):
    chunks = spark.createDataFrame([("file", "1", "projeto do Órion"), ("file", "2", "Ana")], "source string, content_hash string, text string")
    assert answer.appearing_names(chunks, ["Órion", "Ana", "projeto"]) == ["Órion", "projeto"]


def test_phrases_and_prefixes(spark):
    texts = spark.createDataFrame([(1, "o pull request 318 abriu"), (2, "request pull 318"), (3, "3c9d01fa commit")], "id long, text string")
    index, corpus = R.postings(texts, "id")
    assert [r[0] for r in R.phrase(index, ["pull", "request", "318"], "id").collect()] == [1]
    assert [r[0] for r in R.phrase(index, ["3c9d01f*"], "id").collect()] == [3] and corpus.first()["n"] == 3
    assert R.identifier_terms("a mudança 3c9d01f veio do MR 12 de HORTA-26?") == [["horta", "26"], ["3c9d01f*"], ["pull", "request", "12"], ["merge", "request", "12"], ["pr", "12"]]


def test_schema_store(tmp_path):
    body = lambda n: {"version": 2, "target": "message/1", "name": "x", "revision": n, "records": {}, "fields": {f: {"paths": ["$.a"]} for f in ("message_id", "conversation_id", "sent_at")}}
    store = SchemaStore(tmp_path)
    for n in (1, 2):
        store.save(body(n))
    store.propose(body(3))
    assert store.history("x") == [1] and store.accept("x").revision == 3 and store.history("x") == [1, 2]
    assert store.rollback("x").revision == 2 and store.current("x")["revision"] == 2
    with pytest.raises(ValueError):
        SchemaStore(tmp_path / "y").rollback("x")


def test_pages_and_scope(spark):
    rows = spark.createDataFrame([(1, "um\f \fdois"), (2, "sem páginas"), (3, None)], "record_id long, content string")
    assert [(r["page"], r["state"]) for r in answer.pages(rows).orderBy("page").collect()] == [(1, "read"), (2, "pending"), (3, "read")]
    assert spark.range(1).select(answer.in_scope(F.lit("https://a.b/x"), ["https://*.b/*"]), answer.in_scope(F.lit("https://a.c/x"), ["https://*.b/*"])).first()[:] == (True, False)


def test_a_stored_index_reads_what_a_fresh_one_does(spark, tmp_path):
    texts = spark.createDataFrame([(i, " ".join(f"w{i * k % 7}" for k in range(i % 5 + 1)) + " lote") for i in range(40)], "id long, text string")
    fresh, corpus = R.postings(texts, "id")
    stored = R.KeywordIndex.build(texts, str(tmp_path / "index"), "id")
    terms = ["w1", "w3", "lote"]
    scores = lambda index, c: {r["id"]: round(r["score"], 9) for r in R.bm25(index, c, terms, "id").collect()}
    assert scores(stored.postings(terms), stored.corpus()) == scores(fresh, corpus)
    assert {r["term"] for r in stored.postings(["w*"]).collect()} == {f"w{i}" for i in range(7)} and stored.postings([]).count() == 0


def test_nearest_of_each_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (300, 4)).astype(float)  # many ties
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(7)
    found = {}
    for r in R.nearest_of_each(rows, rows.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding"), 6).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in range(0, 300, 20):
        order = sorted(range(300), key=lambda i: (1.0 - vectors[q] @ vectors[i], i))[:6]
        assert [i for _, i in sorted(found[q])] == order


def test_not_found_is_no_answer(corpus):
    hits = answer.retrieve("lote atrasado", corpus[1], corpus[0], [1.0, 0.0], top_k=2)
    assert answer.answer("lote?", hits, lambda prompt: " não encontrado nas notas [1]")[:2] == ("", [])
