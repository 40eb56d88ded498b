"""Grouping of records, the best row, and values chosen by currency."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.llm import survivors

SCHEMA = "record_id long, uid string, source string, occurred_at timestamp, content string, metadata map<string,string>, people array<struct<role:string,name:string>>, exported_at timestamp"
NOW = datetime(2026, 3, 1, 12, tzinfo=UTC)


def row(i, uid, source, metadata, content="palavras de uma mensagem comprida", seconds=0.0, people=None, at=True):
    return (i, uid, source, NOW + timedelta(seconds=seconds) if at else None, content, metadata, people, NOW + timedelta(days=1))


def said(mid="", text="", **more):
    return {"message_id": mid, "conversation": "Sala", "sender": "Ana", "text": text} | more


@pytest.fixture
def told(spark):
    def grouped(*rows):
        df = spark.createDataFrame(list(rows), SCHEMA)
        by = {}
        for r in survivors.groups(df).collect():
            by.setdefault(bytes(r["activity"]), set()).add(r["record_id"])
        return sorted(map(sorted, by.values()))

    return grouped


def test_identities(told):
    full = "ab" * 20
    assert told(
        row(1, "a", "git", {"hash": full}), row(2, "b", "git", {"hash": full[:10]}), row(3, "c", "git", {"hash": "cd" * 20}),
        row(4, "d", "file", {"path": "C:\\Dados\\x.txt"}), row(5, "e", "file", {"path": "c:/Dados//x.txt"}), row(6, "f", "file", {"path": "/Dados/x.txt"}),
        row(7, "g", "browser", {"url": "https://a.example/p#top"}), row(8, "h", "browser", {"url": "https://a.example/p"}), row(9, "i", "browser", {"url": "https://a.example/p"}, seconds=1),
        row(10, "j", "teams", said("m1")), row(11, "k", "teams", said("m1")), row(12, "l", "discord", said("m1")), row(13, "j", "teams", {}),
    ) == [[1, 2], [3], [4, 5], [6], [7, 8], [9], [10, 11, 13], [12]]


@pytest.mark.parametrize("seconds", [0.0, 0.4, 45.0, -80.0, 10800.0, -10800.0, -10755.0])
def test_message_without_id_is_found_by_its_words(told, seconds):
    body = "A medição deu 14 ms em lab-7 e isso é aceitável, vamos seguir."
    cut_short = "Ana: a medicao deu 14 ms em lab-7 e isso e aceitavel, vamos…\nConversa: chat Sala\nRecebida por você"
    pair = [row(1, "a", "teams", said("m1"), body), row(2, "b", "teams", said(), cut_short, seconds)]
    whole_hours = round(seconds / 3600) * 3600
    taught = [row(3, "c", "discord", said("m2"), "uma frase dita uma vez"), row(4, "d", "discord", said(), "Uma frase, dita uma vez", whole_hours)]
    assert told(*pair, *taught) == [[1, 2], [3, 4]]


@pytest.mark.parametrize("hours", [-4, -2, 1, 5.5])
def test_zones_are_learned(told, spark, hours):
    rows = [row(2 * i + j, f"{i}{j}", "teams", said(f"m{i}") if not j else said(), f"a frase de numero {'abcdefgh'[i]} em diante", 7 * i + j * 3600 * hours) for i in range(8) for j in (0, 1)]
    assert told(*rows) == [[2 * i, 2 * i + 1] for i in range(8)]


def test_an_equal_revision_bridges_any_time(told):
    body = "ok, sem pressa por aqui"
    assert told(row(1, "a", "teams", said("m1", revision="1772366400123"), body), row(2, "b", "teams", said(revision="1772366400123"), body, 86_400 * 9 + 500), row(3, "c", "teams", said(), body, 86_400 * 20 + 500)) == [[1, 2], [3]]


def test_undated_messages_meet_the_only_one_with_their_words(told):
    body = "palavras que bastam para comparar"
    again = [row(10 + i, f"x{i}", "teams", said() | {"conversation": "Outra"}, body, at=False) for i in range(3)]
    assert told(row(1, "a", "teams", said("m1"), body), row(2, "b", "teams", said(), body, at=False), *again) == [[1, 2], [10], [11], [12]]
    assert told(*again[:2]) == [[10, 11]]


def test_equal_words_sent_twice_stay_two(told):
    body = "ok, sem pressa por aqui"
    assert told(row(1, "a", "teams", said("m1"), body), row(2, "b", "teams", said("m2"), body, 21), row(3, "c", "teams", said(), body, 20)) == [[1], [2, 3]]


def test_a_shared_revision_tells_more_than_a_near_time(told):
    body = "ok, sem pressa por aqui"
    assert told(row(1, "a", "teams", said("m1", revision="1772366400123"), body), row(2, "b", "teams", said("m2", revision="1772366421123"), body, 21), row(3, "c", "teams", said(revision="1772366400123"), body, 20)) == [[1, 3], [2]]


def test_two_exports_without_id_meet(told):
    body = "um texto bastante comprido para ser comparado"
    assert told(row(1, "a", "teams", said(), body), row(2, "b", "teams", said(), body), row(3, "c", "teams", said() | {"conversation": "Outra"}, body)) == [[1, 2], [3]]


def test_best_row(spark):
    rows = [
        row(1, "a", "file", {"path": "p", "revision": "9"}), row(2, "a", "file", {"path": "p", "revision": "0010"}), row(3, "a", "file", {"path": "p", "revision": "99x"}),
        row(4, "b", "file", {"path": "q", "x": "1"}), row(5, "b", "file", {"path": "q", "x": " "}), row(6, "b", "file", {"path": "q", "x": "1"}, seconds=1), row(7, "b", "file", {"path": "q", "x": "1"}, seconds=1),
        row(8, "c", "file", {"path": "r"}), row(9, "d", "file", {"path": "s", "revision": "9" * 60}), row(10, "d", "file", {"path": "s", "revision": "8" * 61}),
    ]
    found = survivors.survivors(spark.createDataFrame(rows, SCHEMA), least_rows=2).collect()
    assert sorted(r["record_id"] for r in found) == [2, 6, 10]


def test_undated_values_follow_learned_steps(spark):
    rows, n = [], 0
    for group in range(4):  # everywhere else a draft becomes final
        for step, state in enumerate(("draft", "final")):
            n += 1
            rows.append(row(n, f"u{group}", "file", {"path": f"p{group}", "state": state, "revision": str(step + 1)}))
    rows.append(row(100, "x", "file", {"path": "x", "state": "final"}, at=False))
    rows.append(row(101, "x", "file", {"path": "x", "state": "draft"}, at=False))
    rows.append(row(102, "x", "file", {"path": "x", "state": "draft"}, at=False))
    found = {r["record_id"]: r["metadata"] for r in survivors.survivors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert next(m for m in found.values() if m["path"] == "x")["state"] == "final"


def test_fields_come_from_the_latest_filled_rows(spark):
    rows = [row(1, "a", "file", {"path": "p", "size": "10", "revision": "1"}, "antigo"), row(2, "a", "file", {"path": "p", "size": "", "revision": "2"}, None, seconds=60)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = survivors.survivors(df, contents=True).first()
    assert found["record_id"] == 1 or found["record_id"] == 2
    assert found["metadata"] == {"path": "p", "size": "10", "revision": "2"} and found["content"] == "antigo" and found["occurred_at"] == (NOW + timedelta(seconds=60)).replace(tzinfo=None)


def test_nulls_blanks_and_empty(spark):
    rows = [(i, None if i < 3 else "u", None if i % 2 else "teams", None, None, None if i == 1 else {}, None if i % 2 else [], None) for i in range(6)] + [row(9, "t", "teams", {"message_id": None, "conversation": " "}, "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("activity", F.lit(1)).withColumn("stamp", F.lit("clash")).withColumn("n_rows", F.lit(0))
    found = survivors.survivors(df).collect()
    assert sorted(r["n_rows"] for r in found) == [1, 1, 1, 1, 3]
    assert survivors.survivors(df.limit(0)).count() == 0


def test_learned_steps_lead_on(spark):
    rows, n = [], 0
    for group in range(6):  # a draft becomes a review, a review becomes final; no activity tells of all three
        for step, state in enumerate(("draft", "review") if group % 2 else ("review", "final")):
            n += 1
            rows.append(row(n, f"u{group}", "file", {"path": f"p{group}", "state": state, "revision": str(step + 1)}))
    rows += [row(100 + i, "x", "file", {"path": "x", "state": state}, at=False) for i, state in enumerate(("final", "draft", "draft"))]
    found = survivors.survivors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert next(r["metadata"] for r in found if r["metadata"]["path"] == "x")["state"] == "final"


def test_circles_of_learned_steps_are_no_order(spark):
    steps = spark.createDataFrame([("f", "a", "b"), ("f", "b", "c"), ("f", "c", "a"), ("f", "c", "d"), ("g", "a", "d")], "field string, value string, next string")
    closed = {tuple(r) for r in survivors.closed(steps).collect()}
    assert closed == {("f", "a", "b"), ("f", "b", "c"), ("f", "c", "a"), ("f", "a", "d"), ("f", "b", "d"), ("f", "c", "d"), ("g", "a", "d")}
