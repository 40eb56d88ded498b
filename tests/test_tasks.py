"""Tasks and pull requests in one made-up month of a small workshop."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.operators import tasks

BOARD = ((r"quadro\.test/c/([a-z]+)/(\d+)", 2),)
FORGE = (
    tasks.CodeHost(r"^https://forja\.test/([\w-]+)/mudanca/(\d+)(?:[/?#].*)?$", r"^https://forja\.test/([\w-]+)/nova$"),
    tasks.CodeHost(r"^https://outra\.test/r/([\w-]+)/m(\d+)$", r"^https://outra\.test/r/([\w-]+)/abrir"),
)
START = datetime(2031, 2, 3, 8, tzinfo=UTC)
SCHEMA = "record_id long, source string, occurred_at timestamp, content string, metadata map<string,string>"


class Log:
    """Events minute by minute."""

    def __init__(self):
        self.rows = []

    def add(self, minute, source, content, **metadata):
        self.rows.append((len(self.rows), source, START + timedelta(minutes=minute), content, metadata))
        return self

    def page(self, minute, url, title=""):
        return self.add(minute, "browser", url, url=url, title=title)

    def said(self, minute, text, mine):
        return self.add(minute, "teams", text, sent_by_me=str(mine).lower())


@pytest.fixture
def told(spark):
    def run(log, until=timedelta(days=20)):
        events = spark.createDataFrame(log.rows, SCHEMA)
        return {r["task"]: r for r in tasks.report(events, events, START + until, BOARD, FORGE).collect()}

    return run


def card(n, board="horta"):
    return f"https://quadro.test/c/{board}/{n}"


def test_a_form_and_the_first_visit_after_it_make_a_request_mine(told):
    log = Log().page(0, card(3), "Regar canteiros").page(40, "https://forja.test/bomba/nova").page(52, "https://forja.test/bomba/mudanca/71", "Valvula horta 3")
    row = told(log)["horta/3"]
    assert (row["title"], row["n_prs"], row["status"], row["involvement"]) == ("Regar canteiros", 1, "done", "mine")


def test_a_form_too_long_before_opens_nothing(told):
    log = Log().page(0, card(3), "Regar").page(40, "https://forja.test/bomba/nova").page(56, "https://forja.test/bomba/mudanca/71", "Valvula 3")
    assert told(log)["horta/3"]["status"] == "in_progress"


def test_what_others_say_is_a_mention_and_what_i_say_is_mine(told):
    theirs = told(Log().said(0, f"olha {card(8)}", False))["horta/8"]
    mine = told(Log().said(0, f"olha {card(8)}, resolvi em https://outra.test/r/bomba/m5", True))["horta/8"]
    assert (theirs["involvement"], theirs["n_prs"], mine["involvement"], mine["n_prs"]) == ("mentioned_by_others", 0, "mine", 1)


def test_a_title_that_fits_two_cards_belongs_to_neither_but_to_the_last_one_touched(told):
    log = Log().page(0, card(6), "A").page(1, card(6, "pomar"), "B").page(90, "https://forja.test/bomba/nova").page(91, "https://forja.test/bomba/mudanca/2", "ajusta 6")
    found = told(log)
    assert (found["horta/6"]["n_prs"], found["pomar/6"]["n_prs"]) == (0, 1)


def test_inheritance_ends_after_twenty_minutes_and_prefers_the_earlier_card(told):
    log = Log().page(0, card(1), "x").add(10, "git", "meio", authorship="mine").page(20, card(2), "y").add(40, "git", "beira", authorship="mine").add(41, "git", "longe", authorship="mine")
    found = told(log)
    assert (found["horta/1"]["n_events"], found["horta/2"]["n_events"]) == (2, 2)


def test_one_message_counts_for_all_cards_it_names(told):
    assert set(told(Log().said(5, f"{card(1)} depende de {card(2)} e de {card(9, 'pomar')}", False))) == {"horta/1", "horta/2", "pomar/9"}


def test_status_history_and_matching(spark):
    log = Log().said(0, f"Bia: {card(1)} urgente", False).said(30, f"vou ver {card(2)}", True).page(70, card(3), "Poda do limoeiro").add(-60 * 24 * 85, "git", "antigo", authorship="other").add(-60 * 24 * 100, "file", "velho")
    events = spark.createDataFrame(log.rows, SCHEMA)
    end = START + timedelta(days=2)
    found = tasks.report(events, events, end, BOARD, FORGE)
    linked = tasks.linked_pull_requests(tasks.pull_requests(events, BOARD, FORGE), events, BOARD)
    every = tasks.touched(events, linked, BOARD, FORGE)
    keys = lambda df: sorted(r["task"] for r in df.collect())
    assert keys(tasks.of_status(found, "done")) == [] and len(keys(tasks.of_status(found, "in_progress"))) == 3 == len(keys(tasks.of_status(found)))
    assert sorted(r[0] for r in tasks.history_of(events, end).select("record_id").collect()) == [0, 1, 2]
    assert keys(tasks.matching(found, every, linked, way="received", patterns=BOARD)) == ["horta/1"]
    assert keys(tasks.matching(found, every, linked, topic="LIMOEIRO", patterns=BOARD)) == ["horta/3"]
    assert keys(tasks.matching(found, every, linked, people=["urgente"], patterns=BOARD)) == ["horta/1"]  # names nobody, so it is a topic


def test_links_in_the_order_of_the_text(spark):
    text = "antes https://outra.test/r/bomba/m5 depois https://forja.test/cano/mudanca/8?aba=1"
    row = spark.range(1).select(tasks.pr_refs(F.lit(text), FORGE).alias("p"), tasks.task_refs(F.lit(f"{card(4)} {card(4)} {card(5)}"), BOARD).alias("t")).first()
    assert [tuple(p) for p in row["p"]] == [("bomba", 5), ("cano", 8)] and [tuple(t) for t in row["t"]] == [("horta/4", "4"), ("horta/5", "5")]


@pytest.mark.parametrize(("title", "bare"), [("Pull Request 12: Troca filtro", "Troca filtro"), ("Troca filtro by rui · Pull Request #3", "Troca filtro"), ("Troca filtro (!77) · cano", "Troca filtro"), ("Troca filtro - Repos", "Troca filtro"), ("", "")])
def test_titles_without_what_hosts_add(spark, title, bare):
    assert spark.range(1).select(tasks.pr_title(F.lit(title)).alias("t")).first()["t"] == bare


@pytest.mark.parametrize(("title", "identifier", "cited"), [("conserta 31", "31", True), ("conserta-31/b", "31", True), ("conserta 310", "31", False), ("x31", "31", False), ("ver AB-9!", "ab-9", True), ("a.b", "a+b", False)])
def test_identifiers_are_whole_tokens(spark, title, identifier, cited):
    assert spark.range(1).select(tasks.cites(F.lit(title), F.lit(identifier)).alias("c")).first()["c"] == cited
