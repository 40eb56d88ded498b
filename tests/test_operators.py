"""Loads, mapping, sources, planning and streams on small tables."""

from __future__ import annotations

import json
from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import evidence, export, filters, graph, ingest, mapping, metrics, people, search, timeline
from weftline.plans import query as Q
from weftline.sources import events as V
from weftline.streaming.ingest import EventTable, ingest as load

EVENT = "uid string, source string, occurred_at timestamp, content string, metadata map<string,string>"
NOW = datetime(2026, 9, 26, 12, tzinfo=UTC)


def events(spark, *rows):
    return spark.createDataFrame([(u, s, NOW, c, m) for u, s, c, m in rows], EVENT)


@pytest.mark.parametrize(("stored", "incoming", "outcome"), [
    (("a", {"revision": "9"}), ("b", {"revision": "10"}), "updated"), (("a", {"revision": "10"}), ("b", {"revision": "9"}), "kept"), (("a", {"revision": "9"}), ("b", {"revision": "9"}), "kept"),
    (("a", {"revision": "9"}), ("b", {"revision": "9", "caption": "c"}), "updated"), (("a", {}), ("b", {}), "updated"), (("a", {}), ("a", {}), "kept"), (("a", {}), ("b", {"from_backup": "true"}), "kept"),
])
def test_upsert_rules(spark, stored, incoming, outcome):
    old = events(spark, ("u", "file", *stored))
    new = events(spark, ("u", "file", *incoming)).withColumn("arrival", F.lit(1))
    assert ingest.upsert(old, new, old.select("uid").limit(0)).first()["outcome"] == outcome


def test_forgotten_never_come_back(spark):
    new = events(spark, ("u", "file", "a", {})).withColumn("arrival", F.lit(1))
    assert ingest.upsert(new.drop("arrival").limit(0), new, new.select("uid")).count() == 0


def test_rekey_keeps_taken_names(spark):
    stored = spark.createDataFrame([("a",), ("b",), ("c",)], "uid string")
    changes = spark.createDataFrame([("a", "b"), ("c", "d")], "old_uid string, new_uid string")
    renamed, carried, counts = ingest.rekey(stored, changes, spark.createDataFrame([("a",)], "uid string"))
    assert sorted(r[0] for r in renamed.collect()) == ["a", "b", "d"] and [r[0] for r in carried.collect()] == ["b"] and counts.first().asDict() == {"asked": 2, "conflicts": 1}


def test_stream_equals_batch(spark, tmp_path):
    schema = events(spark).schema
    for i in range(4):
        rows = events(spark, *((f"u{j % 5}", "file", f"{i}-{j}", {"revision": str(10 * i + j)}) for j in range(10)))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = EventTable(spark, str(tmp_path / "table"), schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    load(stream, store, lambda: spark.createDataFrame([("u4",)], "uid string"), str(tmp_path / "checkpoint")).awaitTermination()
    found = {r["uid"]: r["metadata"]["revision"] for r in store.read().collect()}
    assert found == {f"u{j}": str(30 + j + 5) for j in range(4)}
    before = store.versions()
    store.merge(store.read(), before[-1], store.read().select("uid"))  # a batch that runs again does nothing
    assert store.versions() == before
    # only the shares of the last two versions are kept, and a batch writes only its own
    store.merge(events(spark, ("u1", "file", "novo", {"revision": "999"})), before[-1] + 1, store.read().select("uid").limit(0))
    assert {r["uid"]: r["content"] for r in store.read().collect()}["u1"] == "novo" and len(list((tmp_path / "table" / f"v{before[-1] + 1}").glob("share=*"))) == 1
    assert not (tmp_path / "table" / f"v{before[0]}").exists() or not list((tmp_path / "table" / f"v{before[0]}").glob("share=*"))


def test_equal_rows_of_a_batch_are_one_event(spark, tmp_path):
    rows = events(spark, ("u", "file", "a", {}), ("u", "file", "a", {}), ("u", "file", "b", {"revision": "1"}), ("w", "git", None, None))
    store = EventTable(spark, str(tmp_path / "table"), rows.schema, shares=3)
    store.merge(rows, 0, rows.select("uid").limit(0))
    assert sorted((r["uid"], r["content"]) for r in store.read().collect()) == [("u", "b"), ("w", None)]


def test_windowed_counts_drop_what_is_late(spark, tmp_path):
    from weftline.streaming.ingest import windowed_counts

    at = lambda m: datetime(2030, 1, 1, 0, m, tzinfo=UTC)
    for i, minutes in enumerate([(0, 1, 6), (40,), (41,), (2, 44), (59,)]):
        spark.createDataFrame([(at(m), "x") for m in minutes], "ts timestamp, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = {}

    def keep(batch, _):
        found.update({r["start"].minute: r["n"] for r in batch.collect()})

    windowed_counts(stream, "ts", "10 minutes", "5 minutes", "kind").writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert found[0] == 2 and found[5] == 1 and found[40] == 3  # the one at minute 2 came too late


def test_mapping_with_lookup_wildcards_and_conditions(spark):
    body = {
        "version": 2, "target": "message/1", "name": "teams-web", "source": "teams", "revision": 1, "records": {"kind": "indexeddb", "namespace_prefix": "Teams:", "container": "replychains", "each": "$.messageMap.<id>"},
        "require": [{"path": "$.type", "not_in": ["Event"]}, {"path": "$.deleted", "kind_not": ["number"]}],
        "fields": {
            "message_id": {"paths": ["$.id"]}, "conversation_id": {"paths": ["^.conversationId"]}, "sender": {"paths": [], "lookup": {"location": {"kind": "indexeddb", "container": "profiles"}, "key_path": "$.creator", "match": "$.mri", "values": ["$.displayName"]}},
            "text": {"paths": ["$.content"], "transform": "html_text"}, "sent_at": {"paths": ["$.at"], "transform": "unix_s"}, "sent_by_me": {"paths": ["$.mine"]},
        },
    }
    message = lambda i, **x: {"id": i, "type": "Text", "creator": "8:1", "content": "<p>Olá</p>", "at": 1700000000.5, "mine": True} | x
    chain = {"conversationId": "c", "messageMap": {"1000": message("1"), "1001": message("2", type="Event"), "1002": message("3", deleted=5), "1003": message("4", at=0), "name": message("5")}}
    profiles = [{"mri": "8:1", "displayName": "Antiga"}, {"mri": "8:1", "displayName": "Ana Prado"}]
    rows = [("indexeddb", "Teams:x", "replychains", 0, json.dumps(chain))] + [("indexeddb", "Teams:x", "profiles", i + 1, json.dumps(p)) for i, p in enumerate(profiles)]
    records = spark.createDataFrame(rows, "kind string, namespace string, container string, seq long, body string").withColumn("value", F.parse_json("body")).drop("body")
    schema = mapping.load_schema(body)
    mapped = mapping.apply_schema(records, schema)
    kept = mapped.where("kept").collect()
    assert [(r["message_id"], r["sender"], r["text"], r["sent_by_me"], int(r["sent_at"].timestamp())) for r in kept] == [("1", "Ana Prado", "Olá", True, 1700000000)]
    assert mapping.tally(records, mapped, schema).first().asDict() == {"records": 3, "in_store": 1, "items": 4, "kept": 1}


@pytest.mark.parametrize("change", [{"extra": 1}, {"name": "Bad Name"}, {"version": 3}, {"fields": {}}, {"fields": {"what": {"paths": ["$.a"]}}}])
def test_schemas_are_checked(change):
    body = {"version": 2, "target": "message/1", "name": "x", "records": {}, "fields": {f: {"paths": ["$.a"]} for f in mapping.REQUIRED}}
    mapping.load_schema(body)
    with pytest.raises((ValueError, KeyError)):
        mapping.load_schema(body | change)


def test_git_log_and_browser(spark):
    log = spark.createDataFrame([("r\x1fabc\x1f2026-09-26T10:00:00-03:00\x1fAna\x1fana@x.org\x1fajusta\n\x1fa.go\nb.go\n\x1e\nr\x1fdef\x1f2026-09-26T10:00:00Z\x1fAna\x1fana@x.org\x1fsem arquivos\x1f\x1e",)], "value string")
    rows = V.from_git_log(log).orderBy("content").collect()
    assert [r["content"] for r in rows] == ["ajusta\n\nArquivos alterados: a.go, b.go", "sem arquivos"] and rows[0]["occurred_at"].hour == 13
    visits = spark.createDataFrame([(1, V.CHROMIUM_EPOCH + 5)], "url_id long, visit_time long")
    urls = spark.createDataFrame([(1, "https://a.example/?token=x&q=1", "Título")], "id long, url string, title string")
    visit = V.from_browser(visits, urls).first()
    assert visit["content"] == "Título\nhttps://a.example/?q=1" and visit["occurred_at"].microsecond == 5


def test_files(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    for name, raw in (("a.txt", "olá".encode()), ("b.bin", b"\xff\xfe"), ("c.txt", b"x\0y"), ("node_modules/d.txt", b"no")):
        (tmp_path / name).write_bytes(raw)
    assert sorted(r["content"] for r in V.from_files(spark, str(tmp_path)).collect()) == ["a.txt\nolá", "b.bin", "c.txt"]


def test_message_store(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    store = V.from_message_store(
        make([(1, 10, 0, "k1", 3, 1000, 0, "oi"), (2, 10, 1, "k2", None, 2000, 0, "eu aqui"), (3, 10, 0, "k3", 1, 3000, 7, "sistema"), (4, 10, 0, "k4", 1, 4000, 1, None)], "_id long, chat_row_id long, from_me int, key_id string, sender_jid_row_id long, timestamp long, message_type int, text_data string"),
        make([(10, 2, "Grupo")], "_id long, jid_row_id long, subject string"), make([(1, "ana@s"), (2, "g@g")], "_id long, raw_string string"),
        make([(3, 1), (3, 2)], "lid_row_id long, jid_row_id long"), make([(4, "foto.png")], "message_row_id long, media_name string"),
    )
    assert sorted(r["content"].split("\n")[0] for r in store.collect()) == ["ana@s: [foto.png]", "ana@s: oi", "eu: eu aqui"]


def test_neighbours_gates_and_citations(spark):
    rows = spark.createDataFrame([(i, datetime.fromtimestamp(1_700_000_000 + 60 * m, UTC)) for i, m in enumerate([0, 10, 119, 120, -120, -121, 5, 5])], "record_id long, occurred_at timestamp")
    near = evidence.neighbours(rows.where("record_id = 0"), rows, most=10).orderBy("rank").collect()
    assert [r["record_id"] for r in near] == [6, 7, 1, 2, 4]
    hits = spark.createDataFrame([("q", 0.5), ("q", 0.8), ("p", 0.65)], "q string, distance double")
    assert [r["distance"] for r in evidence.gates(hits, per=("q",)).collect()] == [0.5]
    cited = spark.range(1).select(evidence.citations(F.lit("[3] e [1], [9] e [3]"), 3).alias("c")).first()["c"]
    assert (cited["valid"], cited["unknown"]) == ([1, 3], [9])


def test_nearest_and_as_of_against_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [(i, rng.randrange(3), rng.randrange(20_000) * 1_000_000, i if rng.random() < 0.2 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, k long, us long, label long")
    found = {r["event_id"]: r["near"] for r in timeline.nearest_cited(df, F.col("label"), 20, "k").collect()}
    for i, k, us, label in rows:
        best = min(((abs(u - us), u > us, lab) for _, kk, u, lab in rows if kk == k and lab is not None and abs(u - us) <= 1_200_000_000), default=None)
        assert found[i] == (label if label is not None else best and best[2])
    right = df.where("label is not null").groupBy("k", "us").agg(F.max("label").alias("value"))
    carried = {r["event_id"]: r["found"] for r in timeline.as_of(df.select("event_id", "k", "us"), right, "k", 30).collect()}
    for i, k, us, _ in rows:
        best = max(((u, lab) for _, kk, u, lab in rows if kk == k and lab is not None and 0 <= us - u <= 1_800_000_000), default=None)
        assert carried[i] == (best and best[1])


def test_neighbours_against_brute_force(spark):
    import random

    rng = random.Random(6)
    rows = [(i, datetime.fromtimestamp(1_700_000_000 + 600 * rng.randrange(300), UTC)) for i in range(250)] + [(1000 + i, datetime.fromtimestamp(1_700_000_000, UTC)) for i in range(30)] + [(5000, None)]
    df = spark.createDataFrame(rows, "record_id long, occurred_at timestamp")
    found = {}
    for r in evidence.neighbours(df.where("record_id % 7 = 0"), df, minutes=60, most=3).collect():
        found.setdefault(r["anchor"], []).append((r["rank"], r["record_id"]))
    for i, at in rows:
        if i % 7 == 0 and at:
            near = sorted((abs((t - at).total_seconds()), j) for j, t in rows if t and j != i and -3600 <= (t - at).total_seconds() < 3600)[:3]
            assert [j for _, j in sorted(found.get(i, []))] == [j for _, j in near]


def test_chat_records_without_a_known_store_are_an_error(spark):
    from pyspark.errors import PySparkException

    from weftline.sources import teams

    rows = spark.createDataFrame([("indexeddb", "o", "Other:x", "things", 1, "{}")], "kind string, origin string, namespace string, container string, seq long, body string").withColumn("value", F.parse_json("body")).drop("body")
    with pytest.raises(PySparkException, match="no store"):
        teams.check(rows).collect()
    assert teams.check(rows.limit(0)).first()["records"] == 0 and teams.from_teams(rows).count() == 0
    strange = rows.withColumn("namespace", F.lit(teams.CHAINS[0] + "x")).withColumn("container", F.lit(teams.CHAINS[1])).withColumn("value", F.parse_json(F.lit('{"messageMap":{"1":{"what":1}}}')))
    with pytest.raises(PySparkException, match="no message"):
        teams.check(strange).collect()


def test_pictures_are_described_in_the_text(spark):
    from weftline.sources import teams

    told = events(spark, ("u", "teams", "oi", {"image_urls": "a\nb\nc"}), ("w", "teams", "sem", {"x": "1"}))
    captions = spark.createDataFrame([("b", "sha-b", "um gráfico"), ("a", "sha-a", " ")], "url string, sha256 string, description string")
    found = {r["uid"]: r for r in teams.with_captions(told, captions).collect()}
    assert found["u"]["content"] == "oi\num gráfico" and found["u"]["metadata"]["image_sha256"] == "sha-a" and found["w"]["content"] == "sem"


def test_histories_are_told_apart_by_their_columns(spark):
    urls = spark.createDataFrame([(1, "https://q.test/", "T")], "id long, url string, title string")
    fox = V.from_browser(spark.createDataFrame([(1, 5_000_000)], "url_id long, visit_date long"), urls).first()
    assert fox["metadata"]["browser"] == "firefox" and fox["occurred_at"].timestamp() == 5
    with pytest.raises(ValueError, match="no known history"):
        V.from_browser(urls.withColumn("url_id", F.col("id")), urls)


def test_retried_numbers_and_odd_paths(spark):
    value = spark.range(1).select(F.parse_json(F.lit('{"a":{"x.y":1,"it\'s":2},"n":[null,{"k":"v"}],"t":"true","f":1e-7}')).alias("v"))
    read = lambda path: value.select(mapping.scalar(F.col("v"), path).alias("s")).first()["s"]
    assert read("$.n[].k") == "v" and read("$.a.it's") == "2" and read("$.f") == "0.0000001" and read("$.none[].k") == "" and read("$.t") == "true"
    for bad in ("a", "$.", "$a", "$.<id", "$[0]"):
        with pytest.raises(ValueError):
            mapping.parse_path(bad)


def test_graph_reaches_three_hops(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "a long, b long")
    found = graph.reachable(edges, spark.createDataFrame([(0,)], "node long"))
    assert {r["node"]: r["hops"] for r in found.collect()} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_export_pages_and_person(spark, tmp_path):
    rows = events(spark, ("u1", "teams", "oi", {"sender": "Ana Prado", "conversation_id": "c", "sent_by_me": "false"}), ("u2", "teams", "e aí", {"sender": "Bruno", "conversation_id": "d"})).withColumn("record_id", F.monotonically_increasing_id())
    export.person(rows, "ana prado", str(tmp_path / "ana"))
    assert [r["uid"] for r in spark.read.json(str(tmp_path / "ana")).collect()] == ["u1"]
    assert export.page(rows, -1, 5)[1]


def test_aliases_and_authorship(spark):
    rows = events(spark, ("u", "git", "c", {"author": "asilva", "email": "ana.silva@x.org"}))
    assert people.with_email_alias(rows).first()["metadata"]["author_alias"] == "ana silva"
    assert people.with_authorship(rows, ["ANA.SILVA@x.org"]).first()["metadata"]["authorship"] == "mine" and people.with_authorship(rows, []) is rows


def test_metrics(spark):
    cases = spark.createDataFrame([([1, 2], [2, 3, 1], None), ([], [], None), ([], [5], None)], "relevant array<int>, found array<int>, groups array<int>")
    scores = metrics.suite_scores(metrics.scored_cases(cases)).first()
    assert (scores["recall"], scores["mrr"], scores["rejection"]) == (1.0, 1.0, 0.5)
    low, high = spark.range(1).select(metrics.wilson(F.lit(0), F.lit(0)).alias("w")).first()["w"]
    assert (low, high) == (0.0, 1.0)


@pytest.mark.parametrize(("question", "mode", "source"), [("liste os commits de ontem", "list", "git"), ("tarefas pendentes de hoje", "tasks", ""), ("resumo de ontem", "answer", "")])
def test_rules(question, mode, source):
    plan = Q.plan_by_rules(question)
    assert plan and (plan.mode, plan.source) == (mode, source)


@pytest.mark.parametrize("question", ["o que a Ana mandou?", "commits e mensagens", "o que tem nas mensagens de ontem?"])
def test_rules_decline(question):
    assert Q.plan_by_rules(question) is None


def test_guards_only_remove():
    plan = Q.Plan(mode="tasks", period="semana passada", people=("Ana",), direction="received", modality="image", related=True)
    found = Q.guarded(plan, "o que falei sobre isso essa semana")
    assert (found.mode, found.period, found.direction, found.modality, found.related) == ("answer", "", "any", "", False)
    assert Q.guarded(Q.Plan(people=("Ana",), direction="received"), "o que recebi da Ana").direction == "received"
    asked = Q.plan("liste os commits de ontem", date(2026, 9, 26))
    assert asked.days and asked.scoped and asked.filter().source == "git"


def test_shared_images_appear_and_show(spark):
    rows = [("u1", "file", "O roteiro de carga novo", {"image_sha256": "a1", "path": "/x/a"}), ("u2", "teams", "nada", {"image_sha256": "a1"}), ("u3", "teams", "nada mais", {"image_sha256": "b2"}), ("u4", "teams", "sem imagem", {"image_sha256": " "}), ("u5", "teams", "um roteiro, de carga", {"attachment": "b.PNG"})]
    events = spark.createDataFrame(rows, "uid string, source string, content string, metadata map<string,string>").withColumn("content_hash", X.content_hash(F.col("content")))
    texts = filters.appearing(search.text_chunks(events), "roteiro de carga")
    found = filters.with_appearing(events, texts, graph.shown_images(events, "uid"), "uid")
    assert sorted(r["uid"] for r in found.collect()) == ["u1", "u2", "u5"]
    assert sorted(r["uid"] for r in events.where(filters.shows_image()).collect()) == ["u1", "u2", "u3", "u5"]
