"""Spellings of names, linked and kept apart."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftline.llm import people, variants

GIVEN = ["Paula", "Paulo", "Bruno", "Bruna", "Márcia", "Thiago", "Rodrigo"]


def linked(spark, names, conversations=()):
    surnames = [f"Zubrevi{a}{b}" for a in "xkm" for b in "tlndr"]
    others = [f"{g} {s}" for i, s in enumerate(surnames) for g in (GIVEN[i % 7], GIVEN[(i + 1) % 7], GIVEN[(i + 3) % 7])] + [f"{g} {s}oquetra" for g in GIVEN for s in ("Dal", "Fer", "Gim", "Hos", "Jun", "Kel", "Lom", "Mov", "Nub")]
    messages = spark.createDataFrame([(n,) for n in [*names, *others, None, "", "eu", "você"]], "sender string")
    records = spark.createDataFrame([([("mentioned", g)],) for g in GIVEN] + [([("conversation", c)],) for c in conversations] + [(None,), ([],), ([(None, None)],)], "people array<struct<role:string,name:string>>")
    found = {r["name"]: r["entity"] for r in variants.variants(messages, records).collect()}
    return {frozenset(n for n in [*names, *conversations] if found.get(n) == e) for e in set(found.values())} - {frozenset()}, found


def test_spellings_of_one_person(spark):
    names = ["Paulo Pigrozofla", "PAULO PIGROZOFLA", "Pigrozofla, Paulo", "Paulo Brandela Pigrozofla", "paulo.pigrozofla", "pigrozofla_paulo", "PauloPigrozofla", "Paullo Pigrozofla", "Paulo Pigrozofa", "Paulo Pigrozofla 🚀", "[EXT] Paulo Pigrozofla", "Paulo Pigrozofla (Terceiros)", "Dr. Paulo Pigrozofla", "Paulinho Pigrozofla", "P. Pigrozofla", "ppigrozofla"]
    groups, _ = linked(spark, names)
    assert groups == {frozenset(names)}


def test_different_given_names_stay_apart(spark):
    names = ["Bruna Tezavajo", "Bruno Tezavajo", "Tezavajo, Bruna", "bruno.tezavajo", "B. Tezavajo", "Paula Tezavajo"]
    groups, _ = linked(spark, names)
    assert frozenset(["Bruna Tezavajo", "Tezavajo, Bruna"]) in groups and frozenset(["Bruno Tezavajo", "bruno.tezavajo"]) in groups and frozenset(["B. Tezavajo"]) in groups


def test_organisations(spark):
    names = ["Cejomuti Logística S/A", "CEJOMUTI", "Logística Cejomuti S.A.", "Grupo Cejomuti", "cejomuti-logistica", "Cejomuti Log.", "Drapoficre Alimentos Ltda"]
    groups, _ = linked(spark, names)
    assert groups == {frozenset(names[:-1]), frozenset(names[-1:])}


def test_placeholders_titles_and_given_names_name_nobody(spark):
    _, found = linked(spark, ["Paulo Pigrozofla"], ["Plantão Farol 60", "Retro Farol", "Paulo Pigrozofla 😀"])
    assert not {"eu", "você", "Paulo", "Plantão Farol 60", "Retro Farol", ""} & set(found) and found["Paulo Pigrozofla 😀"] == found["Paulo Pigrozofla"]


def test_pairs_are_ordered_and_empty_tables_give_none(spark, data):
    pairs = variants.p2_found(spark, data)
    assert pairs.where("name_a >= name_b").count() == 0 and pairs.count() == pairs.distinct().count()
    messages = spark.createDataFrame([("x",)], "sender string").limit(0).withColumn("name", F.lit(1))
    records = spark.createDataFrame([([("sender", "x")],)], "people array<struct<role:string,name:string>>").limit(0)
    assert variants.variants(messages, records).count() == 0


def test_collision_curve():
    least = variants.least_similarity({1: 5, 2: 7}, 2)
    assert least == pytest.approx(1 / 3)  # four of twelve grams are common to seven letters with two of them wrong
    bands = variants.bands_for(least, 0.95, 4)
    assert 1 - (1 - least**4) ** bands >= 0.95 > 1 - (1 - least**4) ** (bands - 1)


@pytest.mark.parametrize(("a", "b", "errors"), [("gofifamo", "gofifamo", 0), ("gofifamo", "gofiamo", 1), ("gofifamo", "gofifaom", 1), ("gofifamo", "gxfifaom", 2), ("gofifamo", "nada", 3)])
def test_edit_distance(a, b, errors):
    assert people.near(a, b) == errors == people.near(b, a)


def test_clean_and_words():
    assert people.words("JoÃ£o  Vagrutrudrú (Terceiros) ✅") == ["joao", "vagrutrudru"] and people.words("Silva, Ana Maria") == ["ana", "maria", "silva"] and people.words("") == []


def test_very_long_name(spark):
    _, found = linked(spark, ["Paulo " + "z" * 20_000, "Paulo Pigrozofla"])
    assert len(set(found.values())) > 1


def test_a_surname_of_many_people_tells_them_apart(spark):
    givens = ["Paula", "Paulo", "Bruno", "Bruna", "Marcia", "Thiago", "Rodrigo", "Helena", "Otavio", "Daniel", "Cecilia", "Ines"]
    names = ["Paula Silva", "Paula Brandela Silva", "Bruno Silva"]
    messages = spark.createDataFrame([(n,) for n in {*names, *(f"{g} Silva" for g in givens)}], "sender string")
    records = spark.createDataFrame([([("mentioned", g)],) for g in givens], "people array<struct<role:string,name:string>>")
    found = {r["name"]: r["entity"] for r in variants.variants(messages, records).collect()}
    assert found["Paula Silva"] == found["Paula Brandela Silva"] != found["Bruno Silva"]


def test_a_common_surname_is_no_mistyped_given_name():
    known = people.Lexicon({"silvia", "ana"}, {"silvia", "ana", "silva"}, {"silva"})
    assert known.parse("B. Silva") == people.Parsed("person", "b", "initial", ("silva",))
    assert known.parse("Ana Brandela Silva").rare == ("brandela", "silva")


def test_more_common_tokens_than_may_be_sent_are_an_error(spark, monkeypatch):
    common = spark.createDataFrame([("ana", True, False, 0), ("ines", True, False, 9), ("silva", False, True, 12)], "token string, is_given boolean, is_surname boolean, n long")
    known = people.lexicon(common)
    assert known.givens == {"ana", "ines"} and known.surnames == {"silva"}
    monkeypatch.setattr(people, "LEXICON_ROWS", 2)
    with pytest.raises(ValueError, match="common tokens"):
        people.lexicon(common)


def test_satellites_never_pass_their_centre_on(spark):
    chain = spark.createDataFrame([(f"n{i + 1:02}", f"n{i:02}") for i in range(29)], "node string, other string")
    assert {r["node"] for r in variants.satellites(chain).collect()} == {f"n{i:02}" for i in range(1, 30, 2)}
    star = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("e", "a")], "node string, other string")
    assert {r["node"] for r in variants.satellites(star).collect()} == {"b", "c", "e"}  # d lies beside satellites only, so it is a centre
    assert variants.satellites(star.limit(0)).count() == 0


def test_a_chain_of_errors_is_no_one_person(spark):
    names = ["Paulo Pigrozofla", "paulo pigrozofla", "PAULO PIGROZOFLA", "Paulo Pigrozofxx", "Paulo Pigrozxxxx"]
    _, found = linked(spark, names)
    assert found[names[0]] == found[names[1]] == found[names[3]] != found[names[4]]


@pytest.mark.parametrize("seed", range(3))
def test_names_that_may_match_share_a_way(seed):
    import itertools
    import random

    rng = random.Random(seed)
    givens = ["antonio", "ana", "roberto", "alberto", "marcela", "thiago", "francisco", "bo"]
    full = lambda short: [g for g in givens if people.is_short_form(short, g)]
    made = [(g, w) for g in givens for w in ("full", "typed", "joined")] + [(t, "short") for t in ("beto", "cela", "thi", "thia", "aninha", "fran", "tonio")] + [(c, w) for c in "abmtz" for w in ("initial", "login")]
    made += [("".join(rng.choice("abtoni") for _ in range(rng.randrange(2, 6))), "nick") for _ in range(40)] + [("", ""), ("", "brand")]
    for (a, x), (b, y) in itertools.product(made, made):
        if variants._given_similarity(a, x, b, y) > 0 and (x, y) != ("short", "short"):  # two short forms meet by a name that both are short for
            assert set(variants.ways(a, x, full)[0]) & set(variants.ways(b, y, full)[1]), (a, x, b, y)


def test_similar_tokens_against_brute_force(spark):
    import random

    rng = random.Random(5)
    made = {"".join(rng.choice(("pi", "gro", "zo", "fla", "dre", "vi", "ta", "mu")) for _ in range(rng.randrange(2, 5))) for _ in range(60)}
    for token in sorted(made)[:40]:
        i = rng.randrange(1, len(token) - 1)
        made.add(token[:i] + rng.choice("xyz") + token[i + 1 :])
        made.add(token[:i] + token[i + 1] + token[i] + token[i + 2 :])
    tokens = spark.createDataFrame([(t,) for t in sorted(made)], "token string")
    wanted = {(a, b) for a in made for b in made if people.near(a, b) == 0 or (people.near(a, b) == 1 and max(len(a), len(b)) >= 5) or (people.near(a, b) == 2 and max(len(a), len(b)) >= 7)}
    found = {(r["token"], r["other"]) for r in variants.similar_tokens(tokens).collect()}
    assert found <= wanted and len(found) >= 0.95 * len(wanted)
    assert found == {(r["token"], r["other"]) for r in variants.similar_tokens(tokens, bucket=2).collect()}


def test_short_forms_are_learned_from_surnames_of_one_person(spark):
    part = lambda token, given, written: ("person", [{"token": token, "given": given, "written": written}])
    rows = [part(f"s{i}", "francisco", "full") for i in range(9)] + [part(f"s{i}", "kiko", "nick") for i in range(6)]  # nothing alike, but often
    rows += [part("t1", "beatriz", "full"), part("t2", "beatriz", "full"), part("t1", "bea", "short"), part("t2", "bea", "short")]
    rows += [part("u1", "bruno", "full"), part("u1", "bruna", "full"), part("u1", "bru", "short"), part("u2", "bruno", "full"), part("u3", "bruna", "full"), part("u2", "bru", "short"), part("u3", "bru", "short")]  # could be either
    named = spark.createDataFrame(rows, "kind string, parts array<struct<token:string,given:string,written:string>>")
    assert variants.short_forms(named) == {"kiko": "francisco", "bea": "beatriz"}
    assert variants.short_forms(named.limit(0)) == {}
    known = people.Lexicon({"francisco", "erica"}, {"francisco", "erica"})
    known.shorts = {"kiko": "francisco"}
    assert known.parse("Kiko Zubrevi") == people.Parsed("person", "francisco", "short", ("zubrevi",))


def test_typing_errors_in_given_names_against_brute_force():
    import random

    rng = random.Random(4)
    givens = {"".join(rng.choice("abeinor") for _ in range(rng.randrange(3, 7))) for _ in range(60)}
    known = people.Lexicon(givens, givens)
    for _ in range(500):
        token = "".join(rng.choice("abeinor") for _ in range(rng.randrange(3, 8)))
        close = [g for g in givens if len(g) >= 4 and people.near(token, g) == 1]
        wanted = token if token in givens else close[0] if len(token) >= 4 and len(close) == 1 else ""
        assert known.typed(token) == wanted


def test_no_table_of_names_is_broadcast(spark, monkeypatch):
    from weftline.plans import lineage

    plans = []

    def kept(df, *by):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return lineage.cut(df, *by)

    monkeypatch.setattr(variants, "cut", kept)
    messages = spark.createDataFrame([(f"{g} {s}",) for g in GIVEN for s in ("Pigrozofla", "Pigrozofa", "Tezavajo")], "sender string")
    records = spark.createDataFrame([([("mentioned", g)],) for g in GIVEN], "people array<struct<role:string,name:string>>")
    found = variants.variants(messages, records)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 9 and sum("SortMergeJoin" in p for p in plans) > 5
    assert not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p]
