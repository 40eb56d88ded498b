"""Personal information: what is found, what isn't, where, and what replaces it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftline.llm import personal
from weftline.llm.people import Lexicon

KNOWN = Lexicon({"ana", "paulo", "antonio", "ines"}, {"ana", "paulo", "antonio", "ines", "gravelo", "ltda", "engenharia"})
DETECTOR = personal.Detector(KNOWN)


def found(text, people=None):
    return [(kind, text[start:end]) for kind, start, end, check in DETECTOR.find(text, people) if check in (None, "pigrozofla", "gegapagre")]


@pytest.mark.parametrize(("text", "expected"), [
    ("copia CONTATO@ZELVIA.EXAMPLE e fim", [("email", "CONTATO@ZELVIA.EXAMPLE")]), ("novo: ana.s+x@corp.a-b.example.", [("email", "ana.s+x@corp.a-b.example")]),
    ("rh (arroba) casdim (ponto) test ok", [("email", "rh (arroba) casdim (ponto) test")]), ("rh [at] casdim.example", [("email", "rh [at] casdim.example")]), ("rh @ brimol.invalid", [("email", "rh @ brimol.invalid")]),
    ("rh at casdim dot example", [("email", "rh at casdim dot example")]), ("r​h@cаsdim.example", [("email", "r​h@cаsdim.example")]), ("login=xk1@a.test falhou", [("email", "xk1@a.test")]),
    ("git clone git@git.pontal.example:erp/core.git", []), ("npm i lodex@1.8.21", []), ("@todos atenção", []), ("{&quot;mail&quot;: &quot;rh@a.example&quot;}", [("email", "rh@a.example")]),
    ("liga +55 56 91431-3974 já", [("phone", "+55 56 91431-3974")]), ("(20)3068-6009", [("phone", "(20)3068-6009")]), ("(+1 (555) 555-0119)", [("phone", "+1 (555) 555-0119")]), ("(20 928655148)", [("phone", "20 928655148")]),
    ("07700 900541", [("phone", "07700 900541")]), ("023 9 6182 4509", [("phone", "023 9 6182 4509")]), ("39.91694.1933/plantão", [("phone", "39.91694.1933")]), ("30 97275‑8349", [("phone", "30 97275‑8349")]), ("555-0176", [("phone", "555-0176")]),
    ("ligue nove um dois três quatro cinco seis sete oito", []), ("fone dois três nove um dois três quatro cinco seis sete oito", []),
    ("pedido 17142-9680", []), ("host 192.0.2.187 porta 1999", []), ("timestamp 1733473036145", []), ("uuid 4ffdc3ad-db01-3813", []), ("+1 [edited]", []), ("prazo de 24/8/2026", []),
    ("CPF 543.870.401-77", [("id_number", "543.870.401-77")]), ("cpf:666-34-5161", [("id_number", "666-34-5161")]), ("Doc 044 629 622 11", [("id_number", "044 629 622 11")]), ("RG nº 28.344.173-X, cópia", [("id_number", "28.344.173-X")]),
    ("CPF 77762680967 está", [("id_number", "77762680967")]), ("his SSN ZX996012 was", [("id_number", "ZX996012")]), ("480866775-70", [("id_number", "480866775-70")]), ("build 91183526910 verde", []), ("nota fiscal 313.397.889", []), ("chamado 2026.5374.44-0", []),
    ("em Avenida dos Trevos, 1312, ap 63", [("address", "Avenida dos Trevos, 1312")]), ("na Al. do Ferreiro, nº 74, sala", [("address", "Al. do Ferreiro, nº 74")]), ("mora na 1220 Marlen Street, Apt 21", [("address", "1220 Marlen Street")]), ("R. Vale Brunido 86", [("address", "R. Vale Brunido 86")]),
    ("rua sem saída no fluxograma, passo 98", []), ("avenida de testes: 817 casos", []),
    ("falei com Paulo Gravelo Pigrozofla hoje", [("name", "Paulo Gravelo Pigrozofla")]), ("a proposta de ANTÔNIO GEGAPAGRE", [("name", "ANTÔNIO GEGAPAGRE")]), ("Paulo, tudo bem?", []), ("ana.souza@x.example", [("email", "ana.souza@x.example")]),
])
def test_places(text, expected):
    surely = [(k, t) for k, t in found(text) if not (k == "phone" and not any(c.isdigit() for c in t))]
    assert surely == expected


def test_names_of_the_row(spark):
    people = [{"role": "sender", "name": "Padribirú, T."}, {"role": "author", "name": "Drapoficre Alimentos Ltda"}, {"role": "conversation", "name": "Plantão Farol 60"}, {"role": "mentioned", "name": "Ana"}, {"role": None, "name": None}]
    text = "Padribirú, T.: Ana viu o Plantão Farol 60 da Drapoficre Alimentos Ltda; PADRIBIRU,  t. respondeu"
    assert found(text, people) == [("name", "Padribirú, T."), ("name", "PADRIBIRU,  t.")]


def test_small_letters_need_a_known_surname(spark):
    rows = [(1, "fala com antonio gegapagre agora", [("sender", "Antônio Gegapagre")]), (2, "antonio gegapagre saiu, paulo pediu para esperar", [("mentioned", "Antônio"), ("mentioned", "Paulo")]), (3, None, None), (4, "", []), (5, "nada aqui", [(None, None)])]
    df = spark.createDataFrame(rows, "record_id long, content string, people array<struct<role:string,name:string>>")
    got = sorted((r["record_id"], r["kind"], r["start_at"]) for r in personal.spans(df).collect())
    assert got == [(1, "name", 9), (2, "name", 0)]
    assert personal.spans(df.limit(0)).count() == 0


def test_redaction_keeps_the_rest(spark):
    rows = [(1, "😀 CPF 543.870.401-77; fone (20)3068-6009, rh@a.example", None), (1 + 1, "sem nada", None), (3, None, None), (4, "x" * 300_000 + " rh@a.example", None)]
    df = spark.createDataFrame(rows, "record_id long, content string, people array<struct<role:string,name:string>>").withColumn("kind", F.lit("clash")).withColumn("n_places", F.lit(-1))
    out = {r["record_id"]: r for r in personal.redact(df).collect()}
    assert out[1]["content"] == "😀 CPF [id_number]; fone [phone], [email]" and out[1]["n_places"] == 3
    assert out[2]["content"] == "sem nada" and out[3]["content"] is None and out[4]["content"].endswith("x [email]") and len(out[4]["content"]) == 300_008 and out[2]["kind"] == "clash"


def test_offsets_map_back():
    text = "a​b &amp; c (arroba) d"
    plain = personal.Plain(text)
    assert plain.text == "ab & c@d"
    for i, c in enumerate(plain.text):
        if c.isalpha():
            assert text[plain.source(i)] == c


def test_a_surname_of_many_people_is_one(spark):
    givens = ["Ana", "Paulo", "Bruno", "Marcia", "Thiago", "Rodrigo", "Helena", "Otavio", "Daniel", "Cecilia", "Ines", "Katia"]
    people = [("author", f"{g} Silva") for g in givens] + [("author", f"{g} Gravelo {s}") for g, s in zip(givens, ("Dalquo", "Ferquo", "Gimquo", "Hosquo", "Junquo", "Kelquo", "Lomquo", "Movquo", "Nubquo", "Pelquo", "Rolquo", "Tamquo"))]
    rows = [(i, None, [p]) for i, p in enumerate(people)] + [(100 + i, None, [("mentioned", g)]) for i, g in enumerate(givens)]
    rows += [(200, "Ana Silva falou; Ana Gravelo saiu", None), (201, "com Bruno Gravelo Silva hoje", None), (202, "SILVA, Ines", None), (203, "Ana falou", None)]
    df = spark.createDataFrame(rows, "record_id long, content string, people array<struct<role:string,name:string>>")
    assert sorted((r["record_id"], r["kind"], r["start_at"], r["end_at"]) for r in personal.spans(df).collect()) == [(200, "name", 0, 9), (201, "name", 4, 23), (202, "name", 0, 11)]


@pytest.mark.parametrize(("text", "expected"), [
    ("JOAO [AT] X [DOT] COM", "JOAO [AT] X [DOT] COM"), ("a joao{at}x.com, ok", "joao{at}x.com"), ("a joao<at>x.com, ok", "joao<at>x.com"), ("joao{ Arroba }x{dot}com", "joao{ Arroba }x{dot}com"), ("JOAO AT X DOT COM", "JOAO AT X DOT COM"),
    ("joao@empresa ponto com", "joao@empresa ponto com"), ("joao@empresa ponto com ponto br já", "joao@empresa ponto com ponto br"), ("joao@empresa.com ponto final", "joao@empresa.com"),
])
def test_disguises_of_mail_in_any_case_and_bracket(text, expected):
    assert found(text) == [("email", expected)]


@pytest.mark.parametrize(("text", "expected"), [
    ("Ana Lima: moro na rua das acacias, 120", ["rua das acacias, 120"]), ("moro na rua das acacias, 120", ["rua das acacias, 120"]), ("Bom dia!\nsou de 12 marlen street, perto", ["12 marlen street"]),
    ("tudo certo por aqui, sem nada de novo para contar desde a semana passada, ate mais. Passei pela rua principal 5 vezes", []),
    ("Ana Lima: rua sem saída no fluxograma passo 36!", []), ("Ana Lima: ha 3 testes on the way", []),
])
def test_streets_without_capitals_are_judged_by_the_words_around_them(text, expected):
    assert [t for kind, t in found(text) if kind == "address"] == expected


def test_no_place_depends_on_how_far_away_something_stands():
    domain = "sub-" * 40 + "empresa"
    assert found(f"joao@{domain} ponto com, ok") == [("email", f"joao@{domain} ponto com")]
    surname = "gegapagre"
    assert found(f"{surname.upper()}, {' ' * 60}Ana e fim") == [("name", f"{surname.upper()}, {' ' * 60}Ana")]
    assert found("nota fiscal" + " " * 50 + "313.397.889-00") == []
    for before in ("", "Oi, ", "Ok. " * 40, "x" * 500 + ". "):
        assert [k for k, _ in found(f"{before}enviar para rua das flores, 120 hoje")] == ["address"]


def test_many_places_take_no_quadratic_time():
    import time

    text = "; ".join(f"a{i}@x.example, (20)3068-{6000 + i % 4000}, Rua Verde, {i % 900 + 1}, Paulo Gegapagre" for i in range(8000))
    began = time.time()
    places = DETECTOR.find(text, [{"name": "Paulo Gegapagre", "role": "author"}])
    assert len(places) == 4 * 8000 and time.time() - began < 20


def test_a_repeated_record_id_is_redacted_row_by_row(spark):
    rows = [(1, "fale com rh@a.example", None), (1, "sem nada", None), (1, "fale com rh@a.example", None), (None, "(20)3068-6009", None)]
    df = spark.createDataFrame(rows, "record_id long, content string, people array<struct<role:string,name:string>>")
    assert sorted((r["content"], r["n_places"]) for r in personal.redact(df).collect()) == [("[phone]", 1), ("fale com [email]", 1), ("fale com [email]", 1), ("sem nada", 0)]
