"""Scalar functions on hand-made cases."""

from __future__ import annotations

import calendar
import html
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions import vectors as V
from weftline.functions.chunking import spans_of
from weftline.functions.dates import DayRange, day_range


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("function", "text", "expected"), [
    (X.fold, "Maçã ÍNDIGO", "maca indigo"), (X.name_key, "Cassyo", "casio"), (X.name_key, "  Ottoni   Kelly ", "otoni keli"),
    (X.name_from_email, "lia_borba.nunes@quintal.test", "lia borba nunes"), (X.name_from_email, "7g2@quintal.test", ""), (X.name_from_email, "l.b@quintal.test", ""), (X.name_from_email, "sem arroba", ""),
    (X.headline, "\t\n \n  um título  \nresto", "um título"), (X.headline, " \n ", ""),
    (X.html_to_text, "<div>linha <i>um</i></div>dois", "linha um\ndois"), (X.html_to_text, "<style>p{}</style>x &lt;y&gt;", "x <y>"),
    (X.html_to_text, '<p>concordo</p><blockquote><strong itemprop="mri">Lia</strong> vamos?</blockquote>', "concordo\n↪ em resposta a Lia: vamos?"),
    (X.html_to_text, 'oi <span class="m" itemtype="http://s/Mention">Rui</span>!', "oi @Rui!"),
    (X.strip_url, "https://q.test/a?state=1&aba=2&X-Goog-Date=3#f", "https://q.test/a?aba=2#f"), (X.strip_url, "https://q.test/a?sig=9", "https://q.test/a"), (X.strip_url, "https://q.test/", "https://q.test/"),
    (X.redact_credentials, "t glpat-abcdefghijklmnop. fim", "t [redacted:gitlab-token]. fim"),
    (X.redact_credentials, "a-----BEGIN PRIVATE KEY-----1\f2-----END PRIVATE KEY-----b-----BEGIN EC PRIVATE KEY-----3\f4\f5-----END EC PRIVATE KEY-----c", "a[redacted:private-key]\fb[redacted:private-key]\f\fc"),
    (X.mask_key, "duas palavras", "<text>"), (X.mask_key, "00412", "<id>"), (X.mask_key, "a:b", "<id>"), (X.mask_key, "camposDoItem", "camposDoItem"), (X.mask_key, "k" * 32, "k" * 32), (X.mask_key, "k" * 33, "<id>"),
    (X.mask_name, "Loja:lia@quintal.test:1234567", "Loja:<email>:<n>"), (X.stable_prefix, "Loja:lia@quintal.test:1234567", "Loja:"), (X.stable_prefix, "Loja:v2", "Loja:v2"),
    (X.unescape_entities, "p&atilde;o &#36;5 &#x20AC;9 &hellip; &amp;lt; &copy2 &semnome; a&b & &#55296;", "pão $5 €9 … &lt; ©2 &semnome; a&b & �"),
])
def test_text(spark, function, text, expected):
    assert value(spark, function(F.lit(text))) == expected


def test_entities_against_the_standard_library(spark):
    from html.entities import html5

    rng = random.Random(8)
    names = sorted(html5)
    texts = ["".join(rng.choice([f"&{rng.choice(names)}", f"&#{rng.randrange(130, 0x24F)};", f"&#x{rng.randrange(0x400, 0x2FFF):x};", "texto ", "&", ";", "&zzz;"]) for _ in range(12)) for _ in range(60)]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.unescape_entities(F.col("t")).alias("u")).collect()
    assert all(r["u"] == html.unescape(r["t"]) for r in found if "&zzz" not in r["t"]) and len(found) == 60


def test_nulls_stay_null(spark):
    null = F.lit(None).cast("string")
    assert value(spark, X.fold(null)) is None and value(spark, X.html_to_text(null)) is None and value(spark, X.headline(null)) == "" and value(spark, X.redact_credentials(null)) is None and value(spark, X.unescape_entities(null)) is None


def test_pages_of_offsets(spark):
    text = "é\fçã\f\fx"
    pages = [value(spark, X.page_of(F.lit(text), F.lit(i))) for i in (0, 2, 3, 7, 8, 9)]
    assert pages == [1, 1, 2, 2, 3, 4]


def test_vectors(spark):
    code = value(spark, V.quantize(F.array(F.lit(-0.3), F.lit(0.15), F.lit(0.0))))
    assert code == [-127, 64, 0] and value(spark, V.quantize(F.array(F.lit(0.0), F.lit(0.0)))) == [0, 0]
    assert [round(x, 6) for x in value(spark, V.dequantize(F.array(F.lit(5), F.lit(12))))] == [0.384615, 0.923077]


TODAY = date(2028, 2, 29)  # a Tuesday


@pytest.mark.parametrize(("phrase", "first", "last"), [
    ("o que fiz ontem?", TODAY - timedelta(1), TODAY - timedelta(1)), ("anteontem", TODAY - timedelta(2), TODAY - timedelta(2)), ("Resumo de HOJE", TODAY, TODAY), ("the day before yesterday", TODAY - timedelta(2), TODAY - timedelta(2)),
    ("semana anterior", date(2028, 2, 21), date(2028, 2, 27)), ("nessa semana", date(2028, 2, 28), TODAY), ("past week", TODAY - timedelta(6), TODAY), ("últimos 10 dias", TODAY - timedelta(9), TODAY),
    ("previous month", date(2028, 1, 1), date(2028, 1, 31)), ("neste mês", date(2028, 2, 1), TODAY), ("last year", date(2027, 1, 1), date(2027, 12, 31)), ("este ano", date(2028, 1, 1), TODAY),
    ("em 2027-11-05", date(2027, 11, 5), date(2027, 11, 5)), ("7/1", date(2028, 1, 7), date(2028, 1, 7)), ("29/02", TODAY, TODAY), ("15/10", date(2027, 10, 15), date(2027, 10, 15)), ("3/4/26", date(2026, 4, 3), date(2026, 4, 3)),
    ("20 de dezembro", date(2027, 12, 20), date(2027, 12, 20)), ("on June 9th, 2025", date(2025, 6, 9), date(2025, 6, 9)), ("the 2nd of March", date(2027, 3, 2), date(2027, 3, 2)), ("hoje, não 1/2/27", date(2027, 2, 1), date(2027, 2, 1)),
])
def test_days(phrase, first, last):
    assert day_range(phrase, TODAY)[0] == DayRange(first, last)


@pytest.mark.parametrize("phrase", ["30/02/2027", "32/1", "hojeem dia", "últimos 0 dias", "they may 3 days", "13/13", "nada"])
def test_no_days(phrase):
    assert day_range(phrase, TODAY) is None


def test_every_day_of_a_year_is_read():
    for month in range(1, 13):
        for day in range(1, calendar.monthrange(2027, month)[1] + 1):
            assert day_range(f"{day}/{month}/2027", TODAY)[0].first == date(2027, month, day)


@pytest.mark.parametrize(("day", "zone", "hours"), [(date(2027, 3, 28), "Europe/Lisbon", 23), (date(2027, 10, 31), "Europe/Lisbon", 25), (date(2027, 5, 5), "UTC", 24)])
def test_days_of_other_lengths(day, zone, hours):
    start, end = DayRange(day, day).instants(zone)
    assert end.timestamp() - start.timestamp() == hours * 3600


def test_chunks_cover_and_stay_under_the_limit():
    text = ("# capa\n\n" + "trecho é ação 😀 " * 200 + "\f" + "x" * 3000 + "\f \f").encode()
    spans = spans_of(text)
    assert all(0 < end - start <= 1200 for start, end, _ in spans)
    assert all(b"\f" not in text[start:end] and text[start:end].decode() for start, end, _ in spans)
    assert {page for *_, page in spans} == {1, 2}
    assert spans_of(b"") == [(0, 0, 1)] and spans_of(b"\f") == [(0, 1, 1)]
