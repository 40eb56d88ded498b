"""Personal information in free text, found and replaced by typed placeholders (problem 5).

Text is first read through transducers that undo disguises and remember where every character came from: invisible
characters and combining marks are dropped, homoglyphs, full-width digits, odd spaces and hyphens become their plain
counterparts, HTML entities are decoded, `(arroba)`, `[at]`, ` @ `, `(ponto)` and `[dot]` become `@` and `.`, and runs of
spelled digits become digits. Detectors run on the plain text; what they find is mapped back to characters of the source.

* email: an address mail can be sent to; `git@host:path` and `package@1.2.3` are none.
* phone: international, area code in brackets or not, local `555-0123`; starts at +, bracket or first digit.
* id_number: the shapes of tax, identity and social security numbers; bare digits and passport numbers behind a word that names them.
* address: street type, name and number, or number, name and street type.
* name: any person's name of the row's people, as spelled there; a given name beside a surname. Given names and surnames are
  those that the corpus's own people have; surnames are looked up by a join, as they grow with the corpus.
"""

from __future__ import annotations

import bisect
import functools
import html
import itertools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.arrow import arrow_column
from weftline.llm.people import Lexicon, fold, is_business, learn, lexicon
from weftline.plans.lineage import cut
from weftline.plans.sizes import small_side
from weftline.sources.tables import table

#: Letters of other scripts that look Latin, and what they look like.
LOOKALIKES = dict(zip("аеорсухіѕјһԁԛԝАВЕКМНОРСТУХІЅЈαοενικρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxisjhdqwABEKMHOPCTYXISJaoevikptuxABEZHIKMNOPTYX"))
#: Digits spelled in Portuguese, Spanish and English.
SPELLED = {"zero": 0, "um": 1, "uma": 1, "dois": 2, "duas": 2, "três": 3, "tres": 3, "quatro": 4, "cinco": 5, "seis": 6, "meia": 6, "sete": 7, "oito": 8, "nove": 9, "cero": 0, "uno": 1, "dos": 2, "cuatro": 4, "siete": 7, "ocho": 8, "nueve": 9, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9}
PLACEHOLDER = {"email": "[email]", "phone": "[phone]", "id_number": "[id_number]", "address": "[address]", "name": "[name]"}

_PLAIN = {ord(k): v for k, v in LOOKALIKES.items()}
_PLAIN |= {c: "-" for c in (0x2010, 0x2011, 0x2012, 0x2013, 0x2212, 0xFE63, 0xFF0D)} | {c: " " for c in (0xA0, 0x2007, 0x2009, 0x202F, 0x3000)}
_PLAIN |= {0xFF01 + i: chr(0x21 + i) for i in range(94)} | {0xFE6B: "@"}
_UNPLAIN = re.compile("[" + "".join(map(chr, _PLAIN)) + "]")
_HIDDEN = re.compile("[­​-‏⁠-⁤﻿̀-ͯ]")
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);")
_AT = re.compile(r"\s*[\[({<]\s*(?:at|arroba)\s*[\])}>]\s*|(?<=[\w+-])\s+@\s+(?=[\w-]+[.\s\[({])|\s+(?:arroba|at)\s+(?=[\w-]+\s*(?:[\[({]\s*(?:dot|ponto|punto)\s*[\])}]|\s(?:dot|ponto|punto)\s))", re.I)
_MAY_AT = re.compile(r"@|arroba|[\s\[({<]at[\s\])}>]")
_DOT = re.compile(r"\s*[\[({<]\s*(?:dot|ponto|punto)\s*[\])}>]\s*", re.I)
_SPOKEN_DOT = re.compile(r"(?<=\w)\s+(?:dot|ponto|punto)\s+(?=\w)", re.I)
_DOMAIN = re.compile(r"(?<=.)@\w[\w-]*(?:\s+(?:dot|ponto|punto)\s+\w+|\.\w+)*", re.I | re.S)
_PLAIN_DOMAIN = re.compile(r"(?<=\w)@\w[\w-]*(?:\s+(?:dot|ponto|punto)\s+\w+)*", re.I)
_RUN = re.compile(r"\b(?:(?:" + "|".join(SPELLED) + r")[\s,.-]+){5,}(?:" + "|".join(SPELLED) + r")\b", re.I)

_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9](?:[\w.+%-]*\w)?@(?>(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})(?![\w@])(?!:[^\s:]*/)", re.A)
_FREE = r"(?<![\w+/=.,-])"
_PHONE = re.compile(
    _FREE + r"(?:\+\d{1,3}[ .-]?(?:\(\d{2,3}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,3}|\(\d{2,3}\) ?9?\d{4}[ -]?\d{4}|0\d{2} 9 \d{4} \d{4}|0\d{4} \d{6}|\d{2}[ .]9\d{4}[ .-]?\d{4}|\d{2}[ .]\d{4}-\d{4}|\d{3}-\d{4})(?![\w-]|[.,]\d)"
)
_SHAPED = re.compile(_FREE + r"(?:\d{3}\.\d{3}\.\d{3}-\d{2}|\d{3} \d{3} \d{3} \d{2}|\d{2}\.\d{3}\.\d{3}-[\dXx]|\d{9}-\d{2}|\d{3}-\d{2}-\d{4})(?![\w-]|[.,]\d)")
#: Words before a number that number something else than a person.
OTHER_NUMBERS = ("nota fiscal", "pedido", "protocolo", "chamado", "build", "timestamp", "host", "invoice", "order", "factura")
_LONGEST_OTHER = max(map(len, OTHER_NUMBERS))
#: Words before the name of a street, words behind it, and words that name a number.
STREETS = ("rua", "r.", "avenida", "av.", "travessa", "tv.", "praça", "praca", "alameda", "al.", "rodovia", "estrada", "largo", "calle", "plaza")
ENGLISH_STREETS = ("rd", "road", "st", "street", "lane", "ln", "avenue", "ave", "drive", "way", "court", "close", "boulevard", "blvd", "terrace", "square")
#: Words that make what stands beside a street word a phrase, if it has no capital.
PHRASE_WORDS = {"sem", "no", "na", "nos", "nas", "em", "com", "para", "pra", "por", "pelo", "pela", "que", "sin", "en", "con", "in", "on", "to", "the", "of", "at", "by", "for", "from", "with", "and", "that", "is", "are"}
NUMBER_WORDS = ("cpf", "rg", "ssn", "doc", "documento", "identidade", "identidad", "passaporte", "passport", "pasaporte", "dni", "nif", "nie", "id card", "social security")
_TOLD = re.compile(rf"(?:\b(?:{'|'.join(NUMBER_WORDS)})\b)[\s:#]*(?:(?:n[º°o.]+|ºn|number|n[úu]mero)\s*)?[\s:]*((?:[A-Z]{{1,3}}\d{{6,9}}|\d{{7,11}}-?[\dXx]?))(?![\w-])", re.I)
_STREET = re.compile(rf"(?<![\w.])(?:{'|'.join(map(re.escape, STREETS))})\s+((?:[^\W\d_]+\.?\s+){{0,4}}[^\W\d_]+)\s*,?\s+(?:n[º°o]?\.?\s*)?\d{{1,5}}(?!\w)", re.I)
_ENGLISH_STREET = re.compile(rf"(?<![\w./-])\d{{1,5}}\s+((?:[^\W\d_]+\s+){{1,3}})(?:{'|'.join(ENGLISH_STREETS)})(?!\w)", re.I)
#: Words either way that a clause is looked through for capitals.
CLAUSE_WORDS = 12
_CLAUSE_ENDS = frozenset(".!?:;,()\n")
_LONG_NUMBER = re.compile(r"\d[\d .()-]{6,}[\dXx]")

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("check", T.StringType())])
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("check", pa.string())])


class _Domains:
    """A dot for each spoken dot that continues the domain behind the last @ before it. Asked from left to right."""

    def __init__(self, text: str, domain: re.Pattern):
        self.text, self.domain, self.at, self.seen = text, domain, -1, 0

    def __call__(self, m: re.Match) -> str:
        last = self.text.rfind("@", self.seen, m.start())
        self.at, self.seen = last if last >= 0 else self.at, m.start()
        return "." if self.at >= 0 and self.domain.fullmatch(self.text, self.at, m.start()) else m.group()


class Plain:
    """A text without its disguises, and for each place where they differ what it came from."""

    def __init__(self, text: str):
        self.text = text.translate(_PLAIN) if not text.isascii() and _UNPLAIN.search(text) else text
        self.stages: list[tuple[list[int], list[int]]] = []
        if _HIDDEN.search(self.text):
            self._replace(_HIDDEN, lambda m: "")
        if "&" in self.text:
            self._replace(_ENTITY, lambda m: html.unescape(m.group()))
        if _MAY_AT.search(self.text.lower()):
            before = self.text
            self._replace(_AT, lambda m: "@")
            self._replace(_DOT, lambda m: ".")
            if "@" in self.text:  # where nothing is disguised, words behind a domain with a plain dot are none of it
                self._replace(_SPOKEN_DOT, _Domains(self.text, _DOMAIN if self.text != before else _PLAIN_DOMAIN))

    def spell(self) -> None:
        """Runs of spelled digits become digits."""
        self._replace(_RUN, lambda m: "".join(str(SPELLED[w.lower()]) for w in re.findall(r"[^\W\d_]+", m.group())))

    def _replace(self, pattern: re.Pattern, by) -> None:
        out, starts, sources, at, size = [], [0], [0], 0, 0
        for m in pattern.finditer(self.text):
            new = by(m)
            if new == m.group():
                continue
            out += [self.text[at : m.start()], new]
            size += m.start() - at
            starts += [size, size + len(new)]
            sources += [m.start(), m.end()]
            size += len(new)
            at = m.end()
        if out:
            self.text = "".join(out) + self.text[at:]
            self.stages.append((starts, sources))

    def source(self, at: int) -> int:
        """Where a character of the plain text begins in the source."""
        for starts, sources in reversed(self.stages):
            i = bisect.bisect_right(starts, at) - 1
            at = sources[i] + (at - starts[i]) if i + 1 == len(starts) or sources[i] + (at - starts[i]) <= sources[i + 1] else sources[i]
        return at


def _clause(body: str, start: int, end: int) -> tuple[int, int]:
    """The clause around a place, as far as CLAUSE_WORDS words either way."""
    words, low = 0, start
    while low and body[low - 1] not in _CLAUSE_ENDS and words <= CLAUSE_WORDS:
        low -= 1
        words += body[low].isspace() and not body[low - 1 : low].isspace()
    words, high = 0, end
    while high < len(body) and body[high] not in _CLAUSE_ENDS and words <= CLAUSE_WORDS:
        words += body[high].isspace() and not body[high - 1].isspace()
        high += 1
    return low, high


def _uncapitalised(body: str, street: re.Match) -> bool:
    """Whether a street name has no capital because the clause around it has none."""
    if any(w.lower() in PHRASE_WORDS for w in street.group(1).split()):
        return False
    start, end = _clause(body, *street.span())
    return not any(c.isupper() for c in body[start:end])


def _named_otherwise(body: str, at: int) -> bool:
    """Whether a word right before a number says that it numbers something else."""
    while at and body[at - 1].isspace():
        at -= 1
    while at and body[at - 1] in "#:nNº°.":
        at -= 1
    while at and body[at - 1].isspace():
        at -= 1
    return body[max(0, at - _LONGEST_OTHER) : at].lower().endswith(OTHER_NUMBERS)


class Taken:
    """Places held so far, none over another; asks and adds in the logarithm of their number."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.starts, end)
        return i == 0 or self.ends[i - 1] <= start

    def add(self, start: int, end: int) -> None:
        i = bisect.bisect_left(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


@functools.lru_cache(maxsize=200_000)
def _spelling(name: str) -> re.Pattern | None:
    """Finds one spelling of a name in folded text, whatever the spaces."""
    parts = fold(name.translate(_PLAIN)).split()
    return re.compile(r"(?<!\w)" + r"\s+".join(re.escape(p) for p in parts) + r"(?!\w)") if parts else None


def _folded(text: str) -> str:
    """Lower case without accents, character by character, so that places stay."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return lower if lower.isascii() else lower.translate(_ACCENTS)


class _Accents(dict):
    def __missing__(self, code: int) -> int:
        plain = unicodedata.normalize("NFKD", chr(code))
        bare = [c for c in plain if not unicodedata.combining(c)]
        self[code] = ord(bare[0]) if len(bare) == 1 and code > 127 else code
        return self[code]


_ACCENTS = _Accents()
_NEXT = re.compile(r"[ \t\xa0]+((?:[^\W\d_]\.|[^\W\d_]{2,}))")


class Detector:
    """All detectors, with the corpus's given names."""

    def __init__(self, known: Lexicon):
        import ahocorasick

        self.known = known
        self.automaton = ahocorasick.Automaton()
        cues = {_folded(w): ("street", _folded(w)) for w in STREETS} | {w: ("english street", w) for w in ENGLISH_STREETS} | {w: ("number", w) for w in NUMBER_WORDS} | {_folded(w): ("spelled", _folded(w)) for w in SPELLED}
        for word, cue in (cues | {g: ("given", g) for g in known.givens}).items():
            self.automaton.add_word(word, cue)
        self._persons: dict[tuple[str, str | None], str | None] = {}
        self.automaton.make_automaton()

    def person(self, name: str | None, role: str | None) -> str | None:
        """How far a string names a person: '' surely, a token to look up, or None for not."""
        if (name, role) not in self._persons:
            if len(self._persons) > 200_000:
                self._persons.clear()
            self._persons[name, role] = self._person(name, role)
        return self._persons[name, role]

    def _person(self, name: str | None, role: str | None) -> str | None:
        parsed = self.known.parse(name) if name and name.strip() else None
        if parsed is None or parsed.kind == "business":
            return None
        if parsed.kind == "single":
            token = parsed.rare[0]
            return token[1:] if name.strip().islower() and len(token) > 4 else None
        if role == "conversation" and (any(c.isdigit() for c in name) or parsed.written not in ("full", "typed", "initial", "short")):
            return parsed.rare[0] if not any(c.isdigit() for c in name) else None
        return ""

    def cues(self, folded: str) -> tuple[dict[str, int], list[tuple[int, int]]]:
        """Kinds of cues in a text and how often they stand in it as words, and where given names stand: one pass."""
        kinds: dict[str, int] = {}
        givens = []
        for end, (kind, word) in self.automaton.iter(folded):
            start, end = end + 1 - len(word), end + 1
            if start and (folded[start - 1].isalnum() or folded[start - 1] == "_"):
                continue
            if kind != "given":
                kinds[kind] = kinds.get(kind, 0) + 1
            elif not (start and folded[start - 1] == "@") and not (end < len(folded) and (folded[end].isalnum() or folded[end] in "_@")):
                givens.append((start, end))
        return kinds, givens

    def names(self, plain: str, folded: str, people: list[dict], givens: list[tuple[int, int]], spans: list[tuple[str, int, int, str | None]]) -> None:
        taken: list[tuple[int, int]] = []
        for name, role in {(p["name"], p["role"]) for p in people or [] if p and p["name"]}:
            check = self.person(name, role)
            if check is None:
                continue
            pattern = _spelling(name)
            for m in pattern.finditer(folded) if pattern else ():
                taken.append(m.span())
                spans.append(("name", m.start(), m.end(), check or None))
        taken.sort()
        reach = list(itertools.accumulate((b for _, b in taken), max))  # how far those that begin up to here go
        for start, end in givens:
            i = bisect.bisect_right(taken, (start, len(plain)))
            if not (i and end <= reach[i - 1]):
                found = self._beside(plain, folded, start, end)
                if found:
                    spans.append(("name", *found))

    def _beside(self, plain: str, folded: str, start: int, end: int) -> tuple[int, int, str | None] | None:
        """A surname behind a given name, past middle names and initials; or before it, with a comma."""
        at = end
        for _ in range(3):
            m = _NEXT.match(plain, at)
            if not m:
                break
            token = _folded(m.group(1)).rstrip(".")
            if len(token) == 1 and m.group(1).endswith("."):
                at = m.end()
                continue
            if token in self.known.givens or is_business(token):
                break
            if token in self.known.common:
                at = m.end()  # a middle name, if a surname follows
                continue
            return start, m.end(), token
        at = start
        while at and plain[at - 1] in " \t\xa0":
            at -= 1
        if at < start and at and plain[at - 1] == ",":
            stop = at = at - 1
            while at and plain[at - 1].isalpha():
                at -= 1
            token = _folded(plain[at:stop])
            if stop - at >= 3 and token not in self.known.common:
                return at, end, token
        return None

    def find(self, text: str, people: list[dict] | None) -> list[tuple[str, int, int, str | None]]:
        plain = Plain(text)
        folded = _folded(plain.text)
        kinds, givens = self.cues(folded)
        if kinds.get("spelled", 0) > 5 and _RUN.search(plain.text):
            plain.spell()
            folded = _folded(plain.text)
            kinds, givens = self.cues(folded)
        body = plain.text
        mails = [m.span() for m in _EMAIL.finditer(body)] if "@" in body else []
        spans: list[tuple[str, int, int, str | None]] = [("email", a, b, None) for a, b in mails]
        taken, held = Taken(), Taken()
        for a, b in mails:
            taken.add(a, b)
            held.add(a, b)
        numbers: list[tuple[str, int, int, str | None]] = []
        long_number = bool(_LONG_NUMBER.search(body))
        if "number" in kinds:
            numbers += [("id_number", *m.span(1), None) for m in _TOLD.finditer(body)]
        if long_number:
            numbers += [("id_number", *m.span(), None) for m in _SHAPED.finditer(body) if not _named_otherwise(body, m.start())]
        streets = [m for kind, pattern in (("street", _STREET), ("english street", _ENGLISH_STREET)) if kind in kinds for m in pattern.finditer(body)]
        numbers += [("address", *m.span(), None) for m in streets if any(w[0].isupper() for w in m.group(1).split()) or _uncapitalised(body, m)]
        if long_number:
            numbers += [("phone", *m.span(), None) for m in _PHONE.finditer(body) if not _named_otherwise(body, m.start())]
        for span in numbers:  # of overlapping ones the kind that is named first above stays
            if taken.free(span[1], span[2]):
                taken.add(span[1], span[2])
                spans.append(span)
        named: list[tuple[str, int, int, str | None]] = []
        self.names(body, folded, people or [], givens, named)
        for span in sorted(named, key=lambda s: (s[1], s[1] - s[2], s[3] is not None)):
            if held.free(span[1], span[2]):
                held.add(span[1], span[2])
                spans.append(span)
        return sorted((kind, plain.source(a), plain.source(b - 1) + 1, check) for kind, a, b, check in spans)


@functools.lru_cache(maxsize=2)
def _detector(key: str, lists) -> Detector:
    return Detector(lists.value)


class _Lists:
    """A broadcast lexicon that caches may be keyed by."""

    def __init__(self, shared, key: str):
        self.shared, self.key = shared, key

    def __hash__(self) -> int:
        return hash(self.key)

    def __eq__(self, other) -> bool:
        return self.key == other.key

    @property
    def value(self) -> Lexicon:
        return self.shared.value


def _found(rows: pa.Array, lists: _Lists) -> pa.Array:
    find = _detector(lists.key, lists).find
    texts, people = (rows.field(i).to_pylist() for i in range(2))
    out = [[dict(zip(("kind", "start", "end", "check"), s)) for s in find(t, p)] if t else [] for t, p in zip(texts, people)]
    return pa.array(out, type=pa.list_(_SPAN))


def spans(records: DataFrame) -> DataFrame:
    """record_id, kind, start_at, end_at of every place with personal information.

    `records` has record_id, content, people. Null or empty content: no places. Null people, null names and roles: ignored.
    Repeated rows have their places each. Very long contents are read whole. An empty table gives no rows.
    """
    people = records.select(F.explode("people").alias("p")).select(F.col("p.name").alias("name"), F.col("p.role").alias("role")).where("name is not null").distinct()
    people = cut(people)
    common, rare = learn(people.where("role <> 'conversation'").select("name").distinct(), people.where("role = 'mentioned'").select("name").distinct())
    known = lexicon(common)
    context = records.sparkSession.sparkContext
    lists = _Lists(context.broadcast(known), f"{context.applicationId}/{id(known)}/{len(known.common)}")
    places = arrow_column(functools.partial(_found, lists=lists), T.ArrayType(SPAN), F.struct("content", "people"))
    keys = [c for c in ("record_id", "_row") if c in records.columns]
    found = records.where(F.length("content") > 0).select(*keys, F.explode(places).alias("s"))
    found = cut(found.select(*keys, "s.kind", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), "s.check"))
    sure = found.where("check is null").drop("check")
    told = found.where("check is not null").join(small_side(cut(rare.select(F.col("token").alias("check")))), "check", "left_semi").drop("check")
    return sure.unionByName(told)


def _redacted(rows: pa.Array) -> pa.Array:
    out = []
    for text, places in zip(*(rows.field(i).to_pylist() for i in range(2))):
        parts, at = [], 0
        for place in sorted(places or [], key=lambda p: (p["start_at"], -p["end_at"])):
            if place["start_at"] >= at:
                parts += [text[at : place["start_at"]], PLACEHOLDER[place["kind"]]]
                at = place["end_at"]
        out.append(text if text is None else "".join(parts) + text[at:])
    return pa.array(out, type=pa.string())


def redact(records: DataFrame) -> DataFrame:
    """`records` with `content` made readable without personal information, and `n_places` replaced in it.

    A row is known by its record_id, content and people, so a repeated record_id does no harm; other columns stay. Contents
    without places, null and empty ones are unchanged.
    """
    marked = records.withColumn("_row", F.xxhash64("record_id", "content", F.to_json("people")))
    by_row = spans(marked.select("record_id", "content", "people", "_row")).groupBy("_row").agg(F.collect_set(F.struct("kind", "start_at", "end_at")).alias("_places"))
    joined = marked.join(by_row, "_row", "left")
    return joined.withColumn("content", arrow_column(_redacted, T.StringType(), F.struct("content", "_places"))).withColumn("n_places", F.coalesce(F.size("_places"), F.lit(0))).drop("_places", "_row")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "records").select("record_id", "content", "people")).select("record_id", "kind", F.col("start_at").cast("bigint"))


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(table(spark, sf_dir, "records").select("record_id", "content", "people"))
