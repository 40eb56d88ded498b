"""Names as people type them: cleaning, tokens, and what the corpus itself says about tokens (for problems 2 and 5)."""

from __future__ import annotations

import functools
import re
import unicodedata
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.arrow import arrow_column
from weftline.plans.lineage import cut

#: Names of nobody, titles, and words that make a name an organisation's (lines of business by their stems).
PLACEHOLDERS = {"eu", "voce", "desconhecido", "me", "you", "yo", "unknown", "desconocido", "anonimo"}
TITLES = {"dr", "dra", "eng", "enga", "prof", "profa", "sr", "sra", "mr", "mrs", "ms"}
LEGAL = {"ltda", "ltd", "sa", "eireli", "me", "epp", "inc", "cia", "grupo", "group", "llc", "gmbh", "corp", "mei"}
BUSINESS = ("alimentos", "comercio", "construtora", "consultoria", "engenharia", "industria", "logistica", "servicos", "sistemas", "solucoes", "tecnologia", "transportes")
#: A token is common (a given name, a middle name, a word) if it stands beside so many different tokens at least.
COMMON = 9
#: The most common tokens that may be sent to executors (some 20 bytes each); more than any language has, and an error beyond.
LEXICON_ROWS = 1_000_000

_WORD = re.compile(r"[^\W\d_]+")
_ODD = {"Cf", "So", "Sk", "Sm", "Mn", "Me", "Cs", "Co", "Cn"}


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def _mended(pair: re.Match) -> str:
    """Two characters that were one character's two bytes, read as Western text."""
    for encoding in ("cp1252", "latin-1"):
        try:
            return pair.group().encode(encoding).decode("utf-8")
        except UnicodeError:
            continue
    return pair.group()


def clean(name: str) -> str:
    """Without decoration: broken encodings mended, brackets, emoji, marks and invisible characters gone."""
    if "Ã" in name or "Â" in name:
        name = re.sub("[ÂÃ].", _mended, name, flags=re.S)
    name = re.sub(r"\[[^\]]*\]|\([^)]*\)", " ", unicodedata.normalize("NFKC", name))
    name = "".join(" " if unicodedata.category(c) in ("So", "Sk", "Sm") or c == "~" else c for c in name if unicodedata.category(c) not in ("Cf", "Cs", "Co", "Cn"))
    return " ".join(name.split())


def words(name: str) -> list[str]:
    """Folded tokens of a name in natural order: `Surname, Given` is turned round, `GivenSurname` cut, `S/A` one token."""
    name = re.sub(r"(?i)\bS\s?[./]\s?A\b\.?", "SA", clean(name))
    if " " not in name:
        name = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])", " ", name)
    before, comma, after = name.partition(",")
    if comma and after.strip():
        name = f"{after} {before}"
    return _WORD.findall(fold(name))


def is_business(token: str) -> bool:
    """Whether a token says that a name is an organisation's; lines of business may be cut short."""
    if token in LEGAL:
        return True
    short = token.rstrip("a") if len(token) == 4 else token
    return len(token) >= 3 and any(line.startswith(short if len(short) >= 3 else token) or (len(token) >= 6 and token.startswith(line[:6])) for line in BUSINESS)


@functools.lru_cache(maxsize=200_000)
def near(a: str, b: str) -> int:
    """Edit distance of two tokens, a swap of neighbours counting once; 3 stands for more than 2."""
    if abs(len(a) - len(b)) > 2:
        return 3
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return min(3, one[-1])


def _shortened(token: str) -> set[str]:
    """A token, and what is left of it without any one of its letters."""
    return {token, *(token[:i] + token[i + 1 :] for i in range(len(token)))}


def is_short_form(token: str, given: str) -> bool:
    """Whether a token is a diminutive of a given name, or some of its letters in order (Thi, Cela, Digo)."""
    if token == given or len(token) < 2:
        return False
    for ending in ("inho", "inha"):
        if token.endswith(ending):
            stem = token[: -len(ending)]
            return len(stem) >= 2 and stem in given and given[-1] != ("a" if ending == "inho" else "o")
    if len(token) <= 5 and len(token) < len(given):
        letters = iter(given)
        return given.startswith(token) or (len(token) >= 4 and given.startswith(token[:-1])) or (len(token) >= 3 and all(c in letters for c in token))
    return False


class Parsed(NamedTuple):
    """A name taken apart: kind `person`, `business` or `single`; how its given name is written; its telling tokens."""

    kind: str
    given: str
    written: str
    rare: tuple[str, ...]


class Lexicon:
    """Given names, other common tokens and common surnames of the corpus; a surname isn't in `common`, so it tells people apart."""

    def __init__(self, givens: set[str], common: set[str], surnames: set[str] = frozenset()):
        self.givens, self.surnames = givens, surnames - givens
        self.common = (common | givens) - self.surnames
        self.shorts: dict[str, str] = {}  # short forms that the corpus itself shows, by what they are short for
        self._typed: dict[str, str] = {}
        self._short: dict[str, bool] = {}
        self._cut: dict[str, list[str]] = {}

    def typed(self, token: str) -> str:
        """The given name that a token is, or is within one typing error of; empty if none or several."""
        if token in self.givens:
            return token
        if len(token) < 4 or token in self.common or token in self.surnames:
            return ""
        known = self._typed.get(token)
        if known is None:
            if not self._cut:  # names an error away have a form in common with one letter left out of either or both
                for given in self.givens:
                    for form in _shortened(given) if len(given) >= 4 else ():
                        self._cut.setdefault(form, []).append(given)
            close = [g for g in {g for form in _shortened(token) for g in self._cut.get(form, ())} if near(token, g) == 1]
            known = self._typed[token] = close[0] if len(close) == 1 else ""
        return known

    def short(self, token: str) -> bool:
        """Whether a token is a short form of any given name."""
        if token not in self._short:
            self._short[token] = any(is_short_form(token, g) for g in self.givens)
        return self._short[token]

    def parse(self, name: str) -> Parsed | None:
        """None for names of nobody: placeholders, blanks, given names alone."""
        tokens = words(name)
        if len(tokens) > 2 and tokens[0] in TITLES:
            tokens = tokens[1:]
        if not tokens or (len(tokens) == 1 and (tokens[0] in PLACEHOLDERS or tokens[0] in self.givens or len(tokens[0]) < 4)):
            return None
        if len(tokens) == 1:
            return Parsed("single", "", "", (tokens[0],))
        given = next((t for t in tokens if t in self.givens), "")
        if not given:
            if any(is_business(t) for t in tokens):
                rare = tuple(t for t in tokens if not is_business(t) and len(t) > 2)
                return Parsed("business", "", "", rare) if rare else None
            learned = next((t for t in tokens if t in self.shorts), "")
            rest = tuple(t for t in tokens if t != learned and len(t) > 2 and t not in self.common)
            if learned and rest:
                return Parsed("person", self.shorts[learned], "short", rest)
            typed = next((t for t in tokens if self.typed(t)), "")
            if typed:
                rest = tuple(t for t in tokens if t != typed and len(t) > 2 and t not in self.common)
                return Parsed("person", self.typed(typed), "typed", rest or tuple(t for t in tokens if t != typed and len(t) > 2)) if len(tokens) > 1 else None
            short = next((t for t in tokens if 1 < len(t) <= 9 and self.short(t)), "")
            if short:
                rare = tuple(t for t in tokens if t != short and len(t) > 2 and t not in self.common)
                if rare:
                    return Parsed("person", short, "short", rare)
            initial = next((t for t in tokens if len(t) == 1), "")
            rare = tuple(t for t in tokens if len(t) > 2 and t not in self.common)
            if len(rare) == 1 and len(tokens) == 2 and not initial and len(tokens[0]) == 2:
                return Parsed("person", tokens[0], "short", rare)  # two letters before a surname stand for a name
            return Parsed("person", initial, "initial" if initial else "", rare) if rare else None
        rest = tuple(t for t in tokens if t != given and len(t) > 2 and t not in self.common) or tuple(t for t in tokens if t != given and len(t) > 2)
        return Parsed("person", given, "full", rest) if rest else None


def _tokens(names: pa.Array) -> pa.Array:
    return pa.array([words(n) if n else [] for n in names.to_pylist()], type=pa.list_(pa.string()))


def _business(tokens: pa.Array) -> pa.Array:
    return pa.array([is_business(t) for t in tokens.to_pylist()], type=pa.bool_())


def name_tokens(names: DataFrame) -> DataFrame:
    """name, tokens of distinct strings in a column `name`."""
    return names.select("name", arrow_column(_tokens, T.ArrayType(T.StringType()), "name").alias("tokens"))


def learn(names: DataFrame, alone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Common tokens (token, is_given, is_surname) and the distinct telling ones (token) of distinct `names`; `alone` are given names seen alone.

    A given name stands beside many different tokens and mostly first; nothing is counted more than once a string. What counts
    as many grows with the corpus: a quarter of what given names seen alone stand beside. A common token that ends names more
    often than it stands inside them is a surname, shared by many or typed in many ways, and tells as much as a rare one.
    """
    tokens = cut(name_tokens(names))
    several = tokens.where(F.size("tokens") > 1).select("name", F.posexplode("tokens").alias("at", "token"), "tokens")
    beside = several.select("token", F.explode("tokens").alias("other")).where("token <> other").distinct().groupBy("token").agg(F.count("*").alias("n"))
    ends = F.avg((F.col("at") == F.size("tokens") - 1).cast("double"))
    first = several.groupBy("token").agg(F.avg((F.col("at") == 0).cast("double")).alias("first"), ends.alias("last"))
    single = name_tokens(alone).where(F.size("tokens") == 1).select(F.col("tokens")[0].alias("token")).distinct().withColumn("alone", F.lit(True))
    facts = cut(beside.join(first, "token").join(single, "token", "full").where(F.length("token") >= 3).withColumn("n", F.coalesce("n", F.lit(0))))
    usual = facts.where("alone").agg(F.percentile_approx("n", 0.5)).first()[0] or 0
    least = max(COMMON, usual // 4)
    # written in full a given name stands beside about as many tokens as the others do; nicknames beside far fewer
    given = F.coalesce(F.col("alone"), (F.col("first") > 0.5) & (F.col("n") >= usual / 2))
    nickname = F.col("alone").isNull() & (F.col("first") > 0.5) & (F.col("n") < usual / 2)
    business = arrow_column(_business, T.BooleanType(), "token")
    inside = 1 - F.col("first") - F.col("last")
    surname = F.col("alone").isNull() & (F.col("first") <= 0.5) & (F.col("last") > inside) & ~business
    common = cut(facts.where(((F.col("n") >= least) & ~F.coalesce(nickname, F.lit(False))) | F.col("alone")).select("token", given.alias("is_given"), F.coalesce(surname, F.lit(False)).alias("is_surname"), "n"))
    rare = several.select("token").distinct().where(F.length("token") > 3).join(common.where("not is_surname").select("token"), "token", "left_anti")
    return common, rare


def lexicon(common: DataFrame) -> Lexicon:
    """The common tokens on the driver, to be sent to executors: short strings, an error if they are more than LEXICON_ROWS."""
    rows = common.limit(LEXICON_ROWS + 1).collect()
    if len(rows) > LEXICON_ROWS:
        raise ValueError(f"more than {LEXICON_ROWS} common tokens in names; raise people.LEXICON_ROWS")
    givens = {r["token"] for r in rows if r["is_given"] and not is_business(r["token"]) and r["token"] not in TITLES | PLACEHOLDERS}
    return Lexicon(givens, {r["token"] for r in rows}, {r["token"] for r in rows if r["is_surname"]})
