"""Variant spellings of names typed by people, linked to one person or organisation each (problem 2).

1. The distinct strings are taken apart (`people.Lexicon`): decoration, order, titles, middle names and lines of business
   are put aside; a given name (whole, mistyped, short or an initial) and a telling token (surname, brand) remain. Strings
   that come to the same parts are one node, however often they stand in the tables.
2. Telling tokens are compared by MinHash banding over their padded q-grams, after folding what sounds alike. The least
   similarity that still matters is that of the most typing errors accepted (`least_similarity`); the number of bands
   follows from the collision curve 1 - (1 - s^rows)^bands at the recall wanted. A crowded bucket meets itself in blocks.
3. Names meet on a telling token and on what their given names could have in common (`ways`): a surname of ten thousand
   people is no all-pairs problem. Candidates are verified by Monge-Elkan similarity: the best match of each token, where a
   given name may be met by its short form or initial but never by another given name, and telling tokens by up to two
   typing errors.
4. Star clustering: in order of rank (better written, more spellings, more frequent) a node without a greater centre beside
   it becomes a centre, the others are its satellites. Satellites join centres only, so errors do not chain; a node that
   fits two people equally (an initial before a surname that two people have) joins none.

A telling token met by several spellings is no typing error, so two such tokens that only look alike stay apart.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.arrow import arrow_column
from weftline.llm.people import LEXICON_ROWS, Lexicon, is_short_form, learn, lexicon, near, words
from weftline.plans.lineage import cut
from weftline.plans.sizes import by_shuffle
from weftline.sources.tables import table

#: Letters of a gram, the recall wanted of the least similarity, and rows of a band.
Q, RECALL, ROWS = 2, 0.95, 4
#: Typing errors accepted in tokens of so many letters at least.
ACCEPTED = {1: 5, 2: 7}
#: Surnames that must show what a word is short for, and the share of them that must agree.
SHORT_SEEN, SHORT_SHARE = 2, 0.95
#: Tokens of a bucket, and of a block of it, that meet each other at once.
BUCKET = 256
#: How well a name is written, best first.
QUALITY = {"full": 5, "business": 5, "typed": 4, "short": 3, "initial": 2, "single": 1, "": 0}

_PART = pa.struct([("token", pa.string()), ("given", pa.string()), ("written", pa.string()), ("sends", pa.list_(pa.string())), ("takes", pa.list_(pa.string()))])
PARSED = T.StructType([
    T.StructField("node", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("quality", T.IntegerType()), T.StructField("spelling", T.StringType()),
    T.StructField("parts", T.ArrayType(T.StructType([*(T.StructField(n, T.StringType()) for n in ("token", "given", "written")), *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("sends", "takes"))]))),
])
_PARSED = pa.struct([("node", pa.string()), ("kind", pa.string()), ("quality", pa.int32()), ("spelling", pa.string()), ("parts", pa.list_(_PART))])


def least_similarity(accepted: dict[int, int] = ACCEPTED, q: int = Q) -> float:
    """Jaccard similarity of the q-grams of two tokens as short as accepted with as many letters typed wrong."""
    found = []
    for errors, letters in accepted.items():
        grams, lost = letters + q - 1, errors * q
        found.append((grams - lost) / (grams + lost))
    return min(found)


def bands_for(similarity: float, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands by which a pair of this similarity shares one with the probability wanted."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def sound(token: str) -> str:
    """Letters that sound alike folded together."""
    token = re.sub("ph", "f", re.sub("th", "t", token)).translate(str.maketrans("yzkw", "iscv"))
    token = re.sub(r"(?<!^)h|^h(?=[aeiou])", "", token)
    return re.sub(r"(.)\1+", r"\1", token)


def ways(given: str, written: str, full: Callable[[str], list[str]]) -> tuple[list[str], list[str]]:
    """What a name sends to greater ones and takes from lesser ones: two names whose given names can stand for each other share one.

    Whole names meet equal ones and, by the letters an unknown word must share with them, possible nicknames; short forms
    meet what they are short for (`full`); initials meet first letters; a name without a given name meets all, as they are few.
    """
    if not given or written == "brand":
        return (["none"], ["none"]) if written == "brand" else (["none", "to any"], ["none", "from any"])
    if written in ("initial", "login"):
        return [f"initial to {given[0]}", f"initials {given[0]}", "from any"], [f"initial from {given[0]}", f"initials {given[0]}", "to any"]
    grams = {given[i : i + 2] for i in range(len(given) - 1)}
    same = [f"is {g}" for g in dict.fromkeys([given, *(full(given) if written == "short" else ())])]
    both = [[f"initial {way} {given[0]}", f"{any_way} any"] for way, any_way in (("from", "from"), ("to", "to"))]
    if written == "nick":
        return [*same, f"nick to {given[:2]}", f"nick end to {given[-2:]}", *both[0]], [*same, f"nick from {given[:2]}", f"nick end from {given[-2:]}", *both[1]]
    return [*same, *(f"nick from {g}" for g in grams), f"nick end from {given[-2:]}", *both[0]], [*same, *(f"nick to {g}" for g in grams), f"nick end to {given[-2:]}", *both[1]]


def _parse(names: pa.Array, known) -> pa.Array:
    known: Lexicon = known.value
    full = functools.lru_cache(maxsize=None)(lambda short: [g for g in known.givens if is_short_form(short, g)])
    meet = functools.lru_cache(maxsize=None)(lambda given, written: ways(given, written, full))
    out = []
    for name in names.to_pylist():
        parsed = known.parse(name) if name else None
        if parsed is None:
            out.append(None)
            continue
        kind, given, written, rare = parsed
        spelling = " ".join(sorted(words(name)))
        if kind == "single":
            token = rare[0]
            parts = [(sound(token), "", "brand")]
            if name.strip().islower() and len(token) > 5:
                parts.append((sound(token[1:]), token[0], "login"))
                parts += [(sound(token[len(g) :]), g, "joined") for g in known.givens if token.startswith(g) and len(token) - len(g) > 3]
            node, quality = f"single|{token}", QUALITY["single"]
        else:
            parts = [(sound(t), given, written) for t in dict.fromkeys(rare)]
            if kind == "person" and not written and len(parts) == 2:  # either may be a nickname of its own
                parts = [(sound(a), b, "nick") for a, b in (rare, rare[::-1])]
            quality = QUALITY["business" if kind == "business" else written]
            node = f"{kind}|{written if written in ('short', 'initial', '') else 'full'}|{given}|{' '.join(sorted({p[0] for p in parts}))}"
        out.append({"node": node, "kind": kind, "quality": quality, "spelling": spelling, "parts": [dict(zip(("token", "given", "written", "sends", "takes"), (*p, *meet(p[1], p[2])))) for p in parts]})
    return pa.array(out, type=_PARSED)


def _signatures(tokens: pa.Array, bands: int, rows: int, q: int) -> pa.Array:
    """A key for every band of every token: MinHash over its q-grams, padded so that both ends count."""
    from zlib import crc32

    rng = np.random.default_rng(20)
    a = rng.integers(1, 1 << 61, bands * rows, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 61, bands * rows, dtype=np.uint64)
    seeds = np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(40)
    keys = np.zeros((len(tokens), bands), dtype=np.int64)
    with np.errstate(over="ignore"):
        for i, token in enumerate(tokens.to_pylist()):
            padded = "\1" * (q - 1) + token + "\2" * (q - 1)
            grams = np.array(sorted({crc32(padded[k : k + q].encode()) for k in range(len(padded) - q + 1)}), dtype=np.uint64)
            hashes = grams[:, None] * a + b
            least = (hashes ^ (hashes >> np.uint64(29))).min(axis=0).reshape(bands, rows)
            mixed = seeds.copy()
            for row in range(rows):
                mixed = (mixed ^ least[:, row]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(32)
            keys[i] = mixed.view(np.int64)
    offsets = pa.array(np.arange(0, len(tokens) * bands + 1, bands, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))


def similar_tokens(tokens: DataFrame, similarity: float | None = None, recall: float = RECALL, rows: int = ROWS, bucket: int = BUCKET) -> DataFrame:
    """token, other, errors: distinct tokens up to two typing errors apart, both ways; each with itself.

    Buckets hold distinct tokens only, so a token of a third of all rows is one entry; a bucket of many is cut into blocks
    that meet each other in tasks of their own.
    """
    bands = bands_for(similarity or least_similarity(), recall, rows)
    signature = arrow_column(functools.partial(_signatures, bands=bands, rows=rows, q=Q), T.ArrayType(T.LongType()), "token")
    # the band is part of the key's hash
    banded = cut(tokens.where(F.length("token") >= min(ACCEPTED.values()) - 1).select("token", F.explode(signature).alias("key")))
    crowded = banded.groupBy("key").agg(F.ceil(F.count("*") / bucket).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    placed = cut(banded.join(by_shuffle(crowded), "key").withColumn("block", F.pmod(F.xxhash64("token"), F.col("blocks")).cast("int")))
    left = placed.select("key", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), "token")
    right = placed.select("key", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("token").alias("other"))
    near = F.abs(F.length("token") - F.length("other")) <= max(ACCEPTED)
    close = near & ((F.col("i") < F.col("j")) | (F.col("token") < F.col("other"))) & (F.levenshtein("token", "other", 2 * max(ACCEPTED)) >= 0)
    met = left.join(by_shuffle(right), ["key", "i", "j"]).where(close).select(F.least("token", "other").alias("token"), F.greatest("token", "other").alias("other")).distinct()
    errors = arrow_column(_errors, T.IntegerType(), F.struct("token", "other"))
    longer = F.greatest(F.length("token"), F.length("other"))
    accepted = functools.reduce(lambda a, b: a | b, ((F.col("errors") == n) & (longer >= letters) for n, letters in ACCEPTED.items()))
    met = cut(met.withColumn("errors", errors).where(accepted))
    both = met.unionByName(met.select(F.col("other").alias("token"), F.col("token").alias("other"), "errors"))
    return both.unionByName(tokens.select("token", F.col("token").alias("other"), F.lit(0).alias("errors")))


def _errors(pairs: pa.Array) -> pa.Array:
    return pa.array([near(a, b) for a, b in zip(*(pairs.field(i).to_pylist() for i in range(2)))], type=pa.int32())


def _nicknamed(nick: str, given: str) -> bool:
    """Whether an unknown word may be a nickname: it begins with letters of the given name or ends like it."""
    return nick[:2] in given or nick[-2:] == given[-2:]


def _given_similarity(given: str, written: str, other: str, other_written: str) -> float:
    """How well one given name may stand for another; 0: not at all."""
    if "brand" in (written, other_written) or (not given and not other):
        return 1.0 if written in ("brand", "") and other_written in ("brand", "") else 0.0
    if not given or not other:
        return 0.6
    loose = [w for w in (written, other_written) if w in ("initial", "login")]
    if loose:
        return (0.8 if "login" not in loose else 0.75) if given[0] == other[0] else 0.0
    if given == other:
        return 1.0
    if "nick" in (written, other_written):
        given, other = (given, other) if written == "nick" else (other, given)
        return 0.75 if written != other_written and _nicknamed(given, other) else 0.0
    if "short" in (written, other_written):
        return 0.9 if (written == "short" and is_short_form(given, other)) or (other_written == "short" and is_short_form(other, given)) else 0.0
    return 0.0


def _monge_elkan(pairs: pa.Array) -> pa.Array:
    """Mean over a name's two parts of their best match in the other name; 0 where the given names exclude each other."""
    out = []
    for given, written, other, other_written, token, errors in zip(*(pairs.field(i).to_pylist() for i in range(6))):
        alike = _given_similarity(given, written, other, other_written)
        telling = 1 - errors / max(len(token), 1)
        sure = alike >= 0.75 or errors == 0
        out.append((alike + telling) / 2 if alike and sure else 0.0)
    return pa.array(out, type=pa.float64())


def satellites(edges: DataFrame) -> DataFrame:
    """node: those of the nodes of `edges` (node, other: a greater node beside it) that are no centre of a star.

    Nodes are judged from the greatest down, all at once whose greater neighbours are judged: beside a centre a node is a
    satellite, and what lies beside satellites only is a centre. Each round judges every node at the top of what is left.
    """
    left, found = cut(edges.select("node", "other").distinct()), None
    while not left.isEmpty():
        tops = left.select("other").distinct().join(by_shuffle(left.select(F.col("node").alias("other")).distinct()), "other", "left_anti")
        now = cut(left.join(by_shuffle(tops), "other", "left_semi").select("node").distinct())
        found = now if found is None else found.unionByName(now)
        left = cut(left.join(by_shuffle(now), "node", "left_anti").join(by_shuffle(now.select(F.col("node").alias("other"))), "other", "left_anti"))
    return edges.select("node").limit(0) if found is None else found


def _parsed(names: DataFrame, words_known: Lexicon) -> DataFrame:
    """Names that may name somebody, taken apart; written once."""
    known = names.sparkSession.sparkContext.broadcast(words_known)
    parse = arrow_column(functools.partial(_parse, known=known), PARSED, "name")
    named = names.where(~F.col("titled") | ~F.col("name").rlike("[0-9]")).withColumn("p", parse).where("p is not null")
    return cut(named.select("name", "n", "titled", "p.*"))


def short_forms(named: DataFrame) -> dict[str, str]:
    """Short forms of given names, by the given name, as the corpus shows them.

    A surname that one given name alone stands before tells what an unknown or shortened word before it is short for. A word is
    learned where several surnames agree, and nearly all that know it; more of them if the two do not look alike. What comes to the driver is
    one row a word that is learned, at most LEXICON_ROWS.
    """
    parts = named.where("kind = 'person'").select(F.explode("parts").alias("p")).select("p.token", "p.given", "p.written").distinct()
    sole = parts.where("written = 'full'").groupBy("token").agg(F.min("given").alias("full"), F.max("given").alias("last")).where("full = last").select("token", "full")
    told = parts.where("written in ('nick', 'short') and length(given) between 2 and 9").join(by_shuffle(sole), "token")
    alike = F.contains("full", F.substring("given", 1, 2)) | (F.col("given").substr(-2, 2) == F.col("full").substr(-2, 2))
    counts = told.groupBy("given", "full").agg(F.count_distinct("token").alias("n")).groupBy("given").agg(F.max_by("full", F.struct("n", "full")).alias("full"), F.max("n").alias("n"), F.sum("n").alias("all"))
    enough = F.col("n") >= F.when(alike, SHORT_SEEN).otherwise(3 * SHORT_SEEN)
    rows = counts.where(enough & (F.col("n") >= SHORT_SHARE * F.col("all")) & (F.col("given") != F.col("full"))).limit(LEXICON_ROWS + 1).collect()
    if len(rows) > LEXICON_ROWS:
        raise ValueError(f"more than {LEXICON_ROWS} short forms of given names")
    return {r["given"]: r["full"] for r in rows}


def clusters(names: DataFrame) -> DataFrame:
    """name, entity of distinct `names` (name, n rows, titled: it stands only as a conversation's, single: as one mentioned).

    Placeholders, blanks, titles of conversations and given names alone have no row.
    """
    common, _ = learn(names.where("not titled").select("name"), names.where("single").select("name"))
    words_known = lexicon(common)
    words_known.shorts = short_forms(_parsed(names, words_known))
    named = _parsed(names, words_known)
    nodes = named.groupBy("node").agg(
        F.first("kind").alias("kind"), F.max("quality").alias("quality"), F.count_distinct("spelling").alias("spellings"), F.sum("n").alias("n"), F.min("titled").alias("titled"),
    )
    rank = F.struct((~F.col("titled")).alias("real"), "quality", "spellings", "n", "node")
    parts = named.select("node", F.explode("parts").alias("part")).distinct().select("node", "part.*")
    tokens = parts.select("token").distinct()
    full = cut(nodes.withColumn("rank", rank).join(by_shuffle(parts), "node"))
    lower = full.drop("takes").join(by_shuffle(similar_tokens(tokens)), "token").withColumn("way", F.explode("sends")).drop("sends")
    greater = full.drop("sends").withColumn("way", F.explode("takes")).drop("takes")
    greater = greater.select("way", *(F.col(c).alias(f"other_{c}") for c in greater.columns if c != "way"))
    met = lower.join(by_shuffle(greater), (F.col("other") == F.col("other_token")) & (lower["way"] == greater["way"])).where((F.col("other_rank") > F.col("rank")) & ((F.col("errors") == 0) | (F.least("spellings", "other_spellings") == 1)))
    kinds = (F.col("kind") == F.col("other_kind")) | (F.col("kind") == "single") | (F.col("other_kind") == "single")
    brand = (F.col("written") == "brand") == ((F.col("other_kind") == "business") | (F.col("other_written") == "brand"))
    score = arrow_column(_monge_elkan, T.DoubleType(), F.struct("given", "written", "other_given", "other_written", "token", "errors"))
    met = met.where(kinds & (brand | (F.col("kind") != "single"))).withColumn("score", score).where("score > 0")
    met = cut(met.select("node", "other_node", "other_rank", "other_given", "score", "errors", "other_quality"))
    around = cut(satellites(met.select("node", F.col("other_node").alias("other"))))
    # a satellite joins the centre that it fits best
    met = met.join(by_shuffle(around.select(F.col("node").alias("other_node"))), "other_node", "left_anti")
    best = F.struct(F.col("score"), -F.col("errors"), F.col("other_quality"))
    top = met.groupBy("node").agg(F.max(best).alias("best"))
    joined = met.join(by_shuffle(top), "node").where(best == F.col("best"))
    # two different people that fit equally well: none of them
    sole = joined.join(by_shuffle(around), "node", "left_semi").groupBy("node").agg(F.max_by("other_node", "other_rank").alias("root"), F.count_distinct("other_given").alias("people")).where("people = 1").drop("people")
    tree = cut(nodes.select("node", "titled").join(by_shuffle(sole), "node", "left").withColumn("root", F.coalesce("root", "node")))
    real = tree.where("not titled").select("root").distinct()
    return named.select("name", "node").join(by_shuffle(tree.join(by_shuffle(real), "root", "left_semi")), "node").select("name", F.col("root").alias("entity"))


def distinct_names(messages: DataFrame, records: DataFrame) -> DataFrame:
    """name, n, titled, single of all strings among senders and people."""
    told = records.select(F.explode("people").alias("p")).select(F.col("p.name").alias("name"), (F.col("p.role") == "conversation").alias("titled"), (F.col("p.role") == "mentioned").alias("single"))
    sent = messages.select(F.col("sender").alias("name"), F.lit(False).alias("titled"), F.lit(False).alias("single"))
    counted = told.unionByName(sent).where(F.col("name").rlike(r"\S"))
    return counted.groupBy("name").agg(F.count("*").alias("n"), F.min(F.coalesce("titled", F.lit(False))).alias("titled"), F.max(F.coalesce("single", F.lit(False))).alias("single"))


def variants(messages: DataFrame, records: DataFrame) -> DataFrame:
    """name, entity: every spelling that names someone, with the same entity for all spellings of one person or organisation.

    `messages` has sender, `records` has people. Null and blank names, null people: no row. Ties: see `clusters`. Repeated rows
    count once as a spelling. Very long names are read whole. Empty tables give no rows; other columns are ignored.
    """
    return clusters(cut(distinct_names(messages, records)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = cut(variants(table(spark, sf_dir, "idb_messages").select("sender"), table(spark, sf_dir, "records").select("people")))
    other = named.select("entity", F.col("name").alias("name_b"))
    # the spellings of one entity are few (people type a name in so many ways), whatever its rows
    return named.withColumnRenamed("name", "name_a").join(by_shuffle(other), "entity").where("name_a < name_b").select("name_a", "name_b")


def p2_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "idb_messages").select("sender"), table(spark, sf_dir, "records").select("people"))
