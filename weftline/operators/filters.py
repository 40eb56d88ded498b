"""Selections of events: one declarative filter, compiled to predicates and semi-joins."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import people as P
from weftline.sources.events import FILE, GIT, TEAMS, filled, meta

#: Words that carry no news.
CHATTER = """
oi oie ola opa aoba eai e ai bom boa dia dias tarde noite
ok okay blz beleza valeu vlw obrigado obrigada brigado show top massa certo entendi isso sim nao claro
perfeito otimo joia fechado combinado tranquilo ah hm hmm uai kk kkk kkkk rs haha
pode ser acho que eu tu vc voce aqui ali la ta to ja vou ver tudo bem faz sentido deu tambem tb
o a os as um uma de do da dos das em no na nos nas me te se com pra pro para por
thanks thx thank you yes no hi hello good morning sure got it fine cool great
""".split()
#: What addresses an assistant, and what asks it to override its rules, in folded text.
ADDRESS = r"(assistente|assistant|chatbot|llm|modelo de linguagem|language model|instrucao do sistema|system prompt|nova instrucao|new instruction)"
OVERRIDE = r"(ignor[ea]r?|desconsidere|disregard|esqueca|forget|responda (que|apenas|so)|reply (only|that)|answer (only|that)|diga (que|ao usuario)|tell the user|cite (apenas|only)|instrucoes anteriores|previous instructions|regras)"
IMAGES = r"(?i)\.(png|jpe?g|webp)$"


@dataclass(frozen=True)
class EventFilter:
    """What an event must be like; an empty field asks for nothing."""

    start: datetime | None = None
    end: datetime | None = None
    source: str = ""
    direction: str = "any"
    people: tuple[str, ...] = ()
    folder: str = ""
    text: str = ""
    terms: tuple[str, ...] = ()
    modality: str = ""
    entities: tuple[str, ...] = ()
    appearing: tuple[str, ...] = ()


def in_period(start: datetime | None, end: datetime | None, at: str = "occurred_at") -> Column:
    """start <= at < end; an open side is no bound."""
    kept = F.lit(True)
    if start is not None:
        kept = kept & (F.col(at) >= F.lit(start))
    return kept if end is None else kept & (F.col(at) < F.lit(end))


def of_source(source: str) -> Column:
    """A source, or any where none is named."""
    return F.col("source") == source if source else F.lit(True)


def in_folder(folder: str) -> Column:
    """Files in a folder."""
    return (F.col("source") == FILE) & X.path_under(meta("path"), folder)


def contains_text(text: str) -> Column:
    """Content holding a text, whatever the case."""
    return F.instr(F.lower("content"), F.lit(text.lower())) > 0


def all_terms(terms: tuple[str, ...]) -> Column:
    """Every folded term in content or conversation."""
    told = X.fold(F.concat_ws(" ", F.col("content"), meta("conversation")))
    kept = F.lit(True)
    for term in terms:
        kept = kept & F.contains(told, X.fold(F.lit(term)))
    return kept


def apply_filter(events: DataFrame, wanted: EventFilter, key: str = "record_id", links: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """Events that meet all parts of a filter. Predicates first, so that semi-joins see little.

    Entities need `links` (see `graph.entity_links`), names that appear in events `links` and `chunks` (see `search.text_chunks`).
    """
    kept = events.where(in_period(wanted.start, wanted.end) & of_source(wanted.source) & P.of_direction(wanted.direction))
    if wanted.folder:
        kept = kept.where(in_folder(wanted.folder))
    if wanted.text:
        kept = kept.where(contains_text(wanted.text))
    if wanted.terms:
        kept = kept.where(all_terms(wanted.terms))
    if wanted.modality:
        kept = kept.where(shows_image() if wanted.modality == "image" else F.col("source") == wanted.modality)
    if wanted.entities:
        kept = kept.join(links.where(F.col("entity_key").isin(*wanted.entities)).select(key), key, "left_semi")
    shown = links.where(F.col("role") == "shows").select(key, "entity_key") if wanted.appearing else None
    for name in wanted.appearing:  # the other event that shows an image may lie outside the filter
        hashed = events.withColumn("content_hash", X.content_hash(F.col("content")))
        kept = kept.join(with_appearing(hashed, appearing(chunks, name), shown, key).select(key), key, "left_semi")
    return P.by_people(kept, list(wanted.people), wanted.direction, key) if wanted.people else kept


def own_commits() -> Column:
    """Everything but other people's commits."""
    return ~((F.col("source") == GIT) & (F.coalesce(meta("authorship"), F.lit("")) == "other"))


def present_files() -> Column:
    """Everything but removed files."""
    return ~((F.col("source") == FILE) & filled(meta("removed_at")).isNotNull())


def is_chatter() -> Column:
    """Teams messages without a word that says anything."""
    first = X.headline(F.coalesce("content", F.lit("")))
    sender = F.concat(F.coalesce(meta("sender"), F.lit("")), F.lit(":"))
    said = F.when(first.startswith(sender), F.substring(first, F.length(sender) + 1, F.length(first))).otherwise(first)
    words = F.array(*(F.lit(w) for w in dict.fromkeys(CHATTER)))
    return (F.col("source") == TEAMS) & (F.size(F.array_except(X.word_tokens(said), words)) == 0)


def gives_orders() -> Column:
    """Text that addresses an assistant and asks it to override its rules, within 80 characters."""
    return X.fold(F.col("content")).rlike(f"{ADDRESS}.{{0,80}}?{OVERRIDE}|{OVERRIDE}.{{0,80}}?{ADDRESS}")


def shows_image() -> Column:
    """Events that show an image, or with one as attachment or file."""
    return F.coalesce(meta("attachment"), meta("path"), F.lit("")).rlike(IMAGES) | filled(meta("image_sha256")).isNotNull()


def appearing(chunks: DataFrame, name: str) -> DataFrame:
    """Distinct texts (source, content_hash) of which one chunk has all words of a name that count (three letters or more)."""
    words = [w for w in re.findall(r"\w+", name.lower()) if len(w) >= 3]
    kept = F.lit(True)
    for word in words:
        kept = kept & F.array_contains(X.word_tokens(F.col("text")), X.fold(F.lit(word)))
    return chunks.where(kept).select("source", "content_hash").distinct()


def with_appearing(events: DataFrame, texts: DataFrame, shown: DataFrame, key: str = "record_id") -> DataFrame:
    """Events (with content_hash) with one of the texts (see `appearing`), or showing an image that some event with one shows.

    `shown` has key, entity_key of all images shown (see `graph.shown_images`).
    """
    own = events.join(texts, ["source", "content_hash"], "left_semi").select(key)
    images = shown.join(own, key, "left_semi").select("entity_key").distinct()
    found = own.unionByName(shown.join(images, "entity_key", "left_semi").select(key)).distinct()
    return events.join(found, key, "left_semi")
