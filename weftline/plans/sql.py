"""Pieces of the checking SQL, written apart from the Spark expressions that they check."""

from __future__ import annotations


def fold(x: str) -> str:
    return f"translate(lower({x}), 'áàâãéêíóôõúç' || chr(775), 'aaaaeeiooouc')"


def letters(x: str) -> str:
    return f"list_filter(regexp_split_to_array({fold(x)}, '[^\\p{{L}}]+'), lambda w: w <> '')"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({fold(x)}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def name_key(x: str) -> str:
    word = "array_to_string(list_filter(string_split(replace(w, 'y', 'i'), ''), lambda c, i: i = 1 OR c <> string_split(replace(w, 'y', 'i'), '')[i - 1]), '')"
    return f"array_to_string(list_transform({letters(x)}, lambda w: {word}), ' ')"


def headline(x: str) -> str:
    return f"coalesce(list_filter(list_transform(string_split({x}, chr(10)), lambda l: regexp_replace(l, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda l: l <> '')[1], '')"


def filled(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '\\S') THEN {x} END)"


def meta(key: str, table: str = "r") -> str:
    return f"{table}.metadata['{key}']"


DIRECTION = "(CASE WHEN r.source = 'teams' THEN CASE WHEN r.metadata['sent_by_me'] = 'true' THEN 'sent' WHEN r.metadata['conversation_kind'] = 'canal' THEN 'channel' ELSE 'received' END END)"

#: record_id, role, name_key of everyone named in records.
PEOPLE = f"""people AS (
  SELECT record_id, role, {name_key('name')} AS name_key, array_to_string({letters('name')}, ' ') AS name FROM (
    SELECT r.record_id, CASE WHEN {filled(meta('sender'))} IS NOT NULL THEN 'sender' ELSE 'author' END AS role, coalesce({filled(meta('sender'))}, {filled(meta('author'))}) AS name FROM records r
    UNION ALL SELECT r.record_id, 'author', {filled(meta('author_alias'))} FROM records r
    UNION ALL SELECT r.record_id, 'conversation', {filled(meta('conversation'))} FROM records r
    UNION ALL SELECT record_id, 'mentioned', m FROM (SELECT r.record_id, unnest(regexp_extract_all(r.content, '@(\\p{{L}}+)', 1)) AS m FROM records r WHERE r.source = 'teams')
  ) WHERE name IS NOT NULL AND len({letters('name')}) > 0)"""
