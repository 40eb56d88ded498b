"""Text functions as columns: they stay in the JVM and inside whole-stage code."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The accented letters that folding knows, and their plain letters.
ACCENTED, PLAIN = "áàâãéêíóôõúç", "aaaaeeiooouc"
#: Query parameters that carry secrets, and prefixes of such parameters.
SECRET_PARAMETERS = ("token", "access_token", "id_token", "refresh_token", "code", "state", "sig", "signature", "key", "apikey", "api_key", "password")
SECRET_PREFIXES = ("x-amz-", "x-goog-")
#: Shapes of credentials, and what they are called in the text that replaces them.
CREDENTIALS = (
    (r"(?:ghp_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})", "github-token"),
    (r"glpat-[A-Za-z0-9_-]{16,}", "gitlab-token"),
    (r"AKIA[0-9A-Z]{16}", "aws-key"),
    (r"xox[bp]-[A-Za-z0-9-]{10,}", "slack-token"),
    (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "jwt"),
)
#: The markup of messages: line breaks, what has no text, quoted messages and their authors, mentions.
BREAKS, NO_TEXT = r"(?i)<br\s*/?>|</p>|</div>|</li>|</h[1-6]>", r"(?is)<(style|script)[^>]*>.*?</(style|script)>"
QUOTE, QUOTE_AUTHOR = r"(?is)<blockquote[^>]*>(.*?)</blockquote>", r"""(?is)<strong[^>]*itemprop="mri"[^>]*>(.*?)</strong>"""
MENTION = r"""(?is)<span[^>]*itemtype="[^"]*Mention[^"]*"[^>]*>(.*?)</span>"""
#: Links in a text, and the parts of a store's name that are data, with what stands for them.
URL = r"""(https?://[^\s<>"'\])]+)"""
GUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
NAME_PARTS = ((GUID, "<guid>"), (r"[^\s@:]+@[^\s@:]+", "<email>"), (r"\d{6,}", "<n>"))
#: The shape of a private key, and how text from markup is tidied.
BLANKS, BEFORE_MARK, BLANK_LINES = "[ \t\u00a0]+", r" +([,.;:!?])", r"\n\s*\n+"
PRIVATE_KEY = r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"


def fold(text: Column) -> Column:
    """Lower case, Portuguese accents removed; the dot that lower case sets above the i of İ goes too."""
    return F.translate(F.lower(text), ACCENTED + "\u0307", PLAIN)


def letter_words(text: Column) -> Column:
    """Array of the folded words of letters alone."""
    return F.filter(F.split(fold(text), r"[^\p{L}]+"), lambda w: w != "")


def word_tokens(text: Column) -> Column:
    """Array of the folded words of letters and digits."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def spelling_key(word: Column) -> Column:
    """A word without doubled letters, y as i: how misspelt names are found again."""
    return F.regexp_replace(F.translate(word, "y", "i"), r"(.)\1+", "$1")


def name_key(name: Column) -> Column:
    """How a name is compared: folded words, each by its spelling key."""
    return F.array_join(F.transform(letter_words(name), spelling_key), " ")


def first_name(name: Column) -> Column:
    """The first word of a name, folded; null for a name without letters."""
    return F.get(letter_words(name), F.lit(0))


def has_name(key: Column, name: Column) -> Column:
    """Whether a name key holds another as whole words."""
    return F.instr(F.concat(F.lit(" "), key, F.lit(" ")), F.concat(F.lit(" "), name, F.lit(" "))) > 0


def name_from_email(email: Column) -> Column:
    """A name read from an address: two words or more of two letters or more; else an empty string."""
    local = F.when(F.instr(email, "@") > 0, F.split(email, "@")[0])
    words = F.filter(letter_words(local), lambda w: F.length(w) >= 2)
    return F.when(F.size(words) >= 2, F.array_join(words, " ")).otherwise("")


def headline(text: Column) -> Column:
    """The first line that isn't blank, trimmed; an empty string if there is none."""
    lines = F.transform(F.split(text, "\n"), lambda line: F.regexp_replace(line, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.coalesce(F.get(F.filter(lines, lambda line: line != ""), F.lit(0)), F.lit(""))


def clip(text: Column, length: int) -> Column:
    """The first `length` characters, with an ellipsis where more were cut off."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("…"))).otherwise(text)


def stable_id(source: Column, *parts: Column) -> Column:
    """Identity of an event: SHA-256 of its source and parts, set apart by NUL."""
    joined = source
    for part in parts:
        joined = F.concat(joined, F.lit("\0"), part)
    return F.sha2(joined, 256)


def content_hash(content: Column) -> Column:
    """SHA-256 of a text: equal texts share chunks and vectors."""
    return F.sha2(content, 256)


def strip_url(url: Column) -> Column:
    """A URL without the query parameters that carry secrets; order and everything else stay."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    name = lambda pair: F.lower(F.try_url_decode(F.split(pair, "=")[0]))
    secret = lambda pair: name(pair).isin(*SECRET_PARAMETERS) | name(pair).startswith(SECRET_PREFIXES[0]) | name(pair).startswith(SECRET_PREFIXES[1])
    kept = F.array_join(F.filter(F.split(query, "&"), lambda pair: ~F.coalesce(secret(pair), F.lit(True))), "&")
    before, after = F.regexp_extract(url, r"^[^?#]*", 0), F.regexp_extract(url, r"#.*$", 0)
    return F.when(query == "", url).otherwise(F.concat(before, F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)), after))


def redact_credentials(text: Column) -> Column:
    """Credentials replaced by what they are; each private key over several pages keeps its own page breaks."""
    for pattern, label in CREDENTIALS:
        text = F.regexp_replace(text, pattern, f"[redacted:{label}]")
    marks = F.transform(F.regexp_extract_all(text, F.lit(PRIVATE_KEY), F.lit(0)), lambda key: F.concat(F.lit("[redacted:private-key]"), F.regexp_replace(key, "[^\f]", "")))
    around = F.zip_with(F.split(text, PRIVATE_KEY, -1), marks, lambda piece, mark: F.concat(F.coalesce(piece, F.lit("")), F.coalesce(mark, F.lit(""))))
    return F.when(text.rlike(PRIVATE_KEY), F.array_join(around, "")).otherwise(text)


def url_tokens(text: Column) -> Column:
    """Array of the URLs in a text."""
    return F.regexp_extract_all(text, F.lit(URL), F.lit(1))


def mentions(text: Column) -> Column:
    """Array of the folded first words behind an @."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"@(\p{L}+)"), F.lit(1)), fold)


def _character(code: Column) -> Column:
    """The character of a code point; those of no character become U+FFFD, the control range is read as Western text."""
    western = {str(n): bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}
    known = F.try_element_at(F.from_json(F.lit(json.dumps({k: v for k, v in western.items() if v})), "map<string,string>"), code.cast("string"))
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.coalesce(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))).otherwise("\ufffd")


def unescape_entities(text: Column) -> Column:
    """Entities of markup decoded: by number, and by all names that the standard library lists, old ones without semicolon too."""
    named = F.from_json(F.lit(json.dumps({k: v for k, v in html5.items() if k.endswith(";")})), "map<string,string>")
    bare = sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True)
    old = F.from_json(F.lit(json.dumps({k: html5[k] for k in bare})), "map<string,string>")

    def decoded(piece: Column) -> Column:
        number = F.regexp_extract(piece, "^#([0-9]{1,9});?", 1)
        hexed = F.regexp_extract(piece, "^#[xX]([0-9a-fA-F]{1,7});?", 1)
        whole = F.try_element_at(named, F.regexp_extract(piece, "^[A-Za-z][A-Za-z0-9]*;", 0))
        start = F.regexp_extract(piece, f"^(?:{'|'.join(bare)})", 0)
        return (
            F.when(number != "", F.concat(_character(number.try_cast("bigint")), F.regexp_replace(piece, "^#[0-9]{1,9};?", "")))
            .when(hexed != "", F.concat(_character(F.conv(hexed, 16, 10).try_cast("bigint")), F.regexp_replace(piece, "^#[xX][0-9a-fA-F]{1,7};?", "")))
            .when(whole.isNotNull(), F.concat(whole, F.regexp_replace(piece, "^[A-Za-z][A-Za-z0-9]*;", "")))
            .when(start != "", F.concat(F.try_element_at(old, start), F.substring(piece, F.length(start) + 1, F.length(piece))))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    pieces = F.split(text, "&")
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(decoded(p))), "")).otherwise(text)


def _plain(fragment: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(fragment, NO_TEXT, ""), BREAKS, "\n")
    text = unescape_entities(F.regexp_replace(text, r"<[^>]*>", ""))
    text = F.regexp_replace(F.regexp_replace(text, BLANKS, " "), BEFORE_MARK, "$1")
    return F.regexp_replace(F.regexp_replace(text, BLANK_LINES, "\n"), r"^\s+|\s+$", "")


def html_to_text(body: Column) -> Column:
    """A message's markup as text: mentions behind @, quoted messages after the reply."""
    quotes = F.transform(
        F.regexp_extract_all(body, F.lit(QUOTE), F.lit(1)),
        lambda quote: F.replace(_plain(F.regexp_replace(F.regexp_replace(quote, QUOTE_AUTHOR, "$1: "), r"<[^>]*>", " ")), F.lit("\n"), F.lit(" ")),
    )
    text = _plain(F.regexp_replace(F.regexp_replace(body, QUOTE, ""), MENTION, "@$1 "))
    answered = F.transform(F.filter(quotes, lambda q: q != ""), lambda q: F.concat(F.lit("\n↪ em resposta a "), q))
    return F.trim(F.concat(text, F.array_join(answered, "")))


def mask_key(key: Column) -> Column:
    """A field name as it is; keys that are data as <text> or <id>."""
    data = key.rlike(r"^\d+$") | key.rlike(r"^[0-9a-fA-F]{16,}$") | key.rlike(GUID) | key.rlike("[@:/]") | (F.octet_length(key) > 32)
    return F.when(key.rlike("[ \t\n]"), "<text>").when(data, "<id>").otherwise(key)


def mask_name(name: Column) -> Column:
    """The name of a database or store without identifiers, addresses and long numbers."""
    for pattern, mask in NAME_PARTS:
        name = F.regexp_replace(name, pattern, mask)
    return name


def stable_prefix(name: Column) -> Column:
    """A name up to the first part that `mask_name` hides: what all users and sessions share."""
    at = F.least(*(F.nullif(F.regexp_instr(name, F.lit(pattern)), F.lit(0)) for pattern, _ in NAME_PARTS))
    return F.when(at.isNull(), name).otherwise(F.substring(name, F.lit(1), at - 1))


def page_of(text: Column, offset: Column) -> Column:
    """The page, from 1, that a byte offset lies on; pages end with a form feed."""
    before = F.substring(F.encode(text, "UTF-8"), F.lit(1), offset).cast("string")
    return F.lit(1) + F.octet_length(before) - F.octet_length(F.replace(before, F.lit("\f"), F.lit("")))


def path_under(path: Column, folder: str) -> Column:
    """Whether a path is a folder or lies in it."""
    folder = folder.rstrip("/")
    return (path == folder) | path.startswith(f"{folder}/")


def basename(path: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(path, "/"), -1)
