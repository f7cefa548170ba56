"""Text predicates and cleaning as column expressions; no Python runs on the rows.

Words end at anything but ASCII letters, digits and underscores, in every function alike.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import words as lists


def alternation(words: Sequence[str]) -> str:
    """A pattern of all words that branches letter by letter: a place in the text is compared with the
    letters that can come next, not with each word."""
    tree: dict = {}
    for word in sorted(words):
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [re.sub(r"([^\w ])", r"\\\1", c) + pattern(below) for c, below in node.items() if c]
        if not ways:
            return ""
        both = ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"
        return f"(?:{both})?" if "" in node else both

    return pattern(tree)


def has_keyword(text: Column, words: Sequence[str] = lists.FINANCIAL, bounded: bool = True) -> Column:
    """Whether any of the words is in the text, as whole words or anywhere."""
    pattern = alternation(words)
    return F.lower(text).rlike(rf"(?<!\w){pattern}(?!\w)" if bounded else pattern)


def speaks_of_event(text: Column) -> Column:
    """Whether any of the event words is in the text, inside other words too."""
    return F.coalesce(has_keyword(text, lists.EVENT, bounded=False), F.lit(False))


def speaks_of_listing(text: Column) -> Column:
    """Whether a text speaks of a company going public: a strong word, or a weak one with context."""
    strong, weak, context = (has_keyword(text, words, bounded=False) for words in (lists.LISTING_STRONG, lists.LISTING_WEAK, lists.LISTING_CONTEXT))
    return F.coalesce(strong | (weak & context), F.lit(False))


def tickers_in(text: Column, uppercased: bool = False) -> Column:
    """Distinct words of 2 to 5 capitals that are not on the stoplist.  uppercased takes the
    text in capitals first, so nearly every short word counts."""
    capitals = F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if uppercased else text
    found = F.regexp_extract_all(capitals, F.lit(r"(?<!\w)([A-Z]{2,5})(?!\w)"), F.lit(1))
    return F.array_except(found, F.array(*(F.lit(w) for w in lists.NO_TICKERS)))


def has_financial_content(text: Column, compat: bool = False) -> Column:
    """A dollar sign, a ticker or a keyword; compat reads tickers in the uppercased text and
    keywords inside other words."""
    return F.coalesce(text.contains("$") | (F.size(tickers_in(text, compat)) > 0) | has_keyword(text, bounded=not compat), F.lit(False))


def comments_text(comments: Column) -> Column:
    """The bodies of comments (array of author, body), as one text."""
    return F.array_join(F.transform(comments, lambda c: F.coalesce(c["body"], F.lit(""))), " ")


def should_classify(text: Column, comments: Column | None = None) -> Column:
    """A cashtag or a whole keyword, financial or social, in the text or its comments."""
    whole = text if comments is None else F.concat_ws(" ", text, comments_text(comments))
    return F.coalesce(whole.rlike(r"\$[A-Z]{1,5}(?!\w)") | has_keyword(whole, lists.FINANCIAL + lists.SOCIAL), F.lit(False))


def wants_comments(text: Column) -> Column:
    """Whether a post's comments are worth a call: any short word in capitals, or a keyword."""
    return F.coalesce(text.rlike(r"(?<!\w)[A-Z]{2,5}(?!\w)") | has_keyword(text, lists.FINANCIAL + lists.SOCIAL), F.lit(False))


def comment_lines(comments: Column) -> Column:
    """Comments that have a body as lines of author and body, for a prompt."""
    told = F.filter(comments, lambda c: F.coalesce(c["body"], F.lit("")) != "")
    lines = F.transform(told, lambda c: F.concat(F.lit("- "), F.coalesce(c["author"], F.lit("[unknown]")), F.lit(": "), c["body"]))
    return F.when(F.coalesce(F.size(told), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise("(No comments)")


def notes_map(notes: Column) -> Column:
    """Notes (array of ticker, summary) as a map from the ticker, trimmed and in capitals, to the
    summary; of several notes on one ticker the last stays, a note without a ticker goes."""
    empty = F.create_map().cast("map<string,string>")

    def put(made: Column, note: Column) -> Column:
        key = F.upper(F.trim(F.coalesce(note["ticker"], F.lit(""))))
        others = F.map_filter(made, lambda k, _: k != key)
        return F.when(key == "", made).otherwise(F.map_concat(others, F.create_map(key, F.coalesce(note["summary"], F.lit("")))))

    return F.aggregate(F.coalesce(notes, F.array().cast("array<struct<ticker:string,summary:string>>")), empty, put)


def is_forum_post(source_type: Column, source_name: Column) -> Column:
    """A social post of the forum whose comments can be read."""
    return F.coalesce((source_type == "social") & source_name.startswith("reddit"), F.lit(False))


def country_codes(codes: Column) -> Column:
    """Two-letter codes of a model's answer, in capitals; anything else goes."""
    return F.transform(F.filter(codes, lambda c: F.length(F.trim(c)) == 2), lambda c: F.upper(F.trim(c)))


def strip_html(html: Column) -> Column:
    """Text of a page: scripts, styles and comments go, tags become spaces, a few entities come back."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def strip_code_fence(text: Column) -> Column:
    """A fenced answer without its fence, with or without a json tag."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def normalize_company(name: Column) -> Column:
    """Lower case, legal forms at the end and punctuation gone, spaces single: two spellings of
    one company agree.  Letters of any script stay; a null name is empty."""
    out = F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)^\s+|\s+$", ""))
    for form in lists.LEGAL_FORMS:
        out = F.regexp_replace(out, rf"(?U)\s+{form.replace('.', '[.]?')}{'[.]?' if form in lists.SHORT_FORMS else ''}$", "")
    out = F.regexp_replace(out, r"(?U)[^\w\s]", "")
    return F.regexp_replace(F.regexp_replace(out, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def domain(url: Column) -> Column:
    """Host of an absolute URL, without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def content_hash(headline: Column, summary: Column) -> Column:
    """SHA-256 of both, end to end."""
    return F.sha2(F.concat(F.coalesce(headline, F.lit("")), F.coalesce(summary, F.lit(""))), 256)


def short_id(url: Column) -> Column:
    return F.substring(F.md5(url), 1, 12)


def truncate_words(text: Column, n: int = 400) -> Column:
    """At most n characters, cut at the last white space before; a first word that is longer is cut."""
    whole = F.length(text) <= n
    at_space = F.regexp_extract(text, rf"(?s)^(.{{0,{n}}})(?=\s)", 1)
    return F.when(whole, text).when(at_space != "", F.rtrim(at_space)).otherwise(F.substring(text, 1, n))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def embedding_text(headline: Column, summary: Column) -> Column:
    return F.concat_ws("\n\n", headline, F.nullif(summary, F.lit("")))


def is_greeting(text: Column) -> Column:
    words = F.split(F.lower(F.trim(F.regexp_replace(text, r"[^\w\s]", ""))), r"\s+")
    return (F.size(words) <= 3) & F.arrays_overlap(words, F.array(*(F.lit(w) for w in ("hi", "hello", "hey", "thanks", "bye"))))


def split_list(text: Column) -> Column:
    """A comma list as an array of its trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def json_list(text: Column) -> Column:
    """A JSON array of strings; a bad or missing one is empty."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
