"""Text functions as column builders: all of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicloom.functions import words

#: White space of the reference semantics: beyond ASCII's, the Unicode spaces and the byte order mark.
SPACE = r"[\s\x0B   -     　﻿]"
SEGMENT = r"[.,?!;:\n\r\-*#()\[\]]+"

# Titles that say nothing, trimmed and in any case.
GENERIC_TITLES = (
    r"untitled$", r"new" + SPACE + r"+note$", r"note" + SPACE + r"*[0-9]*$", r"todo$", r"draft$", r"temp$", r"test$", r"copy" + SPACE + r"+of\b", r"_+$",
)


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once. A column used inside a lambda is else computed again for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def is_generic_title(title: Column) -> Column:
    """Whether a title is missing, at most two characters long, or one of the stock titles."""
    t = trim(F.coalesce(title, F.lit("")))
    return (F.length(t) <= 2) | t.rlike("(?i)^(?:" + "|".join(GENERIC_TITLES) + ")")


def is_skipped(title: Column, body: Column) -> Column:
    """A note with an empty body and a generic title isn't embedded."""
    return (F.coalesce(body, F.lit("")) == "") & is_generic_title(title)


def clean_text(c: Column) -> Column:
    """Without code, Markdown link syntax, HTML tags and addresses; null becomes empty."""
    c = F.coalesce(c, F.lit(""))
    for pattern, by in ((r"```[\s\S]*?```", " "), (r"`[^`]*`", " "), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"<[^>]*>", " "), (r"(?i)https?://\S+", " ")):
        c = F.regexp_replace(c, pattern, by)
    return c


def singularize(w: Column) -> Column:
    """A crude singular of an English word in lower case."""
    size = F.length(w)
    cut = lambda n: F.substring(w, F.lit(1), size - n)
    return (
        F.when((size <= 3) | w.isin(words.SINGULAR_EXCEPTIONS) | w.endswith("ss"), w)
        .when(w.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(w.rlike("(?:ss|ch|sh|x|z)es$"), cut(2))
        .when(w.endswith("es"), cut(1))
        .when(w.endswith("s") & ~w.rlike("[uia]s$"), cut(1))
        .otherwise(w)
    )


def _bare(c: Column) -> Column:
    """Cleaned text in lower case, without apostrophes."""
    return F.regexp_replace(F.lower(clean_text(c)), "['’]", "")


def raw_tokens(c: Column) -> Column:
    return F.regexp_extract_all(_bare(c), F.lit("[a-z]+"), F.lit(0))


def _any_of(listed) -> str:
    """A pattern of whole words, by their first letters."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(listed)):
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{first}(?:{'|'.join(sorted(rest, reverse=True))})" for first, rest in by.items())


def _singular_line(line: Column) -> Column:
    """``singularize`` of every word of a line of words in lower case with single spaces between."""
    but = rf"(?<!\b(?:{'|'.join(words.SINGULAR_EXCEPTIONS)}))"
    for pattern, by in (
        (rf"ies\b(?<=[a-z]ies){but}", "y"),
        (rf"es\b(?<=(?:ss|ch|sh|[a-z]x|[a-z]z)es){but}", ""),
        (rf"s\b(?<=[a-z]{{3}}s)(?<![uias]s){but}", ""),
    ):
        line = F.regexp_replace(line, pattern, by)
    return line


def tokenize(c: Column, stop: tuple[str, ...] | None = None) -> Column:
    """Singular words of three letters or more that are no stop words, in order.

    Words stay one line of text until the last step: replacing patterns in it is compiled code, where functions of each
    word would be interpreted.
    """
    stop = words.stop_words() if stop is None else stop
    line = _singular_line(F.trim(F.regexp_replace(_bare(c), "[^a-z]+", " ")))
    dropped = r"\b(?:[a-z]{1,2}" + (f"|{_any_of(stop)}" if stop else "") + r")(?: |$)"
    return F.array_remove(F.split(F.regexp_replace(line, dropped, ""), " "), "")


def grams_by_length(tokens: Column, longest: int = 3) -> Column:
    """Per length n from 1 on, the n-grams at each position; null where a word stands beside itself."""
    out = [tokens]
    ahead = tokens
    for n in range(2, longest + 1):
        rest = F.greatest(F.size(tokens) - n + 1, F.lit(0))
        ahead = F.slice(ahead, F.lit(1), rest)  # (n-1)-grams that a word follows
        last, one_before = F.slice(tokens, F.lit(n), rest), F.slice(tokens, F.lit(n - 1), rest)
        follows = F.zip_with(one_before, last, lambda a, b: F.when(a != b, b))
        ahead = F.zip_with(ahead, follows, lambda g, w: F.concat(g, F.lit(" "), w))
        out.append(ahead)
    return F.array(*out)


def ngrams(tokens: Column, longest: int = 3) -> Column:
    """At each position the 1-gram, then the 2-gram and so on up to ``longest``, as phrases."""

    def of(t: Column) -> Column:
        def at(_: Column, i: Column) -> Column:
            found = [F.when(i + n <= F.size(t), F.array_join(F.slice(t, i + 1, n), " ")) for n in range(1, longest + 1)]
            return F.filter(F.array(*found), lambda g: g.isNotNull())

        return F.flatten(F.transform(t, at))

    return let(tokens, of)


def has_consecutive_duplicates(phrase: Column) -> Column:
    """Whether a word stands beside itself."""
    beside = lambda w: F.exists(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: a == b), lambda x: x)
    return F.coalesce(let(F.split(F.lower(phrase), " "), beside), F.lit(False))


def segments(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), SEGMENT)


def segment_ngrams(c: Column, longest: int = 3) -> Column:
    """N-grams that don't cross punctuation, without those that repeat a word."""
    return F.filter(F.flatten(F.transform(segments(c), lambda s: ngrams(tokenize(s), longest))), lambda g: ~has_consecutive_duplicates(g))


def title_case(phrase: Column) -> Column:
    """First letters and whole acronyms in capitals; nothing is lowered."""
    return F.array_join(
        F.transform(F.split(phrase, " "), lambda w: F.when(F.lower(w).isin(words.ACRONYMS), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))), " "
    )


def share_words(a: Column, b: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(a), " "), F.split(F.lower(b), " "))


def matches_keyword(title: Column, body: Column, keyword: Column) -> Column:
    """Whether a keyword stands in a title or body with no letter or digit beside it, in any case."""
    quoted = F.regexp_replace(F.lower(keyword), r"([\\^$.|?*+()\[\]{}/-])", r"\\$1")
    pattern = F.concat(F.lit(r"(?:^|[^\p{L}\p{N}])"), quoted, F.lit(r"(?:$|[^\p{L}\p{N}])"))
    # rlike has no literal pattern here, which regexp_like takes as a column
    return F.coalesce(F.regexp_like(F.lower(title), pattern), F.lit(False)) | F.coalesce(F.regexp_like(F.lower(body), pattern), F.lit(False))


def content_hash(title: Column, body: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit(""))), 256)


def sanitize_name(raw: Column) -> Column:
    """A name that a model gave, without quotes, heading marks, labels and last stops, cut to five words."""
    c = trim(raw)
    for pattern in (r"^[\"'`]+|[\"'`]+$", r"^#{1,6}" + SPACE + "*", r"(?i)^(?:title|cluster(?:" + SPACE + r"+name)?|name|category|group|topic)" + SPACE + "*:" + SPACE + "*", r"\.+$"):
        c = F.regexp_replace(c, pattern, "")
    c = trim(c)
    return let(c, lambda n: let(F.split(n, SPACE + "+"), lambda parts: F.when(F.size(parts) > 5, F.array_join(F.slice(parts, 1, 5), " ")).otherwise(n)))


def parse_names(response: str, ids: list[int]) -> dict[int, str] | None:
    """Names by cluster id from a model's reply; None unless half of the ids or more got one."""
    import json

    fenced = re.search(r"```(?:json)?\s*([\s\S]*?)```", response.strip())
    found = re.search(r"\{[\s\S]*\}", fenced[1].strip() if fenced else response.strip())
    try:
        parsed = json.loads(found[0]) if found else None
    except ValueError:
        parsed = None
    if not isinstance(parsed, dict):
        return None
    names = {i: sanitized(parsed[str(i)]) for i in ids if isinstance(parsed.get(str(i)), str) and parsed[str(i)].strip()}
    names = {i: n for i, n in names.items() if n}
    return names if len(names) >= -(-len(ids) // 2) else None


def sanitized(raw: str) -> str:
    """``sanitize_name`` of one string, for names that come back to the driver."""
    name = re.sub(r"^[\"'`]+|[\"'`]+$", "", raw.strip())
    name = re.sub(r"^(?:title|cluster(?:\s+name)?|name|category|group|topic)\s*:\s*", "", re.sub(r"^#{1,6}\s*", "", name), flags=re.I)
    parts = re.sub(r"\.+$", "", name).strip().split()
    return " ".join(parts[:5]) if len(parts) > 5 else re.sub(r"\.+$", "", name).strip()


def naming_prompt(summaries: list[dict]) -> list[dict]:
    """Messages that ask a model for cluster names: summaries hold cluster_id, n_notes, titles and keywords."""
    system = (
        "You give short titles to groups of notes. Read each numbered group and give it a title of 2 to 4 words. "
        'Answer with one JSON object that maps group numbers to titles, such as {"0": "Web Development", "1": "Travel Plans"}, and nothing else.'
    )
    parts = []
    for s in summaries:
        titles = ", ".join(f'"{t}"' for t in s["titles"])
        parts.append(f"Group {s['cluster_id']} ({s['n_notes']} notes): {titles}" + (f"\nKeywords: {', '.join(s['keywords'])}" if s["keywords"] else ""))
    return [{"role": "system", "content": system}, {"role": "user", "content": "\n\n".join(parts)}]


def token_chunks(c: Column, encode=None, size: int = 200) -> Column:
    """Consecutive runs of ``size`` tokens as texts, an Arrow UDF. ``encode`` gives (tokens, join) of a text; by default
    tokens are words and marks with the white space before them, as no public encoder's data is at hand."""

    @F.pandas_udf("array<string>")
    def chunks(text):
        import pandas as pd

        pieces = encode or (lambda t: (re.findall(r"\s*(?:\w+|[^\w\s])", t), "".join))
        out = []
        for t in text:
            tokens, join = pieces(t or "")
            out.append([join(tokens[k : k + size]) for k in range(0, len(tokens), size)])
        return pd.Series(out)

    return chunks(c)
