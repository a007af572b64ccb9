"""Text functions as Catalyst expressions: tokens, lines, chunks, snippets, path predicates, byte cuts."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"(?U)([\p{IsAlphabetic}\p{N}_$@#\-]+)[^\p{IsAlphabetic}\p{N}_$@#\-\s]?|[^\s]"
MAX_TOKEN_BYTES = 100


def terms_of(query: str) -> list[str]:
    """Query words: maximal runs of alphanumerics and underscores, lower-cased, without repeats."""
    cut = "".join(c if c.isalnum() or c == "_" else " " for c in query)
    return list(dict.fromkeys(cut.lower().split()))


def tokens(content: Column) -> Column:
    """Array of (pos, term): lower-cased code tokens of under 100 bytes; punctuation costs positions."""
    raw = F.regexp_extract_all(content, F.lit(TOKEN), F.lit(1))
    pairs = F.transform(raw, lambda t, i: F.struct(i.cast("int").alias("pos"), F.lower(t).alias("term")))
    return F.filter(pairs, lambda x: (x["term"] != "") & (F.octet_length(x["term"]) < MAX_TOKEN_BYTES))


def joined_tokens(content: Column) -> Column:
    """The lower-cased matches of the tokenizer in one string, a newline between two; a place without a term is empty, and
    terms that are too long are still there. No term holds a newline, and lower-casing does not look across one."""
    return F.lower(F.array_join(F.regexp_extract_all(content, F.lit(TOKEN), F.lit(1)), "\n"))


def term_count(raw: Column) -> Column:
    """How many raw matches are terms. Lower-casing makes no character more than three times as long."""
    return F.size(F.filter(raw, lambda t: (t != "") & ((F.octet_length(t) * 3 < MAX_TOKEN_BYTES) | (F.octet_length(F.lower(t)) < MAX_TOKEN_BYTES))))


def token_count(content: Column) -> Column:
    """The size of `tokens`, without building them."""
    return term_count(F.regexp_extract_all(content, F.lit(TOKEN), F.lit(1)))


def places(raw: Column, terms: list[str]) -> Column:
    """Array of (pos, term), as `tokens`, of the given terms alone."""
    low = F.split(F.lower(F.array_join(raw, "\n")), "\n", -1)  # lower-cased at once; no term holds a newline
    hit = F.transform(low, lambda t, i: F.when(t.isin(terms), F.struct(i.cast("int").alias("pos"), t.alias("term"))))
    return F.filter(hit, lambda x: x.isNotNull()) if terms else F.filter(hit, lambda x: F.lit(False))


def lines(content: Column) -> Column:
    parts = F.split(F.replace(content, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def newline_split(content: Column) -> Column:
    """Lines as SQL's string_split(rtrim(text, chr(10)), chr(10)): all closing newlines go, a carriage return stays, and an
    empty text is one empty line."""
    return F.split(F.rtrim(content, F.lit("\n")), "\n", -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def contains_ci(content: Column, query: str) -> Column:
    return F.contains(F.lower(content), F.lit(query.lower()))


def snippet(content: Column, hit, before: int = 2, after: int = 8, limit: int = 10, split=lines) -> Column:
    """Struct (text, offset, count, line) around the first line for which hit(line) holds, else the first `limit` lines and
    no line."""
    ls = split(content)
    i = F.array_position(F.transform(ls, hit), True).cast("int") - 1
    start = F.greatest(i - before, F.lit(0))
    end = F.least(i + after, F.size(ls))
    found = i >= 0
    part = F.when(found, F.slice(ls, start + 1, F.greatest(end - start, F.lit(0)))).otherwise(F.slice(ls, 1, limit))
    text = F.array_join(part, "\n")
    return F.struct(text.alias("text"), F.when(found, start).otherwise(0).alias("offset"),
                    F.when(found, F.size(part)).otherwise(F.size(split(text))).alias("count"), F.when(found, i).alias("line"))


def literal_snippet(content: Column, query: str, split=lines) -> Column:
    words = query.lower().split()
    return snippet(content, lambda line: reduce(lambda a, b: a | b, [F.contains(F.lower(line), F.lit(w)) for w in words]) if words else F.lit(False), split=split)


def regex_snippet(content: Column, java_pattern: str, split=lines) -> Column:
    return snippet(content, lambda line: F.rlike(line, F.lit(java_pattern)), split=split)


def chunk_spans(content: Column, size: int = 50, overlap: int = 10, split=lines) -> Column:
    """Array of (chunk, line_start, line_end, text); empty for texts of `size` lines or fewer."""
    if overlap >= size:
        raise ValueError("chunk_overlap must be smaller than chunk_size")
    ls = split(content)
    n = F.size(ls)
    starts = F.when(n > size, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s, i: F.struct(i.alias("chunk"), (s + 1).alias("line_start"), F.least(s + size, n).alias("line_end"),
                                                     F.array_join(F.slice(ls, s + 1, size), "\n").alias("text")))


def glob(path: Column, pattern: str) -> Column:
    if pattern.startswith("**/") and pattern.endswith("/**") and len(pattern) > 5:
        d = pattern[3:-3]
        return path.contains(f"/{d}/") | path.startswith(f"{d}/") | path.endswith(f"/{d}")
    if pattern.startswith("**/*."):
        return path.endswith(pattern[4:])
    if pattern.startswith("**/"):
        return path.endswith(pattern[3:])
    if pattern.endswith("/**"):
        p = pattern[:-3]
        return path.startswith(p) | path.contains(f"/{p}")
    if pattern.startswith("*."):
        return path.endswith(pattern[1:])
    return (path == pattern) | path.endswith(f"/{pattern}") | path.contains(f"/{pattern}/")


def any_glob(path: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [glob(path, p) for p in patterns], F.lit(False))


def hidden(path: Column) -> Column:
    return F.rlike(path, F.lit(r"(^|/)\."))


def in_directories(path: Column, names: list[str]) -> Column:
    parts = F.split(path, "/", -1)
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(n) for n in names]))


def byte_cut(content: Column, limit: int) -> Column:
    """The longest prefix of at most `limit` bytes that ends on a character boundary."""
    raw = F.encode(content, "UTF-8")
    return F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, limit - k).cast("string")) for k in range(4)])


def line_range(start: Column, end: Column) -> Column:
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start, end))


def display_score(score: Column) -> Column:
    return F.least(score * 3000, F.lit(99.9))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    den = norm(a) * norm(b)
    return F.when(den > 0, dot / den).otherwise(0.0)
