"""Scalar functions on names, paths, queries and judge outputs, as Spark columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_letters() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from Unicode's own decompositions."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c:
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


_ACCENTED, _BASE = _plain_letters()


def decompose(c: Column) -> Column:
    """Identifier to lower-case words: cut at case changes and at everything that is no letter or digit."""
    c = F.regexp_replace(c, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    c = F.regexp_replace(c, r"(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")
    return F.trim(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")))


def search_blob(name: Column, snippet: Column) -> Column:
    return F.concat_ws(" ", decompose(name), decompose(snippet))


def tokens(c: Column) -> Column:
    """Full-text tokens: runs of letters and digits, case and Latin diacritics folded; null has none."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(c, F.lit(""))), _ACCENTED, _BASE), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def fts_phrases(query: Column) -> Column:
    """A query's phrases: one per white-space separated word, each an array of tokens; empty ones fall away."""
    words = F.split(F.trim(query), r"\s+")
    kept = F.transform(words, lambda w: tokens(F.regexp_replace(w, r"[^\p{L}\p{N}_]", "")))
    return F.filter(kept, lambda p: F.size(p) > 0)


def norm_slashes(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def normalize_path(c: Column) -> Column:
    """Resolve `.` and `..` in a relative path; `..` at the top is dropped."""
    parts = F.filter(F.split(norm_slashes(c), "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    stack = F.aggregate(parts, empty, lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(stack, "/")


def dirname(c: Column) -> Column:
    return F.regexp_extract(norm_slashes(c), r"^(.*)/[^/]*$", 1)


def module_of(path: Column) -> Column:
    """Parent folder; `<root>` for files at the top."""
    d = dirname(path)
    return F.when(d == "", F.lit("<root>")).otherwise(d)


def module_of_two(path: Column) -> Column:
    """First two path segments."""
    return F.array_join(F.slice(F.split(norm_slashes(path), "/"), 1, 2), "/")


def strip_comments(src: Column) -> Column:
    """Drop block comments, then line comments that don't follow a colon."""
    return F.regexp_replace(F.regexp_replace(src, r"(?s)/\*.*?\*/", ""), r"(?<!:)//[^\n]*", "")


def parse_hit(hit: Column) -> Column:
    """`path:name` cut at the last colon, as struct<path, name>."""
    return F.struct(F.regexp_extract(hit, r"(?s)^(.*):([^:]*)$", 1).alias("path"), F.regexp_extract(hit, r"(?s)^(.*):([^:]*)$", 2).alias("name"))


def extract_subject(text: Column) -> Column:
    """The word a question is about: of the identifier-like words the longest (the last of equals), else the longest plain word, else all."""
    words = F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    longest = lambda ws: F.aggregate(ws, F.lit(""), lambda best, w: F.when(F.octet_length(w) >= F.octet_length(best), w).otherwise(best))
    marked = F.filter(words, lambda w: w.rlike(r"^\p{L}") & w.rlike(r"[\p{Lu}_]"))
    plain = F.filter(words, lambda w: (F.octet_length(w) >= 4) & w.rlike(r"^\p{L}+$"))
    return F.when(F.size(marked) > 0, longest(marked)).when(F.size(plain) > 0, longest(plain)).otherwise(text)


VERDICT = "verdict STRING, grade INT, reason STRING"


def safe_json(raw: Column) -> Column:
    """A judge's answer as struct<verdict, grade, reason, recovered, parse_error>: parsed, else its outermost braces parsed, else the fields found one by one."""
    whole = F.from_json(raw, VERDICT, {"mode": "PERMISSIVE"})
    inner = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), VERDICT)
    ok = lambda j: j.isNotNull() & (j["verdict"].isNotNull() | j["grade"].isNotNull() | j["reason"].isNotNull())
    value = lambda name, body: F.nullif(F.regexp_extract(raw, rf'"{name}"\s*:\s*{body}', 1), F.lit(""))
    quoted, digits = '"([^"]*)"', "([0-9]+)"
    fields = {"verdict": value("verdict", quoted), "grade": value("grade", digits).cast("int"), "reason": value("reason", quoted)}
    found = fields["verdict"].isNotNull() | fields["grade"].isNotNull() | fields["reason"].isNotNull()
    parsed = ok(whole) | ok(inner)
    pick = lambda n: F.when(ok(whole), whole[n]).when(ok(inner), inner[n]).otherwise(fields[n])
    return F.struct(*[pick(n).alias(n) for n in fields], (~parsed & found).alias("recovered"), (~parsed & ~found).alias("parse_error"))


def version_hash(model: Column, dim: Column, prefix: Column) -> Column:
    """Twelve hex digits that change with model, dimension or query prefix."""
    return F.substring(F.sha2(F.concat_ws("|", model, dim.cast("string"), prefix), 256), 1, 12)


def repo_hash(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def embed_text(kind: Column, name: Column, snippet: Column) -> Column:
    return F.concat_ws(" ", kind, name, snippet)


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.95, "high").when(c >= 0.7, "mid").when(c >= 0.5, "low").otherwise("poor")


def bucket_capacity(seconds: Column, capacity: float = 80.0, refill: float = 0.5) -> Column:
    """Calls a token bucket lets through in so many seconds."""
    return F.lit(capacity) + F.lit(refill) * seconds


def real_verdict(raw: Column, flipped: Column) -> Column:
    """What a verdict on shown positions says about the arms; null if it is none of A, B and tie."""
    return F.when(raw == "tie", "tie").when(raw == "A", F.when(flipped, "B").otherwise("A")).when(raw == "B", F.when(flipped, "A").otherwise("B"))


def clip(text: str, most: int = 500) -> str:
    """At most so many UTF-8 bytes, cut at a character, with an ellipsis if cut."""
    raw = text.encode()
    return text if len(raw) <= most else raw[:most].decode(errors="ignore") + "..."
