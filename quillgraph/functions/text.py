"""Scalar text functions as Columns. Lengths are code points; patterns name their characters and don't depend on locale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.schemas import CATEGORIES

# File extensions by language.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "java": "java", "go": "go", "rs": "rust",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala",
}
# Verbs of factual sentences and of dated events.
FACT_VERBS = "is are was were has have can will must should".split()
EVENT_VERBS = "happened occurred started began ended finished created updated released".split()
# Statement pairs that contradict each other, (positive, negative).
NEGATIONS = ((r"is\s+(\w+)", r"is\s+not\s+(\w+)"), (r"are\s+(\w+)", r"are\s+not\s+(\w+)"), (r"can\s+(\w+)", r"cannot\s+(\w+)"), (r"will\s+(\w+)", r"will\s+not\s+(\w+)"))
#: Word bounds of ASCII words; those of the JVM count accented letters too.
START, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
# Patterns of named things in a text.
ENTITY_PATTERNS = (
    ("person", rf"{START}[A-Z][a-z]+ [A-Z][a-z]+{END}"),
    ("organization", rf"{START}[A-Z][a-z]+ [A-Z][a-z]+ [A-Z][a-z]+{END}"),
    ("acronym", rf"{START}[A-Z][A-Z][A-Z]+{END}"),
    ("date", rf"{START}\d{{4}}-\d{{2}}-\d{{2}}{END}"),
    ("version", rf"{START}\d+\.\d+\.\d+{END}"),
)


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def snippet(text: Column, query: str, before: int = 50, after: int = 150, plain: int = 200) -> Column:
    """Around the first hit, with ... where cut; without a hit the first `plain` characters."""
    at = F.locate(query.lower(), F.lower(text)) - 1
    start, end = F.greatest(F.lit(0), at - before), F.least(F.length(text), at + len(query) + after)
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.length(text), "...").otherwise(""))
    return F.when(at < 0, F.substring(text, 1, plain)).otherwise(cut)


def title(text: Column) -> Column:
    """The first heading of level one, else the first line cut at 50, else Untitled."""
    heading = F.trim(F.regexp_extract(text, r"(?m)^[^\S\n]*# [^\S\n]*(\S.*)$", 1))
    first = F.substring(F.trim(lines(text)[0]), 1, 50)
    return F.coalesce(F.nullif(heading, F.lit("")), F.nullif(first, F.lit("")), F.lit("Untitled"))


def summary(text: Column, count: int = 3, width: int = 200) -> Column:
    """The first lines that have text and aren't headings, joined by spaces, cut with ... ."""
    kept = F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    joined = F.array_join(F.slice(kept, 1, count), " ")
    return F.when(F.length(joined) > width, F.concat(F.substring(joined, 1, width), F.lit("..."))).otherwise(joined)


def words(text: Column, longer_than: int = 3, by: str = "") -> Column:
    """Lower-cased ASCII words of more than so many characters, in order; `by` takes the place of what isn't in words."""
    plain = F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_\s]", by)
    return F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) > longer_than)


def headings(text: Column) -> Column:
    """array<struct<text, level>>: headings of markdown in order."""
    trimmed = F.transform(lines(text), lambda x: F.trim(x))
    found = F.filter(trimmed, lambda x: x.rlike(r"^#+\s+.+$"))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^(#+)\s+(.+)$", 2).alias("text"), F.length(F.regexp_extract(x, r"^(#+)", 1)).alias("level")))


# Marks of markdown and what stays of them.
MARKDOWN = ((r"#+\s*", ""), (r"\*\*(.*?)\*\*", "$1"), (r"\*(.*?)\*", "$1"), (r"`(.*?)`", "$1"), (r"\[(.*?)\]\(.*?\)", "$1"), (r"\n+", " "))


def sentences(text: Column, longer_than: int = 10) -> Column:
    """Sentences of the text without markdown, trimmed, of more than so many characters."""
    plain = text
    for pattern, by in MARKDOWN:
        plain = F.regexp_replace(plain, pattern, by)
    return F.filter(F.transform(F.split(plain, "[.!?]+"), lambda x: F.trim(x)), lambda s: F.length(s) > longer_than)


def is_factual(sentence: Column) -> Column:
    return F.lower(sentence).rlike(rf"\b({'|'.join(FACT_VERBS)})\b")


def events(text: Column) -> Column:
    """array<struct<description, date>>: lines with a date and a verb of events."""
    hit = F.filter(lines(text), lambda x: x.rlike(rf"{START}\d{{4}}[-/]\d{{2}}[-/]\d{{2}}{END}") & x.rlike(rf"(?i){START}({'|'.join(EVENT_VERBS)}){END}"))
    date = lambda x: F.try_to_timestamp(F.replace(F.regexp_extract(x, rf"{START}(\d{{4}}[-/]\d{{2}}[-/]\d{{2}}){END}", 1), F.lit("/"), F.lit("-")), F.lit("yyyy-MM-dd"))
    return F.transform(hit, lambda x: F.struct(F.trim(x).alias("description"), date(x).cast("date").alias("date")))


def entities(text: Column) -> Column:
    """array<struct<name, type>>: persons, organizations, acronyms, dates and versions by pattern."""
    found = lambda kind, pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.struct(x.alias("name"), F.lit(kind).alias("type")))
    return F.flatten(F.array(*(found(kind, pattern) for kind, pattern in ENTITY_PATTERNS)))


def normal_signature(signature: Column) -> Column:
    return F.regexp_replace(F.lower(signature), "[^a-z0-9]", "")


def contradicts(a: Column, b: Column) -> Column:
    """One states what the other denies. A negative form also matches the positive pattern."""
    out = F.lit(False)
    for yes, no in NEGATIONS:
        out = out | (a.rlike(yes) & b.rlike(no)) | (a.rlike(no) & b.rlike(yes))
    return out


def category(path: Column) -> Column:
    """The first of the category folders in the path, else general."""
    low, out = F.lower(path), F.lit("general")
    for name in reversed([c for c in ("active", "completed", "status", "architecture", "compliance", "legacy") if c in CATEGORIES]):
        out = F.when(F.contains(low, F.lit(f"/{name}/")) | F.startswith(low, F.lit(f"{name}/")), name).otherwise(out)
    return out


def language(path: Column) -> Column:
    """By extension; unknown otherwise."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.element_at(table, F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))), F.lit("unknown"))


def node_type(text: Column, given: Column | None = None) -> Column:
    """The kind of node a text is, by ordered rules; a given kind comes first."""
    # The words and patterns that tell of each kind.
    kind = (
        F.when(text.endswith("?"), "question")
        .when(text.contains("because") | text.contains("therefore"), "insight")
        .when(text.rlike(r"\d{4}-\d{2}-\d{2}") | text.contains("happened") | text.contains("occurred"), "event")
        .when(text.rlike("^[A-Z][a-z]+ [A-Z][a-z]+$"), "entity")
        .when(F.length(text) > 200, "document")
        .when(text.contains(" is ") | text.contains(" are "), "fact")
        .otherwise("concept")
    )
    return F.coalesce(given, kind) if given is not None else kind


def types_in(signature: Column) -> Column:
    """Names of types after colons."""
    return F.regexp_extract_all(signature, F.lit(r":\s*([A-Z][A-Za-z0-9_]*)"), F.lit(1))


def relative_path(base_file: Column, target: Column) -> Column:
    """target taken relative to the folder of base_file, with . and .. resolved."""
    folder = F.regexp_replace(base_file, "[^/]*$", "")
    parts = F.filter(F.split(F.concat(folder, target), "/"), lambda p: (p != "") & (p != "."))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))), "/")


def hash36(text: Column) -> Column:
    """A 31-multiplier hash of 32 bits, its absolute value in base 36."""
    folded = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda h, c: F.when(c == "", h).otherwise(F.pmod(h * 31 + F.ascii(c), F.lit(1 << 32))))
    signed = F.when(folded >= 1 << 31, folded - (1 << 32)).otherwise(folded)
    return F.lower(F.conv(F.abs(signed).cast("string"), 10, 36))


def duration_seconds(text: Column) -> Column:
    """15m, 1h, 7d, 30s as seconds; null otherwise."""
    unit = F.regexp_extract(text, r"^(\d+)([smhd])$", 2)
    times = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return F.regexp_extract(text, r"^(\d+)([smhd])$", 1).try_cast("long") * times


def is_iso8601(text: Column) -> Column:
    return text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")


def byte_size(n: Column) -> Column:
    """Bytes in the largest unit that leaves one or more, with one decimal."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**i, F.concat(F.format_string("%.1f", n / float(1024**i)), F.lit(f" {unit}"))).otherwise(out)
    return out


def insight_text(type1: Column, name1: Column, type2: Column, name2: Column, type3: Column, name3: Column) -> Column:
    """What a wedge of three events or three facts suggests; null for others."""
    all_are = lambda kind: (type1 == kind) & (type2 == kind) & (type3 == kind)
    sequence = F.concat(F.lit("Sequence of events detected: "), F.concat_ws(" → ", name1, name2, name3))
    return F.when(all_are("event"), sequence).when(all_are("fact"), "Related facts suggest a pattern or principle connecting these concepts")


def is_test_name(name: Column) -> Column:
    return name.rlike(r"(?i)(^test|test$|_test|\.test|^it_|^should|spec$)")


def call_kind(callee: Column) -> Column:
    """method, constructor or function call, by the callee's spelling."""
    return F.when(F.contains(callee, F.lit(".")), "method").when(callee.rlike("^[A-Z]"), "constructor").otherwise("function")


def csv_field(text: Column) -> Column:
    """Quoted where it has a comma, a quote or a line break."""
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
