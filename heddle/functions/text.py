"""Expressions over text: identifiers, stop words, paths, module names, gold files and literal candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that name functions in every large repository and so are no seeds.
STOP_WORDS = frozenset(
    """the a an is it in of to and or not if for with this that when then should would could but as on at by from we i
    you be have has was were are do does did there here so no yes can will may get set add run test tests code bug issue
    error expected actual result value values type types true false none self return returns print python version line
    lines file files example output input 使用 def class import raise except try else elif while""".split()
)
LEAST_NAME = 3

# The patterns of issue texts; \w and \b are Unicode-aware as in the language that is read.
TRACEBACK = r'(?U)File "([^"]+\.py)", line (\d+)(?:, in (\w+))?'
PATH = r"(?U)\b((?:[\w.-]+/)*[\w.-]+\.py)\b"
BLOB_URL = r"https?://\S*?/blob/[^\s/]+/(\S+?\.py)(?:#L(\d+))?"
IDENT = r"(?U)\b([A-Za-z_][\w]*(?:\.[A-Za-z_][\w]*)*)\b"
CALLED = r"(?U)\b([A-Za-z_][\w]*(?:\.[A-Za-z_][\w]*)*)\s*\("
CODE_SPAN = r"(?Us)`([^`\n]{1,120})`|```[\w]*\n(.*?)```"
ASCII_IDENT = r"([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)"
ASCII_CALLED = ASCII_IDENT + r"[ \t\n\r\f\x0B]*\("
FLAG = r"(?U)(?<![\w-])--?([a-zA-Z][\w]*(?:-[\w]+)+)"
MESSAGE_CODE = r"(?U)\b([EWCRF]\d{4})\b"
QUOTED_OPTION = r"`([a-z][a-z0-9]*(?:-[a-z0-9]+)+)`"
GOLD = r"(?m)^\+\+\+ b/(.+)$"

# The weight of a name by how a text mentions it, and of its last part alone.
SPAN_WEIGHTS, CALL_WEIGHTS, PROSE_WEIGHTS = (2.0, 1.6), (1.5, 1.3), (1.0, 0.8)
FRAME_WEIGHT = 3.0


def matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def last_part(name: Column) -> Column:
    return F.element_at(F.split(name, r"\.", -1), -1)


def kept_identifiers(name: Column) -> Column:
    """Long enough, and not a stop word as a whole."""
    return (F.length(name) >= LEAST_NAME) & ~F.lower(name).isin(*sorted(STOP_WORDS))


def looks_like_code(name: Column) -> Column:
    """Dotted, with an underscore, or not all in lower case."""
    lower = (F.lower(name) == name) & (F.upper(name) != name)
    return F.contains(name, F.lit(".")) | ~lower | F.contains(name, F.lit("_"))


def identifier_offers(texts: DataFrame, key: str, ascii_only: bool = False) -> DataFrame:
    """key, name, weight: each name that a text mentions, with the heaviest of its mentions.

    Names in code spans outweigh called ones, and those outweigh code-like names in prose; a dotted name also offers its
    last part. With ``ascii_only`` patterns are plain ASCII and spans are left to prose.
    """
    ident, called = (ASCII_IDENT, ASCII_CALLED) if ascii_only else (IDENT, CALLED)
    text = F.col("text")

    def offers(names: Column, weights: tuple[float, float]) -> Column:
        whole = F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(weights[0]).alias("weight")))
        parts = F.transform(F.filter(names, lambda n: F.contains(n, F.lit("."))), lambda n: F.struct(last_part(n).alias("name"), F.lit(weights[1]).alias("weight")))
        return F.concat(whole, parts)

    found = [offers(matches(text, called), CALL_WEIGHTS), offers(F.filter(matches(text, ident), looks_like_code), PROSE_WEIGHTS)]
    if not ascii_only:
        spans = F.array_join(F.concat(matches(text, CODE_SPAN, 1), matches(text, CODE_SPAN, 2)), "\n")
        frames = F.transform(F.filter(matches(text, TRACEBACK, 3), lambda n: n != ""), lambda n: F.struct(n.alias("name"), F.lit(FRAME_WEIGHT).alias("weight")))
        found += [offers(matches(spans, IDENT), SPAN_WEIGHTS), frames]
    rows = texts.filter(text.isNotNull()).select(key, F.explode(F.array_distinct(F.concat(*found))).alias("o")).select(key, "o.name", "o.weight")
    return rows.filter(kept_identifiers(F.col("name"))).groupBy(key, "name").agg(F.max("weight").alias("weight"))


def gold_files(patch: Column) -> Column:
    """The Python files that a patch changes or adds."""
    return F.array_distinct(F.filter(matches(patch, GOLD), lambda p: F.endswith(p, F.lit(".py"))))


def literal_candidates(text: Column) -> Column:
    """Option names, message codes and quoted options of an issue text."""
    found = F.array_union(F.array_union(matches(text, FLAG), matches(text, MESSAGE_CODE)), matches(text, QUOTED_OPTION))
    return F.filter(found, lambda c: F.length(c) >= 4)


def node_id(path: Column, qualname: Column) -> Column:
    return F.concat(path, F.lit("::"), qualname)


def file_order(path: Column) -> Column:
    """What sorts paths by their segments."""
    return F.split(path, "/", -1)


def resolve_relative(module: Column, is_package: Column, level: Column, target: Column) -> Column:
    """The absolute module of an import: ``level`` dots up from the importer, then ``target``."""
    parts = F.split(module, r"\.", -1)
    up = F.when(is_package, level - 1).otherwise(level)
    kept = F.slice(parts, 1, F.greatest(F.size(parts) - up, F.lit(0)))
    tail = F.when(F.coalesce(target, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(target))
    return F.when(level == 0, F.coalesce(target, F.lit(""))).otherwise(F.array_join(F.concat(kept, tail), "."))


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a whole segment of the path, or its file's stem, is one of the patterns."""
    names = F.array(*map(F.lit, patterns)) if patterns else F.array().cast("array<string>")
    parts = F.split(path, "/", -1)
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    return F.arrays_overlap(parts, names) | F.array_contains(names, stem)
