"""Strings, similarity and vectors as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of keyword candidates.
STOP_WORDS = """
a an the is are was were be been being
have has had do does did will would could
should may might shall can need dare ought
used to of in on at by for with about
against between into through during before after
above below from up down out off over under
again further then once and but or nor so
yet both either neither not only own same
than too very just because as until while
if when where how what which who whom that
this these those i me my myself we our
you your he him his she her it its they
them their tell give show find get let
make know see take come go say ask
""".split()

# Phrases for well-known relationships.
TEMPLATES = {
    "treats": "{source} treats {target}",
    "causes": "{source} may cause {target}",
    "interacts with": "{source} interacts with {target}",
    "has symptom": "{source} has symptom: {target}",
    "increases risk of": "{source} increases risk of {target}",
    "metabolized by": "{source} is metabolized by {target}",
    "belongs to": "{source} belongs to {target}",
    "acted in": "{source} acted in {target}",
    "directed": "{source} directed {target}",
    "works at": "{source} works at {target}",
    "located in": "{source} is located in {target}",
}


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once per row, however often ``use`` names it, lambdas within it included."""
    return F.get(F.transform(F.array(value), use), 0)


def tokens(text: Column) -> Column:
    clean = F.trim(F.lower(F.regexp_replace(text, r"[^a-zA-Z0-9\s\-]", " ")))
    return F.filter(F.split(clean, r"\s+"), lambda x: x != "")


def keywords(text: Column, stop_words=STOP_WORDS) -> Column:
    """Candidate names: three, two and single words in a row, of the words that aren't stop words; of all words if nothing else is left."""
    content = lambda words: F.filter(words, lambda x: ~x.isin(list(stop_words)))
    gram = lambda words, n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(strings([]))
    every = lambda words: F.array_distinct(F.concat(gram(words, 3), gram(words, 2), words))
    chosen = lambda words: let(content(words), lambda c: F.when(F.size(c) > 0, c).otherwise(words))
    return let(tokens(text), lambda words: let(chosen(words), every))


def characters(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))).otherwise(strings([]))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, row by row of the dynamic programme."""

    def over(bs: Column) -> Column:
        def row(before: Column, c: Column) -> Column:
            cell = lambda done, j: F.array_append(done, F.when(F.get(bs, j - 1) == c, F.get(before, j - 1) + 1).otherwise(F.greatest(F.get(before, j), F.element_at(done, -1))))
            return F.when(F.size(bs) > 0, F.aggregate(F.sequence(F.lit(1), F.size(bs)), F.array(F.lit(0)), cell)).otherwise(before)

        return F.element_at(F.aggregate(characters(a), F.array_repeat(F.lit(0), F.size(bs) + 1), row), -1)

    return let(characters(b), over)


def indel_ratio(a: Column, b: Column) -> Column:
    """2 * LCS / (length of both): 1.0 for equal strings, two empty ones included."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * common_subsequence(a, b) / F.nullif(total, F.lit(0)))


def cosine(a: Column, b: Column) -> Column:
    """Of vectors, in double precision; 0.0 if either has no length. The product stops at the shorter one."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    add = lambda s, x: s + x
    n = F.least(F.size(a), F.size(b))
    dot = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), add))
    size = norm(a) * norm(b)
    return F.when(size > 0, dot / F.nullif(size, F.lit(0.0))).otherwise(0.0)


def humanize(name: Column) -> Column:
    return F.trim(F.lower(F.replace(F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2"), F.lit("_"), F.lit(" "))))


def past_participle(verb: Column) -> Column:
    v = F.trim(verb)
    stem = F.substring(v, F.lit(1), F.length(v) - 1)
    return F.when(v.endswith("es"), F.concat(stem, F.lit("d"))).when(v.endswith("s"), F.concat(stem, F.lit("ed"))).when(v.endswith("e"), F.concat(v, F.lit("d"))).otherwise(F.concat(v, F.lit("ed")))


def intent_name(prefix: Column, relationship: Column) -> Column:
    return F.concat_ws("_", F.lower(prefix), F.lower(relationship))


def template_for(human: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in TEMPLATES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, human), F.concat(F.lit("{source} "), human, F.lit(" {target}")))


def fill(template: Column, source: Column, target: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{source}"), source), F.lit("{target}"), target)


def plain_key(name: Column) -> Column:
    return F.translate(F.lower(name), "_-", "")


def entity_name(name: Column) -> Column:
    """Single spaces, each word with a capital."""
    return F.initcap(F.trim(F.regexp_replace(name, r"\s+", " ")))


def relation_name(name: Column) -> Column:
    """UPPER_SNAKE without other characters."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(name)), r"[\s\-]+", "_"), r"[^A-Z0-9_]", "")


def entity_key(name: Column) -> Column:
    """What entities are equal by: lower case, no leading article, letters and digits and single spaces."""
    bare = F.regexp_replace(F.lower(F.trim(name)), r"^(a|an|the)\s+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^a-z0-9\s]", ""), r"\s+", " "))


def sentences(text: Column) -> Column:
    """Ends at . ! or ? before white space and a capital or digit; not after a title or single letters."""
    marked = F.regexp_replace(text, r"(?<!\b(?:Dr|Mr|Mrs|Ms|Prof|St|vs|etc|e\.g|i\.e|[A-Za-z]))([.!?])\s+(?=[\p{Lu}0-9])", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def value_type(value: Column) -> Column:
    """INTEGER, FLOAT, BOOLEAN, DATE, LIST or STRING by the look of one value as text; null if it is null or empty."""
    v = F.trim(value)
    return (
        F.when(v.isNull() | (v == ""), F.lit(None).cast("string"))
        .when(F.lower(v).isin("true", "false"), "BOOLEAN")
        .when(v.rlike(r"^[+-]?[0-9]+$"), "INTEGER")
        .when(v.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$"), "FLOAT")
        .when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9:.]+(Z|[+-][0-9:]+)?)?$"), "DATE")
        .when(v.rlike(r"^\[.*\]$"), "LIST")
        .otherwise("STRING")
    )


def json_strings(text: Column, most: int) -> Column:
    """The first ``most`` strings of a JSON array at the start of a reply; null if it isn't one."""
    parsed = F.from_json(F.trim(text), "array<string>")
    return F.when(F.trim(text).startswith("["), F.slice(parsed, 1, most))


def comma_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def default_graph_name(uri: Column, database: Column) -> Column:
    return F.concat_ws("@", database, F.regexp_extract(uri, r"^[^:/]+://(?:[^@/]*@)?([^:/?#]+)", 1))


def graph_id() -> Column:
    return F.concat(F.lit("kg_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12))


def intent_reply(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{Alnum}_]", ""))


def joined_context(contexts: Column, most: int = 2000) -> Column:
    return F.substring(F.array_join(F.filter(contexts, lambda c: F.trim(c) != ""), "\n---\n"), 1, most)


def age_seconds(now: Column, then: Column) -> Column:
    return now.cast("double") - then.cast("double")
