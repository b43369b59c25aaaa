"""Graph construction from texts and triples: chunks, sentences, normalised names, resolved entities, induced and evolving schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_key, entity_name, indel_ratio, relation_name, sentences, strings, value_type
from ..sources.shared import checkpoint
from .components import connected_components

TRIPLE = "head string, relation string, tail string, head_type string, tail_type string, confidence double, source_chunk string"
REPLY = "array<struct<head:string,relation:string,tail:string,head_type:string,tail_type:string,confidence:double>>"
MERGE_SIMILARITY = 0.7


def chunks(text: Column, max_size: int = 500, overlap: int = 0) -> Column:
    """An array of chunks of a text.

    A blank text has none and one of up to ``max_size`` characters is its own only chunk.
    Else paragraphs, and of a longer paragraph its pieces of ``max_size``, are packed in order
    while they fit; with ``overlap`` a chunk begins with the last characters of the one
    before. No chunk is blank; none exceeds ``max_size`` + ``overlap`` + 2.
    """
    pieces = F.flatten(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.filter(F.transform(F.sequence(F.lit(0), F.floor((F.length(F.trim(p)) + max_size - 1) / max_size).cast("int")), lambda i: F.trim(F.substring(F.trim(p), i * max_size + 1, F.lit(max_size)))), lambda s: s != "")))
    start = F.struct(strings([]).alias("done"), F.lit("").alias("open"))

    def pack(state: Column, piece: Column) -> Column:
        fits = (state["open"] != "") & (F.length(state["open"]) + 2 + F.length(piece) <= max_size)
        fresh = F.when((state["open"] != "") & F.lit(overlap > 0), F.concat(F.substring(state["open"], F.greatest(F.length(state["open"]) - overlap + 1, F.lit(1)), F.lit(overlap)), F.lit("\n\n"), piece)).otherwise(piece)
        return F.when(fits, F.struct(state["done"].alias("done"), F.concat(state["open"], F.lit("\n\n"), piece).alias("open"))).otherwise(
            F.struct(F.when(state["open"] != "", F.array_append(state["done"], state["open"])).otherwise(state["done"]).alias("done"), fresh.alias("open"))
        )

    packed = F.aggregate(pieces, start, pack, lambda s: F.when(s["open"] != "", F.array_append(s["done"], s["open"])).otherwise(s["done"]))
    return F.when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", strings([])).when(F.length(text) <= max_size, F.array(text)).otherwise(packed)


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_size: int = 500, overlap: int = 0) -> DataFrame:
    return docs.select(id_col, F.posexplode(chunks(F.col(text_col), max_size, overlap)).alias("chunk", "text"))


def split_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, F.posexplode(sentences(F.col(text_col))).alias("pos", "sentence"))


def extract_triples(replies: DataFrame, reply_col: str = "reply", chunk_col: str = "chunk", min_confidence: float = 0.0) -> DataFrame:
    """Triples of model replies, JSON arrays: what isn't an object or lacks an end or relation is dropped, as is low confidence (1.0 if unstated); names normalised."""
    parsed = replies.select(F.col(chunk_col).cast("string").alias("source_chunk"), F.explode(F.from_json(reply_col, REPLY)).alias("t")).where("t is not null")
    t = parsed.select(entity_name(F.col("t.head")).alias("head"), relation_name(F.col("t.relation")).alias("relation"), entity_name(F.col("t.tail")).alias("tail"), F.coalesce("t.head_type", F.lit("")).alias("head_type"), F.coalesce("t.tail_type", F.lit("")).alias("tail_type"), F.coalesce("t.confidence", F.lit(1.0)).alias("confidence"), "source_chunk")
    return t.where("head <> '' and relation <> '' and tail <> ''").where(F.col("confidence") >= min_confidence)


def event_triples(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triples between entities, and those with an event at either end."""
    event = (F.lower("head_type") == "event") | (F.lower("tail_type") == "event")
    return triples.where(~event), triples.where(event)


def resolve_entities(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triples over canonical names, each once, and the map (key, canonical, n_names).

    Names are one entity if their keys are equal; the canonical name is the commonest,
    of equals the least, with capitals. Counts combine before the shuffle, so a name that
    most triples share costs no more than a rare one.
    """
    names = triples.select(F.col("head").alias("name")).unionAll(triples.select(F.col("tail").alias("name")))
    counted = names.groupBy("name").agg(F.count("*").alias("n"))
    keyed = counted.withColumn("key", entity_key(F.col("name")))
    canon = keyed.groupBy("key").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("name"), F.count("*").alias("n_names"))
    canon = canon.select("key", entity_name(F.regexp_replace("name", r"(?i)^\s*(a|an|the)\s+", "")).alias("canonical"), "n_names")
    keys = triples.select(entity_key(F.col("head")).alias("head_key"), "relation", entity_key(F.col("tail")).alias("tail_key")).distinct()
    end = lambda x: canon.select(F.col("key").alias(f"{x}_key"), F.col("canonical").alias(x))
    return keys.join(end("head"), "head_key").join(end("tail"), "tail_key").select("head", "relation", "tail"), canon


def induce_relations(triples: DataFrame) -> DataFrame:
    """(relation, n, source_types, target_types): what each relation was seen to join; types are a schema's, so their sets are small."""
    kinds = lambda c: F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))), ",")
    per_type = triples.groupBy("relation", "head_type", "tail_type").agg(F.count("*").alias("n"))
    return per_type.groupBy("relation").agg(F.sum("n").alias("n"), kinds("head_type").alias("source_types"), kinds("tail_type").alias("target_types"))


def induce_types(triples: DataFrame) -> DataFrame:
    """(type, entity): the stated types, or, of entities without one, the role their relation gives them."""
    stated = lambda end, role: triples.select(F.coalesce(F.nullif(F.col(f"{end}_type"), F.lit("")), F.concat(F.lit(role), "relation")).alias("type"), F.col(end).alias("entity"))
    return stated("head", "SOURCE_OF_").unionAll(stated("tail", "TARGET_OF_")).distinct()


def jaccard_pairs(members: DataFrame, threshold: float = MERGE_SIMILARITY) -> DataFrame:
    """(a, b, similarity): types (type, entity) whose entity sets reach the Jaccard similarity.

    An inverted index on entities joins only types that share one, and counts the shared.
    Sets of that similarity differ in size by at most its factor, so the size filter is exact.
    """
    sized = members.distinct().join(members.distinct().groupBy("type").agg(F.count("*").alias("n")), "type")
    a, b = (sized.select("entity", F.col("type").alias(x), F.col("n").alias(f"n_{x}")) for x in ("a", "b"))
    met = a.join(b, "entity").where((F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")))
    shared = met.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    return shared.select("a", "b", F.round(F.col("n") / (F.col("n_a") + F.col("n_b") - F.col("n")), 6).alias("similarity")).where(F.col("similarity") >= threshold)


def merge_types(members: DataFrame, threshold: float = MERGE_SIMILARITY) -> DataFrame:
    """(type, merged): each type and the least type it merges into, through chains of merges of any length."""
    roots = connected_components(jaccard_pairs(members, threshold).select("a", "b")).withColumnRenamed("node", "type")
    return members.select("type").distinct().join(roots, "type", "left").select("type", F.coalesce("root", "type").alias("merged"))


def infer_types(properties: DataFrame) -> DataFrame:
    """(label, key, data_type): one type for all of a property's values; integers and floats together are FLOAT, other mixtures and no values STRING."""
    kinds = properties.select("label", "key", value_type(F.col("value")).alias("k")).groupBy("label", "key").agg(F.array_sort(F.collect_set("k")).alias("kinds"))
    number = F.size(F.array_except("kinds", F.array(F.lit("FLOAT"), F.lit("INTEGER")))) == 0
    return kinds.select("label", "key", F.when(F.size("kinds") == 1, F.get("kinds", 0)).when((F.size("kinds") == 2) & number, "FLOAT").otherwise("STRING").alias("data_type"))


def type_hierarchy(parents: DataFrame) -> DataFrame:
    """(type, ancestor, depth): for (type, parent) rows every ancestor and how far it is; a cycle ends where it would repeat."""
    parents = checkpoint(parents.where("parent is not null").distinct())
    level = parents.select("type", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    found, depth = level, 1
    while not level.isEmpty():
        depth += 1
        step = level.join(parents.select(F.col("type").alias("ancestor"), "parent"), "ancestor").select("type", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth")).distinct()
        level = checkpoint(step.where("type <> ancestor").join(found, ["type", "ancestor"], "left_anti"))
        found = found.unionAll(level)
    return found


def type_depths(parents: DataFrame) -> DataFrame:
    """(type, depth): steps to the farthest ancestor, 0 for roots."""
    deepest = type_hierarchy(parents).groupBy("type").agg(F.max("depth").alias("depth"))
    every = parents.select("type").unionAll(parents.where("parent is not null").select(F.col("parent").alias("type"))).distinct()
    return every.join(deepest, "type", "left").select("type", F.coalesce("depth", F.lit(0)).alias("depth"))


def schema_diff(known: DataFrame, seen: DataFrame, key: str = "name", threshold: float = MERGE_SIMILARITY) -> DataFrame:
    """(name, change, n): types of ``seen`` (name, n) that are NEW, an ALIAS of a similar known one, or KNOWN, with the counts added up."""
    old = known.select(F.lower(key).alias("old"), F.col("n").alias("n_old"))
    joined = seen.select(F.col(key).alias("name"), "n").join(old, F.lower("name") == F.col("old"), "left")
    new = joined.where("old is null").select("name", "n")
    alike = new.join(F.broadcast(old.select(F.col("old").alias("other")))).where(indel_ratio(F.lower("name"), F.col("other")) >= threshold).groupBy("name").agg(F.min("other").alias("alias_of"))
    fresh = new.join(alike, "name", "left").select("name", F.when(F.col("alias_of").isNull(), "NEW").otherwise("ALIAS").alias("change"), "n")
    return fresh.unionByName(joined.where("old is not null").select("name", F.lit("KNOWN").alias("change"), (F.col("n") + F.col("n_old")).alias("n")))


def subtypes(hierarchy: DataFrame, of: str, recursive: bool = False) -> DataFrame:
    """(type, depth) beneath a type of ``type_hierarchy``; only the next level unless ``recursive``."""
    below = hierarchy.where(F.col("ancestor") == of)
    return (below if recursive else below.where("depth = 1")).select("type", "depth")


def supertypes(hierarchy: DataFrame, of: str, recursive: bool = False) -> DataFrame:
    above = hierarchy.where(F.col("type") == of)
    return (above if recursive else above.where("depth = 1")).select("ancestor", "depth")


def depth_of(depths: DataFrame, of: str) -> int:
    """Depth of a type of ``type_depths``; -1 for an unknown one."""
    r = depths.where(F.col("type") == of).first()
    return r.depth if r else -1


def diff_summary(diff: DataFrame) -> str:
    """How many types a ``schema_diff`` changes, and the new ones, in a line."""
    rows = {r.change: (r.n, r.names) for r in diff.groupBy("change").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("name")).alias("names")).collect()}
    changed = rows.get("NEW", (0, []))[0] + rows.get("ALIAS", (0, []))[0]
    return f"{changed} changes; new: {', '.join(rows.get('NEW', (0, []))[1]) or 'none'}"
