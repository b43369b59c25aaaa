"""From a question to entries and an intent: all candidates, or all questions, in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cosine, indel_ratio, keywords, strings
from ..sources.graph import Graph
from . import schema

# Markers of abstract questions.
ABSTRACT_MARKERS = ["why", "purpose", "reason", "explain", "how come", "what is the role", "what are the roles", "what is the use", "what are the uses", "overview", "summary", "describe"]
# Rows, scores and lengths of the matching stages.
EXACT_ROWS, PARTIAL_ROWS, FUZZY_ROWS, FUZZY_RESULTS, FUZZY_RATIO, FUZZY_LENGTH = 10, 10, 200, 5, 0.85, 3
SEMANTIC_RESULTS, SEMANTIC_WHOLE, SEMANTIC_SCORE, SEMANTIC_LENGTH, LABEL_ROWS = 3, 5, 0.70, 2, 5


def candidates(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """``queries`` with one row per candidate name, ``ord`` and ``candidate``, longest first."""
    return queries.select("*", F.posexplode(keywords(F.col(text_col))).alias("ord", "candidate"))


def search_values(graph: Graph, primary: bool = False) -> DataFrame:
    """(id, label, value) of searchable properties, lower-cased; only the first of each label if ``primary``."""
    keep = [(label, key) for label, keys in graph.searchable.items() for key in (sorted(keys)[:1] if primary else keys)]
    if not keep:
        return graph.properties.limit(0).select("id", "label", F.col("value"))
    wanted = F.array(*[F.lit(f"{a}\x00{b}") for a, b in keep])
    return graph.properties.where(F.array_contains(wanted, F.concat_ws("\x00", "label", "key"))).where("value is not null").select("id", "label", F.lower("value").alias("value"))


def _first_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each candidate: Spark keeps n per task before the shuffle."""
    ranked = df.withColumn("at", F.row_number().over(_window("candidate").orderBy(*order)))
    return ranked.where(F.col("at") <= n).drop("at")


def _window(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def match_exact(graph: Graph, names: DataFrame, limit: int = EXACT_ROWS) -> DataFrame:
    """(candidate, id, label) where a searchable value equals the candidate, an equi-join."""
    found = names.select("candidate").distinct().join(search_values(graph), F.col("candidate") == F.col("value")).select("candidate", "id", "label").distinct()
    return _first_rows(found, limit, F.col("id"))


def match_partial(graph: Graph, names: DataFrame, limit: int = PARTIAL_ROWS) -> DataFrame:
    """... where a searchable value contains it. Candidates are a question's, a handful, and broadcast after the bound is checked."""
    found = _small(names).join(search_values(graph), F.col("value").contains(F.col("candidate"))).select("candidate", "id", "label").distinct()
    return _first_rows(found, limit, F.col("id"))


def _small(names: DataFrame, most: int = 10_000) -> DataFrame:
    names = names.select("candidate").where("candidate <> ''").distinct()
    return F.broadcast(names) if names.limit(most + 1).count() <= most else names


def match_fuzzy(graph: Graph, names: DataFrame, ratio: float = FUZZY_RATIO, rows: int = FUZZY_ROWS, limit: int = FUZZY_RESULTS) -> DataFrame:
    """... where the label's first searchable value is of similar length and the Indel ratio reaches ``ratio``; the best few, with their score."""
    values = search_values(graph, primary=True)
    half = F.floor(F.length("candidate") / 2)
    near = _small(names.where(F.length("candidate") > FUZZY_LENGTH)).join(values, F.length("value").between(F.greatest(F.length("candidate") - half, F.lit(1)), F.length("candidate") + half))
    near = _first_rows(near, rows, F.col("id"))
    scored = near.select("candidate", "id", "label", indel_ratio(F.col("candidate"), F.col("value")).alias("score")).where(F.col("score") >= ratio)
    return _first_rows(scored, limit, F.desc("score"), F.col("id"))


def match_semantic(vectors: DataFrame, names: DataFrame, threshold: float = SEMANTIC_SCORE, limit: int = SEMANTIC_RESULTS) -> DataFrame:
    """(candidate, id, label, score): for each of ``names`` (candidate, asked: its vector) the nearest of all ``vectors`` (id, label, embedding) by cosine, at least ``threshold``.

    Names are a question's, broadcast after the bound is checked; null vectors are near nothing.
    """
    few = names.where("candidate <> '' and asked is not null").select("candidate", "asked").dropDuplicates(["candidate"])
    few = F.broadcast(few) if few.limit(10_001).count() <= 10_000 else few
    scored = vectors.where("embedding is not null").join(few, F.length("candidate") > SEMANTIC_LENGTH).select("candidate", "id", "label", F.round(cosine(F.col("embedding"), F.col("asked")), 6).alias("score"))
    return _first_rows(scored.where(F.col("score") >= threshold), limit, F.desc("score"), F.col("id"))


def extract(graph: Graph, queries: DataFrame, text_col: str = "text", fuzzy: bool = True, vectors: DataFrame | None = None, asked: DataFrame | None = None, threshold: float = SEMANTIC_SCORE) -> DataFrame:
    """(query_id, id, label, stage, ord): for every candidate the first stage that finds anything; a node once per query, by its first candidate.

    The fourth stage needs ``vectors`` (id, label, embedding) of nodes and ``asked``
    (candidate, asked) of candidates.
    """
    own = candidates(queries, text_col).select("query_id", "ord", "candidate")
    exact = match_exact(graph, own).withColumn("stage", F.lit(1))
    rest = own.join(exact.select("candidate").distinct(), "candidate", "left_anti")
    partial = match_partial(graph, rest).withColumn("stage", F.lit(2))
    found = exact.unionByName(partial)
    if fuzzy:
        rest = rest.join(partial.select("candidate").distinct(), "candidate", "left_anti")
        near = match_fuzzy(graph, rest).drop("score").withColumn("stage", F.lit(3))
        found = found.unionByName(near)
    if vectors is not None and asked is not None:
        rest = asked.join(own.select("candidate").distinct(), "candidate", "left_semi").join(found.select("candidate").distinct(), "candidate", "left_anti")
        found = found.unionByName(match_semantic(vectors, rest, threshold).drop("score").withColumn("stage", F.lit(4)))
    hits = own.join(found, "candidate")
    return hits.groupBy("query_id", "id", "label").agg(F.min(F.struct("ord", "stage")).alias("x")).select("query_id", "id", "label", "x.stage", "x.ord")


def label_match(graph: Graph, question: str, labels: list[str]) -> DataFrame | None:
    """The busiest nodes of the first label whose name the question contains."""
    low = question.lower()
    for label in labels:
        if label.lower() in low:
            top = schema.top_degree(graph, label, LABEL_ROWS)
            if not top.isEmpty():
                return top
    return None


def semantic(vectors: DataFrame, query: list[float], threshold: float = SEMANTIC_SCORE, limit: int = SEMANTIC_RESULTS, vector_col: str = "embedding", id_col: str = "id", scan: int | None = None) -> DataFrame:
    """(id, score): the nearest vectors by cosine, at least ``threshold``; of the first ``scan`` ids only if that is set."""
    rows = vectors.where(F.col(vector_col).isNotNull())
    if scan is not None:
        rows = rows.orderBy(id_col).limit(scan)
    scored = rows.select(id_col, F.round(cosine(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query])), 6).alias("score"))
    return scored.where(F.col("score") >= threshold).orderBy(F.desc("score"), id_col).limit(limit)


def classify(queries: DataFrame, intents: DataFrame, text_col: str = "text") -> DataFrame:
    """``queries`` with ``intent``: abstract if a marker and no keyword occurs, else the first intent one of whose keywords does, else general.

    Intents are a configuration's, so they travel as one array; the questions are never shuffled.
    """
    table = intents.select(F.struct("ord", "name", F.transform("keywords", lambda k: F.lower(k)).alias("keywords")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("intents"))
    low = F.lower(F.col(text_col))
    hit = F.get(F.filter("intents", lambda x: F.exists(x["keywords"], lambda k: low.contains(k))), 0)["name"]
    marked = F.exists(strings(ABSTRACT_MARKERS), lambda m: low.contains(m))
    return queries.join(F.broadcast(table)).withColumn("intent", F.coalesce(hit, F.when(marked, "abstract"), F.lit("general"))).drop("intents")
