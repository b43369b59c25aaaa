"""Text functions, construction, ranking, memory, catalog and streaming in small."""

import pytest
from pyspark.sql import functions as F

from graphweft.functions import text as tx
from graphweft.operators import construction as c
from graphweft.operators import memory, ranking
from graphweft.operators.catalog import Catalog
from graphweft.sources import graph as graphs
from graphweft.sources import sample
from graphweft.streaming.memory_stats import windowed_counts


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_keywords(spark):
    words = one(spark, tx.keywords(F.col("q")), q="What are the side effects of well-known Aspirin?")
    assert words == ["side effects well-known", "effects well-known aspirin", "side effects", "effects well-known", "well-known aspirin", "side", "effects", "well-known", "aspirin"]
    assert one(spark, tx.keywords(F.col("q")), q="what is the") == ["what is the", "what is", "is the", "what", "is", "the"]
    assert one(spark, tx.keywords(F.col("q")), q="?!") == []


@pytest.mark.parametrize(("a", "b", "ratio"), [("headaches", "headache", 16 / 17), ("aspirin", "asprin", 12 / 13), ("abc", "xyz", 0), ("", "", 1), ("a", "", 0)])
def test_indel_ratio(spark, a, b, ratio):
    assert one(spark, tx.indel_ratio(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(ratio)


def test_names(spark):
    assert one(spark, tx.humanize(F.col("x")), x="SideEffect_OF") == "side effect of"
    assert [one(spark, tx.past_participle(F.col("x")), x=x) for x in ("causes", "treats", "use", "directed")] == ["caused", "treated", "used", "directeded"]
    assert one(spark, tx.entity_name(F.col("x")), x="  high   blood ") == "High Blood"
    assert one(spark, tx.relation_name(F.col("x")), x="treats/cures") == "TREATSCURES"
    assert one(spark, tx.relation_name(F.col("x")), x="is part-of") == "IS_PART_OF"
    for raw, key in (("ASPIRIN", "aspirin"), ("the flu", "flu"), ("an Apple", "apple"), ("high-blood pressure", "highblood pressure"), ("  foo   bar  ", "foo bar")):
        assert one(spark, tx.entity_key(F.col("x")), x=raw) == key
    assert one(spark, tx.default_graph_name(F.col("u"), F.col("d")), u="bolt://user@host.example:7687", d="neo") == "neo@host.example"
    assert one(spark, tx.json_strings(F.col("x"), 2), x='["a", "b", "c"]') == ["a", "b"]
    assert one(spark, tx.comma_list(F.col("x")), x="a, ,b") == ["a", "b"]
    assert one(spark, tx.intent_reply(F.col("x")), x="  Side_Effects. ") == "side_effects"


def test_cosine(spark):
    assert one(spark, tx.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(2**-0.5)
    assert one(spark, tx.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_chunks(spark):
    cut = lambda t, n, o=0: one(spark, c.chunks(F.col("t"), n, o), t=t)
    assert cut("", 9) == [] and cut("   \n\n  ", 9) == []
    assert cut("Hello there.", 500) == ["Hello there."]
    assert cut("First paragraph.\n\nSecond paragraph.\n\nThird paragraph.", 30) == ["First paragraph.", "Second paragraph.", "Third paragraph."]
    long = cut("Word " * 500, 200)
    assert all(0 < len(x) <= 200 for x in long) and len(long) >= 12
    over = cut("\n\n".join(w * 50 for w in ("Alpha ", "Beta ", "Gamma ")), 350, 50)
    assert len(over) >= 2 and over[0][-20:] in over[1]


def test_sentences(spark):
    cut = lambda t: one(spark, tx.sentences(F.col("t")), t=t)
    assert cut("") == []
    assert cut("First one. Second one! Third?") == ["First one.", "Second one!", "Third?"]
    assert cut("Dr. Smith went to Washington. He arrived at 5 p.m.") == ["Dr. Smith went to Washington.", "He arrived at 5 p.m."]


def triples(spark, *rows):
    return spark.createDataFrame([(*r, "", "", 1.0, "")[:7] for r in rows], c.TRIPLE)


def test_resolution(spark):
    t, canon = c.resolve_entities(triples(spark, ("the flu", "AFFECTS", "patient"), ("flu", "AFFECTS", "PATIENT"), ("Flu", "AFFECTS", "patient")))
    assert [tuple(r) for r in t.collect()] == [("Flu", "AFFECTS", "Patient")]
    assert {r.key: r.canonical for r in canon.collect()} == {"flu": "Flu", "patient": "Patient"}
    assert c.resolve_entities(triples(spark))[0].count() == 0


def test_extraction(spark):
    replies = spark.createDataFrame([("1", '[{"head": " aspirin ", "relation": "treats", "tail": "pain", "confidence": 0.9}, {"head": "", "relation": "r", "tail": "x"}, 7]'), ("2", "no json"), ("3", '[{"head": "a", "relation": "b", "tail": "c", "confidence": 0.1}]')], "chunk string, reply string")
    rows = c.extract_triples(replies, min_confidence=0.5).collect()
    assert [(r.head, r.relation, r.tail, r.source_chunk) for r in rows] in ([("Aspirin", "TREATS", "Pain", "1")], [])


def test_types(spark):
    members = spark.createDataFrame([(t, e) for t, es in {"A": "xyz", "B": "xyz", "C": "pq", "D": "xyw"}.items() for e in es], "type string, entity string")
    assert [(r.a, r.b, r.similarity) for r in c.jaccard_pairs(members).collect()] == [("A", "B", 1.0)]
    assert {r.type: r.merged for r in c.merge_types(members).collect()} == {"A": "A", "B": "A", "C": "C", "D": "D"}
    props = spark.createDataFrame([("L", k, v) for k, vs in {"i": "1 2", "f": "1 2.5", "b": "true False", "d": "2024-01-02 2024-02-03", "s": "1 x"}.items() for v in vs.split()] + [("L", "e", None)], "label string, key string, value string")
    assert {r.key: r.data_type for r in c.infer_types(props).collect()} == {"i": "INTEGER", "f": "FLOAT", "b": "BOOLEAN", "d": "DATE", "s": "STRING", "e": "STRING"}
    parents = spark.createDataFrame([("dog", "mammal"), ("mammal", "animal"), ("animal", None), ("loop", "loop2"), ("loop2", "loop")], "type string, parent string")
    found = {(r.type, r.ancestor): r.depth for r in c.type_hierarchy(parents).collect()}
    assert found["dog", "animal"] == 2 and found["loop", "loop2"] == 1
    assert {r.type: r.depth for r in c.type_depths(parents).collect()}["dog"] == 2
    known, seen = (spark.createDataFrame(x, "name string, n long") for x in ([("Drug", 5), ("Disease", 2)], [("Drugs", 1), ("Hospital", 1), ("drug", 2)]))
    assert {r.name: (r.change, r.n) for r in c.schema_diff(known, seen).collect()} == {"Drugs": ("ALIAS", 1), "Hospital": ("NEW", 1), "drug": ("KNOWN", 7)}


def test_scores(spark):
    edges = spark.createDataFrame([("a", "CAUSES", "b", 0), ("a", "INCREASES_RISK_OF", "c", 1), ("a", "IS", "b", 2), ("a", "CAUSES", "b", 3)], "source_id string, rel_type string, target_id string, ord int")
    names = spark.createDataFrame([("a", "Aspirin"), ("b", "Stomach Bleeding"), ("c", None)], "id string, name string")
    kept = ranking.filter_edges(edges)
    assert kept.count() == 3
    found = {r.rel_type: r.points for r in ranking.score_edges(kept, names, "CAUSES", "does aspirin cause bleeding").collect()}
    assert found == {"CAUSES": 10 + 40 + 30 + 10, "INCREASES_RISK_OF": 10 + 15 + 10 + 10, "IS": 10 + 30}


def test_memory_recall_order(spark):
    rows = [("1", "q1", [1.0, 0.0], "a", "", "", "", 0.0, "", "d", 10.0), ("2", "q2", [1.0, 0.1], "b", "", "", "", 0.0, "", "d", 20.0), ("3", "q3", None, "c", "", "", "", 0.0, "", "d", 30.0), ("4", "q4", [1.0, 0.0], "x", "", "", "", 0.0, "", "e", 30.0)]
    m = spark.createDataFrame(rows, memory.SCHEMA)
    found = memory.recall(m, F.array(F.lit(1.0), F.lit(0.0)), "d", 100.0).collect()
    assert [(r.query_text, r.age_seconds) for r in found] == [("q1", 90.0), ("q2", 80.0)]
    assert memory.stats(m, 3625.0).first().asDict() == {"total": 4, "last_hour": 2}


def test_catalog(spark, tmp_path):
    path = str(tmp_path / "graph")
    graphs.build(spark, sample.NODES, sample.RELATIONSHIPS).save(path)
    assert graphs.check(spark, path) == (True, "ok") and not graphs.check(spark, path + "x")[0]
    cat = Catalog(spark, str(tmp_path / "catalog"))
    with pytest.raises(ConnectionError):
        cat.register(path + "x")
    made = cat.register(path, "med", now=1.0)
    assert made["total_relationships"] == 37 and made["strategies"]["chained"] == 5
    cat.ensure_default(path, now=2.0)
    assert [r.kg_id for r in cat.list_all().collect()] == ["default", made["kg_id"]]
    r = cat.pipeline(made["kg_id"]).query("What does aspirin cause?")
    assert r.intent != "out_of_scope"
    assert cat.list_all().first().kg_id == made["kg_id"]
    assert cat.delete(made["kg_id"]) and not cat.delete("nope")
    with pytest.raises(KeyError):
        cat.pipeline(made["kg_id"])


def test_merge_semantics(spark):
    g = graphs.build(spark, [("A", "X", {"k": 1}), ("A", "X", {}), ("A", "Y", {}), ("B", "X", {})], [("A", "R", "B"), ("A", "R", "B"), ("A", "R", "none")])
    assert g.nodes.count() == 3 and sorted(r.source_id for r in g.edges.collect()) == ["X:A", "Y:A"]


def test_stream_counts(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b"), ("2024-01-01 05:00:00", "z")], "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r.window_start), r.key, r.n) for r in spark.table("counts").collect()) == [("2024-01-01 00:00:00", "a", 2), ("2024-01-01 01:00:00", "b", 1)]


def test_cardinality_and_wider_names(spark):
    from graphweft.operators import schema

    g = graphs.build(spark, [("a", "X", {}), ("b", "X", {}), ("c", "Y", {}), ("d", "Y", {})], [("a", "R", "c"), ("a", "R", "d")])
    assert schema.cardinality(g).first().cardinality == "1:N"
    assert schema.cardinality_bounds(g).first().notation == "[0..2] -> [1..1]"
    profile = spark.createDataFrame([("L", "email", "Integer", 0.9), ("L", "age", "Integer", 0.1)], "label string, key string, type string, unique_ratio double")
    assert schema.searchable(profile).count() == 0 and schema.searchable(profile, schema.WIDER_NAMES).first().key == "email"


def test_hierarchy_lookups(spark):
    h = c.type_hierarchy(spark.createDataFrame([("doctor", "person"), ("person", "entity"), ("drug", "entity")], "type string, parent string"))
    assert {r.type for r in c.subtypes(h, "entity").collect()} == {"person", "drug"}
    assert {r.type for r in c.subtypes(h, "entity", True).collect()} == {"person", "drug", "doctor"}
    assert [r.ancestor for r in c.supertypes(h, "doctor").collect()] == ["person"]
    depths = c.type_depths(spark.createDataFrame([("child", "root")], "type string, parent string"))
    assert (c.depth_of(depths, "root"), c.depth_of(depths, "child"), c.depth_of(depths, "unknown")) == (0, 1, -1)
    known, seen = (spark.createDataFrame(x, "name string, n long") for x in ([("Drug", 5)], [("Hospital", 1), ("Drug", 2)]))
    assert c.diff_summary(c.schema_diff(known, seen)) == "1 changes; new: Hospital"


def test_staged_build(spark):
    from graphweft.plans import build
    from graphweft.plans.model import Offline

    model = Offline(lambda prompt: build.heuristic_reply(prompt[len(build.PROMPT) :]))
    docs = spark.createDataFrame([(1, "Aspirin treats headache. aspirin treats HEADACHE. Ibuprofen treats fever.")], "doc_id long, text string")
    r = build.run(spark, docs, model)
    assert r.stages_completed == ["extraction", "induction", "resolution", "build", "discovery"] and not r.errors
    assert r.triples.count() == 3 and r.resolved.count() == 2 and r.discovered["total_relationships"] == 2
    r = build.run(spark, spark.createDataFrame([(1, "")], "doc_id long, text string"), model)
    assert r.stages_completed == [] and "No triples extracted" in r.report()


def test_service(spark, tmp_path):
    from graphweft.plans.model import Offline
    from graphweft.plans.service import Service, ServiceError

    path = str(tmp_path / "g")
    graphs.build(spark, sample.NODES, sample.RELATIONSHIPS).save(path)
    service = Service(Catalog(spark, str(tmp_path / "c")), str(tmp_path / "m"), Offline(lambda p: '["What does aspirin cause?"]' if "JSON array" in p else "Nausea."))
    made = service.connect(path, "med")
    assert service.health()["status"] == "healthy" and len(service.graphs()["graphs"]) == 1
    assert service.graph(made["kg_id"])["schema"] == service.schema(made["kg_id"])
    r = service.query("What does aspirin cause?", made["kg_id"])
    assert "Nausea" in r["entities"] and r["answer"] == "Nausea."
    r = service.agent_query("What does aspirin cause?", made["kg_id"])
    assert r["answer"] == "Nausea." and service.memory_stats(made["kg_id"])["total_memories"] == 1
    assert service.recall("What does aspirin cause?", made["kg_id"])["results"][0]["similarity"] == 1.0
    for call, status in ((lambda: service.delete("default"), 400), (lambda: service.graph("none"), 404), (lambda: service.connect(path + "x"), 400)):
        with pytest.raises(ServiceError) as e:
            call()
        assert e.value.status == status
    assert service.delete(made["kg_id"])["status"] == "deleted"


def test_command_line(spark, tmp_path, capsys):
    from graphweft.plans import cli

    cli.main([str(tmp_path / "g"), "What treats headaches?", "--seed"])
    out = capsys.readouterr().out
    assert "32 nodes, 37 relationships" in out and "Ibuprofen treats Headache" in out


def test_a_hop_on_a_saved_graph_is_pushed_to_the_scan(spark, tmp_path):
    from graphweft.operators import traverse as t

    path = str(tmp_path / "g")
    graphs.build(spark, sample.NODES, sample.RELATIONSHIPS).save(path)
    hop = t.targeted(graphs.load(spark, path), ["Drug:Aspirin"], "CAUSES", "Drug", "SideEffect")
    assert hop.count() == 2
    plan = hop._jdf.queryExecution().executedPlan().toString()
    assert "rel_type" in plan.split("PartitionFilters: [")[1].split("]")[0] and "source_" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert "rel_props" not in plan.split("ReadSchema: ")[1]


def test_an_anchor_on_tables_is_pushed_to_the_scan(spark, tmp_path):
    from graphweft.operators import traverse as t
    from graphweft.sources.graph import EDGE_TABLES, NODE_TABLES, from_tables

    for table in {n[1] for n in NODE_TABLES} | {e[5] for e in EDGE_TABLES}:
        columns = {c: "long" for n in NODE_TABLES if n[1] == table for c in [n[2], *filter(None, [n[3]]), *(m[1] for m in n[4])]} | {c: "long" for e in EDGE_TABLES if e[5] == table for c in (e[2], e[4])}
        spark.createDataFrame([tuple(range(1, len(columns) + 1))], ", ".join(f"{c} {k}" for c, k in columns.items())).write.parquet(f"{tmp_path}/{table}.parquet")
    g = from_tables(spark, str(tmp_path))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    hop = plan(t.targeted(g, ["Customer:1", "Customer:4"], "PLACED", "Customer", "Order"))
    assert hop.count("FileScan") == 1 and "In(o_custkey, [1,4])" in hop.split("PushedFilters: [")[1]
    hop = plan(t.targeted(g, ["Part:1"], "SUPPLIES", "Supplier", "Part", "target"))
    assert hop.count("FileScan") == 1 and "EqualTo(l_partkey,1)" in hop
    assert plan(t.general(g, ["Supplier:1", "Customer:7", "Customer:07", "Customer:x", "Nowhere:1"])).count("FileScan") == 4  # LOCATED_IN, SUPPLIES, LIVES_IN, PLACED
    assert t.general(g, ["Nowhere:1", "Customer:x"]).count() == 0


def test_later_properties_win(spark):
    rows = [("a", "L", {"x": 1, "y": 1}), ("b", "L", {"x": 5}), ("a", "L", {"x": 2}), ("a", "L", {"z": 3, "x": 4})]
    g = graphs.build(spark, rows, [("a", "R", "b")])
    assert {(r.key, r.value) for r in g.properties.where("id = 'L:a'").collect()} == {("x", "4"), ("y", "1"), ("z", "3"), ("name", "a")}
    n = spark.createDataFrame([(2, "a", "L", ["x"], ["new"], ["String"]), (1, "a", "L", ["x"], ["old"], ["String"])], "ord int, name string, label string, keys array<string>, values array<string>, types array<string>")
    assert graphs.merge(n, spark.createDataFrame([], "source string, type string, target string")).properties.where("key = 'x'").first().value == "new"


def test_trails_tell_edges_apart_by_their_parts(spark):
    """Two edges whose parts, joined, read alike."""
    from graphweft.operators import traverse as t

    edges = spark.createDataFrame([("a", "L", "R~a", "{}", "b", "L"), ("b", "L", "S", "{}", "a~R", "L"), ("a~R", "L", "a", "{}", "b", "L")], graphs.EDGE_SCHEMA)
    g = graphs.Graph(spark.createDataFrame([], graphs.NODE_SCHEMA), edges, spark.createDataFrame([], graphs.PROP_SCHEMA))
    assert max(len(r.path) for r in t.trails(g, ["a"], 1, 3).collect()) == 3


def test_memory_ids_repeat(spark, tmp_path):
    for k in range(2):
        memory.Memory(spark, str(tmp_path / str(k))).store("what?", "that", now=5.0)
    a, b = (memory.Memory(spark, str(tmp_path / str(k))).table().first().id for k in range(2))
    assert a == b
