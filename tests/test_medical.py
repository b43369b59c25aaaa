"""The sample medical graph against results worked out by hand."""

import pytest

from graphweft.operators import configuration, retrieval, schema
from graphweft.operators import traverse as t
from graphweft.plans import agent, evaluation
from graphweft.plans.model import Offline
from graphweft.plans.question import QuestionPipeline
from graphweft.sources import graph as graphs
from graphweft.sources import sample


@pytest.fixture(scope="module")
def graph(spark):
    g = graphs.build(spark, sample.NODES, sample.RELATIONSHIPS)
    g = graphs.Graph(g.nodes.cache(), g.edges.cache(), g.properties.cache())
    return graphs.Graph(g.nodes, g.edges, g.properties, schema.discover(g)["searchable_properties"])


@pytest.fixture(scope="module")
def pipeline(graph):
    return QuestionPipeline(graph, sample.CONFIG)


def ids(*names):
    label = {n: f"{kind}:{n}" for n, kind, _ in sample.NODES}
    return [label[n] for n in names]


def ends(df, side="target_id"):
    return sorted(r[side].split(":")[1] for r in df.collect())


def test_discovery(graph):
    s = schema.discover(graph)
    assert s["node_counts"] == {"Disease": 8, "Drug": 8, "SideEffect": 9, "Symptom": 7}
    assert (s["total_nodes"], s["total_relationships"]) == (32, 37)
    found = {(p["type"], p["source_label"], p["target_label"]): p["count"] for p in s["relationships"]}
    assert found == {
        ("CAUSES", "Drug", "SideEffect"): 13, ("TREATS", "Drug", "Disease"): 10, ("HAS_SYMPTOM", "Disease", "Symptom"): 7,
        ("INCREASES_RISK_OF", "SideEffect", "Disease"): 3, ("INTERACTS_WITH", "Drug", "Drug"): 3, ("HAS_SYMPTOM", "Disease", "SideEffect"): 1,
    }
    assert [p["count"] for p in s["relationships"]] == sorted(found.values(), reverse=True)
    assert "name" in s["searchable_properties"]["Symptom"]


def test_generated_configuration(spark, graph):
    config = configuration.generate(spark, schema.discover(graph))
    kinds = [s["strategy"] for s in config["intent_patterns"].values()]
    assert len(kinds) == 19 and kinds.count("chained") == 5 and len(config["relationship_templates"]) == 5
    assert kinds == sorted(kinds, key=configuration.PRIORITY.index)
    assert all(k == k.lower() for s in config["intent_patterns"].values() for k in s["keywords"])
    assert all("{source}" in x and "{target}" in x for x in config["relationship_templates"].values())
    assert config["intent_patterns"]["drug_causes"]["keywords"] == ["causes", "causes side effect", "side effect of", "what does it causes", "what side effect"]
    assert "treated by" in config["intent_patterns"]["disease_treats_reverse"]["keywords"]


@pytest.mark.parametrize(
    ("question", "entries", "intent"),
    [
        ("What are the side effects of aspirin?", ["Aspirin"], "side_effects"),
        ("What treats headaches?", ["Headache"], "treated_by"),
        ("Can I take aspirin with warfarin?", ["Aspirin", "Warfarin"], "interaction"),
        ("What are the symptoms of diabetes?", ["Diabetes"], "symptoms"),
        ("Give me an overview of metformin", ["Metformin"], "neighborhood"),
        ("How is aspirin connected to peptic ulcer?", ["Peptic Ulcer", "Aspirin"], "connection"),
        ("What do aspirin and ibuprofen have in common?", ["Aspirin", "Ibuprofen"], "shared_effects"),
        ("What symptoms does aspirin indirectly cause through the diseases it treats?", ["Aspirin"], "indirect_symptoms"),
        ("What diseases does aspirin lead to through its side effects?", ["Aspirin"], "drug_risk_chain"),
        ("What does ibuprofen treat?", ["Ibuprofen"], "treatment"),
        ("How is aspirin connected to kidney damage?", ["Kidney Damage", "Aspirin", "Liver Damage"], "connection"),
        ("Who is the Prime Minister of India?", [], "general"),
        ("xyzzy foobar blargh 12345", [], "general"),
        ("", [], "general"),
    ],
)
def test_entries_and_intents(pipeline, question, entries, intent):
    assert [e["name"] for e in pipeline.entries(question)] == entries
    assert pipeline.intent(question) == intent


def test_set_based_classification_agrees(spark, pipeline):
    asked = ["Why are drugs used?", "Tell me about drugs", "What treats headaches?", "Give me an overview of metformin"]
    found = retrieval.classify(spark.createDataFrame(list(enumerate(asked)), "i int, text string"), pipeline.intents).orderBy("i").collect()
    assert [r.intent for r in found] == [pipeline.intent(q) for q in asked] == ["abstract", "general", "treated_by", "neighborhood"]


def test_label_match_finds_the_busiest(pipeline):
    assert len(pipeline.entries("Tell me about drugs")) == 5


def test_traversals(graph):
    assert ends(t.targeted(graph, ids("Aspirin"), "CAUSES")) == ["Nausea", "Stomach Bleeding"]
    assert ends(t.targeted(graph, ids("Headache"), "TREATS", anchor="target"), "source_id") == ["Aspirin", "Ibuprofen"]
    both = t.targeted(graph, ids("Aspirin", "Warfarin"), "INTERACTS_WITH", "Drug", "Drug", "either").collect()
    assert len(both) == 6 and {(r.target_id, r.source_id) for r in both} == {(r.source_id, r.target_id) for r in both}
    assert t.chained_paths(graph, ids("Aspirin"), "Drug", [t.Hop("TREATS", "Disease"), t.Hop("HAS_SYMPTOM", "Symptom")]).count() == 2
    assert t.chained(graph, ids("Aspirin"), "Drug", [t.Hop("TREATS", "Disease"), t.Hop("HAS_SYMPTOM", "Symptom")]).count() == 4
    assert ends(t.chained(graph, ids("Aspirin"), "Drug", [t.Hop("CAUSES"), t.Hop("INCREASES_RISK_OF")])) == ["Peptic Ulcer", "Stomach Bleeding"]
    assert (t.trails(graph, ids("Metformin")).count(), t.variable_hop(graph, ids("Metformin")).count()) == (4, 4)
    assert (t.trails(graph, ids("Aspirin")).count(), t.variable_hop(graph, ids("Aspirin")).count()) == (10, 10)
    assert (t.trails(graph, ids("Aspirin"), 1, 6).count(), t.shortest_path(graph, ids("Aspirin")).count()) == (16, 12)
    shared = t.shared_neighbor(graph, ids("Aspirin", "Ibuprofen"))
    assert shared.count() == 6 and set(ends(shared)) == {"Headache", "Nausea", "Warfarin"}


def test_shortest_paths(graph):
    path = t.shortest_paths(graph, ids("Aspirin", "Peptic Ulcer")).collect()
    assert len(path) == 1 and {n.split(":")[1] for n in path[0].nodes} == {"Aspirin", "Stomach Bleeding", "Peptic Ulcer"}
    path = t.shortest_paths(graph, ids("Aspirin", "Kidney Damage")).collect()[0]
    assert [n.split(":")[1] for n in path.nodes] == ["Aspirin", "Headache", "Ibuprofen", "Kidney Damage"]
    assert t.shortest_path(graph, ids("Aspirin", "Kidney Damage")).count() == 3
    assert t.shortest_paths(graph, ids("Aspirin", "Fever"), 1).count() == 0


def test_no_entries_and_unknown_strategies(graph):
    assert t.traverse(graph, [], {}, "general").strategy == "none"
    odd = t.traverse(graph, ids("Aspirin"), {"x": t.Pattern(strategy="leap")}, "x")
    assert odd.strategy == "leap" and odd.edges.count() == 5
    assert t.traverse(graph, ids("Aspirin"), {}, "whatever").strategy == "general"


def test_hops_read_the_edges_once_per_step(graph):
    plan = t.chained(graph, ids("Aspirin"), "Drug", [t.Hop("TREATS"), t.Hop("HAS_SYMPTOM")])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize(
    ("question", "strategy", "names"),
    [
        ("What are the side effects of aspirin?", "targeted", {"Nausea", "Stomach Bleeding"}),
        ("What treats headaches?", "targeted", {"Aspirin", "Ibuprofen"}),
        ("What symptoms does aspirin indirectly cause through the diseases it treats?", "chained", {"Severe Pain", "Chest Pain"}),
        ("Give me an overview of metformin", "variable_hop", {"Diabetes", "Frequent Urination"}),
        ("How is aspirin connected to peptic ulcer?", "shortest_path", {"Stomach Bleeding"}),
        ("What side effects do aspirin and ibuprofen share?", "shared_neighbor", {"Nausea"}),
    ],
)
def test_questions_end_to_end(pipeline, question, strategy, names):
    r = pipeline.query(question)
    assert r.strategy == strategy and names <= set(r.entry_nodes) and r.answer is None
    assert "RELATIONSHIPS:" in r.context and len({n["id"] for n in r.subgraph["nodes"]}) == len(r.subgraph["nodes"])


def test_rejection_abstract_and_answers(graph, pipeline):
    r = pipeline.query("Who is the Prime Minister of India?")
    assert (r.intent, r.strategy, r.context) == ("out_of_scope", "none", "") and "outside" in r.answer
    r = pipeline.query("Why are drugs used?")
    assert r.intent == "abstract" and r.context.startswith("RELATIONSHIP PATTERNS")
    model = Offline(lambda prompt: "Nausea, says the graph." if "Context:" in prompt else "?")
    r = QuestionPipeline(graph, sample.CONFIG, model).query("What are the side effects of aspirin?")
    assert r.answer == "Nausea, says the graph." and "llm_ms" in r.timing
    r = QuestionPipeline(graph, sample.CONFIG, Offline()).query("What are the side effects of aspirin?")
    assert r.context in r.answer


def test_names_and_questions_match_by_meaning(spark, graph):
    class Meaning(Offline):
        def embed_text(self, text):
            if "broken" in text:
                raise RuntimeError("overloaded")
            return [1.0, 0.0] if "xyzzy" in text or "qx" in text else [0.0, 0.0]

    (aspirin, ibuprofen), model = ids("Aspirin", "Ibuprofen"), Meaning()
    vectors = spark.createDataFrame([(aspirin, "Drug", [1.0, 0.1]), (ibuprofen, "Drug", [0.2, 0.9]), (ibuprofen, "Drug", None)], "id string, label string, embedding array<double>")
    pipeline = QuestionPipeline(graph, sample.CONFIG, model, vectors)
    assert pipeline.entries("What does xyzzy do?") == [{"id": aspirin, "name": "Aspirin"}]  # a candidate's fourth stage
    assert pipeline.entries("qx?") == [{"id": aspirin, "name": "Aspirin"}]  # too short a candidate: the whole question
    assert pipeline.entries("quux?") == pipeline.entries("broken quux?") == []
    assert [e["name"] for e in pipeline.entries("What treats headaches?")] == [e["name"] for e in QuestionPipeline(graph, sample.CONFIG).entries("What treats headaches?")]
    stages = retrieval.extract(graph, spark.createDataFrame([(0, "xyzzy or ibuprofen")], "query_id int, text string"), vectors=vectors, asked=spark.createDataFrame([("xyzzy", [1.0, 0.0]), ("ibuprofen", [1.0, 0.0])], "candidate string, asked array<double>"))
    assert {(r.id, r.stage) for r in stages.collect()} == {(aspirin, 4), (ibuprofen, 1)}  # a name found before is not looked for by meaning


def test_evaluation_suite(spark, pipeline):
    cases = [
        evaluation.Case("effects", "coverage", "What are the side effects of aspirin?", expect_min_facts=1, expect_rel_types=("CAUSES",)),
        evaluation.Case("reject", "rejection", "xyzzy foobar", expect_intent="out_of_scope", expect_no_llm_call=True),
        evaluation.Case("wrong", "coverage", "What treats headaches?", expect_intent="symptoms", expect_no_rel_types=("TREATS",)),
    ]
    scores = evaluation.run(spark, pipeline, cases)
    found = {r.name: (r.passed, r.details) for r in scores.collect()}
    assert found["effects"] == (True, "PASS") and found["reject"][0]
    assert found["wrong"] == (False, "intent treated_by; forbidden TREATS")
    assert round(evaluation.pass_rate(scores).first()[0], 1) == 66.7


def test_agent(spark, pipeline, tmp_path):
    from graphweft.operators.memory import Memory

    def reply(prompt):
        return '["What are the side effects of aspirin?", "What treats headaches?"]' if "JSON array" in prompt else "Together: nausea."

    model = Offline(reply)
    memory = Memory(spark, str(tmp_path / "memory"), model.embed_text)
    a = agent.Agent(pipeline, memory, model)
    r = a.execute("What about aspirin and headaches?", "med")
    assert r.answer == "Together: nausea." and len(r.sub_results) >= 2 and not r.memory_hit
    again = agent.Agent(pipeline, Memory(spark, str(tmp_path / "memory"), model.embed_text), model).execute("What about aspirin and headaches?", "med")
    assert again.memory_hit and again.answer == r.answer
    assert memory.table().count() == 1 and memory.stats("med")["total"] == 1 and memory.stats("other")["total"] == 0


def test_agent_verdicts():
    assert agent.evaluate([0, 0], ["out_of_scope"] * 2, ["", ""]) == {"sufficient": True, "gaps": [], "coverage": 0.0}
    assert agent.evaluate([3, 4], ["a", "b"], ["x", ""]) == {"sufficient": True, "gaps": [], "coverage": 0.7}
    assert not agent.evaluate([1], ["a"], [""])["sufficient"] and len(agent.evaluate([1], ["a"], [""])["gaps"]) == 2
    assert agent.sub_questions('["a", "b", "c", "d"]', 3) == ["a", "b", "c"]
    assert agent.sub_questions("no", 3) is None and agent.sub_questions("[1]", 3) is None and agent.sub_questions("[oops", 3) is None
