"""A sample medical graph and the hand-written configuration of its domain."""

from __future__ import annotations

# Nodes (name, label, properties) and relationships (source name, type, target name).
NODES = [
    ("Aspirin", "Drug", {"type": "NSAID"}),
    ("Ibuprofen", "Drug", {"type": "NSAID"}),
    ("Warfarin", "Drug", {"type": "Anticoagulant"}),
    ("Metformin", "Drug", {"type": "Biguanide"}),
    ("Lisinopril", "Drug", {"type": "ACE Inhibitor"}),
    ("Omeprazole", "Drug", {"type": "PPI"}),
    ("Atorvastatin", "Drug", {"type": "Statin"}),
    ("Amoxicillin", "Drug", {"type": "Antibiotic"}),
    ("Headache", "Disease", {"severity": "Mild"}),
    ("Arthritis", "Disease", {"severity": "Moderate"}),
    ("Diabetes", "Disease", {"severity": "Chronic"}),
    ("Hypertension", "Disease", {"severity": "Chronic"}),
    ("Heart Disease", "Disease", {"severity": "Severe"}),
    ("Peptic Ulcer", "Disease", {"severity": "Moderate"}),
    ("High Cholesterol", "Disease", {"severity": "Chronic"}),
    ("Bacterial Infection", "Disease", {"severity": "Moderate"}),
    ("Nausea", "SideEffect", {"severity": "Mild"}),
    ("Stomach Bleeding", "SideEffect", {"severity": "Severe"}),
    ("Kidney Damage", "SideEffect", {"severity": "Severe"}),
    ("Dry Cough", "SideEffect", {"severity": "Mild"}),
    ("Dizziness", "SideEffect", {"severity": "Mild"}),
    ("Fatigue", "SideEffect", {"severity": "Mild"}),
    ("Muscle Pain", "SideEffect", {"severity": "Moderate"}),
    ("Diarrhea", "SideEffect", {"severity": "Mild"}),
    ("Liver Damage", "SideEffect", {"severity": "Severe"}),
    ("Severe Pain", "Symptom", {}),
    ("Joint Pain", "Symptom", {}),
    ("Frequent Urination", "Symptom", {}),
    ("High Blood Pressure", "Symptom", {}),
    ("Chest Pain", "Symptom", {}),
    ("Burning Sensation", "Symptom", {}),
    ("Fever", "Symptom", {}),
]
RELATIONSHIPS = [
    ("Aspirin", "TREATS", "Headache"),
    ("Aspirin", "TREATS", "Heart Disease"),
    ("Aspirin", "CAUSES", "Nausea"),
    ("Aspirin", "CAUSES", "Stomach Bleeding"),
    ("Aspirin", "INTERACTS_WITH", "Warfarin"),
    ("Ibuprofen", "TREATS", "Headache"),
    ("Ibuprofen", "TREATS", "Arthritis"),
    ("Ibuprofen", "CAUSES", "Nausea"),
    ("Ibuprofen", "CAUSES", "Kidney Damage"),
    ("Ibuprofen", "INTERACTS_WITH", "Warfarin"),
    ("Warfarin", "TREATS", "Heart Disease"),
    ("Warfarin", "CAUSES", "Stomach Bleeding"),
    ("Metformin", "TREATS", "Diabetes"),
    ("Metformin", "CAUSES", "Nausea"),
    ("Metformin", "CAUSES", "Fatigue"),
    ("Lisinopril", "TREATS", "Hypertension"),
    ("Lisinopril", "CAUSES", "Dry Cough"),
    ("Lisinopril", "CAUSES", "Dizziness"),
    ("Omeprazole", "TREATS", "Peptic Ulcer"),
    ("Omeprazole", "CAUSES", "Diarrhea"),
    ("Atorvastatin", "TREATS", "High Cholesterol"),
    ("Atorvastatin", "CAUSES", "Muscle Pain"),
    ("Atorvastatin", "CAUSES", "Liver Damage"),
    ("Amoxicillin", "TREATS", "Bacterial Infection"),
    ("Amoxicillin", "CAUSES", "Diarrhea"),
    ("Amoxicillin", "INTERACTS_WITH", "Warfarin"),
    ("Headache", "HAS_SYMPTOM", "Severe Pain"),
    ("Arthritis", "HAS_SYMPTOM", "Joint Pain"),
    ("Diabetes", "HAS_SYMPTOM", "Frequent Urination"),
    ("Hypertension", "HAS_SYMPTOM", "High Blood Pressure"),
    ("Heart Disease", "HAS_SYMPTOM", "Chest Pain"),
    ("Peptic Ulcer", "HAS_SYMPTOM", "Burning Sensation"),
    ("Peptic Ulcer", "HAS_SYMPTOM", "Stomach Bleeding"),
    ("Bacterial Infection", "HAS_SYMPTOM", "Fever"),
    ("Stomach Bleeding", "INCREASES_RISK_OF", "Peptic Ulcer"),
    ("Kidney Damage", "INCREASES_RISK_OF", "Hypertension"),
    ("Muscle Pain", "INCREASES_RISK_OF", "Heart Disease"),
]

# Intents in the order they are tried, texts for relationships, rows of a general hop.
CONFIG = {
    "domain": "medical",
    "description": "Medical knowledge graph: Drugs, Diseases, SideEffects, Symptoms",
    "intent_patterns": {
        "indirect_symptoms": {
            "strategy": "chained",
            "keywords": ["indirectly", "diseases it treats", "indirect symptom", "what symptoms does", "related symptoms"],
            "entry_label": "Drug",
            "hops": [{"relationship": "TREATS", "target_label": "Disease"}, {"relationship": "HAS_SYMPTOM", "target_label": "Symptom"}],
        },
        "drug_risk_chain": {
            "strategy": "chained",
            "keywords": ["increases risk of", "risk chain", "lead to", "leads to"],
            "entry_label": "Drug",
            "hops": [{"relationship": "CAUSES", "target_label": "SideEffect"}, {"relationship": "INCREASES_RISK_OF", "target_label": "Disease"}],
        },
        "shared_effects": {
            "strategy": "shared_neighbor",
            "keywords": ["in common", "both cause", "both treat", "share", "same effect", "common side effect"],
            "min_connections": 2,
        },
        "connection": {
            "strategy": "shortest_path",
            "keywords": ["connected", "how is", "what connects", "path between", "link between", "relationship between", "how are"],
            "max_hops": 6,
        },
        "neighborhood": {
            "strategy": "variable_hop",
            "keywords": ["everything about", "overview of", "related to", "all about", "full profile"],
            "min_hops": 1,
            "max_hops": 2,
        },
        "side_effects": {
            "strategy": "targeted",
            "keywords": ["side effect", "side effects", "adverse", "risk", "cause", "causes", "what does it cause"],
            "source_label": "Drug",
            "relationship": "CAUSES",
            "target_label": "SideEffect",
            "entry_anchor": "source",
        },
        "treated_by": {
            "strategy": "targeted",
            "keywords": ["what treats", "treatment for", "treated by", "what can i take for", "what drug", "what medication"],
            "source_label": "Drug",
            "relationship": "TREATS",
            "target_label": "Disease",
            "entry_anchor": "target",
        },
        "treatment": {
            "strategy": "targeted",
            "keywords": ["treat", "cure", "does it help", "medicine for", "drug for", "what does it treat"],
            "source_label": "Drug",
            "relationship": "TREATS",
            "target_label": "Disease",
            "entry_anchor": "source",
        },
        "interaction": {
            "strategy": "targeted",
            "keywords": ["interact", "interaction", "combine", "take with", "safe with", "together", "can i take"],
            "source_label": "Drug",
            "relationship": "INTERACTS_WITH",
            "target_label": "Drug",
            "entry_anchor": "either",
        },
        "symptoms": {
            "strategy": "targeted",
            "keywords": ["symptom", "symptoms", "signs", "presents with", "how does it feel"],
            "source_label": "Disease",
            "relationship": "HAS_SYMPTOM",
            "target_label": "Symptom",
            "entry_anchor": "source",
        },
    },
    "relationship_templates": {
        "TREATS": "{source} treats {target}",
        "CAUSES": "{source} may cause {target}",
        "INTERACTS_WITH": "{source} interacts with {target}",
        "HAS_SYMPTOM": "{source} has symptom: {target}",
        "INCREASES_RISK_OF": "{source} increases risk of {target}",
        "METABOLIZED_BY": "{source} is metabolized by {target}",
    },
    "general_traversal": {"node_limit": 30},
}
