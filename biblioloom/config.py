"""Policy values of the engine and their version."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, replace


@dataclass(frozen=True)
class Policy:
    # Filter cascade, graph, ranking and budget constants.
    year_floor: int = 2015
    survey_min_citations: int = 200
    survey_min_rate: float = 40.0
    core_allow: tuple = ("cs.LG", "cs.AI", "cs.CL", "cs.NE", "stat.ML", "cs.MA", "cs.PL")
    borderline: tuple = ("cs.IR", "cs.CY", "cs.DS", "math.OC", "cs.DC", "cs.CE", "cs.MS")
    applied_deny: tuple = (
        "cs.CV", "cs.RO", "cs.SE", "cs.HC", "cs.CR", "cs.DB", "cs.NI", "cs.SD",
        "q-bio.*", "q-fin.*", "eess.*", "physics.*", "econ.*", "astro-ph.*",
    )
    core_venues: tuple = (
        "NeurIPS", "ICML", "ICLR", "ACL", "EMNLP", "NAACL", "AAAI", "IJCAI", "COLT", "AISTATS", "TMLR", "JMLR", "COLM", "EACL", "CoNLL",
    )
    biochem_terms: tuple = (
        "metabolic pathway", "metabolic reaction", "retrobiosynth", "biosynthetic pathway", "metabolite prediction",
        "biotransformation", "active site prediction", "catalytic site prediction", "catalytic residue", "reactive site",
        "enzyme active site", "enzyme function", "enzyme commission", "ec number", "enzyme annotation", "enzymatic reaction",
        "substrate specificity", "binding site", "binding affinity prediction", "protein-ligand", "molecular docking",
        "protein function", "go term", "gene ontology", "protein language", "protein representation", "protein sequence",
    )
    reaction_terms: tuple = (
        "retrosynth", "reaction prediction", "reaction outcome", "reactivity prediction", "reaction yield", "yield prediction",
        "synthesis planning", "synthesis prediction", "reaction condition", "catalyst design", "chemical reaction network",
    )
    applied_terms: tuple = (
        "clinical", "patient", "radiolog", "ehr", "diagnosis", "crop", "agricultur", "portfolio", "stock return",
        "credit risk", "seismic", "wafer", "churn", "fraud detection",
    )
    weights: dict = field(
        default_factory=lambda: {"overlap": 2.0, "quality": 0.4, "recency": 0.3, "venue": 0.2, "hub": -0.6, "cocite": 0.0, "bibcoup": 0.0}
    )
    damping: float = 0.85
    completeness_floor: float = 0.6
    forward_expand_max: int = 2000
    max_depth: int = 3
    recency_lane: float = 0.15
    direction_floor: float = 0.20
    source_cap: float = 0.40
    score_floor: float = 0.0
    half_life: float = 4.0

    @property
    def version(self) -> str:
        """The first 12 hex digits of the SHA-256 of the values."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:12]

    def merged(self, **override) -> Policy:
        """A partial override; ``weights`` are merged by name."""
        if "weights" in override:
            override["weights"] = {**self.weights, **override["weights"]}
        return replace(self, **override)


# Fields of the older broad gate.
ALLOWED_FIELDS = ("Computer Science", "Mathematics")
EXCLUDED_FIELDS = (
    "Biology", "Medicine", "Chemistry", "Physics", "Economics", "Finance", "Business", "Engineering", "Geology", "Geography",
    "Political Science", "Psychology", "Sociology", "History", "Art", "Philosophy", "Environmental Science",
    "Agricultural And Food Sciences", "Materials Science", "Linguistics",
)
# Topic groups of the view in order of precedence, each with category prefixes and title terms.
TOPIC_GROUPS = {
    "biochem": (
        ("q-bio.",),
        ("metabolic", "metabolite", "biosynth", "retrobiosynth", "enzym", "catalytic residue", "active site", "reactive site", "substrate specificity",
         "binding site", "binding affinity", "protein-ligand", "drug target", "docking", "protein", "proteom", "peptide", "antibody", "nanobody",
         "amino acid", "gene ontology", "go term", "biolog", "biomedical", "bioinformatic", "genom", "molecular dynamics"),
    ),
    "chem": (("physics.", "cond-mat."), ("retrosynth", "reaction", "reactivity", "synthesis", "molecul", "chemi", "catalys", "compound", "drug discovery")),
    "cs": (("cs.", "stat.", "math."), ()),
}


@dataclass(frozen=True)
class GateTerms:
    # Vocabularies of the older strict gate, all lower case, matched as plain substrings.
    core: tuple = (
        "neural network", "neural networks", "neural", "deep learning", "transformer", "attention mechanism", "self-attention",
        "convolutional", "recurrent network", "diffusion model", "mixture-of-experts", "mixture of experts", "state space model",
        "language model", "language models", "llm", "large language model", "natural language processing", "nlp", "text generation",
        "machine translation", "question answering", "summarization", "tokenization", "prompt", "prompting", "in-context learning",
        "chain-of-thought", "chain of thought", "instruction tuning", "fine-tuning", "pretraining", "pre-training",
        "machine learning", "reinforcement learning", "rlhf", "supervised learning", "unsupervised learning", "self-supervised",
        "semi-supervised", "transfer learning", "meta-learning", "few-shot", "zero-shot", "contrastive learning", "curriculum learning",
        "federated learning", "continual learning", "active learning", "agent", "agents", "agentic", "tool use", "tool learning",
        "planning", "reasoning", "multi-agent", "memory", "retrieval", "retrieval-augmented", "rag", "information retrieval",
        "embedding", "embeddings", "vector search", "knowledge graph", "semantic search", "dense retrieval",
        "computer vision", "image classification", "object detection", "segmentation", "multimodal", "vision-language",
        "speech recognition", "text-to-speech", "data mining", "recommender system", "recommendation",
        "clustering", "classification", "regression", "time series", "graph neural", "representation learning", "dimensionality reduction",
        "bayesian", "probabilistic model", "variational", "generative model", "optimization", "gradient descent", "stochastic gradient",
        "statistical learning", "feature selection", "benchmark", "evaluation", "dataset", "scaling law", "scaling laws",
        "interpretability", "explainability", "alignment", "hallucination", "quantization", "distillation", "pruning", "sparsity",
        "inference efficiency", "parameter-efficient", "lora", "residual learning", "residual network", "resnet",
        "normalization", "batch norm", "layer norm", "lstm", "long short-term memory", "gru", "rnn", "cnn",
        "encoder", "decoder", "sequence to sequence", "seq2seq", "autoencoder", "auto-encoding", "variational bayes",
        "adversarial", "generative adversarial", "gan", "backpropagation", "gradient", "dropout", "regularization",
        "overfitting", "loss function", "objective function", "image recognition", "image generation", "perceptron",
        "attention", "self-supervision", "latent space", "hyperparameter", "model architecture", "training dynamics",
        "stochastic optimization", "convergence",
    )
    venues: tuple = (
        "neurips", "neural information processing systems", "nips", "icml", "international conference on machine learning",
        "iclr", "international conference on learning representations", "aaai", "ijcai", "jmlr", "journal of machine learning research",
        "acl", "annual meeting of the association for computational linguistics", "emnlp", "empirical methods in natural language processing",
        "naacl", "coling", "tacl", "conll", "eacl", "cvpr", "computer vision and pattern recognition",
        "iccv", "eccv", "international conference on computer vision", "sigir", "kdd", "knowledge discovery and data mining",
        "wsdm", "recsys", "the web conference", "machine learning", "neural computation", "artificial intelligence",
        "pattern analysis and machine intelligence", "tpami", "uai", "aistats", "colt",
    )
    applied: tuple = (
        "chemistry", "chemical", "molecule", "molecular", "drug discovery", "drug design", "protein", "compound screening", "catalysis",
        "materials discovery", "crystal structure", "biochemistry", "medicine", "medical", "medicinal", "clinical", "clinician",
        "diagnosis", "diagnostic", "patient", "patients", "hospital", "disease", "cancer", "oncology", "tumor", "radiology", "radiograph",
        "healthcare", "health care", "biomedical", "genomics", "genome", "electronic health record", "drug", "therapy", "therapeutic",
        "epidemiolog", "pathology", "surgery", "surgical", "psychiatric", "finance", "financial", "trading", "stock market", "portfolio",
        "credit risk", "fraud detection", "banking", "insurance", "investment", "asset pricing", "cryptocurrency", "accounting",
        "economic forecasting", "algorithmic trading", "manufacturing", "industrial", "supply chain", "predictive maintenance",
        "fault diagnosis", "production line", "assembly line", "logistics", "quality inspection", "smart factory",
        "robot", "robotic", "robotics", "manipulation", "grasping", "autonomous driving", "self-driving", "drone", "uav",
        "motion planning", "locomotion", "actuator", "teleoperation", "cybersecurity", "cyber security", "intrusion detection", "malware",
        "phishing", "network security", "vulnerability detection", "penetration testing", "ransomware", "botnet", "spam detection",
        "agriculture", "agricultural", "crop", "climate", "weather forecasting", "remote sensing", "satellite imagery", "geospatial",
        "legal", "law", "court", "judicial", "education", "student performance", "e-learning", "energy grid", "power system", "smart grid",
        "traffic", "transportation", "urban planning", "astronomy", "astrophysic", "particle physics",
        "sports analytics", "marketing", "advertising", "e-commerce",
    )
    allowed: tuple = ALLOWED_FIELDS
    excluded: tuple = EXCLUDED_FIELDS


DEFAULT = Policy()
#: For the proxy corpus of the test tables.
PROXY = Policy(
    year_floor=1995, survey_min_citations=40, survey_min_rate=8.0, forward_expand_max=40,
    core_allow=("STANDARD", "PROMO"), borderline=("MEDIUM",), applied_deny=("LARGE", "SMALL.*"), core_venues=("Brand#11", "Brand#22", "ICLR"),
)
AS_OF_YEAR = 2001


def load(path: str) -> Policy:
    """A policy file (JSON, or YAML where a parser is installed): a partial override of the defaults."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        given = json.loads(text)
    else:
        import yaml

        given = yaml.safe_load(text) or {}
    names = {f.name for f in fields(Policy)}
    if unknown := sorted(set(given) - names):
        raise ValueError(f"unknown policy values {unknown}")
    return DEFAULT.merged(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
