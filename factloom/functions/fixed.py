"""Results depend on exactly these words, pairs, weights and limits."""

# (canonical relation, category, directional, surface forms), in matching order
RELATIONS = [
    ("is_a", "hierarchical", True, ["is_a", "is a", "est un", "est une"]),
    ("part_of", "hierarchical", True, ["part_of", "is part of", "fait partie de", "belongs to"]),
    ("contains", "hierarchical", True, ["contains", "contient", "includes", "inclut"]),
    ("subclass_of", "hierarchical", True, ["subclass_of", "subclass of", "sous-classe de", "type of"]),
    ("has_component", "composition", True, ["has_component", "has component", "a comme composant"]),
    ("composed_of", "composition", True, ["composed_of", "composed of", "composé de"]),
    ("member_of", "composition", True, ["member_of", "member of", "membre de"]),
    ("causes", "causality", True, ["causes", "cause", "provoque", "entraîne"]),
    ("enables", "causality", True, ["enables", "permet", "facilitates"]),
    ("prevents", "causality", True, ["prevents", "empêche", "blocks"]),
    ("leads_to", "causality", True, ["leads_to", "leads to", "mène à", "conduit à"]),
    ("regulates", "governance", True, ["regulates", "réglemente", "governs", "encadre"]),
    ("requires", "governance", True, ["requires", "exige", "nécessite", "mandates"]),
    ("complies_with", "governance", True, ["complies_with", "complies with", "se conforme à", "conforme à"]),
    ("enforces", "governance", True, ["enforces", "applique", "impose"]),
    ("precedes", "temporal", True, ["precedes", "précède", "before"]),
    ("follows", "temporal", True, ["follows", "suit", "after"]),
    ("concurrent_with", "temporal", False, ["concurrent_with", "concurrent with", "simultané avec"]),
    ("created_by", "attribution", True, ["created_by", "created by", "créé par"]),
    ("authored_by", "attribution", True, ["authored_by", "authored by", "rédigé par", "écrit par"]),
    ("owned_by", "attribution", True, ["owned_by", "owned by", "détenu par", "appartient à"]),
    ("employs", "attribution", True, ["employs", "emploie", "hires"]),
    ("located_in", "location", True, ["located_in", "located in", "situé dans", "basé à"]),
    ("applies_to", "location", True, ["applies_to", "applies to", "s'applique à", "concerne"]),
    ("operates_in", "location", True, ["operates_in", "operates in", "opère dans"]),
    ("related_to", "association", False, ["related_to", "related to", "lié à", "associé à"]),
    ("similar_to", "association", False, ["similar_to", "similar to", "similaire à"]),
    ("contrasts_with", "association", False, ["contrasts_with", "contrasts with", "contraste avec", "s'oppose à"]),
    ("references", "association", True, ["references", "référence", "cite", "mentionne"]),
    ("produces", "production", True, ["produces", "produit", "generates", "génère"]),
    ("generates", "production", True, ["generates", "génère", "yields"]),
    ("implements", "production", True, ["implements", "implémente", "met en œuvre"]),
    ("defines", "production", True, ["defines", "définit", "specifies", "spécifie"]),
]

TRANSITIVE = ["part_of", "is_a", "subclass_of", "contains"]
INVERSES = {
    "contains": "part_of", "part_of": "contains", "is_a": "subclass_of", "subclass_of": "is_a", "regulates": "regulated_by",
    "regulated_by": "regulates", "created_by": "creates", "creates": "created_by", "precedes": "follows", "follows": "precedes",
}
OPPOSING = [("enables", "prevents"), ("causes", "prevents"), ("requires", "prevents"), ("precedes", "follows"), ("contains", "excludes"), ("complies_with", "violates")]
INFERENCE_FACTOR, MAX_HOPS = 0.7, 3
LEAST_CONFIDENCE, HALF_LIFE_DAYS, CORPUS_HALF_LIFE_DAYS = 0.05, 365.0, 90.0

# text patterns; (?U) would widen \w in one engine only, so letters are spelled \p{L}\p{N}_
LITERALS = [r"^[\p{Nd}.,]+\s*[%€$£¥]?$", r"^[\p{Nd}.,]+\s+[\p{L}\p{N}_]{1,10}$", r"^\p{Nd}{4}[-/]\p{Nd}{2}([-/]\p{Nd}{2})?$"]
HEADINGS = [r"^(#{1,6})\s+(.+)$", r"^(\d+(?:\.\d+)*)\s+(.+)$", r"^(?:chapter|chapitre)\s+(\d+)\s*[:\.\-—]?\s*(.*)$", r"^([A-Z][A-Z\s]{3,})$"]
CONTENTS_MARKERS = [r"table\s+of\s+contents", r"table\s+des\s+matières", r"sommaire", r"contents\s*$"]
BIBLIOGRAPHY_HEADING = r"(?im)^#{1,3}\s+(?:references|bibliography|bibliographie|références)\s*$"
BIBLIOGRAPHY_WORDS = ["references", "bibliography", "bibliographie", "références"]
ANNEX_WORDS = ["annex", "appendix", "annexe"]
FRENCH = ["les", "des", "une", "dans", "pour", "avec", "est", "sont", "cette", "par", "qui", "que", "sur", "pas", "aux", "ses", "entre"]
GERMAN = ["der", "die", "und", "ist", "ein", "den", "das", "nicht", "sich"]
ENGLISH = ["the", "and", "is", "for", "that", "with", "this", "are", "from"]
FRENCH_LETTERS = "àâäéèêëïîôùûüÿçœæ"

FACTUAL = [r"\bwho\b", r"\bwhat is\b", r"\bwhen\b", r"\bhow many\b", r"\bhow much\b", r"\bdefine\b", r"\bname\b"]
RELATIONAL = [r"\brelat\w+\b", r"\bconnect\w+\b", r"\blink\w+\b", r"\bbetween\b", r"\bcause\b", r"\bimpact\b", r"\baffect\b", r"\bdepend\b", r"\binfluence\b"]
EXPLORATORY = [r"\bsummar\w+\b", r"\boverview\b", r"\bexplain\b", r"\bmain\s+theme\b", r"\bkey\s+topic\b", r"\btell\s+me\s+about\b", r"\bwhat\s+are\s+the\b"]
LEVELS = {"factual": ["chunk", "entity"], "relational": ["entity", "chunk", "corpus"], "exploratory": ["community", "entity"], "conceptual": ["entity", "chunk"]}
LEVEL_COST = {"community": 500, "entity": 800, "chunk": 1200, "corpus": 600}
PRUNE = {"community": 0.3, "entity": 0.25, "chunk": 0.2}
TOP_K = {"community": 5, "entity": 20, "chunk": 10}
CORPUS_BLOCK = {"cnodes": 10, "tnodes": 5, "members": 5, "xedges": 10}
ENRICHED = {"decontextualizer", "concept_extractor", "reference_extractor", "synthesizer"}
PROMPT_HEADS = {"members": 20, "relations": 15, "communities": 10, "profiles": 10, "profile_chars": 120, "triplets": 15, "summary_chars": 500, "synthesis_chars": 800, "text_chars": 8000, "key_entities": 5}
CHARS_PER_TOKEN, CONTEXT_TOKENS = 4, 4000

FORMATS = {"pdf": "pdf", "epub": "epub", "docx": "docx", "md": "md", "txt": "txt", "png": "image", "jpg": "image", "jpeg": "image", "webp": "image"}
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif", "bmp": "image/bmp", "tiff": "image/tiff", "tif": "image/tiff"}
GRANULARITY = {"day": 5, "month": 4, "quarter": 3, "year": 2, "decade": 1}
CALL_COLUMNS = ["call_id", "timestamp", "document_id", "agent", "model", "provider", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "latency_ms", "status", "retry_count", "prompt_hash", "estimated_cost_usd"]
