"""Constants of the engine; every operator takes them as parameters with these defaults."""

# Limits, weights and thresholds of chunking, search, fusion, expansion, reranking and caching.
CHUNK_TOKENS, CHUNK_MIN_TOKENS, CHARS_PER_TOKEN = 512, 50, 4
SLICE_CHARS = 1000
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
SPARSE_TOP_K, DENSE_TOP_K, MAX_CANDIDATES, LIMIT = 40, 60, 30, 6
MIN_DENSE_SCORE, MIN_SCORE = 0.30, 0.10
ALPHA, RRF_K = 0.45, 20
CONSENSUS = 0.1
REWRITE_WEIGHTS = {"original": 1.0, "semantic": 0.8, "decomposition": 0.7, "keyword": 0.5}
MAX_SEMANTIC = 3
DRIFT_GUARDS = {"semantic": 0.65, "decomposition": 0.55}
EDGE_WEIGHTS = {
    "same_section": 0.92,
    "thematic": 0.85,
    "parent_section": 0.75,
    "child_section": 0.75,
    "sibling_section": 0.65,
    "next_section": 0.55,
    "previous_section": 0.45,
}
HOP_DECAY, MIN_EXPAND, RESONANCE, HOPS, MAX_EXPANDED = 0.80, 0.15, 0.3, 2, 60
SKIP_WINDOW, SKIP_CONSENSUS, SKIP_GAP = 8, 3, 0.08
PER_DOCUMENT, PER_SECTION = 3, 2
FUSE_RETRIEVAL, FUSE_RERANK, RERANK_THRESHOLD, RERANK_GAP = 0.35, 0.65, 0.3, 0.25
CACHE_SCORE, CACHE_SURE, CACHE_VERIFY, CACHE_TTL_S = 0.96, 0.999, 0.5, 86_400
COOLDOWN_S, ENROLMENT_TTL_S = 180, 300
SCORES_KEPT = 50_000
BLOCK_SECONDS, BLOCK_GAP, UNIT_CONFIDENCE, OPEN_UNIT_SECONDS = 60.0, 1.2, 0.75, 5.0
METRICS_KEPT, METRICS_LATEST, COST_PER_MILLION = 1000, 100, 0.10
MIN_CARD_CONFIDENCE = 0.7
CRAWL_PAGES, SITEMAP_PAGES = 15, 30
EMBED_DIM, EMBED_TERMS = 64, 512
QUERY_PREFIX = "Represent this question for searching relevant passages: "
# Speech rate, pitch and volume of an emotion, and how they are changed.
PROSODY = {"EXCITED": (15, 6, 10), "INQUISITIVE": (6, 10, 0), "REFLECTIVE": (-8, -5, -5), "SERIOUS": (-5, -3, 6), "NEUTRAL": (0, 0, 0)}
PROSODY_INERTIA, PROSODY_LEAD, PROSODY_SLOWER, PROSODY_LIMITS = 0.8, 3, 3, (25, 20, 20)
