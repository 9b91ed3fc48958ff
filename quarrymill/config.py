"""Fixed values that results depend on, and the limits of retrieval."""

# Limits and weights.
K, RRF_K, PREPASS_DEPTH, PINNED, DEDUP_FACTOR, DEDUP_LEAST, CANDIDATES_LEAST = 5, 60, 400, 20, 10, 50, 100
DISTANCE_LIMIT = 1.1
CHUNK_LEAST, CHUNK_MOST, CHUNK_OVERLAP, CODE_CONTEXT, TOKENS_PER_WORD = 300, 600, 50, 180, 0.85
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25

# Patterns.
TOKEN = r"[a-z0-9][a-z0-9_\-+.]*"
NEGATIVE_SUPPORT = [r"\bdoes\s+not\s+support\b", r"\bdo\s+not\s+support\b", r"\bdoesn't\s+support\b", r"\bdon't\s+support\b", r"\bnot\s+supported\b", r"\bno\s+support\b", r"\bwithout\s+support\b", r"\bunsupported\b"]
DENIED = "support"  # is in each of NEGATIVE_SUPPORT
BOILERPLATE = [r"^register\s*login$", r"^english\s*chinese$", r"^about\s*\|\s*contact us\s*\|\s*privacy\s*\|\s*sitemap$", r"^created at\s*:", r"^last updated at\s*:", r"^copy$", r"^table of contents$", r"^on this page$", r"^skip to content$", r"^sign in$", r"^sign up$", r"^all rights reserved\.?$"]

# Vocabularies. Words of one vendor are added by the caller.
STOPWORDS = ["a", "an", "and", "are", "be", "better", "can", "configured", "configuration", "for", "called", "do", "does", "how", "i", "improve", "in", "is", "it", "of", "on", "or", "out", "performance", "processor", "processors", "recommended", "settings", "should", "step", "steps", "system", "systems", "the", "to", "what", "which", "with", "benchmark", "benchmarking", "benchmarked", "benchmarks", "brief", "cloud", "config", "configure", "guide", "options", "reference", "setup", "tutorial"]
DIRECT_STOPWORDS = ["a", "an", "and", "are", "as", "be", "both", "by", "can", "do", "does", "for", "from", "how", "i", "in", "into", "is", "it", "of", "on", "or", "same", "should", "that", "the", "them", "to", "versus", "what", "when", "where", "which", "who", "why", "with"]
TUNING = ["benchmark", "benchmarking", "benchmarked", "benchmarks", "config", "configure", "configured", "configuration", "latency", "oltp", "optimize", "optimized", "performance", "throughput", "tune", "tuned", "tuning"]
REFERENCE_ARCHITECTURE = ["architecture", "deploy", "deployment", "reference", "steps"]
TUTORIAL = ["how", "install", "migration", "migrate", "port", "porting", "setup", "tutorial"]
SUPPORT = ["available", "availability", "capable", "capabilities", "capability", "compatible", "compatibility", "device", "devices", "hardware", "processor", "processors", "server", "servers", "support", "supported", "supporting", "supports"]
PROVIDER = ["autopilot", "compute", "engine", "gcp", "gke", "google", "kubernetes"]
PROVIDER_TYPE = "google cloud documentation"
COMPILER = ["compiler", "compilers", "gcc", "llvm", "clang"]
LINK_STOPWORDS = ["a", "an", "and", "for", "here", "in", "of", "or", "the", "this", "to"]
SUPPORT_WORDS, DEVICES, SERVERS = ["support", "supported", "supports", "capable"], ["device", "devices"], ["server", "servers"]
CAPABILITY_PREFIXES = ["sme", "sve"]
EXCLUDED_NAMES = ["venv", ".venv", "env", "ENV", "virtualenv", "node_modules", "__pycache__", ".pytest_cache", ".mypy_cache", ".tox", "build", "dist", ".git", ".svn", ".hg", ".vscode", ".idea", ".eclipse", "error_logging.yaml", "target", "out", ".cache"]
EXCLUDED_SUFFIXES = [".egg-info"]
