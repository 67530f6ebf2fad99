"""Fixed values of the engine, and the per-tree policy."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

# Limits and ranking weights that results depend on.
BUDGET_TOKENS = 1800
RESULT_LIMIT = 8
CHUNK_LINES = 40
CHUNK_OVERLAP = 8
CHUNK_STEP = CHUNK_LINES - CHUNK_OVERLAP
MAX_FILE_BYTES = 512 * 1024
CACHE_ROWS = 100
SEMANTIC_WEIGHT = 0.3
EDGE_BONUS, EDGE_BONUS_CAP = 0.05, 0.5
RECENCY = [(7.0, 1.10), (30.0, 1.03)]
BM25_K1, BM25_B, BM25_FLOOR = 1.2, 0.75, 1e-6
SYMBOL_BASE, SUBSYSTEM_BASE = 0.25, 0.2
ROLE_BOOST = {"entrypoint": 1.4, "source": 1.3, "route": 1.3, "model": 1.3, "controller": 1.2, "middleware": 1.15, "view": 1.1, "test": 1.1, "documentation": 0.7, "agent-guidance": 0.6}
KIND_BOOST = {"class": 1.30, "function": 1.25, "method": 1.25, "interface": 1.20, "symbol": 1.10, "section": 0.95}
PACK_HITS, PACK_SUBSYSTEMS, PACK_EDGES = 10, 3, 3
CAPTURE_SUMMARY_CHARS, CAPTURE_FILES = 1000, 8
STATE_DIR = ".tessera"
SCHEMA_VERSION = "1"

# Which files are looked at, and what their names say.
EXCLUDED_DIRS = [".git", ".hg", ".svn", STATE_DIR, ".venv", "venv", "node_modules", "vendor", "dist", "build", "coverage", ".pytest_cache", ".mypy_cache", "__pycache__", "target", ".next", ".turbo", ".idea", "storage"]
EXCLUDED_SUFFIXES = [".pyc", ".pyo", ".so", ".dylib", ".dll", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".pdf", ".zip", ".tar", ".gz", ".mp4", ".mov"]
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".json": "json", ".toml": "toml", ".yaml": "yaml", ".yml": "yaml",
    ".md": "markdown", ".txt": "text", ".rs": "rust", ".go": "go", ".java": "java", ".kt": "kotlin", ".swift": "swift", ".rb": "ruby", ".php": "php", ".html": "html", ".css": "css",
    ".scss": "scss", ".sql": "sql", ".sh": "shell",
}
ROLE_HINTS = {
    "README.md": "documentation", "AGENTS.md": "agent-guidance", "CLAUDE.md": "agent-guidance", "pyproject.toml": "build-config", "package.json": "build-config", "Cargo.toml": "build-config",
    "go.mod": "build-config", "docker-compose.yml": "runtime-config", "docker-compose.yaml": "runtime-config", "Dockerfile": "runtime-config",
}
ENTRYPOINTS = ["main.py", "app.py", "server.py", "wsgi.py", "asgi.py", "manage.py", "index.js", "server.js", "app.js", "index.ts", "server.ts", "app.ts", "index.php", "app.php", "main.go", "main.rs", "Application.java"]
ROUTE_FILES = ["urls.py", "routes.py", "router.py", "web.php", "api.php", "console.php", "channels.php"]
CONFIG_FILES = ["settings.py", ".env.example"]
ROOT_FILES = ["README.md", "AGENTS.md", "pyproject.toml", "package.json", "Cargo.toml", "go.mod"]
IMPORT_SUFFIXES = ["", ".py", ".ts", ".tsx", ".js", ".jsx", ".php", ".rb", ".go", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


@dataclass(frozen=True)
class Policy:
    """What a tree's own config.json may change. A call's own values win over it, and it wins over the fixed values."""

    extra_excludes: tuple[str, ...] = ()
    include_overrides: tuple[str, ...] = ()
    role_overrides: dict[str, str] = field(default_factory=dict)
    parser_overrides: dict[str, bool] = field(default_factory=dict)
    retrieval_defaults: dict[str, int] = field(default_factory=dict)
    ranking_v2: bool = True

    @staticmethod
    def load(path: str | Path) -> Policy:
        """Read a policy file; a missing or broken one gives the defaults."""
        try:
            raw = json.loads(Path(path).read_text(encoding="utf-8"))
            return Policy(tuple(raw.get("extra_excludes", ())), tuple(raw.get("include_overrides", ())), dict(raw.get("role_overrides", {})), {k: bool(v) for k, v in raw.get("parser_overrides", {}).items()}, dict(raw.get("retrieval_defaults", {})), bool(raw.get("ranking_v2", True)))
        except (OSError, ValueError, AttributeError):
            return Policy()

    def limit(self, asked: int | None) -> int:
        return asked if asked is not None else self.retrieval_defaults.get("limit", RESULT_LIMIT)

    def budget(self, asked: int | None) -> int:
        return asked if asked is not None else self.retrieval_defaults.get("budget_tokens", BUDGET_TOKENS)
