"""What kind of file a path names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and names by language, and path patterns by kind.
EXTENSIONS = {
    "c": "c h",
    "cpp": "cc cpp cxx hh hpp hxx",
    "csharp": "cs",
    "css": "css less scss",
    "dart": "dart",
    "elixir": "ex exs",
    "go": "go",
    "html": "htm html",
    "java": "java",
    "javascript": "cjs js jsx mjs",
    "json": "json jsonc",
    "kotlin": "kt kts",
    "markdown": "markdown md",
    "php": "php",
    "python": "py pyi",
    "ruby": "rake rb",
    "rust": "rs",
    "shell": "bash sh zsh",
    "sql": "sql",
    "swift": "swift",
    "terraform": "tf",
    "toml": "toml",
    "typescript": "cts mts ts tsx",
    "xml": "xml",
    "yaml": "yaml yml",
}
NAMES = {"dockerfile": "docker", "gemfile": "ruby", "makefile": "make", "rakefile": "ruby", "cmakelists.txt": "cmake"}
TEST = r"(?i)(^|/)(tests?|spec|__tests__|testing)/|(^|/)(test_[^/]*|[^/]*_test|[^/]*[.](test|spec)|conftest)\.[a-z]+$|[A-Za-z0-9](Test|Tests|Spec)\.(java|kt|cs|php|swift)$"
VENDORED = r"(^|/)(node_modules|vendor|third_party|bower_components|site-packages)/"
GENERATED = r"(_pb2(_grpc)?\.pyi?|\.pb\.go|\.g\.dart|\.designer\.cs|\.min\.(js|css)|\.generated\.[a-z]+)$|(^|/)(generated|__generated__|dist|build)/"
SENSITIVE = {
    "migration": r"(?i)(^|/)(migrations?|alembic)/",
    "authentication": r"(?i)(^|/)[^/]*(auth|login|session|permission|password)[^/]*",
    "pipeline": r"(^|/)(\.github/workflows|\.gitlab-ci|\.circleci|Jenkinsfile|azure-pipelines)",
    "infrastructure": r"(?i)(\.tf$|(^|/)(dockerfile|docker-compose[^/]*|k8s|helm|terraform)(/|$|\.))",
}


def _first(path: Column, rules: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(path.rlike(p), k) for k, p in rules.items()])


def language_of(path: Column) -> Column:
    """By the file's name, else by its extension; null if neither is known."""
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    ext = F.regexp_extract(base, r"\.([a-z0-9]+)$", 1)
    by_name = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    by_ext = F.create_map(*[F.lit(x) for lang, exts in EXTENSIONS.items() for e in exts.split() for x in (e, lang)])
    return F.coalesce(by_name[base], by_ext[ext])


def is_test(path: Column) -> Column:
    return path.rlike(TEST)


def origin(path: Column) -> Column:
    """vendored, generated or null."""
    return F.when(path.rlike(VENDORED), "vendored").when(path.rlike(GENERATED), "generated")


def sensitive_kind(path: Column) -> Column:
    return _first(path, SENSITIVE)


def image_name(image: Column) -> Column:
    """A container image without registry, tag and digest, lower-cased."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(image, "@.*$", ""), r":[^:/]+$", ""), r"^(?:[^/]*[.:][^/]*|localhost)/", ""))


def route(url: Column) -> Column:
    """A route's template: placeholders of any style as ``{}``; null if what is left isn't absolute."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z]+://[^/]*", ""), r"[?#].*$", "")
    open_ = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\$?\{[^}]*\}", "{}"), r"<[^>]*>", "{}"), r"/:[A-Za-z_]\w*", "/{}")
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(open_, r"^\{\}(?=/)", ""), "/+", "/"), "(?<=.)/$", "")
    return F.when(flat.startswith("/"), flat)


def duration_days(text: Column) -> Column:
    """``2w`` as 14; units d, w, m (30 days), y (365 days); null if it isn't one."""
    unit = F.create_map(*[F.lit(x) for kv in {"d": 1, "w": 7, "m": 30, "y": 365}.items() for x in kv])
    return F.try_to_number(F.nullif(F.regexp_extract(text, r"^(\d+)([dwmy])$", 1), F.lit("")), F.lit("999999")).cast("int") * unit[F.regexp_extract(text, r"^(\d+)([dwmy])$", 2)]


def middle_cut(text: Column, limit: int) -> Column:
    """A text over ``limit`` characters with its middle as one ellipsis; 45 % of what stays is in front, rounded up."""
    left = -(-(limit - 1) * 45 // 100)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(left)), F.lit("…"), F.right(text, F.lit(limit - 1 - left))))


def snake(name: Column) -> Column:
    """``Admin::HTTPUser`` as ``admin/http_user``."""
    sep = F.replace(name, F.lit("::"), F.lit("/"))
    return F.lower(F.regexp_replace(F.regexp_replace(sep, r"([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z0-9])([A-Z])", "$1_$2"))
