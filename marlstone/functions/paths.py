"""Repository paths: safety, language, module, role and category, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact_key, token_set

# Fixed values of the reading conventions, as text in their natural order.
LANGUAGES = {
    ".py": "Python", ".pyi": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript",
    ".go": "Go", ".rs": "Rust", ".java": "Java", ".kt": "Kotlin", ".kts": "Kotlin", ".swift": "Swift", ".c": "C", ".h": "C/C++ Header", ".cc": "C++", ".cpp": "C++", ".cs": "C#",
    ".rb": "Ruby", ".php": "PHP", ".vue": "Vue", ".svelte": "Svelte", ".sh": "Shell", ".bash": "Shell", ".sql": "SQL", ".md": "Markdown", ".mdx": "Markdown",
    ".rst": "ReStructuredText", ".json": "JSON", ".toml": "TOML", ".yaml": "YAML", ".yml": "YAML", ".xml": "XML", ".html": "HTML", ".css": "CSS", ".scss": "SCSS",
}
SPECIAL_NAMES = {"Dockerfile": "Dockerfile", "Makefile": "Makefile", "LICENSE": "License", "COPYING": "License"}
EXCLUDED_DIRS = [".git", ".hg", ".svn", ".idea", ".vscode", ".omx", ".venv", "venv", "env", "node_modules", "vendor", "dist", "build", "target", "coverage",
                 ".mypy_cache", ".pytest_cache", ".ruff_cache", ".codegraph", "__pycache__"]
ENTRYPOINT_NAMES = ["main.py", "app.py", "cli.py", "server.py", "manage.py", "main.ts", "main.tsx", "index.ts", "index.tsx", "main.js", "index.js", "main.go", "main.rs"]
MANIFEST_NAMES = ["pyproject.toml", "package.json", "cargo.toml", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "makefile"]
LOCATOR_MANIFESTS = ["cargo.toml", "dockerfile", "go.mod", "makefile", "package.json", "pom.xml", "pyproject.toml"]
TEST_PARTS = ["test", "tests", "spec", "specs", "__tests__"]
AUXILIARY_PARTS = [".git", ".next", "benchmark", "benchmarks", "build", "coverage", "dist", "doc", "docs", "documentation", "example", "examples", "fixture", "fixtures",
                   "gen", "generated", "node_modules", "spec", "specs", "target", "test", "tests", "vendor"]
NON_PRODUCT_PARTS = ["doc", "docs", "example", "examples", "sample", "samples", "fixture", "fixtures", "test", "tests", "testing", "__tests__", "integration_test",
                     "integration_tests", "e2e", "eval", "evals", "benchmark", "benchmarks", "demo", "demos", "playground", "generated"]
PRODUCT_LANGUAGES = ["Python", "JavaScript", "TypeScript", "Go"]
COMMON_TOP_PARTS = ["src", "cmd", "apps", "packages", "pkg", "lib", "internal", "server", "client"]
ROLE_ORDER = ["entrypoint", "boundary", "orchestration", "core", "model", "persistence", "adapter", "presentation", "configuration", "documentation", "test"]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def base_name(c: Column | str) -> Column:
    return F.substring_index(_c(c), "/", -1)


def suffix(c: Column | str) -> Column:
    """.py of a/b.py, lower case; empty without one or for a name that begins with its only dot."""
    return F.lower(F.regexp_extract(base_name(c), r"^.+(\.[^.]+)$", 1))


def stem(c: Column | str) -> Column:
    return F.regexp_replace(base_name(c), r"(?<=.)\.[^.]+$", "")


def language_of(c: Column | str) -> Column:
    """Special names first, then license and readme files, then the ending."""
    name = base_name(c)
    out = F.when(F.lower(name).startswith("license"), "License").when(F.lower(name).startswith("readme"), "Markdown")
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    special = F.create_map(*[F.lit(x) for kv in SPECIAL_NAMES.items() for x in kv])
    return F.coalesce(special[name], out.otherwise(table[suffix(c)]))


def module_of(c: Column | str) -> Column:
    return F.when(F.instr(_c(c), "/") > 0, F.substring_index(_c(c), "/", 1)).otherwise("root")


def path_parts(c: Column | str) -> Column:
    """Parts of a safe relative path; none for an absolute one or one that climbs."""
    raw = F.split(F.translate(_c(c), "\\", "/"), "/")
    unsafe = _c(c).isNull() | _c(c).startswith("/") | _c(c).startswith("\\") | F.array_contains(raw, "..")
    return F.when(unsafe, F.array().cast("array<string>")).otherwise(F.filter(raw, lambda p: (p != "") & (p != ".")))


def safe_path(c: Column | str) -> Column:
    parts = path_parts(F.trim(_c(c)))
    return F.when(F.size(parts) > 0, F.array_join(parts, "/"))


def preferred_label(c: Column | str) -> Column:
    """First part, or the second behind a common top directory."""
    parts = F.filter(F.split(_c(c), "/"), lambda p: p != "")
    first = F.try_element_at(parts, F.lit(1))
    return F.when(F.size(parts) == 0, "root").when(first.isin(COMMON_TOP_PARTS) & (F.size(parts) >= 2), F.try_element_at(parts, F.lit(2))).otherwise(first)


def module_view(c: Column | str) -> Column:
    """Directories that stand for a module: two levels under packages, apps and services, else three."""
    parts = path_parts(c)
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    depth = F.when(F.lower(F.try_element_at(dirs, F.lit(1))).isin("packages", "apps", "services"), 2).otherwise(3)
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(dirs, 1, depth), "/"))


def _any(parts: Column, names: list[str]) -> Column:
    return F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))


def view_category(c: Column | str) -> Column:
    parts = F.transform(path_parts(c), F.lower)
    name = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return (
        F.when(F.exists(parts, lambda p: p.startswith(".")), "engineering-support")
        .when(_any(parts, ["artifacts", "artifact", "generated", "generated-source", "reverse-source", "decompiled", "unpacked", "dist", "coverage", "cache", "caches"]), "generated-or-reference")
        .when(_any(parts, ["test", "tests", "fixtures"]) | name.contains(".test.") | name.endswith("_test.go") | name.endswith("_test.py"), "testing")
        .when(_any(parts, ["example", "examples", "demo", "demos", "sample", "samples", "assets", "sandbox-projects"]) | F.exists(parts, lambda p: p.endswith("-assets") | p.endswith("_assets")), "examples")
        .when(_any(parts, ["doc", "docs", "spec", "specs", "changelog", "changes"]), "documentation")
        .when(_any(parts, ["script", "scripts", ".github", "build", "tools"]), "engineering-support")
        .otherwise("product-implementation")
    )


def is_test_path(c: Column | str) -> Column:
    parts = F.split(F.lower(_c(c)), "/")
    return _any(parts, TEST_PARTS) | F.lower(base_name(c)).rlike(r"(^|[._-])(test|spec)([._-]|$)")


def is_auxiliary(c: Column | str) -> Column:
    return _any(F.split(F.lower(_c(c)), "/"), AUXILIARY_PARTS)


def file_role(c: Column | str) -> Column:
    name, end, s = F.lower(base_name(c)), suffix(c), F.lower(stem(c))
    has = lambda *w: s.rlike("|".join(w))
    return (
        F.when(is_test_path(c), "test")
        .when(name.isin(ENTRYPOINT_NAMES), "entrypoint")
        .when(name.isin(LOCATOR_MANIFESTS) | end.isin(".toml", ".yaml", ".yml"), "configuration")
        .when(name.startswith("readme") | end.isin(".md", ".mdx", ".rst"), "documentation")
        .when(has("route", "handler", "controller", "endpoint", "api"), "boundary")
        .when(has("orchestrat", "service", "manager", "workflow", "engine", "flow"), "orchestration")
        .when(has("model", "schema", "type", "entity", "protocol"), "model")
        .when(has("repository", "storage", "store", "database", "persistence"), "persistence")
        .when(has("adapter", "client", "transport", "gateway", "provider", "socket"), "adapter")
        .when(has("view", "component", "page", "screen", "ui"), "presentation")
        .otherwise("core")
    )


def role_rank(role: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for i, r in enumerate(ROLE_ORDER) for x in (r, i)])[role], F.lit(99))


def locator_product(c: Column | str) -> Column:
    return ~is_auxiliary(c) & ~is_test_path(c) & (file_role(c) != "documentation")


def _dirs(c: Column | str) -> Column:
    parts = F.split(F.lower(_c(c)), "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def is_product_source(path: Column | str, language: Column) -> Column:
    name = F.lower(base_name(path))
    return language.isin(PRODUCT_LANGUAGES) & ~_any(_dirs(path), NON_PRODUCT_PARTS) & ~name.rlike(r"^(test_|spec_)") & ~name.rlike(r"\.test\.|\.spec\.|_test\.go")


def is_test_source(path: Column | str) -> Column:
    name = F.lower(base_name(path))
    return _any(_dirs(path), ["test", "tests", "testing", "eval", "evals"]) | name.rlike(r"^(test_|spec_)") | name.rlike(r"\.test\.|\.spec\.|_test\.go")


def source_priority(c: Column | str) -> Column:
    """0 product source, 1 other, 2 examples, 3 documents, 4 tests, 5 no path."""
    parts = F.transform(path_parts(c), F.lower)
    return (
        F.when(F.size(parts) == 0, 5)
        .when(_any(parts, ["test", "tests", "fixtures"]), 4)
        .when(_any(parts, ["docs", "doc", "spec", "specs"]), 3)
        .when(_any(parts, ["example", "examples", "demo", "demos", "sample", "samples"]), 2)
        .when(F.try_element_at(parts, F.lit(1)).isin("src", "lib", "libs", "packages", "apps", "server", "client"), 0)
        .otherwise(1)
    )


def within(path: Column | str, module: Column | str) -> Column:
    """Is the path the module itself or below it, by whole parts?"""
    p, m = safe_path(path), safe_path(module)
    return F.coalesce((p == m) | p.startswith(F.concat(m, F.lit("/"))), F.lit(False))


def slice_path(path: Column | str, marker: str = "source-slice") -> Column:
    """What follows the marker directory of a copied slice; the path itself where there is no such directory."""
    parts = F.filter(F.split(F.translate(_c(path), "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    at = F.array_position(parts, marker)
    rest = F.slice(parts, (at + 1).cast("int"), F.greatest(F.size(parts) - at, F.lit(1)).cast("int"))
    return F.when(at == 0, F.translate(_c(path), "\\", "/")).when((at == F.size(parts)) | F.array_contains(rest, ".."), F.lit(None)).otherwise(F.array_join(rest, "/"))


def bundle_module(c: Column | str) -> Column:
    """At most two directory levels, or the root of the repository."""
    parts = path_parts(c)
    return F.when(F.size(parts) < 2, "repository-root").otherwise(F.array_join(F.slice(parts, 1, F.least(F.size(parts) - 1, F.lit(2))), "/"))


def matches_query(name: Column, query: str) -> Column:
    """Equal as compact keys, or every token of the query among the tokens of the name."""
    key = "".join(ch for ch in query.lower() if ch.isalnum())
    want = token_set(F.lit(query))
    return (compact_key(name) == key) | ((F.size(want) > 0) & (F.size(F.array_except(want, token_set(name))) == 0))


def remote_identity(c: Column | str) -> Column:
    """host/path of a remote without credentials, lower case, without .git; empty where it is no plain remote."""
    t = F.trim(_c(c))
    scp = F.regexp_extract(t, r"^git@([^:/]+):(.*)$", 1)
    plain = F.regexp_extract(t, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:(?<=ssh://)git@)?([^/@:?#]+)(?::\d+)?(/[^?#]*)?$", 1)
    rest = F.regexp_extract(t, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:(?<=ssh://)git@)?([^/@:?#]+)(?::\d+)?(/[^?#]*)?$", 2)
    whole = F.when(scp != "", F.concat(scp, F.lit("/"), F.regexp_extract(t, r"^git@([^:/]+):(.*)$", 2))).when(plain != "", F.concat(plain, rest)).otherwise("")
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(whole, F.lit(""))), "/+$", ""), r"\.git$", "")


def clean_remote(c: Column | str) -> Column:
    """A remote without user information, query and fragment; transport users of SCP forms are kept."""
    t = F.trim(_c(c))
    url = t.contains("://")
    cut = F.regexp_replace(t, r"[?#].*$", "")
    scp_user = F.lower(F.regexp_extract(cut, r"^(.*)@[^@]*$", 1))
    scp = F.when(cut.contains("@") & ~scp_user.isin("git", "hg", "ssh"), F.regexp_extract(cut, r"@([^@]*)$", 1)).otherwise(cut)
    stripped = F.regexp_replace(cut, r"^([A-Za-z][A-Za-z0-9+.-]*://)(?:[^/]*@)?", "$1")
    host = F.regexp_extract(stripped, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:]+)", 1)
    return F.when(_c(c).isNull() | (_c(c) == ""), _c(c)).when(~url, F.when(scp != "", scp)).when(host != "", stripped)
