"""Rules about paths, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that are never read.
IGNORED_DIRS = (
    "node_modules bower_components dist build out .next .nuxt .svelte-kit .turbo .vercel .netlify .output coverage "
    ".nyc_output .cache .parcel-cache vendor .venv venv __pycache__ .pytest_cache .idea .vscode .gradle target .terraform"
).split()
# Language, its analysis tier and its file name extensions.
LANGUAGES = (
    ("typescript", "full", (".ts", ".tsx", ".mts", ".cts")),
    ("javascript", "full", (".js", ".jsx", ".mjs", ".cjs")),
    ("python", "structural", (".py", ".pyi")),
    ("go", "structural", (".go",)),
    ("rust", "structural", (".rs",)),
    ("java", "history", (".java",)),
    ("csharp", "history", (".cs",)),
    ("ruby", "history", (".rb",)),
    ("php", "history", (".php",)),
    ("c", "history", (".c", ".h")),
    ("cpp", "history", (".cpp", ".cc", ".hpp")),
    ("swift", "history", (".swift",)),
    ("kotlin", "history", (".kt", ".kts")),
)
CODE_EXTENSIONS = tuple(e for _, _, extensions in LANGUAGES for e in extensions)
# Other files that are read.
SUPPORTING_EXTENSIONS = ".json .sql .prisma .md .yml .yaml .toml .env .sh .graphql .gql .pem .key".split()
SUPPORTING_NAMES = (
    "dockerfile id_rsa id_dsa id_ecdsa id_ed25519 docker-compose.yml docker-compose.yaml compose.yml compose.yaml "
    "procfile .env .env.local .env.production .env.development .gitignore .npmrc"
).split()
LOCKFILES = (
    "package-lock.json pnpm-lock.yaml yarn.lock bun.lockb bun.lock poetry.lock cargo.lock go.mod go.sum gemfile.lock composer.lock"
).split()
# Path patterns of generated files and of tests.
GENERATED = (
    r"\.min\.(js|css)$",
    r"\.bundle\.js$",
    r"(^|[/\\])next-env\.d\.ts$",
    r"(^|[/\\])vite-env\.d\.ts$",
    r"(^|[/\\])env\.d\.ts$",
    r"\.generated\.",
    r"[/\\]generated[/\\]",
    r"[/\\]__generated__[/\\]",
    r"[/\\]\.gen[/\\]",
    r"[/\\]migrations?[/\\].*\.(ts|js)$",
)
TESTS = (
    r"\.(test|spec)\.[cm]?[jt]sx?$",
    r"\.test-d\.[cm]?tsx?$",
    r"(^|[/\\])test-d[/\\]",
    r"(^|[/\\])(tests?|spec)\.[cm]?[jt]sx?$",
    r"(^|[/\\])test_[^/\\]*\.pyi?$",
    r"_test\.pyi?$",
    r"_test\.go$",
    r"(^|[/\\])conftest\.pyi?$",
    r"(^|[/\\])__tests__[/\\]",
    r"(^|[/\\])__mocks__[/\\]",
    r"(^|[/\\])(tests?|e2e|cypress|playwright)[/\\]",
)
LICENSE_STEM = r"^(?:un)?licen[cs]e(?:[-._].*)?$|^copying(?:[-._].*)?$|^notice(?:[-._].*)?$"
REQUIREMENTS = r"(?i)(^|[/\\])requirements[^/\\]*\.txt$"


def any_of(patterns: tuple[str, ...]) -> str:
    return "(?i)" + "|".join(patterns)


def normalised(path: Column) -> Column:
    return F.array_join(F.filter(F.split(path, r"[\\/]"), lambda s: s != ""), "/")


def basename(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^/]*)$", 1))


def extension(path: Column) -> Column:
    """From the last dot of the name on, unless the name starts with it."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def is_ignored(path: Column) -> Column:
    return F.arrays_overlap(F.split(normalised(path), "/"), F.array(*map(F.lit, IGNORED_DIRS)))


def is_code(path: Column) -> Column:
    return extension(path).isin(*CODE_EXTENSIONS)


def is_test(path: Column) -> Column:
    return path.rlike(any_of(TESTS))


def is_generated(path: Column) -> Column:
    return path.rlike(any_of(GENERATED))


def is_lockfile(path: Column) -> Column:
    return basename(path).isin(*LOCKFILES)


def is_license(path: Column) -> Column:
    ext, base = extension(path), basename(path)
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(ext))
    return ext.isin("", ".md", ".txt", ".rst") & stem.rlike(LICENSE_STEM)


def is_relevant(path: Column) -> Column:
    base = basename(path)
    read = (
        is_code(path)
        | is_lockfile(path)
        | path.rlike(REQUIREMENTS)
        | is_license(path)
        | base.isin(*SUPPORTING_NAMES)
        | base.startswith(".env")
        | base.startswith("dockerfile")
        | extension(path).isin(*SUPPORTING_EXTENSIONS)
    )
    return ~is_ignored(path) & read


def has_generated_header(content: Column) -> Column:
    head = F.substring(content, 1, 1000)
    return head.contains("@generated") | head.rlike("(?i)Code generated .*DO NOT EDIT|DO NOT EDIT THIS FILE|auto-?generated by")


def language(path: Column) -> Column:
    ext, out = extension(path), F.lit("other")
    for name, _, extensions in LANGUAGES:
        out = F.when(ext.isin(*extensions), name).otherwise(out)
    return out


def tier(language_name: Column) -> Column:
    full = [n for n, t, _ in LANGUAGES if t == "full"]
    structural = [n for n, t, _ in LANGUAGES if t == "structural"]
    return F.when(language_name.isin(full), "full").when(language_name.isin(structural), "structural").otherwise("history")
