"""Languages of files, and how deep each is read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import extension

# Languages, their names, how deep they are read, and their extensions.
LANGUAGES = (
    ("typescript", "TypeScript", "full", (".ts", ".tsx", ".mts", ".cts")),
    ("javascript", "JavaScript", "full", (".js", ".jsx", ".mjs", ".cjs")),
    ("python", "Python", "structural", (".py", ".pyi")),
    ("go", "Go", "structural", (".go",)),
    ("rust", "Rust", "structural", (".rs",)),
    ("java", "Java", "history", (".java",)),
    ("csharp", "C#", "history", (".cs",)),
    ("ruby", "Ruby", "history", (".rb",)),
    ("php", "PHP", "history", (".php",)),
    ("c", "C", "history", (".c", ".h")),
    ("cpp", "C++", "history", (".cpp", ".cc", ".hpp")),
    ("swift", "Swift", "history", (".swift",)),
    ("kotlin", "Kotlin", "history", (".kt", ".kts")),
    ("other", "other languages", "history", ()),
)


def looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def language_of(path: Column) -> Column:
    return F.coalesce(looked_up(extension(path), {e: name for name, _, _, own in LANGUAGES for e in own}), F.lit("other"))


def label_of(language: Column) -> Column:
    return looked_up(language, {name: label for name, label, _, _ in LANGUAGES})


def tier_of(language: Column) -> Column:
    """``full``, ``structural`` or ``history``."""
    return looked_up(language, {name: tier for name, _, tier, _ in LANGUAGES})
