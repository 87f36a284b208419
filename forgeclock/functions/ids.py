"""Column expressions over package ids and log headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Package id prefixes that mark a public source.
PUBLIC_REGISTRY_PREFIXES = (
    "registry+https://github.com/rust-lang/crates.io-index",
    "sparse+https://index.crates.io",
)
PUBLIC_GIT_PREFIX = "git+http"
LOCAL_PREFIX = "path+"

# Header fields that are removed, and the words that replace arguments.
PRIVATE_HEADER_FIELDS = ("cwd", "workspace_root", "target_dir", "manifest_path")
PROGRAM_WORD = "cargo"
ARGUMENT_WORD = "<arg>"


def package_name(package_id: Column) -> Column:
    """Text after the last ``#`` up to the first ``@``; null when there is none."""
    fragment = F.substring_index(package_id, "#", -1)
    return F.when(
        F.contains(package_id, F.lit("#")),
        F.nullif(F.substring_index(fragment, "@", 1), F.lit("")),
    )


def package_version(package_id: Column) -> Column:
    """Version part of a package id: after ``@``, or the whole fragment without one."""
    fragment = F.substring_index(package_id, "#", -1)
    return F.when(
        F.contains(package_id, F.lit("#")),
        F.nullif(F.substring_index(fragment, "@", -1), F.lit("")),
    )


def is_public(package_id: Column, project_public: Column | None = None, strict_git: bool = True) -> Column:
    """Whether a unit may be published.

    ``strict_git`` treats a git id that holds an ``@`` as private, which also hides
    public ids of the form ``#name@version``; turn it off to accept those.
    """
    pid = F.coalesce(package_id, F.lit(""))
    public = F.lit(False)
    for prefix in PUBLIC_REGISTRY_PREFIXES:
        public = public | F.startswith(pid, F.lit(prefix))
    git = F.startswith(pid, F.lit(PUBLIC_GIT_PREFIX))
    if strict_git:
        git = git & ~F.contains(pid, F.lit("@"))
    public = public | git
    if project_public is not None:
        public = public | (F.coalesce(project_public, F.lit(False)) & F.startswith(pid, F.lit(LOCAL_PREFIX)))
    return public


def canonical_id(package_id: Column) -> Column:
    """Replace a local path id by ``workspace#name@version``; other ids stay."""
    rest = F.substr(package_id, F.lit(len(LOCAL_PREFIX) + 1))
    cut = F.instr(rest, "#")
    folder = F.rtrim(F.substr(rest, F.lit(1), cut - 1), F.lit("/"))
    tail = F.substr(rest, cut + 1)
    return (
        F.when(~F.startswith(package_id, F.lit(LOCAL_PREFIX)), package_id)
        .when(cut == 0, F.lit("workspace"))
        .when(F.contains(tail, F.lit("@")), F.concat(F.lit("workspace#"), tail))
        .otherwise(F.concat(F.lit("workspace#"), F.substring_index(folder, "/", -1), F.lit("@"), tail))
    )


def scrub_command(command: Column, strict_values: bool = False) -> Column:
    """Keep option tokens of a logged command line, hide everything else.

    ``strict_values`` also cuts the value off ``-flag=/path`` tokens.
    """
    words = F.filter(command, lambda w: w.isNotNull())

    def scrub(word: Column, i: Column) -> Column:
        option = word
        if strict_values:
            option = F.when(
                F.contains(word, F.lit("=")) & word.rlike(r"=.*[/\\]"),
                F.concat(F.substring_index(word, "=", 1), F.lit("=<path>")),
            ).otherwise(word)
        return (
            F.when(i == 0, F.lit(PROGRAM_WORD))
            .when(F.startswith(word, F.lit("-")), option)
            .otherwise(F.lit(ARGUMENT_WORD))
        )

    return F.transform(words, scrub)


def prune_edges(edges: Column, private: Column) -> Column:
    """Remove private unit numbers, keeping order and repeats."""
    hidden = F.coalesce(private, F.array().cast("array<bigint>"))
    return F.filter(edges, lambda i: ~F.coalesce(F.array_contains(hidden, i), F.lit(False)))


def version_key(version: Column) -> Column:
    """Numeric parts of a version as an array that sorts in version order."""
    return F.transform(F.regexp_extract_all(version, F.lit(r"\d+"), 0), lambda p: p.cast("bigint"))


def precedence_key(version: Column) -> Column:
    """A version as a value that sorts in order of precedence.

    Numbers of any length compare as numbers; a pre-release comes before its release, numeric identifiers before words, and fewer
    identifiers before more; what follows a plus sign doesn't count.
    """
    plain = F.split_part(version, F.lit("+"), F.lit(1))
    core, later = F.split_part(plain, F.lit("-"), F.lit(1)), F.regexp_extract(plain, "^[^-]*-(.*)$", 1)

    def number(digits: Column) -> list[Column]:
        bare = F.regexp_replace(digits, "^0+(?=.)", "")
        return [F.length(bare).alias("size"), bare.alias("text")]

    def identifier(word: Column) -> Column:
        numeric = word.rlike("^[0-9]+$")
        size, bare = number(word)
        return F.struct((~numeric).alias("word"), F.when(numeric, size).otherwise(F.lit(0)).alias("size"), F.when(numeric, bare).otherwise(word).alias("text"))

    numbers = F.transform(F.regexp_extract_all(core, F.lit("[0-9]+"), 0), lambda d: F.struct(*number(d)))
    words = F.transform(F.split(later, "[.]"), identifier)
    return F.struct(numbers.alias("numbers"), (later == "").alias("release"), words.alias("later"))
