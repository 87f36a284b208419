"""Column expressions over compiler flags, command lines and program names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from forgeclock.functions.text import BLANKS, strip

# The only environment variables that are kept.
ENV_VARIABLES = (
    "RUSTFLAGS",
    "CARGO_ENCODED_RUSTFLAGS",
    "RUSTC_WRAPPER",
    "RUSTC_WORKSPACE_WRAPPER",
    "CARGO_BUILD_TARGET",
    "CARGO_BUILD_JOBS",
    "CARGO_INCREMENTAL",
)

# Flags whose value is the next token when written with a space.
VALUE_FLAGS = ("-C", "-Z", "-L", "-l", "--cfg", "--extern", "--edition")

# Codegen settings kept from a compiler command line.
CODEGEN_KEYS = (
    "opt-level",
    "debuginfo",
    "codegen-units",
    "panic",
    "overflow-checks",
    "lto",
    "embed-bitcode",
    "split-debuginfo",
    "target-cpu",
    "target-feature",
    "strip",
)

def path_like(value: Column) -> Column:
    return F.contains(value, F.lit("/")) | F.contains(value, F.lit("\\"))


def base_name(value: Column) -> Column:
    return F.regexp_extract(value, r"([^/\\]*)$", 1)


def program_name(value: Column) -> Column:
    """Last path part of a program; null for blank text."""
    trimmed = strip(value)
    return F.when(trimmed != "", base_name(trimmed))


def sanitise_flag(flag: Column) -> Column:
    """One flag made safe to publish; null means drop it."""
    flag = strip(flag)
    cut = F.instr(flag, "=")
    name = F.substr(flag, F.lit(1), cut - 1)
    value = F.substr(flag, cut + 1)
    dropped = F.lit(None).cast("string")
    return (
        F.when((flag == "") | F.startswith(flag, F.lit("--remap-path-prefix")), dropped)
        .when(cut == 0, F.when(~path_like(flag), flag))
        .when(~path_like(value), flag)
        .when(F.endswith(name, F.lit("linker")), F.concat(name, F.lit("="), base_name(value)))
        .otherwise(F.concat(name, F.lit("=<path>")))
    )


def split_flags(raw: Column, encoded: bool = False) -> Column:
    """Flag text to an array of flags, with ``-C opt-level=2`` joined into one."""
    separator = "\x1f" if encoded else f"{BLANKS}+"
    mark = "\x1e"
    words = F.array_join(F.filter(F.split(raw, separator), lambda t: t != ""), mark)
    # Matches run left to right and never overlap, so a value is not taken for a flag again.
    joined = F.regexp_replace(words, rf"(?<=^|{mark})({'|'.join(VALUE_FLAGS)}){mark}([^{mark}]*)", "$1 $2")
    return F.filter(F.split(joined, mark), lambda t: t != "")


def sanitised_flags(raw: Column, encoded: bool = False) -> Column:
    return F.filter(F.transform(split_flags(raw, encoded), sanitise_flag), lambda f: f.isNotNull())


def tokens(command_line: Column) -> Column:
    """Arguments of a recorded command line; single quotes group and are removed."""
    pattern = rf"(?:[^{BLANKS}']++|'[^']*+'?+)++"
    bare = F.transform(
        F.regexp_extract_all(command_line, F.lit(pattern), 0), lambda t: F.replace(t, F.lit("'"), F.lit(""))
    )
    return F.filter(bare, lambda t: t != "")


def _after(token: Column, prefix: str) -> Column:
    return F.when(F.startswith(token, F.lit(prefix)), F.substr(token, F.lit(len(prefix) + 1)))


def _option_values(args: Column, option: str) -> Column:
    """Values of ``--option=x`` and ``--option x`` in order."""
    found = F.transform(
        args,
        lambda t, i: F.coalesce(
            _after(t, option + "="), F.when(t == option, F.try_element_at(args, i + F.lit(2)))
        ),
    )
    return F.filter(found, lambda x: x.isNotNull())


def crate_name(args: Column) -> Column:
    return F.try_element_at(_option_values(args, "--crate-name"), F.lit(-1))


def crate_type(args: Column) -> Column:
    return F.coalesce(F.try_element_at(_option_values(args, "--crate-type"), F.lit(1)), F.lit("lib"))


def unit_hash(args: Column) -> Column:
    """Last ``metadata=`` value, empty when there is none."""
    found = F.filter(F.transform(args, lambda t: _after(t, "metadata=")), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def source_package(args: Column) -> Column:
    """Package folder of the first source file when it lies in a registry; else the crate name."""
    source = F.try_element_at(F.filter(args, lambda t: F.endswith(t, F.lit(".rs"))), F.lit(1))
    folder = F.regexp_extract(source, r"/registry/src/[^/]*/([^/]*)", 1)
    return F.coalesce(F.nullif(folder, F.lit("")), crate_name(args))


def is_compile(command_line: Column, args: Column) -> Column:
    """A compiler process that builds a unit, not a probe."""
    probe = F.exists(args, lambda t: F.startswith(t, F.lit("--print")))
    name = crate_name(args)
    return F.coalesce(
        F.startswith(command_line, F.lit("rustc")) & name.isNotNull() & (name != "___") & ~probe, F.lit(False)
    )


def unit_settings(args: Column) -> Column:
    """MAP of the settings a unit was compiled with; last one wins, paths never kept."""

    def setting(token: Column, i: Column) -> Column:
        following = F.try_element_at(args, i + F.lit(2))
        codegen = F.when(
            F.startswith(token, F.lit("-C")),
            F.coalesce(F.nullif(F.ltrim(F.substr(token, F.lit(3))), F.lit("")), following),
        )
        key = F.when(F.contains(codegen, F.lit("=")), F.substring_index(codegen, "=", 1))
        value = F.substr(codegen, F.instr(codegen, "=") + 1)
        return (
            F.when(key.isin(*CODEGEN_KEYS), F.struct(key.alias("k"), value.alias("v")))
            .when(key == "incremental", F.struct(F.lit("incremental").alias("k"), F.lit("true").alias("v")))
            .when(codegen.isNotNull(), F.lit(None))
            .when(
                F.startswith(token, F.lit("--edition=")),
                F.struct(F.lit("edition").alias("k"), _after(token, "--edition=").alias("v")),
            )
            .when(token == "--target", F.struct(F.lit("target").alias("k"), following.alias("v")))
            .when(
                F.startswith(token, F.lit("--target=")),
                F.struct(F.lit("target").alias("k"), _after(token, "--target=").alias("v")),
            )
        )

    found = F.filter(F.transform(args, setting), lambda s: s["v"].isNotNull())
    outside_codegen = F.filter(
        F.transform(
            args,
            lambda t: F.when(
                F.startswith(t, F.lit("feature=")), F.trim(F.substr(t, F.lit(9)), F.lit('"'))
            ),
        ),
        lambda x: x.isNotNull(),
    )

    # Keep the last setting of each key.
    newest_first = F.reverse(found)
    keys = F.transform(newest_first, lambda s: s["k"])
    picked = F.filter(newest_first, lambda s, i: F.array_position(keys, s["k"]) == i + 1)
    features = F.when(
        F.size(outside_codegen) > 0,
        F.struct(
            F.lit("features").alias("k"),
            F.array_join(F.array_sort(F.array_distinct(outside_codegen)), ",").alias("v"),
        ),
    )
    every = F.concat(picked, F.filter(F.array(features), lambda s: s.isNotNull()))
    return F.map_from_entries(F.array_sort(every))


def compile_facts(command_line: Column) -> Column:
    """Everything a command line says about its unit: an array of one struct for ``inline``.

    The one-element array binds the tokens to a variable, and ``inline`` keeps the
    optimizer from repeating the whole expression for every field read.
    """

    def facts(args: Column) -> Column:
        return F.struct(
            is_compile(command_line, args).alias("is_compile"),
            crate_name(args).alias("crate"),
            crate_type(args).alias("crate_type"),
            unit_hash(args).alias("unit_hash"),
            source_package(args).alias("package"),
            unit_settings(args).alias("settings"),
        )

    return F.transform(F.array(tokens(command_line)), facts)


def linker_of(flags: Column) -> Column:
    """Linker named by ``linker=`` or ``fuse-ld=`` in an array of flags; the last one wins."""
    named = F.filter(
        F.transform(flags, lambda f: F.nullif(F.regexp_extract(f, r"(?:linker|fuse-ld)=(.*)$", 1), F.lit(""))),
        lambda x: x.isNotNull(),
    )
    return F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit("default"))
