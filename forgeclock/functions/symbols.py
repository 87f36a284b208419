"""Column expressions over thread names and symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbol fragments that name a compiler phase, in matching order.
PHASE_MARKERS = (
    ("macro_expand", ("rustc_expand::",)),
    ("resolve", ("rustc_resolve::",)),
    ("coherence", ("rustc_hir_analysis::coherence",)),
    ("type_check", ("rustc_hir_analysis::", "rustc_hir_typeck::")),
    ("borrowck", ("rustc_borrowck::", "rustc_mir_transform::")),
    ("monomorphize", ("rustc_monomorphize::",)),
    ("metadata_encode", ("rustc_metadata::rmeta::encoder", "encode_metadata")),
    ("codegen", ("rustc_codegen_llvm::", "rustc_codegen_ssa::")),
)

# Leaf symbols of a parked thread.
WAIT_SYMBOLS = (
    "semaphore_wait_trap",
    "__psynch_cvwait",
    "__ulock_wait",
    "kevent",
    "__wait4",
    "mach_msg2_trap",
    "poll",
    "epoll_wait",
    "futex_wait",
)

# Thread names that do codegen work, and the trait solver's prefix.
CODEGEN_THREAD_PREFIXES = ("opt cgu", "codegen cgu")
CODEGEN_COORDINATOR = "coordinator"
TRAIT_PREFIX = "rustc_trait_selection"


def phase_marker(symbol: Column) -> Column:
    """First phase whose marker occurs in the symbol, or null."""
    marker = None
    for phase, fragments in PHASE_MARKERS:
        hit = F.lit(False)
        for fragment in fragments:
            hit = hit | F.contains(symbol, F.lit(fragment))
        marker = F.when(hit, F.lit(phase)) if marker is None else marker.when(hit, F.lit(phase))
    return marker


def is_wait(symbol: Column) -> Column:
    """Whether a leaf symbol means the thread was parked; null for no symbol."""
    hit = F.lit(False)
    for name in WAIT_SYMBOLS:
        hit = hit | F.endswith(symbol, F.lit(name))
    return F.when(symbol.isNotNull(), hit)


def is_trait_work(symbol: Column) -> Column:
    return F.coalesce(F.contains(symbol, F.lit(TRAIT_PREFIX)), F.lit(False))


def thread_class(name: Column) -> Column:
    codegen = name == CODEGEN_COORDINATOR
    for prefix in CODEGEN_THREAD_PREFIXES:
        codegen = codegen | F.startswith(name, F.lit(prefix))
    return F.when(F.coalesce(codegen, F.lit(False)), F.lit("parallel")).otherwise(F.lit("serial"))
