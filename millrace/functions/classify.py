"""Ordered rules as CASE expressions: dependencies, limits, failures, back-off."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import strip_ascii

# Languages of the Node family, and the modules that come with Node.
NODE_LANGUAGES = ("javascript", "jsx", "typescript", "tsx")
NODE_BUILTINS = (
    "assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram",
    "diagnostics_channel", "dns", "domain", "events", "fs", "http", "http2", "https", "inspector", "module", "net",
    "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream",
    "string_decoder", "sys", "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi",
    "worker_threads", "zlib",
)
PYTHON_MODULES = tuple(sorted(sys.stdlib_module_names))


def dependency(raw: Column, language: Column) -> Column:
    """(canonical, kind) of an import that is no project file; canonical is '' for what names no package."""
    value, lang = strip_ascii(F.coalesce(raw, F.lit(""))), F.lower(strip_ascii(F.coalesce(language, F.lit(""))))
    relative = F.startswith(value, F.lit("./")) | F.startswith(value, F.lit("../"))
    turned = F.replace(value, F.lit("\\"), F.lit("/"))
    first = F.split_part(value, F.lit("/"), F.lit(1))
    top = strip_ascii(F.split_part(value, F.lit("."), F.lit(1)))
    package = F.regexp_replace(value, "^package:", "")
    package_relative = F.startswith(package, F.lit("./")) | F.startswith(package, F.lit("../"))
    answer = lambda name, kind: F.struct(name.alias("canonical"), kind.alias("kind"))
    external, sdk = F.lit("external"), F.lit("sdk")
    dart = (
        F.when(F.startswith(value, F.lit("dart:")), answer(value, sdk))
        .when(package_relative, answer(F.replace(package, F.lit("\\"), F.lit("/")), external))
        .otherwise(answer(F.split_part(package, F.lit("/"), F.lit(1)), external))
    )
    python = F.when(relative, answer(turned, external)).otherwise(answer(top, F.when(top.isin(*PYTHON_MODULES), sdk).otherwise(external)))
    scoped = F.array_join(F.slice(F.split(value, "/", -1), 1, 2), "/")
    node = (
        F.when(F.startswith(value, F.lit("node:")), answer(F.split_part(F.substr(value, F.lit(6)), F.lit("/"), F.lit(1)), sdk))
        .when(relative, answer(turned, external))
        .when(F.startswith(value, F.lit("@")), answer(scoped, external))
        .otherwise(answer(first, F.when(first.isin(*NODE_BUILTINS), sdk).otherwise(external)))
    )
    return (
        F.when(value == "", answer(F.lit(""), external)).when(lang == "dart", dart).when(lang == "python", python).when(lang.isin(*NODE_LANGUAGES), node).otherwise(answer(value, external))
    )


def limit_type(message: Column) -> Column:
    """Kind of rate limit that a message speaks of: tpm before rpm before quota before overloaded, else null."""
    low, has = F.lower(message), lambda s: F.contains(F.lower(message), F.lit(s))
    return (
        F.when(has("tokens per min") | F.rlike(low, F.lit(r"\btpm\b")), "tpm")
        .when(has("requests per min") | F.rlike(low, F.lit(r"\brpm\b")), "rpm")
        .when(has("daily") | has("quota") | has("resource_exhausted"), "quota")
        .when(has("overloaded") | has("529"), "overloaded")
    )


def signalled(message: Column, signals: Column) -> Column:
    return F.exists(signals, lambda s: F.contains(F.lower(message), F.lower(s)))


#: The verdict for each reason of a failed call.
VERDICTS = {
    "provider-quota-exhausted": "terminal_billing", "provider-authentication-rejected": "global", "provider-model-unavailable": "global", "provider-rate-limited": "rate_limit",
    "provider-input-rejected": "input", "provider-output-truncated": "input", "provider-timeout": "transient", "provider-connection-failed": "transient",
    "provider-response-malformed": "transient", "provider-request-failed": "transient",
}


def failure(insufficient_source: Column, contract_final: Column, reason: Column) -> Column:
    """Verdict in fixed precedence: the source, the response contract, the reason code, transient without one.

    A reason code outside the closed set is an error.
    """
    mapped = F.lit("transient")
    for code, verdict in VERDICTS.items():
        mapped = F.when(reason == code, verdict).otherwise(mapped)
    unknown = F.raise_error(F.concat(F.lit("unknown reason code "), reason))
    mapped = F.when(reason.isNotNull() & ~reason.isin(*VERDICTS), unknown).otherwise(mapped)
    return F.when(insufficient_source, "insufficient_source").when(contract_final, "response_contract_final").otherwise(mapped)


def ladder(workers: Column) -> Column:
    """Steps down in concurrency: all, half (two at least), one."""
    half = F.greatest(F.lit(2), F.floor(workers / 2).cast("int"))
    return F.when(workers <= 1, F.array(F.lit(1))).when(workers == 2, F.array(F.lit(2), F.lit(1))).otherwise(F.array_distinct(F.array(workers, half, F.lit(1))))


def backoff(rung: Column, retry_after: Column, least: float, scale: float, cap: float) -> Column:
    """Seconds before the next rung: what the server asked for, else growing by the rung; never above the cap."""
    own = F.lit(least) * F.pow(F.lit(scale), rung) if least > 0 else F.lit(0.0)
    return F.least(F.lit(float(cap)), F.coalesce(retry_after.cast("double"), own))


# The providers, and what the names of their models begin with; all others are the last one's.
PROVIDERS = ("anthropic", "gemini", "openai")
PREFIXES = {"anthropic": ("claude",), "gemini": ("gemini",)}


def provider(name: Column, model: Column, prefixes: dict[str, tuple[str, ...]] | None = None) -> Column:
    """A named provider, or for ``auto`` (and null) that of the model's prefix; any other name is an error."""
    low, auto = F.lower(model), F.lit("openai")
    for kind in ("gemini", "anthropic"):
        begins = F.exists(F.array(*[F.lit(p) for p in (prefixes or PREFIXES).get(kind, ())]).cast("array<string>"), lambda p: F.startswith(low, p))
        auto = F.when(begins, kind).otherwise(auto)
    asked = F.coalesce(name, F.lit("auto"))
    return F.when(asked == "auto", auto).when(asked.isin(*PROVIDERS), asked).otherwise(F.raise_error(F.concat(F.lit("no provider "), asked)))


# Signs that an instruction asks for more than one file shows, in order, with the words shown for them;
# the first that matches counts. And the most notes of a run.
CROSS_FILE = (
    ("every_file", "every file", r"(?i)\bevery\s+files?\b"), ("each_file", "each file", r"(?i)\beach\s+files?\b"), ("all_files", "all files", r"(?i)\ball\s+files?\b"),
    ("other_file", "other/another file", r"(?i)\b(?:other|another)\s+files?\b"), ("different_file", "different file", r"(?i)\bdifferent\s+files?\b"),
    ("across_files", "across files", r"(?i)\bacross\s+(?:all\s+)?files?\b"),
    ("project_scope", "project-wide", r"(?i)\b(?:across\s+the\s+project|project[- ]wide|whole\s+project|entire\s+project)\b"),
    ("repository_scope", "repository/repo-wide", r"(?i)\b(?:repository|repo[- ]wide)\b"), ("codebase_scope", "codebase", r"(?i)\bcodebase\b"), ("other_modules", "other modules", r"(?i)\bother\s+modules?\b"),
    ("importers", "files that import", r"(?i)\bfiles?\s+that\s+imports?\b"), ("callers", "callers", r"(?i)\bcallers?\b"), ("cross_file_usages", "usages across", r"(?i)\busages?\s+across\b"),
    ("all_references", "all/every references", r"(?i)\b(?:all|every)\b[^\n]{0,40}\breferences?\b"), ("all_imports_from", "all imports from", r"(?i)\ball\s+imports?\s+from\b"),
)
MOST_NOTES = 16


def cross_file(instruction: Column) -> Column:
    """(category, shown) of the first sign that matches, else null."""
    found = F.lit(None).cast("struct<category:string,shown:string>")
    for name, shown, pattern in reversed(CROSS_FILE):
        found = F.when(F.rlike(instruction, F.lit(pattern)), F.struct(F.lit(name).alias("category"), F.lit(shown).alias("shown"))).otherwise(found)
    return found


def feasibility_notes(units: DataFrame, most: int = MOST_NOTES) -> DataFrame:
    """(ord, note): what changed instructions ask for beyond one file, in order, without repeats, the first ``most``.

    ``units`` is (ord, component, field, instruction, default_instruction); a unit as it is by default gives no note.
    """
    own = units.filter(~F.col("instruction").eqNullSafe(F.col("default_instruction"))).withColumn("sign", cross_file(F.col("instruction"))).filter("sign IS NOT NULL")
    note = F.format_string("%s %s: asks for %s (%s), but one pass sees one file only", "component", "field", F.col("sign.shown"), F.col("sign.category"))
    return own.groupBy(note.alias("note")).agg(F.min("ord").alias("ord")).orderBy("ord").limit(most).select("ord", "note")
