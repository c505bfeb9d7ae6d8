"""Scalar functions of the engine as Column expressions: all stay inside generated code."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.schemas import TYPE_KINDS

# They must be what users of such maps expect.
TEST_SEGMENTS = ("test", "tests", "__tests__", "spec", "specs", "testing")
TEST_NAMES = ("test_*", "*_test.*", "*.test.*", "*.spec.*", "*Test.*", "*Tests.*")
STOP_WORDS = ("the", "a", "an", "to", "of", "in", "on", "and", "or", "for", "is", "it", "this", "that", "with", "as", "at", "by", "be", "add", "use", "fix", "make")
TYPE_NOISE = ("Optional", "Promise", "List", "Array", "Vec", "Box", "Rc", "Arc", "Option", "Result", "Ok", "Err", "None", "null", "undefined", "readonly", "const", "mut", "ref")
SELF_NAMES = ("self", "this", "Self", "cls")
INDEX_STEMS = ("__init__", "mod", "lib", "index")


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_of(path: Column) -> Column:
    """The directory part; "." for a file at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob whose * also crosses slashes."""
    out = re.sub(r"\\\*", ".*", re.escape(pattern)).replace(r"\?", ".")
    return f"^(?s:{out})$"


def is_test_path(path: Column) -> Column:
    """A segment (the last one too) that names a test folder, or a test file's name. Case matters."""
    return F.arrays_overlap(F.split(path, "/"), strings(*TEST_SEGMENTS)) | base_name(path).rlike("|".join(map(glob_regex, TEST_NAMES)))


def matches_globs(path: Column, globs: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for g in globs:
        found = found | path.rlike(glob_regex(g)) | base_name(path).rlike(glob_regex(g))
    return found


def stem_of(path: Column) -> Column:
    """The file's name without its last suffix; for an index file, its directory's name."""
    stem = F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")
    parts = F.split(path, "/")
    return F.when(stem.isin(*INDEX_STEMS) & (F.size(parts) > 1), F.element_at(parts, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(stem)


def path_parts(text: Column) -> Column:
    return F.split(text, r"::|\.|/")


def import_segments(source: Column) -> Column:
    """Distinct non-empty segments, without relative markers."""
    return F.array_distinct(F.filter(path_parts(source), lambda x: (x != "") & ~x.isin("crate", "super", "self")))


def callee_base(text: Column) -> Column:
    """What an external name is looked up by: its last segment."""
    return F.try_element_at(F.filter(F.split(text, r"::|->|\.|/"), lambda x: x != ""), F.lit(-1))


def signature(kind: Column, qualname: Column, params: Column, returns: Column, path: Column) -> Column:
    listed = F.array_join(F.transform(F.coalesce(params, F.array().cast("array<struct<name: string, type: string>>")), lambda p: F.when(p["type"].isNotNull(), F.concat(p["name"], F.lit(": "), p["type"])).otherwise(p["name"])), ", ")
    plain = F.concat(qualname, F.lit("("), listed, F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), returns), F.lit("")))
    return F.when(kind.isin(*TYPE_KINDS), F.concat_ws(" ", kind, qualname)).when(kind == "variable", qualname).when(kind == "module", F.concat(F.lit("<anonymous> ("), path, F.lit(")"))).otherwise(plain)


def oneline(text: Column, limit: int) -> Column:
    """The first line of the stripped text, cut to ``limit`` characters with an ellipsis."""
    line = F.split(F.trim(F.coalesce(text, F.lit(""))), "\n")[0]
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, limit - 1)), F.lit("…")))


def tokens(text: Column) -> Column:
    """Four characters a token."""
    return F.floor(F.length(text) / 4)


def bpe_tokens(ranks: str, pattern: str) -> Callable[[Column], Column]:
    """A token counter by a rank file, in place of ``tokens``: a function of a text column. Workers load the file once."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encoding = _encoding(ranks, pattern)
        return texts.map(lambda x: len(encoding.encode_ordinary(x or "")))

    return count


@functools.lru_cache
def _encoding(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as f:
        known = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=known, special_tokens={})


def strip_generics(name: Column) -> Column:
    """A type's name without its parameters."""
    return F.trim(F.substring_index(name, "<", 1))


def strip_quotes(text: Column) -> Column:
    return F.regexp_replace(text, "^[\"'`]+|[\"'`]+$", "")


def project_folder(path: Column) -> Column:
    """A path as the name of one folder, as agents name what they keep of a project."""
    return F.regexp_replace(path, r"[/\\:]", "-")


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def words_of(text: Column) -> Column:
    """The words of identifiers: runs of letters and digits, parted where a capital follows a small letter or a digit, before
    the last of several capitals if a small letter follows it, and where a digit follows several capitals."""
    parted = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    parted = F.regexp_replace(parted, "([A-Z])([A-Z][a-z])", "$1 $2")
    parted = F.regexp_replace(parted, "([A-Z][A-Z])([0-9])", "$1 $2")
    return F.regexp_extract_all(parted, F.lit("[A-Za-z0-9]+"), F.lit(0))


def terms(text: Column) -> Column:
    """Lower-case words of two letters or more, without stop words, in first-seen order."""
    found = F.transform(words_of(text), lambda x: F.lower(x))
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) >= 2) & ~x.isin(*STOP_WORDS)))


def relevance(text: Column, path: Column, task: tuple[str, ...], diff_paths: tuple[str, ...] = (), recent_paths: tuple[str, ...] = ()) -> Column:
    """Exact terms, half of the partial ones (three letters or more, inside a term), and a boost for touched files."""
    own, asked = terms(text), strings(*task) if task else F.array().cast("array<string>")
    partial = F.filter(asked, lambda t: ~F.array_contains(own, t) & (F.length(t) >= 3) & F.exists(own, lambda x: x.contains(t)))
    boost = F.when(path.isin(*diff_paths) if diff_paths else F.lit(False), 2.0).when(path.isin(*recent_paths) if recent_paths else F.lit(False), 1.0).otherwise(0.0)
    return F.size(F.array_intersect(asked, own)) + 0.5 * F.size(partial) + boost


def centrality(fan_in: Column, churn: Column, max_churn: Column) -> Column:
    return F.when(max_churn > 0, fan_in * (1 + churn / max_churn)).otherwise(fan_in.cast("double"))


def escape_html(text: Column) -> Column:
    """For JSON inside a script element."""
    return F.replace(F.replace(F.replace(text, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e")), F.lit("&"), F.lit("\\u0026"))
