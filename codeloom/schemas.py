"""The tables of the engine, as explicit schemas: nothing is inferred on read, and absent fields default to null."""

from __future__ import annotations

from pyspark.sql.types import StructType

PARAMS = "array<struct<name: string, type: string>>"
#: A child table's rows carry an ordinal where the order of a file matters (first import wins, definition order).
TABLES = {
    "files": "path string, language string, error string, doc string",
    "symbols": f"id string, name string, qualname string, kind string, path string, language string, params {PARAMS}, returns string, start_line int, end_line int, decorated boolean, exported boolean, doc string, test boolean",
    "imports": "path string, name string, source string, ordinal int",
    "raw_calls": "caller_id string, path string, text string, name string, receiver string, line int",
    "raw_refs": "caller_id string, path string, name string, receiver string, line int",
    "edges": "caller string, callee string, lines array<int>",
    "referenced": "caller string, callee string, lines array<int>",
    "ambiguous": "caller string, name string, candidates array<string>",
    "external": "caller string, callee string, lines array<int>",
    "notes": "symbol_id string, seq int, text string, created timestamp",
    "provenance": "tool_version string, spec_hash string, git_commit string, subpath string, excludes array<string>, max_file_size bigint, files map<string, string>, stat map<string, array<bigint>>, unsupported struct<count: int, languages: map<string, int>>",
}
#: One file as the extraction returns it; its arrays are exploded into the tables above.
FILE_MAP = (
    "path string, language string, error string, doc string, content_hash string, "
    f"symbols array<struct<id: string, name: string, qualname: string, kind: string, params: {PARAMS}, returns: string, start_line: int, end_line: int, decorated: boolean, exported: boolean, doc: string>>, "
    "calls array<struct<caller_id: string, text: string, name: string, receiver: string, line: int>>, "
    "refs array<struct<caller_id: string, name: string, line: int>>, imports array<struct<name: string, source: string>>"
)
TYPE_KINDS = ("class", "interface", "enum", "struct", "record", "trait")
MODULE = "::<module>"


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])
