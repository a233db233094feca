"""Command line: lint schemas, generate documents, print the version."""

from __future__ import annotations

import argparse
import os
import sys

from typeloom import __version__, api
from typeloom.operators import lint

GENERATORS = ("shacl", "json-schema", "spark", "rdfs", "schema", "table-schema", "graphql", "er-diagram")


def _documents(schema: api.Schema, options: argparse.Namespace) -> dict[str, str]:
    """Documents by file name; a single one has the name ''."""
    kind = options.kind
    if kind == "json-schema":
        return {"": schema.json_schema(options.open, options.tree_root, options.root_form)}
    if kind == "table-schema":
        return {"": schema.table_schema(options.tree_root)}
    if kind in ("shacl", "rdfs"):
        form = "turtle" if options.format == "turtle" else "ntriples"
        return {"": schema.shacl(options.open, options.root_only, form) if kind == "shacl" else schema.rdfs(options.root_only, form)}
    if kind == "graphql":
        return {"": schema.graphql(options.pruning or "skip")}
    if kind == "er-diagram":
        return {"": schema.er_diagram(options.pruning or "skip")}
    if kind == "schema":
        return {"": schema.merged_text(options.pruning or "tree_root", not options.skip_derivation, "yaml" if options.format == "yaml" else "json")}
    return {f"{c.name}.sql": schema.ddl(c.name) for c in schema.catalog.classes.values()}


def _write(documents: dict[str, str], to: str | None) -> None:
    if list(documents) == [""]:
        if to is None:
            sys.stdout.write(documents[""])
        else:
            with open(to, "w", encoding="utf-8") as file:
                file.write(documents[""])
    elif to is None:
        for name, text in documents.items():
            sys.stdout.write(f"---- {name} ----\n{text}\n")
    else:
        os.makedirs(to, exist_ok=True)
        for name, text in documents.items():
            with open(os.path.join(to, name), "w", encoding="utf-8") as file:
                file.write(text)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="typeloom")
    commands = parser.add_subparsers(dest="command", required=True)
    check = commands.add_parser("validate", help="lint schemas")
    check.add_argument("files", nargs="+")
    check.add_argument("--format", choices=("terminal", "plain", "json"), default="terminal" if sys.stdout.isatty() else "plain")
    check.add_argument("--strict", action="store_true", help="warnings count as errors")
    make = commands.add_parser("generate", help="generate a document")
    make.add_argument("kind", choices=GENERATORS)
    make.add_argument("file")
    make.add_argument("--to")
    make.add_argument("--format", default="ntriples")
    make.add_argument("--open", action="store_true")
    make.add_argument("--tree-root")
    make.add_argument("--root-form")
    make.add_argument("--root-only", action="store_true")
    make.add_argument("--pruning", choices=("skip", "tree_root", "schema_root"))
    make.add_argument("--skip-derivation", action="store_true")
    commands.add_parser("version")
    options = parser.parse_args(argv)
    if options.command == "version":
        print(__version__)
        return 0
    if options.command == "validate":
        found = {f: lint.lint(f) for f in options.files}
        print(lint.rendered(found, options.format))
        return lint.exit_code((i for issues in found.values() for i in issues), options.strict)
    catalog, issues = lint.load(options.file)
    if catalog is None:
        print(lint.problems(issues, 5, True), file=sys.stderr)
        return 1
    _write(_documents(api.Schema(catalog), options), options.to)
    return 0


if __name__ == "__main__":
    sys.exit(main())
