"""The public interface: load a schema, lint it, generate documents, validate DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from typeloom.operators import lint as _lint
from typeloom.operators import rdf, render, validate
from typeloom.plans.catalog import Catalog
from typeloom.sources.documents import Importer, MapImporter


class Schema:
    """A loaded schema; make one with load_file, load_path, load_string or load_map."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    # -- lint

    def issues(self) -> list[_lint.Issue]:
        return _lint.issues(self.catalog)

    def lint(self, max_problems: int | None = None, verbose: bool = False) -> str | None:
        return _lint.problems(self.issues(), max_problems, verbose)

    def report(self, form: str = "plain") -> str:
        return _lint.rendered({self.catalog.root.id: self.issues()}, form)

    def check(self, strict: bool = False) -> None:
        """Raise the schema's problems if there are any."""
        _lint.raise_on_failure(self.issues(), strict)

    @property
    def is_valid(self) -> bool:
        return _lint.exit_code(self.issues()) == 0

    # -- documents

    def json_schema(self, open: bool = False, tree_root: str | None = None, tree_root_form: str | None = None, indent: int | None = 2) -> str:  # noqa: A002
        return render.to_json(render.json_schema(self.catalog, open, tree_root, tree_root_form), indent)

    def table_schema(self, tree_root: str | None = None, indent: int | None = 2) -> str:
        return render.to_json(render.table_schema(self.catalog, tree_root), indent)

    def merged(self, pruning: str = "tree_root", derive: bool = True) -> dict:
        return render.merged_schema(self.catalog, pruning, derive)

    def merged_text(self, pruning: str = "tree_root", derive: bool = True, form: str = "yaml") -> str:
        """The merged schema as YAML or JSON."""
        return (render.to_yaml if form == "yaml" else render.to_json)(self.merged(pruning, derive))

    def graphql(self, pruning: str = "skip") -> str:
        return render.graphql(self.catalog, pruning)

    def er_diagram(self, pruning: str = "skip", optional_marker: bool = True) -> str:
        return render.er_diagram(self.catalog, pruning, optional_marker)

    def shacl(self, open: bool = False, root_only: bool = False, form: str = "ntriples") -> str:  # noqa: A002
        return self._rdf(rdf.shacl(self.catalog, open, root_only), form)

    def rdfs(self, root_only: bool = False, form: str = "ntriples") -> str:
        return self._rdf(rdf.rdfs(self.catalog, root_only), form)

    def _rdf(self, triples, form: str) -> str:
        if form == "turtle":
            return rdf.turtle(triples, rdf.namespaces(self.catalog))
        return rdf.ntriples_text(triples)

    # -- Spark

    def struct_type(self, cls: str) -> T.StructType:
        return render.struct_type(self.catalog, cls)

    def ddl(self, cls: str) -> str:
        return render.table_ddl(self.catalog, cls)

    def validate(self, df: DataFrame, cls: str, keys: Sequence[str]) -> DataFrame:
        return validate.violations(df, self.catalog, cls, keys)

    def validation_report(self, df: DataFrame, cls: str) -> DataFrame:
        return validate.report(df, self.catalog, cls)

    def valid_rows(self, df: DataFrame, cls: str) -> DataFrame:
        return validate.valid_rows(df, self.catalog, cls)

    def triples(self, df: DataFrame, cls: str) -> DataFrame:
        return rdf.instances(df, self.catalog, cls)


def load_file(uri: str, importer: Importer | None = None) -> Schema:
    return Schema(_lint.loaded(uri, None, importer))


load_path = load_file


def load_string(text: str, importer: Importer | None = None) -> Schema:
    return Schema(_lint.loaded(None, text, importer))


def load_map(uri: str, texts: dict[str, str]) -> Schema:
    return Schema(_lint.loaded(uri, None, MapImporter(texts)))
