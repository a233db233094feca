import json

import pytest

from typeloom.__main__ import main
from typeloom.operators import lint
from typeloom.sources.documents import MapImporter

HEAD = "id: https://e.org/s\nname: s\nimports: [linkml:types]\ndefault_range: string\n"
ROOT = "classes:\n  Root: {tree_root: true}\n"


def kinds(text, head=HEAD):
    catalog, found = lint.load(text=head + text)
    return [i.kind for i in (found if catalog is None else lint.issues(catalog))]


@pytest.mark.parametrize("text, kind", [
    ("classes:\n  A: {is_a: Nope}\n", "UnknownReference"),
    ("classes:\n  A: {attributes: {x: {range: sl}}}\nslots: {sl: {}}\n", "InvalidRange"),
    ("classes:\n  A: {is_a: A}\n", "CyclicInheritance"),
    ("classes:\n  A: {tree_root: true}\n  B: {tree_root: true}\n", "MultipleTreeRoots"),
    (ROOT + "  K: {attributes: {a: {key: true}, b: {identifier: true}}}\n", "MultipleKeyOrIdSlots"),
    (ROOT + "  K: {attributes: {a: {key: true, range: Root}}}\n", "InvalidKeyOrIdSlotType"),
    (ROOT + "enums: {Root: {}}\n", "NonUniqueName"),
    (ROOT + "types: {t: {base: str, implicit_prefix: nope}}\n", "UndefinedPrefix"),
    (ROOT + "slots: {s: {slot_uri: 'no where:x'}}\n", "InvalidUriOrCurie"),
    (ROOT + "  C: {slot_usage: {ghost: {required: true}}}\n", "InvalidSlotUsage"),
    ("classes:\n  A: {}\n", "NoTreeRootClass"),
])
def test_each_check(text, kind):
    assert kinds(text) == [kind]


def test_default_ranges():
    head = "id: https://e.org/s\nname: s\n"
    assert kinds("classes:\n  A: {tree_root: true, attributes: {x: {}}}\n", head) == ["InvalidDefaultRange"]
    assert kinds("classes:\n  A: {tree_root: true}\n", head) == ["UndefinedDefaultRange"]
    assert "UnknownStringReference" in kinds("classes:\n  A: {attributes: {x: {range: string}}}\n", head)


def test_paths_and_messages():
    _, found = lint.load(text=HEAD + "slots: {wrong: {range: nope}}\n")
    assert found[0].path == "/slots/wrong/range/" and found[0].short() == "Unknown reference 'nope' at /slots/wrong/range/"
    _, found = lint.load(text="id: [")
    assert found[0].kind == "SchemaParseError" and lint.exit_code(found) == 1


def test_same_id_in_two_schemas():
    texts = {"a.yaml": HEAD.replace("[linkml:types]", "[linkml:types, b]") + ROOT, "b.yaml": "id: https://e.org/s\nname: other\n"}
    assert [i.kind for i in lint.lint("a.yaml", MapImporter(texts))] == ["SchemaIdClash"]


def test_problems_text():
    issues = [lint.Issue("NoTreeRootClass")] * 4
    assert lint.problems([]) is None
    assert lint.problems(issues, 2).splitlines()[-1] == "and 2 more problems..."


def test_report_and_exit_codes(tmp_path, capsys):
    good, warn, bad = tmp_path / "g.yaml", tmp_path / "w.yaml", tmp_path / "b.yaml"
    good.write_text(HEAD + ROOT)
    warn.write_text(HEAD)
    bad.write_text("id: [")
    assert main(["validate", str(good)]) == 0 and main(["validate", str(warn)]) == 0
    assert main(["validate", "--strict", str(warn)]) == 1 and main(["validate", str(bad), str(good)]) == 1
    capsys.readouterr()
    assert main(["validate", "--format", "json", str(warn)]) == 0
    assert json.loads(capsys.readouterr().out)["counts"] == {"fatal": 0, "error": 0, "warning": 1}


@pytest.mark.parametrize("kind", ["shacl", "json-schema", "spark", "rdfs", "schema", "table-schema", "graphql", "er-diagram"])
def test_every_generator_from_the_command_line(tmp_path, kind, capsys):
    source = tmp_path / "m.yaml"
    source.write_text(HEAD + "classes:\n  Root: {tree_root: true, attributes: {a: {required: true}}}\n")
    assert main(["generate", kind, str(source)]) == 0 and "a" in capsys.readouterr().out
    assert main(["generate", kind, str(source), "--to", str(tmp_path / "out")]) == 0 and (tmp_path / "out").exists()
    assert main(["generate", kind, str(tmp_path / "none.yaml")]) == 1
