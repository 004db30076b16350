import pytest

from tessera.llm import layout as Y

HAND_GO = """package a

import "fmt"

// scan reads the rows of every page.
func scan(rows []int, limit int) (int, error) {
	n := 8
	for i, x := range rows {
		if x > limit+14 {
			n += i * x
		}
	}
	return n, fmt.Errorf("over %d", n)
}
"""
HAND_JS = "import { a } from './b';\n\nfunction f(x, limit = 3) {\n  let y = [{ k: [1, 2], keep: true }].map((o) => o.k[0])[0];\n  return y;\n}\n"
MIN_JS = "".join(f"function f{i}(a){{return a+{i}}}var b{i}=c{i},d=[e,{i}];if(x>{i}){{r=x*{i}}}else{{r=null}}" for i in range(30))


@pytest.mark.parametrize(
    "path,text,want",
    [
        ("r:a/b.go", HAND_GO, []),
        ("r:a/b.js", HAND_JS, []),
        ("r:a/b.go", "// Code generated by tool. DO NOT EDIT.\n" + HAND_GO, ["generated"]),
        ("r:a/b.go", HAND_GO + "\n// Diese Datei wurde automatisch von tool erzeugt - nicht bearbeiten\n", ["generated"]),
        ("r:a/b.py", "# built from x.tmpl by tool; regenerate with: make x\nx = 1\n", ["generated"]),
        ("r:a/b.py", "# Fichier produit par tool ; ne pas modifier a la main\nx = 1\n", ["generated"]),
        ("r:a/b.py", "x = '# Code generated by tool. DO NOT EDIT.'\n", []),
        ("r:a/b.go", "// Writes the 'Code generated ... DO NOT EDIT' line into its output; this file itself is maintained by hand.\n" + HAND_GO, []),
        ("r:a/b.go", "// Hints for people who edit @generated files elsewhere in this tree:\n" + HAND_GO, []),
        ("r:a/b.go", "// Owner: x team. Please edit with care.\n// Copyright 2024 the r authors. All rights reserved.\n" + HAND_GO, []),
        ("r:a/b_pb2.py", "x = 1\n", ["generated"]),
        ("r:a/DaggerFoo.java", "class DaggerFoo { }\n", ["generated"]),
        ("r:vendor/lib/a.go", HAND_GO, ["vendored"]),
        ("r:vendors1/lib/a.go", HAND_GO, []),
        ("r:web/static/lib/x/a.js", HAND_JS, ["vendored"]),
        ("r:a/b.py", "# lib v1.2.3 | (c) the lib contributors | released under the MIT licence\nx = 1\n", ["vendored"]),
        ("r:a/b.py", "# Imported from lib release 2.0.1. Do not patch here, send changes to the lib project.\nx = 1\n", ["vendored"]),
        ("r:a/b.py", "# This file is part of lib (2.0.1), bundled with this project.\nx = 1\n", ["vendored"]),
        ("r:a/b.py", "# We replaced lib with this module, written from scratch.\nx = 1\n", []),
        ("r:a/b.js", MIN_JS, ["minified"]),
        ("r:a/b.js", "/*! lib v1.2.3 */\n" + MIN_JS, ["minified", "vendored"]),
        ("r:a/b.go", "package a\n\nvar x = []byte{\n" + "\t0x2b, 0x8e, 0x91, 0xcd,\n" * 40 + "}\n", ["data"]),
        ("r:a/b.py", "X = (\n" + "    'NrpY8hq3ACgt4dQ8M3Mu6EFi2en4wcYd7ruacwe2Icn0bERnmKIXFA'\n" * 20 + ")\n", ["data"]),
        ("r:a/b.py", 'def f():\n    """' + "Long words of a docstring. " * 60 + '"""\n    return 1\n', []),
        ("r:a/b.py", "", []),
    ],
)
def test_reasons(path, text, want):
    assert Y.reasons(path, text) == want


def test_uniform_files_are_generated():
    text = "package a\n" + "".join(f"func Get{i}(m *M) int64 {{\n\treturn m.f{i}\n}}\n" for i in range(150))
    assert Y.reasons("r:a/b.go", text) == ["generated"]
    assert Y.reasons("r:a/b.go", text.replace("m.f77", " m.f77 ")) == []


def test_tolerates_anything():
    for t in ("\x00" * 50, "'" * 999, "/*", "`${", '"""', "\ufeff", "a" * 200_000, "(" * 5000, "<<<<<<< HEAD\n=======\n"):
        for ext in ("go", "py", "js", "java", "rs", "txt"):
            Y.reasons(f"r:a/b.{ext}", t)


def test_table_with_repeats_nulls_and_detector(spark):
    rows = [("r:a/x.js", MIN_JS), ("./r:a/x.js", MIN_JS), ("r:a/y.go", HAND_GO), ("r:vendor/n.go", None), (None, "x")]
    df = spark.createDataFrame(rows, "path STRING, content STRING").selectExpr("*", "1 AS reasons", "2 AS h")
    found = Y.classified(df).cache()
    assert {r["path"]: r["reasons"] for r in found.collect()} == {"r:a/x.js": ["minified"], "r:a/y.go": [], "r:vendor/n.go": ["vendored"]}
    files = spark.createDataFrame([("./r:a/y.go", "marker"), ("r:a/x.js", None), (None, "marker")], "path STRING, gen_reason STRING")
    got = {(r["language"], r["reason"]): (r["files"], r["detected"]) for r in Y.against_detector(found, files).collect()}
    assert got == {("javascript", "minified"): (1, 0), ("go", "hand-written"): (1, 1), ("go", "vendored"): (1, 0)}
    assert Y.classified(df.limit(0)).count() == 0
