import ast

import pytest

from tessera.llm import syntax as S
from tessera.llm.gll import Grammar

GOOD = {
    "go": ["package a\n", "\ufeffpackage a\r\nfunc f() {}\r\n", "package a\nimport (\n\t\"fmt\"\n\tx \"y\"\n)\ntype T[K comparable, V any] struct { *B; a, b int `json:\"a\"` }\nfunc (t *T[K, V]) M(xs ...int) (n int, err error) {\n\tif v, ok := m[k]; ok && (v == T{}) {\n\t\treturn\n\t}\n\tfor i := range 10 { go func() { ch <- i }() }\n\tswitch x := y.(type) {\n\tcase int, *string: break\n\tdefault:\n\t}\n\tselect { case v := <-ch: _ = v; default: }\nL:\n\tfor ;; { continue L }\n\treturn len(xs) << 2 &^ 1, nil\n}"],
    "python": ["", "x = 1", "\ufeffprint('a')\r\n", "match x:\n  case [1, *r] if r: pass\n  case {'a': b, **c} | P(k=1) as z: pass\nmatch = 3; match(x)\n", "async def f[T: int](a, /, *b, c=1, **d) -> int:\n    async with a as b, c: await x\n    return [i async for i in y if i if (j := i)]\n", "f'{x!r:>{w}}' \"b\"\nlambda *a, k=1: (yield)\nx[1:2, ::3, *y] = {**a, 'b': 1}\n"],
    "javascript": ["", "#!/usr/bin/env node\nlet a = b\n++c\nreturn_(x)\n", "import a, {b as c} from 'x'\nexport default class extends B { #p = 1; static { } get x() { return this.#p } async *g() { yield* `a${ {x: `${1}`}.x }b` } }", "with (a) { await = 1 }", "if (a) { b = c } else { d = /[/]\\/x/g.test(e) ? f => ({f}) : async (x, ...y) => { for await (const z of x) ; } }", "a?.b?.[c]?.(d) ?? e ** -f\nlabel: for (;;) { continue label }", "x = function () {}\nvar {a, b: [c = 1, ...d], ...e} = f"],
    "java": ["", "package a.b; import static c.D.*; @A(x = {1, 2}) public sealed class C<T extends D & E> extends F<T[]> permits G { int a[] = {1}, b; static { } C() { this(1); } <U> void m(final int... x) throws Y { for (var e : x) { } int y = (int) z + (a) - b; Runnable r = () -> { }; F f = String[]::new; int s = switch (k) { case 1, 2 -> 3; case P(int q) when q > 0 -> { yield 4; } default -> 5; }; if (o instanceof List<?> l && l.size() >> 2 > 1) { } try (var t = u()) { } catch (A | B ex) { } } }", "record P(int x) { P { } } enum E implements I { A(1) { }, B; int z; } @interface N { int v() default 1; }", "module m { requires transitive a.b; exports c to d; }", 'class A { String s = """\n  a "quoted" b\n  """; char c = \'\\u0041\'; long l = 0x1F_FFL; }'],
    "rust": ["", "#![allow(x)]\nuse a::{b, c::*, self as d};\n/* a /* b */ c */\npub(crate) fn f<'a, T: Fn(&'a u8) -> X + ?Sized>(&mut self, x: [u8; 4]) -> Result<(), Box<dyn E + 'a>> where T: Y { let Some(z) = g::<Vec<Vec<u8>>>()? else { return Err(r#\"a\"b\"#)?; }; match x { A { b, .. } | C(1..=5) if b => {} _ => (), } for i in 0..n { 'l: loop { break 'l; } } let c = move |a: u8, (b, c)| a as u32 + 1; S { a, ..d }.m(b'x')[1..].await }", "macro_rules! m { ($x:expr) => { $x + 1 }; }\nimpl<T> !Send for S<T> {}\nstruct P(pub u8, f64);\nenum E { A = 1, B { c: u8 }, }\n"],
}
BAD = {
    "go": ["", "x", "package a\nfunc f() {", "package a\nfunc f() { x := }\n", "package a\n<<<<<<< HEAD\n", "package a.b\n", "package a\nvar s = \"x\n", "package a\n\x00"],
    "python": ["print 'a'\n", "if x:\npass\n", "x = (1\n", " x = 1\n", "<<<<<<< HEAD\n", "a = 'x\n", "x = 0777\n", "def f(:\n  pass\n", "\x00"],
    "javascript": ["function f( {", "let a = ;", "a b", "}", "`${a", "if (a) }", "import x from", "x = 'a\n'"],
    "java": ["\ufeffclass A { }", "class A {", "class A { void f() { a + b; } }", "class A { int x = 1 }", "int f() { }", "def f(x):"],
    "rust": ["fn f() {", "fn f() { let x = ; }", "<<<<<<< a", "fn f() -> { }", "let x = 1;", "fn f() { a b }", "/* x"],
}


@pytest.mark.parametrize("language", sorted(GOOD))
def test_texts_that_parse(language):
    for t in GOOD[language]:
        assert S.parses(language, t), t


@pytest.mark.parametrize("language", sorted(BAD))
def test_texts_that_do_not(language):
    for t in BAD[language]:
        assert not S.parses(language, t), t


def test_every_cut_of_a_python_file_agrees_with_its_own_parser():
    text = open(S.__file__).read()[:6000]
    for n in range(0, len(text), 7):
        cut = text[:n]
        try:
            ast.parse(cut)
            ok = True
        except SyntaxError:
            ok = False
        assert S.parses("python", cut) == ok, cut[-60:]


def test_ambiguous_and_nullable_grammars():
    g = Grammar("Start = Some | ; Some = Part Part 'x' | Part 'y' Start ; Part = [ 'a' ] { 'b' } ;", ["Start"])
    t = g.terminals
    sentence = lambda s: g.recognise([t[c] for c in s]) < 0
    assert all(sentence(s) for s in ("", "x", "ax", "aax", "abbabx", "ay", "yx", "abyabby"))
    assert not any(sentence(s) for s in ("a", "aaax", "xx", "xy"))
    left = Grammar("Sum = Sum '+' Term | Term ; Term = 'n' ;", ["Sum"])
    n, plus = left.terminals["n"], left.terminals["+"]
    assert left.recognise([n, plus, n, plus, n]) == -1 and left.recognise([n, n]) == 1 and left.recognise([plus]) == 0


def test_files_of_a_table(spark):
    rows = [("r:a/x.py", "x = 1\n"), ("./r:a/x.py", "x = 1\n"), ("r:a/y.py", "x = (\n"), ("r:a/z.go", "x = 1\n"), ("r:a/n.py", None), (None, "x"), ("r:a/readme.txt", "("), ("q:b/E.java", ""), ("q:b/e.go", ""), ("r:b/long.py", "x = [1]\n" * 60_000)]
    df = spark.createDataFrame(rows, "path STRING, content STRING").selectExpr("*", "1 AS ok", "2 AS language")
    got = {r["path"]: (r["language"], r["ok"], r["repo"]) for r in S.parsed(df).collect()}
    assert got == {"r:a/x.py": ("python", True, "r"), "r:a/y.py": ("python", False, "r"), "r:a/z.go": ("go", False, "r"), "q:b/E.java": ("java", True, "q"), "q:b/e.go": ("go", False, "q"), "r:b/long.py": ("python", True, "r")}
    log = spark.createDataFrame([("./r:a/y.py", "x"), ("r:a/y.py", None), (None, "e")], "path STRING, error STRING")
    rate = {(r["repo"], r["language"]): (r["files"], r["failed"], r["logged"]) for r in S.rates(S.parsed(df), log).collect()}
    assert rate == {("r", "python"): (3, 1, 1), ("r", "go"): (1, 1, 0), ("q", "java"): (1, 0, 0), ("q", "go"): (1, 1, 0)}
    assert S.parsed(df.limit(0)).count() == 0
