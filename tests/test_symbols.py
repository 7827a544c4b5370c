"""Symbol extraction against the Python parser and known snippets."""

import ast
import importlib
import itertools
import time
import uuid

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from symgrove.catalog.code_templates import TEMPLATES
from symgrove.functions.ids import name_uuid
from symgrove.operators import symbols as b
from symgrove.rules import rules_for
from symgrove.scanner import definitions

MODULES = ["json.decoder", "dataclasses", "textwrap", "heapq", "string", "contextlib", "queue", "shlex",
           "fractions", "tempfile", "csv", "calendar", "argparse", "ast", "inspect", "typing"]


def _files(spark, rows):
    return spark.createDataFrame(rows, "rel_path string, language string, content string")


def _ast_definitions(source):
    """(kind, name, start byte, text) of each def and class."""
    starts = [0]
    raw = source.encode()
    for line in raw.split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            start = starts[node.lineno - 1] + node.col_offset
            yield kind, node.name, start, raw[start:starts[node.end_lineno - 1] + node.end_col_offset].decode()


def test_python_definitions_equal_ast(spark):
    sources = {}
    for name in MODULES:
        with open(importlib.import_module(name).__file__, encoding="utf-8") as fh:
            sources[f"{name}.py"] = fh.read()
    files = _files(spark, [(p, "python", s) for p, s in sources.items()])
    rows = b.classify_tag(b.scan_definitions(files)).collect()
    got = {(r.rel_path, r.node_type, r.symbol_name, r.start_byte): r.source_code for r in rows}
    want = {(p, k, n, at): text for p, s in sources.items() for k, n, at, text in _ast_definitions(s)}
    assert got.keys() == want.keys()
    assert [k for k in want if got[k] != want[k]] == []


SNIPPETS = {
    ("go", "a.go"): ("// Add adds\nfunc Add(a int) int { return a }\ntype T struct {\n\tx int\n}\n"
                     "func (t *T) M() string {\n\tif t != nil {\n\t\treturn \"}\"\n\t}\n\treturn \"{\"\n}\n",
                     {("function", "Add"): "func Add(a int) int { return a }",
                      ("method", "M"): "func (t *T) M() string {\n\tif t != nil {\n\t\treturn \"}\"\n\t}\n"
                                       "\treturn \"{\"\n}"}),
    ("rust", "a.rs"): ("pub struct P;\n#[x]\npub struct Q { a: i32 }\nenum E {\n    A, // one\n    #[y]\n"
                       "    B(i32),\n    C {\n        x: i32,\n    },\n}\nfn k() {\n    Some(1)\n}\n"
                       "pub trait Tr {\n    fn sig(&self) -> i32;\n    fn body(&self) {\n        x();\n    }\n}\n"
                       "macro_rules! m {\n    () => {};\n}\nfn allman()\n{\n    1\n}\n",
                       {("class", "P"): "pub struct P;", ("class", "Q"): "pub struct Q { a: i32 }",
                        ("class", "A"): "A", ("class", "B"): "B(i32)",
                        ("class", "C"): "C {\n        x: i32,\n    }", ("function", "k"): "fn k() {\n    Some(1)\n}",
                        ("class", "Tr"): None, ("function", "sig"): "fn sig(&self) -> i32;",
                        ("function", "body"): "fn body(&self) {\n        x();\n    }",
                        ("function", "m"): "macro_rules! m {\n    () => {};\n}",
                        ("function", "allman"): "fn allman()\n{\n    1\n}"}),
    ("ruby", "a.rb"): ("module M\n  class A::B < C\n    def x?(a)\n      1\n    rescue\n      2\n    end\n"
                       "    def self.y; 3; end\n    alias z x\n  end\nend\n",
                       {("class", "B"): None, ("method", "x?"): "def x?(a)\n      1\n    rescue\n      2\n    end",
                        ("method", "y"): "def self.y; 3; end", ("method", "z"): "alias z x"}),
    ("c-sharp", "a.cs"): ("namespace N {\n  public class K : B {\n    public int F(int a) {\n      return a;\n"
                          "    }\n    void G() => H();\n  }\n  interface I {\n    string Name();\n  }\n}\n",
                          {("class", "K"): None, ("class", "I"): "interface I {\n    string Name();\n  }",
                           ("method", "F"): "public int F(int a) {\n      return a;\n    }",
                           ("method", "G"): "void G() => H();", ("method", "Name"): "string Name();"}),
    ("swift", "a.swift"): ("protocol P {\n    func a() -> Int\n    func b()\n}\nfinal class C: P {\n"
                           "    class func k() { }\n}\nextension C {\n    func e() {\n    }\n}\nstruct S {}\n",
                           {("class", "P"): None, ("class", "C"): None, ("function", "a"): "func a() -> Int",
                            ("function", "b"): "func b()", ("function", "k"): "class func k() { }",
                            ("function", "e"): "func e() {\n    }", ("class", "S"): "struct S {}"}),
    ("php", "a.php"): ("<?php\nabstract class A {\n  public static function f($x) {\n    return 1;\n  }\n}\n"
                       "function g() { return 2; }\n",
                       {("class", "A"): None, ("function", "f"): "public static function f($x) {\n    return 1;\n  }",
                        ("function", "g"): "function g() { return 2; }"}),
    ("dart", "a.dart"): ("class A {\n  A(this.x) : super();\n  int f(int y) {\n    return y;\n  }\n}\n"
                         "mixin M {}\nextension X on A {}\nvoid main() => run();\n",
                         {("class", "A"): None, ("function", "A"): None, ("function", "f"): "int f(int y)",
                          ("class", "M"): "mixin M {}", ("class", "X"): "extension X on A {}",
                          ("function", "main"): "void main()"}),
    ("perl", "a.t"): ("package P;\nsub f {\n  my $x = 1; # {\n}\n", {("function", "f"): "sub f {\n  my $x = 1; # {\n}"}),
    ("lua", "a.lua"): ("local function f(x)\n  return x\nend\nM.g = function()\n  return 1\nend\nfunction M:h()\nend\n",
                       {("function", "f"): "local function f(x)\n  return x\nend",
                        ("function", "g"): "M.g = function()\n  return 1\nend",
                        ("function", "h"): "function M:h()\nend"}),
    ("r", "a.R"): ("f <- function(x) {\n  x\n}\ng = function() 1\n",
                   {("function", "f"): "f <- function(x) {\n  x\n}", ("function", "g"): "g = function() 1"}),
    ("elixir", "a.ex"): ("defmodule M do\n  def f(x) do\n    x\n  end\n  defp g(y), do: y\nend\n",
                         {("function", "f"): "def f(x) do\n    x\n  end", ("function", "g"): "defp g(y), do: y"}),
    ("erlang", "a.erl"): ("-record(r, {a}).\n-define(M(X), X).\n-spec f(x) -> ok.\nf(1) ->\n    ok;\nf(X) ->\n    X.\n",
                          {("class", "r"): None, ("function", "M"): None, ("class", "f"): None,
                           ("function", "f"): None}),
    ("haskell", "a.hs"): ("f :: Int -> Int\nf x = case x of\n  1 -> 2\ndata T = A | B\nclass C a where\n  m :: a\n",
                          {("function", "f"): None, ("class", "T"): "data T = A | B",
                           ("class", "C"): "class C a where\n  m :: a"}),
    ("scala", "a.scala"): ("class A(x: Int) {\n  def f(y: Int): Int = {\n    y\n  }\n  def g = 3\n}\ntrait T\n",
                           {("class", "A"): None, ("function", "f"): "def f(y: Int): Int = {\n    y\n  }",
                            ("function", "g"): "def g = 3", ("class", "T"): "trait T"}),
    ("java", "a.java"): ("class Test {\n  void f() {\n  }\n}\n", {}),
    ("javascript", "a.js"): ("function f() { return 1; }\n", {}),
}


def test_snippets_of_every_language(spark):
    files = _files(spark, [(path, lang, text) for (lang, path), (text, _) in SNIPPETS.items()])
    got = {}
    for row in b.symbol_nodes(files).collect():
        got.setdefault(row.file_path, {})[(row.node_type, row.symbol_name)] = row.source_code
    for (_, path), (_, want) in SNIPPETS.items():
        mine = got.get(path, {})
        assert mine.keys() == want.keys(), path
        for key, text in want.items():
            assert text is None or mine[key] == text, (path, key)


def test_extended_rules_are_off_by_default(spark):
    files = _files(spark, [("a.java", "java", "class T {\n  int f(int a) {\n    return a;\n  }\n}\n"),
                           ("a.js", "javascript", "export function f() {\n  return 1;\n}\n"),
                           ("a.ts", "typescript", "interface I {\n  x: number;\n}\n"),
                           ("a.c", "c", "static int f(int a)\n{\n  return a;\n}\n"),
                           ("a.cpp", "cpp", "class K {\n};\nvoid K::go() {\n}\n"),
                           ("a.kt", "kotlin", "class K {\n  fun f() = 1\n}\n"),
                           ("a.sh", "bash", "f() {\n  echo }\n}\nfunction g {\n  true\n}\n")])
    assert b.symbol_nodes(files).count() == 0
    got = {(r.file_path, r.symbol_name) for r in b.symbol_nodes(files, extended=True).collect()}
    assert got == {("a.java", "T"), ("a.java", "f"), ("a.js", "f"), ("a.ts", "I"), ("a.c", "f"), ("a.cpp", "K"),
                   ("a.cpp", "K::go"), ("a.kt", "K"), ("a.kt", "f"), ("a.sh", "f"), ("a.sh", "g")}


def test_ids_equal_uuid5_and_are_stable(spark):
    files = _files(spark, [("src/é.py", "python", "x = 1\ndef my_func(): pass")])
    row = b.symbol_nodes(files).first()
    assert row.node_id == str(uuid.uuid5(uuid.NAMESPACE_URL, "src/é.py:6:my_func"))
    names = [f"n{i}é" for i in range(200)]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", name_uuid(F.col("n")).alias("u"))
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.n)) for r in rows.collect())


def test_same_path_in_two_repositories(spark):
    files = spark.createDataFrame([(r, "a.py", "python", "def f(): pass") for r in "xy"],
                                  "repo string, rel_path string, language string, content string")
    nodes = b.symbol_nodes(files, ("repo", "rel_path"), id_path=F.concat_ws("/", "repo", "rel_path"))
    assert nodes.select("node_id").distinct().count() == 2


def test_nothing_is_shuffled(spark, tmp_path):
    _files(spark, [("a.py", "python", "def f(): pass")]).write.parquet(str(tmp_path / "files"))
    plan = b.symbol_nodes(spark.read.parquet(str(tmp_path / "files")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


def _filled(text):
    for mark, value in (("@n", "é_ring_12"), ("@T", "T_ring_12"), ("@f", "f_ring_12"), ("@s", "7")):
        text = text.replace(mark, value)
    return text


@pytest.mark.parametrize("language, suffix, shapes", TEMPLATES, ids=[t[0] for t in TEMPLATES])
def test_templates_in_any_order(language, suffix, shapes):
    for order in itertools.permutations(range(len(shapes))):
        text, want = "", set()
        for i in order:
            body, found = shapes[i]
            for tag, name, own in found:
                assert body.count(own) == 1
                start = len((text + _filled(body[:body.index(own)])).encode())
                want.add((tag, _filled(name), start, start + len(_filled(own).encode()), _filled(own)))
            text += _filled(body) + "\n\n"
        assert set(definitions(text, language)) == want


# What line rules once lost or made up: language, text, names with their source.
CASES = [
    ("rust", "enum Color { Red, Green }", {"Color": None, "Red": "Red", "Green": "Green"}),
    ("rust", "enum E {\n    A, B,\n    C = 3,\n}", {"E": None, "A": "A", "B": "B", "C": "C = 3"}),
    ("rust", "fn f() { if !x { fn g() {} } }\nfoo! { fn no() {} }", {"f": None, "g": "fn g() {}"}),
    ("php", "<?php class A { function m() { return 1; } }", {"A": None, "m": "function m() { return 1; }"}),
    ("php", "<p>don't</p><?php function f() {} ?>it's<?php function g() {}", {"f": "function f() {}", "g": "function g() {}"}),
    ("c-sharp", "class One { void M() {} }", {"One": None, "M": "void M() {}"}),
    ("c-sharp", "class K { public uint F() { return 1; } public short S() => 2; (int,int) T() { return (1, 2); }\n"
                "  [Test] public void U() {} public K(int x) { Foo(x); } }",
     {"K": None, "F": "public uint F() { return 1; }", "S": "public short S() => 2;", "T": "(int,int) T() { return (1, 2); }",
      "U": "[Test] public void U() {}"}),
    ("ruby", "class A; def m; end; end", {"A": "class A; def m; end; end", "m": "def m; end"}),
    ("ruby", "x = <<~T\n  def no\n  end\nT\ndef y\n  1 if z\nend", {"y": "def y\n  1 if z\nend"}),
    ("perl", "sub g {1} sub h {2}", {"g": "sub g {1}", "h": "sub h {2}"}),
    ("dart", "class A { A(this.x); int f({int a = 1}) => a; void g() { A(1); f(2); } }",
     {"A": "A(this.x)", "f": "int f({int a = 1})", "g": "void g()"}),
    ("haskell", "f x\n  | x > 0 = 1\n  | otherwise = 2\nx <+> y = x\nk = 3", {"f": "f x\n  | x > 0 = 1\n  | otherwise = 2"}),
    ("erlang", "f(X)\n  when X > 0 ->\n    ok.\n", {"f": "f(X)\n  when X > 0 ->\n    ok"}),
    ("r", "f <-\n  function(x) x\nlapply(a, init = function(x) 1)", {"f": "f <-\n  function(x) x"}),
    ("scala", "trait T {\n  def a: Int\n  def +(o: T): T = o\n  def b = 1\n}", {"T": None, "b": "def b = 1"}),
    ("swift", "extension A { static func + (l: A, r: A) -> A { l }; func f() {} }", {"A": None, "f": "func f() {}"}),
    ("lua", "t = { f = function() end }\nfunction g() end", {"g": "function g() end"}),
    ("elixir", "def a + b, do: a\ndef f(x),\n  do: x\n", {"f": "def f(x),\n  do: x"}),
    ("go", "var f = func(a int) int { return a }\nfunc G() {}; func H() {}", {"G": "func G() {}", "H": "func H() {}"}),
]


@pytest.mark.parametrize("language, text, want", CASES, ids=[f"{i}-{c[0]}" for i, c in enumerate(CASES)])
def test_cases(language, text, want):
    got = {name: source for _, name, _, _, source in definitions(text, language)}
    assert got.keys() == want.keys()
    assert {n: got[n] for n, t in want.items() if t is not None} == {n: t for n, t in want.items() if t is not None}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["{", "}", "(", ")", "[", "]", "\n", " ", "end", "do", "def f", "class A", "fn g", "func h()",
                                 "function k()", "'", '"', "/*", "*/", "#", "--[[", "=", ";", "->", "case", "é", "<<~X", "sub q",
                                 "enum E", ",", "if", "@", "<?php", "?>", "f(x)", ".", "when", "\\"]), max_size=40),
       st.sampled_from(sorted(rules_for(True))))
def test_any_text_is_scanned(parts, language):
    text = "".join(parts)
    raw = text.encode()
    for _, name, start, end, source in definitions(text, language, True):
        assert 0 <= start <= end <= len(raw) and raw[start:end].decode() == source


def test_long_texts_take_linear_time():
    def seconds(n):
        text = "".join(f"func f{i}(a int) int {{\n\treturn g(a, [{i}])\n}}\n" for i in range(n))
        begin = time.perf_counter()
        assert len(definitions(text, "go")) == n
        return time.perf_counter() - begin

    seconds(1000)
    assert seconds(20000) < 40 * max(seconds(2000), 0.01)


@pytest.mark.parametrize("content", ["", "\n\n", "def f(:", "class", "}}}}", "\r\ndef g():\r\n    pass\r\n"])
def test_odd_contents(spark, content):
    for language in ("python", "go"):
        b.symbol_nodes(_files(spark, [("a", language, content)])).collect()
