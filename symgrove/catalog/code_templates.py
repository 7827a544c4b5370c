"""Source text with known definitions: for each language a few shapes, and what is defined in them.

``@n``, ``@T`` and ``@f`` stand for names (any start, upper and lower ASCII),
``@s`` for a number. Shapes hold one-line, several-a-line, multi-line and
nested definitions, and decoys in strings, comments and other places.
"""

from __future__ import annotations

# (language, suffix, shapes); a shape is (body, definitions); a definition (tag, name, its text in the body).
TEMPLATES = [
    ("python", ".py", [
        ("class @T: x = @s", [("class", "@T", "class @T: x = @s")]),
        ("@dec\nasync def @n(\n    a,\n    b=\"def no(): pass\",\n):\n    def in_@n(): return @s\n    return in_@n", [
            ("function", "@n", "async def @n(\n    a,\n    b=\"def no(): pass\",\n):\n    def in_@n(): return @s\n    return in_@n"),
            ("function", "in_@n", "def in_@n(): return @s")]),
        ("def @n():\n    '''\ndef no(): pass\n    '''\n    # class No: pass\n    return @s\nx = @s", [
            ("function", "@n", "def @n():\n    '''\ndef no(): pass\n    '''\n    # class No: pass\n    return @s")]),
    ]),
    ("go", ".go", [
        ("func @n() {}; func g_@n(x interface{ F() }) interface{} { return @s }", [
            ("function", "@n", "func @n() {}"),
            ("function", "g_@n", "func g_@n(x interface{ F() }) interface{} { return @s }")]),
        ("func (t *T) @T(\n\ta int,\n) (\n\tb int,\n) {\n\treturn \"}\" + `func no() {` // }\n}", [
            ("method", "@T", "func (t *T) @T(\n\ta int,\n) (\n\tb int,\n) {\n\treturn \"}\" + `func no() {` // }\n}")]),
        ("/* func no() {} */\nvar v_@n = func(a int) int { return @s }\nfunc @n[K any](x K) K {\n\tf := func() int { return @s }\n\treturn x\n}", [
            ("function", "@n", "func @n[K any](x K) K {\n\tf := func() int { return @s }\n\treturn x\n}")]),
    ]),
    ("ruby", ".rb", [
        ("class @T; def m_@n; @s; end; end", [
            ("class", "@T", "class @T; def m_@n; @s; end; end"), ("method", "m_@n", "def m_@n; @s; end")]),
        ("h_@n = <<~EOS\n  def no\n  end\nEOS\ndef self.@n=(v)\n  return 1 if v\n  x = if v then 2 else 3 end\n"
         "  while v do v = nil end\n  [1].each do |i| i end\nend", [
             ("method", "@n=", "def self.@n=(v)\n  return 1 if v\n  x = if v then 2 else 3 end\n"
                               "  while v do v = nil end\n  [1].each do |i| i end\nend")]),
        ("module M_@n\n  class << K_@n\n    def e_@n = @s\n    alias z_@n x\n  end\nend\nv = { if: 1, end: 2 }", [
            ("class", "K_@n", "class << K_@n\n    def e_@n = @s\n    alias z_@n x\n  end"),
            ("method", "e_@n", "def e_@n = @s"), ("method", "z_@n", "alias z_@n x")]),
    ]),
    ("rust", ".rs", [
        ("enum E_@n { @T, B_@n(i32), C_@n { x: i32 } }", [
            ("enum", "E_@n", "enum E_@n { @T, B_@n(i32), C_@n { x: i32 } }"), ("struct", "@T", "@T"),
            ("struct", "B_@n", "B_@n(i32)"), ("struct", "C_@n", "C_@n { x: i32 }")]),
        ("pub(crate) async fn @n(\n    a: [u8; 3],\n) -> i32\nwhere\n    T: X,\n{\n    if a { @s } else { 0 }\n} struct S_@n; "
         "macro_rules! m_@n { () => { fn no() {} } }", [
             ("function", "@n", "pub(crate) async fn @n(\n    a: [u8; 3],\n) -> i32\nwhere\n    T: X,\n{\n    if a { @s } else { 0 }\n}"),
             ("struct", "S_@n", "struct S_@n;"), ("macro", "m_@n", "macro_rules! m_@n { () => { fn no() {} } }")]),
        ("/* /* fn no() {} */ fn no2() {} */\ntrait R_@n { fn sig_@n(&self) -> i32; fn b_@n(&self) { let s = r#\"fn q() {}\"#; } }", [
            ("interface", "R_@n", "trait R_@n { fn sig_@n(&self) -> i32; fn b_@n(&self) { let s = r#\"fn q() {}\"#; } }"),
            ("function", "sig_@n", "fn sig_@n(&self) -> i32;"),
            ("function", "b_@n", "fn b_@n(&self) { let s = r#\"fn q() {}\"#; }")]),
    ]),
    ("lua", ".lua", [
        ("function A.@n(x) if x then return @s end end local function l_@n() end", [
            ("function", "@n", "function A.@n(x) if x then return @s end end"), ("function", "l_@n", "local function l_@n() end")]),
        ("M.@n = function(\n    x\n)\n    for i = 1, 2 do x = i end\n    repeat local y until y\n    return function() end\nend", [
            ("function", "@n", "M.@n = function(\n    x\n)\n    for i = 1, 2 do x = i end\n    repeat local y until y\n"
                               "    return function() end\nend")]),
        ("local t_@n = { f = function() return 1 end }\n--[==[ function no() end ]==]\ns = [[ function no() end ]]\n"
         "local @n = function() return @s end", [("function", "@n", "@n = function() return @s end")]),
    ]),
    ("c-sharp", ".cs", [
        ("class @T { void M_@n() {} public uint F_@n() { return new uint(); } }", [
            ("class", "@T", "class @T { void M_@n() {} public uint F_@n() { return new uint(); } }"),
            ("method", "M_@n", "void M_@n() {}"), ("method", "F_@n", "public uint F_@n() { return new uint(); }")]),
        ("[Serializable]\npublic sealed class @T\n    : Base<int>\n{\n    [Test]\n    public (int, int) @n<K>(\n        K a)\n"
         "        where K : class\n    {\n        if (a) { Foo(@s); }\n        return (1, 2);\n    }\n}", [
             ("class", "@T", "[Serializable]\npublic sealed class @T\n    : Base<int>\n{\n    [Test]\n    public (int, int) @n<K>(\n"
                             "        K a)\n        where K : class\n    {\n        if (a) { Foo(@s); }\n        return (1, 2);\n    }\n}"),
             ("method", "@n", "[Test]\n    public (int, int) @n<K>(\n        K a)\n        where K : class\n    {\n"
                              "        if (a) { Foo(@s); }\n        return (1, 2);\n    }")]),
        ("#region public void No() { }\ninterface I_@n { short S_@n(); Dictionary<string, List<int>> D_@n(int x) => null; }", [
            ("interface", "I_@n", "interface I_@n { short S_@n(); Dictionary<string, List<int>> D_@n(int x) => null; }"),
            ("method", "S_@n", "short S_@n();"),
            ("method", "D_@n", "Dictionary<string, List<int>> D_@n(int x) => null;")]),
    ]),
    ("swift", ".swift", [
        ("protocol P_@n { func a_@n() -> Int; func b_@n() }", [
            ("interface", "P_@n", "protocol P_@n { func a_@n() -> Int; func b_@n() }"),
            ("function", "a_@n", "func a_@n() -> Int"), ("function", "b_@n", "func b_@n()")]),
        ("extension @T {\n    static func + (l: Int, r: Int) -> Int { l }\n    @objc(x) public func @n<K>(_ t: K)\n        -> Int\n"
         "        where K: P {\n        return @s\n    }\n}", [
             ("class", "@T", "extension @T {\n    static func + (l: Int, r: Int) -> Int { l }\n    @objc(x) public func @n<K>(_ t: K)\n"
                             "        -> Int\n        where K: P {\n        return @s\n    }\n}"),
             ("function", "@n", "@objc(x) public func @n<K>(_ t: K)\n        -> Int\n        where K: P {\n        return @s\n    }")]),
        ("func @n() { let s = \"func no() {}\" }; struct S_@n { var x: Int }; class C_@n { func m_@n() { class D_@n {} } }", [
            ("function", "@n", "func @n() { let s = \"func no() {}\" }"), ("struct", "S_@n", "struct S_@n { var x: Int }"),
            ("class", "C_@n", "class C_@n { func m_@n() { class D_@n {} } }"),
            ("function", "m_@n", "func m_@n() { class D_@n {} }"), ("class", "D_@n", "class D_@n {}")]),
    ]),
    ("php", ".php", [
        ("<p>it's function no() { </p><?php class @T { function m_@n() { return '}'; } } function g_@n() { return @s; } ?>", [
            ("class", "@T", "class @T { function m_@n() { return '}'; } }"),
            ("function", "m_@n", "function m_@n() { return '}'; }"), ("function", "g_@n", "function g_@n() { return @s; }")]),
        ("<?php\n#[Attr]\nabstract class @T\n{\n    abstract protected function a_@n($x);\n    public static function\n        &b_@n(\n"
         "        $x)\n    {\n        // }\n        return @s;\n    }\n}\n?> don't function no() {}", [
             ("class", "@T", "#[Attr]\nabstract class @T\n{\n    abstract protected function a_@n($x);\n    public static function\n"
                             "        &b_@n(\n        $x)\n    {\n        // }\n        return @s;\n    }\n}"),
             ("function", "a_@n", "abstract protected function a_@n($x);"),
             ("function", "b_@n", "public static function\n        &b_@n(\n        $x)\n    {\n        // }\n        return @s;\n    }")]),
        ("<?php $x = <<<EOT\nfunction no() {}\nEOT;\n$o = new class { public function @n() { return K::class; } }; ?>", [
            ("function", "@n", "public function @n() { return K::class; }")]),
    ]),
    ("dart", ".dart", [
        ("class @T { @T(this.x); int @n({int a = 1}) => a; void v_@n() { foo(@s); } }", [
            ("class", "@T", "class @T { @T(this.x); int @n({int a = 1}) => a; void v_@n() { foo(@s); } }"),
            ("function", "@T", "@T(this.x)"), ("function", "@n", "int @n({int a = 1})"), ("function", "v_@n", "void v_@n()")]),
        ("@override\nMap<String, List<int>> @n(\n  int a, [int b = 2]\n) async {\n  int in_@n(int q) { return q; }\n"
         "  return bar(in_@n(a));\n}", [
             ("function", "@n", "Map<String, List<int>> @n(\n  int a, [int b = 2]\n)"), ("function", "in_@n", "int in_@n(int q)")]),
        ("mixin M_@n {}\nextension X_@n on M_@n { String get g => ''; }\n/* /* void no() {} */ void no2() {} */\n@n() => @s;", [
            ("interface", "M_@n", "mixin M_@n {}"), ("class", "X_@n", "extension X_@n on M_@n { String get g => ''; }"),
            ("function", "@n", "@n()")]),
    ]),
    ("perl", ".t", [
        ("sub @n {@s} sub h_@n {2}", [("function", "@n", "sub @n {@s}"), ("function", "h_@n", "sub h_@n {2}")]),
        ("=pod\n\nsub no { }\n\n=cut\nsub P::@n\n{\n    my $x = $#a; # }\n    return { a => '}' };\n}", [
            ("function", "P::@n", "sub P::@n\n{\n    my $x = $#a; # }\n    return { a => '}' };\n}")]),
        ("print <<\"EOT\";\nsub no {}\nEOT\nsub fwd_@n;\nsub @n { return @s }", [("function", "@n", "sub @n { return @s }")]),
    ]),
    ("r", ".R", [
        ("@n <- function(x) x; k_@n <- function(y) if (y) @s else 2", [
            ("function", "@n", "@n <- function(x) x"), ("function", "k_@n", "k_@n <- function(y) if (y) @s else 2")]),
        ("@n <-\n  function(a,\n           b = function(z) 2) {\n    a # }\n  }\nlapply(v, init = function(x) @s)", [
            ("function", "@n", "@n <-\n  function(a,\n           b = function(z) 2) {\n    a # }\n  }")]),
        ("`q @n` <- \\(x) x +\n  @s\ny$@n <- function() 3\ns_@n = function() \"function\"", [
            ("function", "`q @n`", "`q @n` <- \\(x) x +\n  @s"), ("function", "s_@n", "s_@n = function() \"function\"")]),
    ]),
    ("elixir", ".ex", [
        ("def @n, do: @s; defp h_@n(x), do: x", [
            ("function", "@n", "def @n, do: @s"), ("function", "h_@n", "defp h_@n(x), do: x")]),
        ("@doc \"\"\"\ndef no do\nend\n\"\"\"\ndef @n(\n      a,\n      b\n    ) when a > 0 do\n  f = fn y -> y end\n"
         "  if a do b else f end\nend", [
             ("function", "@n", "def @n(\n      a,\n      b\n    ) when a > 0 do\n  f = fn y -> y end\n  if a do b else f end\nend")]),
        ("defmodule M_@n do\n  defmacro @n(q) do quote do def in_@n(1), do: @s end end\n  def z_@n(x),\n    do: x\nend", [
            ("function", "@n", "defmacro @n(q) do quote do def in_@n(1), do: @s end end"),
            ("function", "in_@n", "def in_@n(1), do: @s"), ("function", "z_@n", "def z_@n(x),\n    do: x")]),
    ]),
    ("erlang", ".erl", [
        ("@f(1) -> \"a.b; \"; @f(2) -> $;.", [("function", "@f", "@f(1) -> \"a.b; \""), ("function", "@f", "@f(2) -> $;")]),
        ("-spec @f(x) -> ok.\n@f(X)\n  when X > 0 ->\n    case X of 1 -> a; 2 -> b end;\n@f(_) ->\n"
         "    F = fun(Y) -> Y; (_) -> 1.5 end,\n    F(@s).", [
             ("interface", "@f", "-spec @f(x) -> ok"),
             ("function", "@f", "@f(X)\n  when X > 0 ->\n    case X of 1 -> a; 2 -> b end"),
             ("function", "@f", "@f(_) ->\n    F = fun(Y) -> Y; (_) -> 1.5 end,\n    F(@s)")]),
        ("-record(r_@f, {a, b = 1}).\n-define(M_@f(X), X). % f(X) -> no.\n@f() -> lists:map(fun g/1, []), ok.", [
            ("struct", "r_@f", "-record(r_@f, {a, b = 1})"), ("macro", "M_@f", "-define(M_@f(X), X)"),
            ("function", "@f", "@f() -> lists:map(fun g/1, []), ok")]),
    ]),
    ("haskell", ".hs", [
        ("data @T = A | B deriving Show\n@f x | x > 0 = 1 | otherwise = @s", [
            ("struct", "@T", "data @T = A | B deriving Show"), ("function", "@f", "@f x | x > 0 = 1 | otherwise = @s")]),
        ("@f :: Int\n  -> Int\n@f x\n  | x > 0 = 1\n  | otherwise = @s", [
            ("function", "@f", "@f :: Int\n  -> Int"), ("function", "@f", "@f x\n  | x > 0 = 1\n  | otherwise = @s")]),
        ("{- {- -} no x = 2 -}\nclass Eq a => C_@f a where\n  m :: a\nnewtype N_@f a = N { un :: a }\nx <+> y = \"no z = 1\"\nk = @s", [
            ("interface", "C_@f", "class Eq a => C_@f a where\n  m :: a"), ("struct", "N_@f", "newtype N_@f a = N { un :: a }")]),
    ]),
    ("scala", ".scala", [
        ("class @T(x: Int) { def f_@n: Int = 1; def g_@n(y: Int): Int = { y } }", [
            ("class", "@T", "class @T(x: Int) { def f_@n: Int = 1; def g_@n(y: Int): Int = { y } }"),
            ("function", "f_@n", "def f_@n: Int = 1"), ("function", "g_@n", "def g_@n(y: Int): Int = { y }")]),
        ("trait R_@n {\n  def no: Int\n  def +(o: Int): Int = o\n  @tailrec private def @n(z: Int)(implicit q: Int => Int): Int =\n"
         "    z +\n      @s\n}", [
             ("interface", "R_@n", "trait R_@n {\n  def no: Int\n  def +(o: Int): Int = o\n"
                                   "  @tailrec private def @n(z: Int)(implicit q: Int => Int): Int =\n    z +\n      @s\n}"),
             ("function", "@n", "@tailrec private def @n(z: Int)(implicit q: Int => Int): Int =\n    z +\n      @s")]),
        ("/* /* def no = 1 */ class No */\ncase class @T(a: Int)\n  extends B\n  with D {\n  val s = \"def no = 1\"\n}", [
            ("class", "@T", "case class @T(a: Int)\n  extends B\n  with D {\n  val s = \"def no = 1\"\n}")]),
    ]),
]

# One row per shape, and one per definition with the text before it.
BODIES = [(b, shape, language, suffix, body) for b, (language, suffix, shapes) in enumerate(TEMPLATES)
          for shape, (body, _) in enumerate(shapes)]
DEFINITIONS = [(b, shape, tag, name, body[:body.index(text)], text) for b, (_, _, shapes) in enumerate(TEMPLATES)
               for shape, (body, found) in enumerate(shapes) for tag, name, text in found]
SHAPES = 3


def sql_values(rows: list[tuple]) -> str:
    def one(value) -> str:
        return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"
    return ",\n".join("(" + ", ".join(map(one, row)) + ")" for row in rows)
