"""Tag extraction, language by language."""

import pytest
from pyspark.sql import functions as F

from stratalens.operators import graph, rank, scopes, tags as tg, text
from stratalens.plans import pipelines
from stratalens.sources.rules import EXTENSION_LANGUAGES, RULES, Rule, read_rules, rules_table

FILES = "repo_id string, path string, content string"

# language: (file name, text, definitions that must be found, references that must be found, names that must not be)
SAMPLES = {
    "python": (
        "a.py",
        'class Foo(Base):\n    """call(x)"""\n    async def go(self):  # nope(1)\n        return run("s(2)") and self.b.stop()\n',
        {("Foo", 0), ("go", 2)},
        {("run", 3), ("stop", 3)},
        {"call", "nope", "s", "Base", "return"},
    ),
    "java": (
        "A.java",
        "public class Foo extends Base implements Runnable, Closeable {\n"
        "    private List<String> names(int n) { return find(n); }\n"
        "    public Foo() { this.x = new Bar(1); }\n"
        "    // gone(1)\n}\ninterface Shape {\n    double area();\n}\n",
        {("Foo", 0), ("names", 1), ("Shape", 5), ("area", 6)},
        {("Base", 0), ("Runnable", 0), ("Closeable", 0), ("find", 1), ("Bar", 2)},
        {"gone", "return"},
    ),
    "go": (
        "a.go",
        "package main\nfunc Add(a int, b int) int { return sum(a, b) }\n"
        "func (s *Server) Run() error {\n\treturn s.loop(`raw(1)`)\n}\ntype Server struct {\n}\n",
        {("Add", 1), ("Run", 2), ("Server", 5)},
        {("sum", 1), ("loop", 3), ("Server", 2), ("Server", 5), ("int", 1), ("error", 2)},
        {"raw", "main"},
    ),
    "c_sharp": (
        "a.cs",
        "namespace App {\npublic class Foo : Base, IThing {\n    public int Run(string s) { return helper.Go(s); }\n"
        "    Widget w = new Widget();\n}\ninterface IThing : IOther { }\nclass Box<T> where T : Item { }\n",
        {("App", 0), ("Foo", 1), ("Run", 2), ("IThing", 5), ("Box", 6)},
        {("Base", 1), ("IThing", 1), ("Go", 2), ("Widget", 3), ("IOther", 5), ("T", 6), ("Item", 6)},
        {"return"},
    ),
    "javascript": (
        "a.js",
        "class Foo {\n  constructor() { init(1); }\n  run(x) {\n    return other.stop(x);\n  }\n}\n"
        "function make() { return new Foo(); }\nconst add = (a, b) => a + b;\nmodule.exports.go = function () {};\n"
        "const o = { pair: () => 1 };\nconst z = require('z');\nif (ready(z)) {}\n",
        {("Foo", 0), ("run", 2), ("make", 6), ("add", 7), ("go", 8), ("pair", 9)},
        {("init", 1), ("stop", 3), ("Foo", 6), ("ready", 11)},
        {"constructor", "require", "if"},
    ),
    "typescript": (
        "a.ts",
        "interface Shape {\n  area(): number;\n}\nabstract class Base {\n  abstract draw(): void;\n}\n"
        "class Foo extends Base {\n  run(s: Shape): Result {\n    return new Runner(s);\n  }\n}\n"
        "function make(x: Thing) {}\ntype Alias = string;\nenum Color { Red }\nmodule Inner {}\n",
        {("Shape", 0), ("area", 1), ("Base", 3), ("draw", 4), ("Foo", 6), ("run", 7), ("make", 11), ("Alias", 12),
         ("Color", 13), ("Inner", 14)},
        {("Shape", 7), ("Result", 7), ("Runner", 8), ("Thing", 11)},
        {"number", "void"},
    ),
    "php": (
        "a.php",
        "<?php\nclass Foo {\n  public function run($x) { return helper($x); }\n}\nfunction make() { return new Foo(1); }\n"
        "$f->go(1); Foo::stop(2); // gone(3)\n",
        {("Foo", 1), ("run", 2), ("make", 4)},
        {("helper", 2), ("Foo", 4), ("go", 5), ("stop", 5)},
        {"gone", "return"},
    ),
    "ruby": (
        "a.rb",
        "module Web\n  class App::Page < Base\n    def self.make(x)\n      x.render!(1) # gone\n    end\n"
        "    alias draw render\n  end\nend\nrequire 'x'\n",
        {("Web", 0), ("Page", 1), ("make", 2), ("draw", 5)},
        {("render!", 3), ("Base", 1), ("x", 3), ("make", 2)},
        {"gone", "require", "end", "self"},
    ),
    "rust": (
        "a.rs",
        "pub struct Foo;\nenum Kind { A }\ntype Id = u32;\ntrait Draw {}\nmod inner {}\nmacro_rules! my { () => {} }\n"
        "impl Draw for Foo {\n    fn draw(&self) { helper(1); self.go(); println!(\"x(1)\"); }\n}\nimpl Foo {\n}\n"
        "fn main() { Foo::assoc(1); }\n",
        {("Foo", 0), ("Kind", 1), ("Id", 2), ("Draw", 3), ("inner", 4), ("my", 5), ("draw", 7), ("main", 11)},
        {("Draw", 6), ("helper", 7), ("go", 7), ("println", 7), ("Foo", 9)},
        {"assoc", "x"},
    ),
    "elixir": (
        "a.ex",
        "defmodule App.Page do\n  alias App.Other\n  def run(x) when x > 1 do\n    x |> clean |> Other.save(1)\n  end\n"
        "  defp zero, do: 1\nend\n",
        {("App.Page", 0), ("run", 2), ("zero", 5)},
        {("App.Other", 1), ("clean", 3), ("save", 3), ("Other", 3), ("defmodule", 0), ("def", 2)},
        set(),
    ),
    "elm": (
        "A.elm",
        "module App.Page exposing (view, Msg)\ntype Msg\n    = Go\n    | Stop Int\nview : Model -> Html\n"
        "view model =\n    div (render model)\nstart = Go\n",
        {("App.Page", 0), ("Msg", 1), ("Go", 2), ("Stop", 3), ("view", 5), ("start", 7)},
        {("view", 0), ("view", 4), ("Model", 4), ("Html", 4), ("div", 6), ("render", 6), ("Go", 7)},
        {"module"},
    ),
    "elisp": (
        "a.el",
        "(defun greet (name)\n  \"say (hi)\" ; (gone)\n  (message name))\n(defsubst two () 2)\n(defmacro twice (x) x)\n",
        {("greet", 0), ("two", 3), ("twice", 4)},
        {("message", 2), ("name", 2)},
        {"gone", "hi", "defun"},
    ),
    "ocaml": (
        "a.ml",
        "module M = struct\n  let add x y = helper x + y\n  let id = fun x -> x\nend\nmodule type S = sig end\n"
        "external now : unit -> float = \"now\"\nlet ( +! ) a b = a\n(* gone x *)\n"
        "class point = object method move d = d end\nlet p = new point\nlet r = M.add 1 2 |> show\nlet q = p#move\n",
        {("M", 0), ("add", 1), ("id", 2), ("S", 4), ("now", 5), ("+!", 6), ("point", 8), ("move", 8)},
        {("helper", 1), ("+", 1), ("point", 9), ("M", 10), ("add", 10), ("show", 10), ("|>", 10), ("move", 11)},
        {"gone"},
    ),
    "ql": (
        "a.ql",
        "module Lib {\n}\nclass Call extends Expr {\n  string getName() { result = this.text() }\n}\n"
        "newtype TNode = TLeaf(int i)\npredicate isBig(Call c) { isLarge(c) }\n",
        {("Lib", 0), ("Call", 2), ("getName", 3), ("TNode", 5), ("TLeaf", 5), ("isBig", 6)},
        {("Expr", 2), ("text", 3), ("Call", 6), ("isLarge", 6)},
        {"result"},
    ),
    "c": (
        "a.c",
        "#include <x.h>\nstruct p { int a; };\nint add(int x, int y);\n/* two\n lines */ static char *name(void) {\n"
        "  return foo(\"bar(1)\");\n}\ntypedef struct p pt;\nenum color { RED };\nunion u { int i; };\n",
        {("p", 1), ("add", 2), ("name", 4), ("pt", 7), ("color", 8), ("u", 9)},
        {("foo", -1), ("p", -1), ("RED", -1)},
        {"bar", "two", "return", "int", "include", "x.h"},
    ),
    "cpp": (
        "a.cpp",
        "class Foo : public Base {\n public:\n  int run(int x);\n};\nint Foo::run(int x) { return x; }\n"
        "enum class Kind { A };\nstruct S { };\ntypedef int number;\n",
        {("Foo", 0), ("run", 2), ("run", 4), ("Kind", 5), ("S", 6), ("number", 7)},
        {("Foo", -1), ("Base", -1), ("x", -1)},
        {"public", "class", "return"},
    ),
}


@pytest.mark.parametrize("lang", SAMPLES)
def test_language(make, lang):
    path, content, defs, refs, absent = SAMPLES[lang]
    tags = tg.tag_files(make([("r", path, content)], FILES)).collect()
    found = {kind: {(t.name, t.line) for t in tags if t.kind == kind} for kind in ("def", "ref")}
    assert defs <= found["def"], defs - found["def"]
    assert {name for name, _ in found["def"]} <= {name for name, _ in defs}
    assert refs <= found["ref"], refs - found["ref"]
    assert not absent & {t.name for t in tags}


def test_every_language_has_rules_and_extensions():
    assert {rule.lang for rule in RULES} == set(EXTENSION_LANGUAGES.values()) == set(SAMPLES)


def test_double_captures(make, rows):
    files = make([("r", "a.ts", "interface Shape {}\n"), ("r", "b.rs", "impl X {\n  fn f() {}\n}\n")], FILES)
    symbols = tg.file_symbols(tg.tag_files(files))
    assert rows(symbols) == [("r", "a.ts", 0, "Shape")] * 2 + [("r", "b.rs", 1, "f")] * 2
    assert rows(tg.definition_tags(tg.tag_files(files))) == [("r", "a.ts", 0, "Shape"), ("r", "b.rs", 1, "f")]


def test_backfill_keeps_duplicates_and_can_be_left_out(make, rows):
    files = make([("r", "p.c", "struct p { int p; };\n")], FILES)
    assert rows(tg.tag_files(files)) == [("r", "p.c", -1, "p", "ref")] * 2 + [("r", "p.c", 0, "p", "def")]
    assert rows(tg.tag_files(files, backfill=False)) == [("r", "p.c", 0, "p", "def")]


def test_files_without_tags(make):
    files = make([("r", "a.py", ""), ("r", "b.txt", "def x():"), ("r", "c", "def x():"), ("r", "d.py", None)], FILES)
    assert tg.tag_files(files).count() == 0


def test_line_breaks_and_long_lines(make, rows):
    files = make([("r", "a.py", "x\r\ndef a(): pass\rdef b(): pass  #" + "y" * 200)], FILES)
    tags = tg.tag_files(files, with_text=True)
    assert [(line, name, len(text)) for _, _, line, name, _, text in rows(tags.where("kind = 'def'"))] == [
        (1, "a", 13),
        (2, "b", 100),
    ]


def test_unclosed_text_does_not_fail(make):
    junk = '"' + "a\\" * 50_000 + "'''" + "/*" * 50_000 + "\u0001" + "(" * 20_000 + "word " * 20_000
    files = make([("r", f"f.{ext}", junk) for ext in EXTENSION_LANGUAGES], FILES)
    assert tg.tag_files(files).count() >= 0


def test_rules_from_a_file(spark, tmp_path, make, rows):
    own = [Rule("note", "def", "title", r"^# (\w+)"), Rule("note", "ref", "link", r"\[(\w+)\]")]
    table = rules_table(spark, [*own, Rule("note", "other", "x", "y")])
    table.write.json(str(tmp_path / "rules"))
    loaded = read_rules(spark, str(tmp_path / "rules"))
    assert sorted(loaded) == sorted(own)
    tags = tg.tag_files(make([("r", "a.note", "# Top\nsee [Top]")], FILES), rules=loaded, extensions={"note": "note"})
    assert rows(tags) == [("r", "a.note", 0, "Top", "def"), ("r", "a.note", 1, "Top", "ref")]


@pytest.fixture
def texts(spark):
    """Few narrow rows that become many texts, as a table or a folder does: of the texts Spark sees the size of the rows only."""
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(400))).alias("k")).select(F.col("k").cast("string"), F.lit("def part{k}():\n    part{k}(make{k})\n").alias("t"))
    path = F.concat(F.lit("src/"), "k", F.lit(".py"))
    return rows.select(F.lit("r").alias("repo_id"), path.alias("path"), F.replace("t", F.lit("{k}"), "k").alias("content"))


def _planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_repository_map_broadcasts_no_tags(spark, texts):
    """A kept table counts with the size it has, and blocks are never taken to be small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "300")
    try:
        pairs = graph.keep_pairs(tg.tag_files(texts))
        assert int(str(pairs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > 1000
        lines = text.repo_map_lines(tg.tag_definitions(texts, with_text=True, with_scopes=True), pairs)
        blocks = text.repo_map_text(lines, pairs.select("repo_id", F.col("path").alias("file")).distinct())
        assert "BroadcastHashJoin" not in _planned(blocks)
        assert blocks.count() == 400
        assert blocks.where("path = 'src/7.py'").first()["text"] == "src/7.py:\ndef part7():"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scopes_broadcast_no_tags(spark, texts):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        found = scopes.tag_scopes(tg.tag_definitions(texts, with_text=True, with_scopes=True))
        assert "BroadcastHashJoin" not in _planned(found)
        assert found.count() == 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ranked_tags_broadcast_no_tags(spark, texts):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "300")
    try:
        pairs = graph.keep_pairs(tg.tag_files(texts))
        ranks = pairs.select("repo_id", F.col("path").alias("file"), F.lit(1.0).alias("rank")).distinct()
        listed = rank.ranked_tags(tg.tag_definitions(texts), pairs, ranks)
        assert "BroadcastHashJoin" not in _planned(listed)
        assert listed.where("ident = 'part7' and line = 0").count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _run_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_definitions_are_found_once(texts):
    """No filter that Spark infers finds them, and what is code, once more."""
    plan = _run_plan(tg.tag_definitions(texts, with_text=True, with_scopes=True))
    assert plan.count("ArrowEvalPython") == 1
    assert plan.count("macro_rules!") == 1


def test_map_reads_texts_once(texts):
    """Definitions come from the kept tags, so what is left to do reads no text."""
    blocks = pipelines.repo_map_blocks(texts)
    assert "ArrowEvalPython" not in _run_plan(blocks)
    assert blocks.count() == 400
    assert blocks.where("path = 'src/7.py'").first()["text"] == "src/7.py:\ndef part7():"


def test_scopes_are_dealt_out_once(texts):
    files = texts.withColumn("repo_id", F.substring("path", 5, 1))  # a constant would not be dealt out by
    plan = _run_plan(scopes.tag_scopes(tg.tag_definitions(files, with_text=True, with_scopes=True)))
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("ArrowEvalPython") == 1


def test_scopes_of_odd_rows(make, rows):
    """Rows of one path meet, exact copies are one, and without a repository no name is found for a head."""
    schema = "repo_id string, path string, line int, name string, kind string, scopes array<struct<line:int,text:string>>"
    inner = lambda text: [(0, text), (1, "if")]
    found = make(
        [
            ("r", "a", 0, "B", "def", []), ("r", "a", 0, "A", "def", []), ("r", "a", 0, "A", "def", []),
            ("r", "a", 2, "f", "def", inner("A B")), ("r", "a", 2, "f", "def", inner("A B")), ("r", "a", 2, "f", "ref", None),
            ("r", "b", 0, "C", "def", []), ("r", "b", 2, "f", "def", inner("C")), ("r", "b", 2, "f", "def", inner("D")),
            (None, "a", 0, "A", "def", []), (None, "a", 2, "f", "def", inner("A")), ("r", "c", 3, "g", "def", None),
        ],
        schema,
    )
    assert rows(scopes.tag_scopes(found)) == [
        (None, "a", 0, "A", 0, [], "A"),
        (None, "a", 2, "f", 2, [0, 1], "f"),
        ("r", "a", 0, "A", 0, [], "A"),
        ("r", "a", 0, "B", 0, [], "B"),
        ("r", "a", 2, "f", 2, [0, 1], "A.f"),
        ("r", "b", 0, "C", 0, [], "C"),
        ("r", "b", 2, "f", 4, [0, 0, 1, 1], "C.C.f"),
        ("r", "c", 3, "g", 0, [], "g"),
    ]
