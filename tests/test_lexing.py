"""Comments and literals, bracket marks, enclosing heads, and rules on whole texts."""

import time

import pytest
from pyspark.sql import functions as F

from stratalens.operators import scopes, tags as tg, text
from stratalens.operators.graph import tag_pairs
from stratalens.plans.samples import SAMPLES
from stratalens.sources import lexing
from stratalens.sources.rules import RULES, Rule, first_sign, guarded, marking

FILES = "repo_id string, path string, content string"


@pytest.mark.parametrize(
    "lang,text,code",
    [
        ("ocaml", 'a (* b (* c *) "*)" d *) e', "a e"),
        ("ocaml", "a {x|(* |} |x} b", "a b"),
        ("elm", "a {- b {- c -} d -} e", "a e"),
        ("rust", 'a r#"b "c" d"# e /* f /* g */ h */ i', "a e i"),
        ("rust", "fn f<'a>(x: &'a str) -> char { 'x' }", "fn f<>(x: &'a str) -> char { }"),
        ("javascript", "a = /'/; b", "a = ; b"),
        ("javascript", "a / b / c", "a / b / c"),
        ("javascript", "return /[/\"]/g.test(a)", "return .test(a)"),
        ("javascript", "`a ${ b(`c ${d} e`) } f` + g", "[ b( [d] ) ] + g"),
        ("javascript", "`a ${ {b: 1} } c`", "[ {b: 1} ]"),
        ("javascript", "'a\\' b' + c", "+ c"),
        ("python", "f'a {b('c')} {{d}}' + e", "[b( )] + e"),
        ("python", "x = 'a' 'b' # c\ny", "x =\ny"),
        ("python", '"""a\n\'\'\'b""" c', "c"),
        ("ruby", "a = <<~X + <<-'Y' + b\n c\n X\n d\n  Y\ne", "a = + + b\ne"),
        ("ruby", "a = %w[b [c] d] + e % f", "a = + e % f"),
        ("ruby", '"a #{b ? "c" : d} e" + f', "[b ? : d] + f"),
        ("ruby", "a = b / c / d", "a = b / c / d"),
        ("ruby", "a if b =~ /c'd/i && e", "a if b =~ && e"),
        ("php", "a <?php b // c\n?> d <?= e", "b\n e"),
        ("php", "<?php a <<<'X'\n b\n X; c", "a\n; c"),
        ("elixir", 'a ~s(b ") <> "c #{d("e")}" # f', "a <> [d( )]"),
        ("c_sharp", '$"a {b("c")} {{d}}" + @"e""f\\" + g', "[b( )] + + g"),
        ("c_sharp", '"""a "b" c""" + d', "+ d"),
        ("cpp", 'R"x(a )" b)x" + 1\'000 + \'c\' + d', "+ 1'000 + + d"),
        ("c", "#define A(x) \\\n  b(x)\nc", "c"),
        ("elisp", '(a ?" ?\\( "b ; c" ; d\n e)', "(a\n e)"),
        ("go", 'a `b\n"c` d', "a\n d"),
        ("java", 'a """b\n" c""" d', "a\n d"),
    ],
)
def test_code_without_literals(lang, text, code):
    assert lexing.scan(text, lang)[0].replace("\f", "").replace("\t", "").replace("\x0b", "").strip() == code


def test_unclosed_literals_and_brackets_end():
    for lang in lexing.LANGUAGES:
        for junk in ('"', "'", "`", "/*", "(*", "{-", '"""', "<<~X\n", "`${", '"#{', "f'{", "~s(", "%w[", "<?php <<<X\n", "r#\"", "(", "}", "<" * 50, ""):
            code, numbers, heads, _ = lexing.scan(f"a\n{junk} b\nc", lang, True)
            assert len(numbers) == len(heads) == (len(code.split("\n")) if code else 0)


def test_numbers_of_lines():
    code, numbers, _, _ = lexing.scan("\n\na\n\n# c\nb '''x\n\n''' c\n\n", "python")
    assert (code, numbers) == ("a\nb\n c", [2, 5, 7])


def test_marks_and_type_arguments():
    code, _, _, removed = lexing.scan("f(a, g(b)) {\n(x) => 1\nh(c);", "javascript")
    assert code == "f\f(a, g(b)) {\n\x0b(x) => 1\nh(c);"
    code, numbers, _, removed = lexing.scan("Map<A,\n List<B<C>>> x = a < b && c > d;", "java")
    assert (code, numbers) == ("Map<\n> x = a < b && c > d;", [0, 1]) and removed.split() == ["A,", "List<B<C>>"]
    assert lexing.scan("for (i = 0; i < n; i++) { a > b }", "java")[0] == "for (i = 0; i < n; i++) { a > b }"


def test_heads():
    java = "class A\n  extends B\n{\n  void f(\n    int x)\n  {\n    if (x) {\n      g();\n    }\n  }\n}\nclass C {}"
    heads = lexing.scan(java, "java", True)[2]
    assert [list(h) for h in heads] == [[], [], [], [0], [0], [0], [0, 3], [0, 3, 6], [0, 3, 6], [0, 3], [0], []]
    python = "class A:\n  x = [\n1, 2]\n\n  def f(self):\n    return 1\ny = 1"
    _, numbers, heads, _ = lexing.scan(python, "python", True)
    assert [(n, list(h)) for n, h in zip(numbers, heads)] == [(0, []), (1, [0]), (2, [0, 1]), (4, [0]), (5, [0, 4]), (6, [])]


def test_marking():
    assert marking("a(b)c") == "(?md)(?<skip>)(?<before>a)(?<name>b)(?<after>c)(?<pass>)"
    assert marking("(?i)x|y([)|]z)|w") == "(?md)(?i)(?<skip>x)|(?<before>y)(?<name>[)|]z)(?<after>)|(?<pass>w)"
    for wrong in ("(?:(a)|b)", "ab", r"(a)\1"):
        with pytest.raises(ValueError):
            marking(wrong)
    for rule in RULES:
        marking(rule.pattern)


def test_first_sign():
    assert first_sign(r"\bstruct\s+(\w+)") == r"(?=[\x{73}])"
    assert first_sign(r"^\s*(?:pub\s+)?(fn)") == r"^(?=[\s\x{66}\x{70}])"
    assert first_sign(r"(?:\bnew\s+|(?!^)\G\s*,)([^\s(]+)") == r"(?=[\s\x{2c}\x{6e}])"
    # What can be empty, begins with anything, or is read otherwise by Java, has none.
    for other in (r"(a*)", r".(a)", r"\p{L}(a)", r"[a[bc]](d)", r"(?i)a(b)", r"\Qa\E(b)", r"\h(a)", r"\\G(?<n>a)(", r"[a&&b](c)"):
        assert first_sign(other) == "", other


def test_first_sign_changes_no_match(make):
    """All rules on all samples, cut anywhere: the test of the first sign leaves what is set off as it is."""
    texts = [(lang, lexing.scan(s.text.replace("{k}", "7")[at:], lang)[0]) for lang, s in SAMPLES.items() for at in (0, 40, 111)]
    off = F.lit("${skip}${before}<${name}>${after}${pass}")
    both = [(r.lang, F.regexp_replace("code", F.lit(marking(r.pattern)), off), F.regexp_replace("code", F.lit(guarded(r.pattern)), off)) for r in RULES]
    table = make(texts, "lang string, code string")
    for lang in SAMPLES:
        same = [plain.eqNullSafe(tested) for name, plain, tested in both if name == lang]
        assert table.where(F.col("lang") == lang).where(~F.forall(F.array(*same), lambda x: x)).count() == 0, lang


def test_own_rules_on_whole_texts(make, rows):
    own = [Rule("note", "def", "head", r"^#\s+(\w+)$"), Rule("note", "ref", "link", r"!\[\w+\]|\[\s*(\w+)\s*\]"), Rule("note", "ref", "word", "(none)")]
    files = make([("r", "a.note", "# One\n#\n\nTwo\n[ One\n] ![No] [\nTwo ] \u0001\u0002")], FILES)
    tags = tg.tag_files(files, rules=own, extensions={"note": "note"})
    assert rows(tags) == [
        ("r", "a.note", 0, "One", "def"), ("r", "a.note", 3, "Two", "def"), ("r", "a.note", 4, "One", "ref"), ("r", "a.note", 6, "Two", "ref"),
    ]


def test_scopes_and_map(make, rows):
    source = "class A:\n  def f(self):\n    def g(): pass\n    return g()\n  def h(self): return f()\n"
    files = make([("r", "a.py", source), ("r", "b.py", "def k(): h(1)\n")], FILES)
    definitions = tg.tag_definitions(files, with_text=True, with_scopes=True)
    assert rows(scopes.tag_scopes(definitions)) == [
        ("r", "a.py", 0, "A", 0, [], "A"),
        ("r", "a.py", 1, "f", 1, [0], "A.f"),
        ("r", "a.py", 2, "g", 2, [0, 1], "A.f.g"),
        ("r", "a.py", 4, "h", 1, [0], "A.h"),
        ("r", "b.py", 0, "k", 0, [], "k"),
    ]
    lines = text.repo_map_lines(definitions, tag_pairs(tg.tag_files(files)))
    assert [(path, line) for _, path, line, _ in rows(lines)] == [("a.py", 0), ("a.py", 1), ("a.py", 2), ("a.py", 4)]


def test_long_texts_of_words(make):
    """No rule takes quadratic time or a deep stack on many lines without a sign."""
    texts = [("r", f"f.{s.extension}", "word another Thing\n " * 10_000 + "A,\n" * 10_000 + "a <\n" * 5_000) for s in SAMPLES.values()]
    start = time.time()
    assert tg.tag_files(make(texts, FILES)).count() > 0
    assert time.time() - start < 90


def test_languages_have_samples():
    assert set(SAMPLES) == set(lexing.LANGUAGES) == {rule.lang for rule in RULES}
