"""What of a source text is code: comments and literals blanked, brackets paired, enclosing heads of each line.

Comments that nest, raw strings, heredocs, literals with code inside and slashes that may divide or open a pattern need a
state and a depth, which no single regular expression has. So each text goes through one pass of a small state machine per
language, as an Arrow function next to the native expressions that match the rules on its result.

The code that comes out has no blank lines (``numbers`` tells each line's number in the text), and between two tokens at most
one line break and one blank. Marks, which count as white space, stand before an opening parenthesis and tell what follows the
one that closes it: ``\\f`` a body, ``\\x0B`` an arrow, ``\\t`` the end of a signature.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BODY, ARROW, SIGNATURE = "\f", "\x0b", "\t"

SCANNED = "struct<code string, numbers array<int>, heads array<array<int>>, arguments string>"


class Quote(NamedTuple):
    """A literal that may hold code: how it opens, and what matters inside."""

    opens: str
    # Alternatives named esc (passed over), code (code follows, up to a closing brace), end, and eol (ends the literal too).
    inside: str


class Language(NamedTuple):
    notes: tuple[str, ...] = ()  # comments
    literals: tuple[str, ...] = ()
    nested: tuple[str, str, str] | None = None  # comment that nests: opening, closing, what is passed over inside
    quotes: tuple[Quote, ...] = ()
    kept: tuple[str, ...] = ()  # code in which a quote sign is no quote
    patterns: str = ""  # a slash opens one where an operand is expected
    delimited: str = ""  # literal that names its own delimiter in its last character; ``closing`` pairs it
    heredoc: str = ""  # opening; group ``id`` names the line that ends it
    follows: tuple[tuple[str, str], ...] = ()  # mark, and what follows a closing parenthesis
    generics: bool = False  # type arguments are left out of the code
    blocks: str = "{"  # "{", "(" or "indent": what a scope is


_LINE = r"//[^\n]*"
_STAR = r"/\*.*?(?:\*/|\Z)"
_HASH = r"#[^\n]*"
# A literal that is not closed ends with its line.
_QUOTED = r'"(?:[^"\\\n]|\\.)*+"?'
_APOSTROPHED = r"'(?:[^'\\\n]|\\.)*+'?"
_CHARACTER = r"'(?:\\[^\n']+|[^\\'\n])'"
_TRIPLE_QUOTED = r'"""(?:\\.|(?!""").)*+(?:"""|\Z)'
_TRIPLE_APOSTROPHED = r"'''(?:\\.|(?!''').)*+(?:'''|\Z)"
# A literal of several lines; one that is not closed ends with its line.
_QUOTED_LINES = r'"(?:[^"\\]|\\.)*+"|"[^\n]*'
_APOSTROPHED_LINES = r"'(?:[^'\\]|\\.)*+'|'[^\n]*"
_DIRECTIVE = r"^[ \t]*\#(?:[^\n\\]|\\.)*"
_JS_PATTERN = r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[A-Za-z]*"
_RUBY_PATTERN = r"/(?:[^\\/\n]|\\.)*+/[a-z]*"

_JS = {
    "notes": (_LINE, _STAR),
    "literals": (_QUOTED, _APOSTROPHED),
    "quotes": (Quote("`", r"(?P<esc>\\.)|(?P<code>\$\{)|(?P<end>`)"),),
    "patterns": _JS_PATTERN,
}
_C = {"notes": (_DIRECTIVE, _LINE, _STAR), "literals": (_QUOTED, _CHARACTER)}


def _python_quotes() -> tuple[Quote, ...]:
    """f-strings, whose braces hold code."""
    found = []
    for sign in ('"""', "'''", '"', "'"):
        eol = "" if len(sign) == 3 else r"|(?P<eol>\n)"
        found.append(Quote(rf"(?<!\w)(?i:f|rf|fr){sign}", rf"(?P<esc>\\.|\{{\{{)|(?P<code>\{{)|(?P<end>{sign}){eol}"))
    return tuple(found)


def _hash_brace(opens: str, end: str) -> Quote:
    return Quote(opens, rf"(?P<esc>\\.)|(?P<code>\#\{{)|(?P<end>{end})")


LANGUAGES: dict[str, Language] = {
    "c": Language(**_C),
    "cpp": Language(
        notes=_C["notes"],
        literals=(r'\b(?:u8|[uUL])?R"(?P<raw>[^()\\\s]*)\(.*?(?:\)(?P=raw)"|\Z)', _QUOTED, _CHARACTER),
        kept=(r"\b\d[\w']*",),
        follows=(
            (
                BODY,
                r"\s*(?:(?:const|noexcept|override|final|volatile|try)\b\s*|&+\s*)*(?:->[^;{}()]*)?(?::[^:;{}][^;{}]*)?\{",
            ),
        ),
    ),
    "c_sharp": Language(
        notes=(r"^[ \t]*\#[^\n]*", _LINE, _STAR),
        literals=(r'(?P<fence>"{3,}).*?(?:(?P=fence)|\Z)', r'@"(?:[^"]|"")*+"?', _QUOTED, _CHARACTER),
        quotes=(
            Quote(r'(?:\$@|@\$)"', r'(?P<esc>""|\{\{)|(?P<code>\{)|(?P<end>")'),
            Quote(r'\$"', r'(?P<esc>\\.|\{\{)|(?P<code>\{)|(?P<end>")|(?P<eol>\n)'),
        ),
        generics=True,
    ),
    "elisp": Language(notes=(r";[^\n]*",), literals=(r"\?\\?[\";'()\[\]]", _QUOTED_LINES), blocks="("),
    "elixir": Language(
        notes=(_HASH,),
        literals=(r"\?\\?[\"'\#]", _TRIPLE_APOSTROPHED, _APOSTROPHED),
        quotes=(_hash_brace('"""', '"""'), _hash_brace('"', '"')),
        delimited=r"~[a-zA-Z]+(?:\"\"\"|'''|[(\[{<|/\"'])",
        blocks="indent",
    ),
    "elm": Language(
        notes=(r"--[^\n]*",),
        nested=(r"\{-", r"-\}", r"(?!)"),
        literals=(_TRIPLE_QUOTED, _QUOTED, _CHARACTER),
        blocks="indent",
    ),
    "go": Language(notes=(_LINE, _STAR), literals=(r"`[^`]*+`?", _QUOTED, _CHARACTER)),
    "java": Language(notes=(_LINE, _STAR), literals=(_TRIPLE_QUOTED, _QUOTED, _CHARACTER), generics=True),
    "javascript": Language(**_JS, follows=((ARROW, r"\s*=>"), (BODY, r"\s*\{"))),
    "ocaml": Language(
        nested=(r"\(\*", r"\*\)", r'"(?:[^"\\]|\\.)*+"|\{(?P<qi>[a-z_]*)\|.*?\|(?P=qi)\}|\'"\''),
        literals=(r"\{(?P<qs>[a-z_]*)\|.*?(?:\|(?P=qs)\}|\Z)", _QUOTED_LINES, _CHARACTER),
        blocks="indent",
    ),
    "php": Language(
        # Text outside the tags is no code.
        notes=(r"\?>.*?(?:<\?(?:php\b|=)?|\Z)", _LINE, _STAR, r"\#(?!\[)[^\n]*"),
        literals=(_QUOTED_LINES, _APOSTROPHED_LINES, r"`[^`]*+`?"),
        heredoc=r"<<<[ \t]*(?P<sign>[\"']?)(?P<id>[A-Za-z_]\w*)(?P=sign)",
    ),
    "python": Language(
        notes=(_HASH,),
        literals=(_TRIPLE_QUOTED, _TRIPLE_APOSTROPHED, _QUOTED, _APOSTROPHED),
        quotes=_python_quotes(),
        blocks="indent",
    ),
    "ql": Language(notes=(_LINE, _STAR), literals=(_QUOTED,), follows=((BODY, r"\s*[{;]"),)),
    "ruby": Language(
        notes=(r"^=begin\b.*?(?:^=end\b[^\n]*|\Z)", r"^__END__\n.*", _HASH),
        literals=(r"(?<![\w)\]}])\?[\"'\#/](?!\w)", _APOSTROPHED_LINES),
        quotes=(_hash_brace('"', '"'), _hash_brace("`", "`")),
        patterns=_RUBY_PATTERN,
        delimited=r"%[qQwWiIrsx]?[(\[{<|!/]",
        heredoc=r"<<(?:[~-](?P<sign>[\"'`]?)(?P<id>[A-Za-z_]\w*)(?P=sign)|(?<=[\s(,=]<<)(?P<bare>[A-Z][A-Z0-9_]*)\b)",
        blocks="indent",
    ),
    "rust": Language(
        notes=(_LINE,),
        nested=(r"/\*", r"\*/", r"(?!)"),
        literals=(r'\b[bc]?r(?P<hashes>\#*)".*?(?:"(?P=hashes)|\Z)', _QUOTED_LINES, _CHARACTER),
        follows=((BODY, r"\s*(?:->(?:\[[^\]]*\]|[^;{}\[])*)?(?:\bwhere\b[^;{}]*)?\{"),),
        generics=True,
    ),
    "typescript": Language(
        **_JS,
        follows=(
            (ARROW, r"\s*(?::[^=;{}()]*)?=>"),
            (BODY, r"\s*(?::[^=;{}()]*(?:\{[^{}]*\}[^=;{}()]*)?)?\{"),
            (SIGNATURE, r"\s*:[^={}()]*?;"),
        ),
        generics=True,
    ),
}

_CLOSING = {"(": ")", "[": "]", "{": "}", "<": ">"}
# What an operand follows: a sign, or one of these words. After a name, a number or a closing bracket a slash divides.
_OPERATORS = frozenset("(,=:[!&|?{};+-*%<>~^")
_WORDS_BEFORE_OPERANDS = frozenset(
    "return typeof case in of delete void throw new else do yield await instanceof if unless while until and or not when then"
    " elsif puts raise".split()
)


class Machine(NamedTuple):
    language: Language
    code: re.Pattern  # what ends a stretch of code, by kind
    inside: tuple[re.Pattern, ...]  # of each quote
    nested: re.Pattern | None


def _group(kind: str, parts: tuple[str, ...]) -> list[str]:
    return [f"(?P<{kind}>{'|'.join(parts)})"] if parts else []


@lru_cache(maxsize=None)
def machine(lang: str) -> Machine:
    language = LANGUAGES[lang]
    flags = re.DOTALL | re.MULTILINE
    kinds = _group("note", language.notes)
    if language.nested:
        kinds += _group("nest", (language.nested[0],))
    kinds += [f"(?P<quote{i}>{q.opens})" for i, q in enumerate(language.quotes)]
    if language.heredoc:
        kinds += [f"(?P<heredoc>{language.heredoc})", r"(?P<eol>\n)"]
    if language.delimited:
        kinds += _group("delimited", (language.delimited,))
    kinds += _group("literal", language.literals) + _group("kept", language.kept)
    if language.patterns:
        kinds.append("(?P<slash>/)")
    if language.quotes:
        kinds.append(r"(?P<brace>[{}])")
    nested = None
    if language.nested:
        opens, closes, passed = language.nested
        nested = re.compile(f"(?P<pass>{passed})|(?P<open>{opens})|(?P<close>{closes})", flags)
    return Machine(language, re.compile("|".join(kinds), flags), tuple(re.compile(q.inside, flags) for q in language.quotes), nested)


def _blank(skipped: str) -> str:
    return " " + "\n" * skipped.count("\n")


def _operand_expected(before: str) -> bool:
    """Whether an operand, not an operator, comes after the code ``before``."""
    if not before or before[-1] in _OPERATORS:
        return True
    word = re.search(r"\w+\Z", before[-20:])  # longer than any of the words
    return bool(word) and word.group() in _WORDS_BEFORE_OPERANDS


def _delimited_end(text: str, start: int, opening: str) -> int:
    """End of a literal whose delimiter stands before ``start``; brackets of its own kind nest."""
    closing = _CLOSING.get(opening, opening)
    depth = 1
    signs = re.compile(rf"\\.|{re.escape(opening)}|{re.escape(closing)}", re.DOTALL)
    for m in signs.finditer(text, start):
        if m.group() == closing:
            depth -= 1
        elif m.group() == opening:
            depth += 1
        if not depth:
            return m.end()
    return len(text)


def _nested_end(pattern: re.Pattern, text: str, start: int) -> int:
    depth = 1
    for m in pattern.finditer(text, start):
        depth += (m.lastgroup == "open") - (m.lastgroup == "close")
        if not depth:
            return m.end()
    return len(text)


def blank_literals(text: str, lang: str) -> str:
    """``text`` with each comment and literal as a blank and the line breaks it held. Code inside literals stays, in brackets."""
    tool = machine(lang)
    language, n = tool.language, len(text)
    out: list[str] = []
    before = ""  # the last stretch of code that is not blank
    pos = depth = 0
    open_quotes: list[tuple[int, int]] = []  # literals around the code: number of the quote, depth of braces outside
    pending: list[str] = []  # heredocs whose text starts on the next line
    quote = -1
    if lang == "php" and "<?" in text:
        pos = re.search(r"<\?(?:php\b|=)?", text).end()
        out.append(_blank(text[:pos]))
    while pos < n:
        if quote >= 0:  # inside a literal
            m = tool.inside[quote].search(text, pos)
            while m and m.lastgroup == "esc":
                m = tool.inside[quote].search(text, m.end())
            end = n if m is None else m.start() if m.lastgroup == "eol" else m.end()
            out.append(_blank(text[pos:end]))
            pos, before = end, '"'
            if m and m.lastgroup == "code":
                out.append("[")
                open_quotes.append((quote, depth))
                depth, before = 0, "["
            quote = -1
            continue
        m = tool.code.search(text, pos)
        stretch = text[pos : m.start() if m else n]
        if stretch:
            out.append(stretch)
            if not stretch.isspace():
                before = stretch.rstrip()
        if m is None:
            break
        kind, found, pos = m.lastgroup, m.group(), m.end()
        if kind == "note":
            out.append(_blank(found))
        elif kind == "nest":
            end = _nested_end(tool.nested, text, pos)
            out.append(_blank(text[m.start() : end]))
            pos = end
        elif kind == "literal":
            out.append(_blank(found))
            before = '"'
        elif kind == "kept":
            out.append(found)
            before = found
        elif kind == "slash":
            pattern = re.compile(language.patterns, re.DOTALL).match(text, m.start()) if _operand_expected(before) else None
            out.append(_blank(pattern.group()) if pattern else found)
            pos, before = (pattern.end(), '"') if pattern else (pos, found)
        elif kind == "delimited":
            # A sign and a bracket alone may be a remainder; with a letter between them it is a literal.
            if len(found) > 2 or _operand_expected(before):
                opening = found[-3:] if found[-3:] in ('"""', "'''") else found[-1]
                end = _delimited_end(text, pos, opening)
                out.append(_blank(text[m.start() : end]))
                pos, before = end, '"'
            else:
                out.append(found[:1])
                pos, before = m.start() + 1, found[:1]
        elif kind == "heredoc":
            pending.append(m.group("id") or m.groupdict().get("bare") or "")
            out.append(" ")
            before = '"'
        elif kind == "eol":
            out.append("\n")
            for name in pending:
                close = re.compile(rf"^[ \t]*{re.escape(name)}\b", re.MULTILINE).search(text, pos)
                end = close.end() if close else n
                out.append(_blank(text[pos:end]))
                pos = end
            pending = []
        elif kind == "brace":
            if found == "}" and open_quotes and not depth:
                quote, depth = open_quotes.pop()
                out.append("]")
            else:
                depth += 1 if found == "{" else -1 if depth else 0
                out.append(found)
                before = found
        else:  # a quote opens
            quote = int(kind.removeprefix("quote"))
    return "".join(out)


_BRACKETS = re.compile(r"[()\[\]{};]")
_IN_ARGUMENTS = re.compile(r"[<>]|&&|\|\||=>?|[^\w\s,.?&|:'\[\]$*@]")
_PAIRS = {")": "(", "]": "[", "}": "{"}


def type_arguments(code: str) -> list[tuple[int, int]]:
    """Ranges inside the outermost angle brackets that enclose nothing but types. One pass, whatever is left open."""
    opened: list[int] = []
    closed: list[tuple[int, int]] = []
    pos = code.find("<")
    while pos >= 0:
        sign = code[pos]
        if sign == "<":
            if pos and (code[pos - 1].isalnum() or code[pos - 1] in "_$ \n"):
                opened.append(pos + 1)
        elif sign == ">":
            closed.append((opened.pop(), pos))
        else:
            opened.clear()
        # Where nothing is open, only an opening one matters.
        found = _IN_ARGUMENTS.search(code, pos + 1) if opened else None
        pos = found.start() if found else -1 if opened else code.find("<", pos + 1)
    ranges: list[tuple[int, int]] = []
    for start, end in sorted(closed):
        if not ranges or start > ranges[-1][1]:
            ranges.append((start, end))
    return ranges


def _number(numbers: list[int], starts: list[int], pos: int) -> int:
    return numbers[bisect_right(starts, pos) - 1]


def pair_brackets(code: str, language: Language, numbers: list[int], starts: list[int], scopes: bool):
    """Marks by position, and the enclosing heads of each line."""
    follows = [(mark, re.compile(pattern)) for mark, pattern in language.follows]
    marks: dict[int, str] = {}
    stack: list[tuple[str, int]] = []
    heads: list[tuple[int, ...]] = [()]  # of the code at hand, one entry more for each open block
    lines: list[tuple[int, ...]] = []
    boundary = 0
    upcoming = starts[0] if starts else len(code)  # the line after the last of ``lines``
    first_sign = re.compile(r"\S")
    for m in _BRACKETS.finditer(code):
        sign, pos = m.group(), m.start()
        while upcoming <= pos:
            lines.append(heads[-1])
            upcoming = starts[len(lines)] if len(lines) < len(starts) else len(code)
        if sign in "([{":
            stack.append((sign, pos))
            if sign == language.blocks:
                at = pos if sign == "(" else first_sign.search(code, boundary).start()
                line = numbers[len(lines) - 1] if at >= starts[len(lines) - 1] else _number(numbers, starts, at)
                heads.append(heads[-1] if heads[-1][-1:] == (line,) else heads[-1] + (line,))
            if sign == "{":
                boundary = pos + 1
        elif sign == ";":
            if not stack or stack[-1][0] == "{":
                boundary = pos + 1
        elif stack and stack[-1][0] == _PAIRS[sign]:
            _, opened = stack.pop()
            if _PAIRS[sign] == language.blocks and len(heads) > 1:
                heads.pop()
            if sign == "}":
                boundary = pos + 1
            elif sign == ")":
                for mark, pattern in follows:
                    if pattern.match(code, pos + 1):
                        marks[opened] = mark
                        break
    lines += [heads[-1]] * (len(starts) - len(lines))
    return marks, lines


def indent_heads(lines: list[str], numbers: list[int]) -> list[tuple[int, ...]]:
    """For each line the lines above it that are less and less indented. Lines that begin inside or with brackets are no heads
    (code in a literal stands in brackets)."""
    open_heads: list[tuple[int, int]] = []
    found = []
    depth = 0
    for line, number in zip(lines, numbers):
        bare = line.lstrip()
        starts = not depth and not bare.startswith("[")
        if starts:
            indent = len(line) - len(bare)
            while open_heads and open_heads[-1][0] >= indent:
                open_heads.pop()
        found.append(tuple(head for _, head in open_heads))
        if starts:
            open_heads.append((indent, number))
        depth = max(0, depth + sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}"))
    return found


def scan(text: str, lang: str, scopes: bool = False) -> tuple[str, list[int], list[tuple[int, ...]] | None, str]:
    """Code, the number of each of its lines, the heads that enclose each line, and the type arguments left out."""
    language = LANGUAGES[lang]
    plain = blank_literals(text, lang).split("\n")
    numbers = [i for i, line in enumerate(plain) if line and not line.isspace()]
    shown = [plain[i].expandtabs(8) for i in numbers]
    # Blanks between tokens are one; an indent is one.
    squeezed = [(" " if line[0].isspace() else "") + " ".join(line.split()) for line in shown]
    code = "\n".join(squeezed)
    starts, at = [], 0
    for line in squeezed:
        starts.append(at)
        at += len(line) + 1
    heads = None
    removed = ""
    braces = language.blocks != "indent"
    if language.follows or language.generics or (scopes and braces):
        marks, heads = pair_brackets(code, language, numbers, starts, scopes and braces)
        arguments = type_arguments(code) if language.generics else []
        edits = sorted([(p, p, mark) for p, mark in marks.items()] + [(a, b, "\n" * code.count("\n", a, b)) for a, b in arguments])
        pieces, last = [], 0
        for a, b, put in edits:
            if a < last:
                continue
            pieces += [code[last:a], put]
            last = b
        removed = " ".join(code[a:b] for a, b in arguments)
        code = "".join([*pieces, code[last:]])
    if scopes and not braces:
        heads = indent_heads(shown, numbers)
    if not scopes:
        heads = None
    else:
        heads = [tuple(h for h in line if h != number) if number in line else line for line, number in zip(heads, numbers)]
    return code, numbers, heads, removed


def scanned(content: Column, lang: Column, scopes: bool = False) -> Column:
    """``scan`` of each text, as ``SCANNED``; a language without a machine gives null."""

    @F.arrow_udf(SCANNED)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        fields = [
            pa.field("code", pa.string()),
            pa.field("numbers", pa.list_(pa.int32())),
            pa.field("heads", pa.list_(pa.list_(pa.int32()))),
            pa.field("arguments", pa.string()),
        ]
        for texts, langs in batches:
            rows = [
                scan(text, name, scopes) if name in LANGUAGES and text is not None else (None,) * 4
                for text, name in zip(texts.to_pylist(), langs.to_pylist())
            ]
            columns = [pa.array([row[i] for row in rows], f.type) for i, f in enumerate(fields)]
            yield pa.StructArray.from_arrays(columns, fields=fields)

    return run(content, lang)
