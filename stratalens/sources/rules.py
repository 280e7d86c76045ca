"""Capture rules: which text of a line defines or refers to a name, per language.

The rules are data. A user may pass other rows (``Rule`` tuples, or a table read with ``read_rules``) to the
tag operators. A pattern is a Java regular expression whose first group is the name; the group must stand at the top level of
the pattern or of one of its alternatives. It is applied to the whole code of a file (see ``lexing``), with ``^`` and ``$`` at
every line, so a head may span lines. Between two tokens of the code there is at most one line break and one blank: a test of
what stands before a name may take white space to be one or two characters. An alternative without a group passes text over.
"""

from __future__ import annotations

import re
from re import _parser
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EXTENSIONS, RULES as RULES_SCHEMA


class Rule(NamedTuple):
    lang: str
    kind: str  # "def" or "ref"
    category: str
    pattern: str


# Token used to fill in references for a file whose rules found definitions only.
IDENTIFIER = r"[A-Za-z_]\w*"

# File extension to language.
EXTENSION_LANGUAGES = {
    "c": "c",
    "h": "c",
    "cc": "cpp",
    "cpp": "cpp",
    "cxx": "cpp",
    "hh": "cpp",
    "hpp": "cpp",
    "hxx": "cpp",
    "cs": "c_sharp",
    "el": "elisp",
    "elm": "elm",
    "ex": "elixir",
    "exs": "elixir",
    "go": "go",
    "java": "java",
    "js": "javascript",
    "jsx": "javascript",
    "mjs": "javascript",
    "ml": "ocaml",
    "mli": "ocaml",
    "php": "php",
    "py": "python",
    "ql": "ql",
    "qll": "ql",
    "rb": "ruby",
    "rs": "rust",
    "ts": "typescript",
    "tsx": "typescript",
}

# Reserved words of a language, which are not identifiers.
KEYWORDS = {
    "c": (
        "auto break case char const continue default do double else enum extern float for goto if inline int "
        "long register restrict return short signed sizeof static struct switch typedef union unsigned void "
        "volatile while"
    ).split(),
    "cpp": (
        "alignas alignof and asm auto bool break case catch char class const constexpr const_cast continue "
        "decltype default delete do double dynamic_cast else enum explicit export extern false float for friend "
        "goto if inline int long mutable namespace new noexcept not nullptr operator or private protected public "
        "register reinterpret_cast return short signed sizeof static static_assert static_cast struct switch "
        "template this thread_local throw true try typedef typeid typename union unsigned using virtual void "
        "volatile wchar_t while xor"
    ).split(),
    "c_sharp": (
        "abstract as base bool break byte case catch char checked class const continue decimal default delegate do "
        "double else enum event explicit extern false finally fixed float for foreach goto if implicit in int "
        "interface internal is lock long namespace new null object operator out override params private protected "
        "public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw "
        "true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while"
    ).split(),
    "elisp": [],
    "elm": "alias as case else exposing if import in let module of port then type where".split(),
    "elixir": "after and catch do else end false fn in nil not or rescue true when".split(),
    "go": (
        "break case chan const continue default defer else fallthrough for func go goto if import interface map "
        "package range return select struct switch type var"
    ).split(),
    "java": (
        "abstract assert boolean break byte case catch char class const continue default do double else enum "
        "extends final finally float for goto if implements import instanceof int interface long native new package "
        "private protected public return short static strictfp super switch synchronized this throw throws "
        "transient try void volatile while"
    ).split(),
    "javascript": (
        "async await break case catch class const continue debugger default delete do else export extends finally "
        "for function if import in instanceof let new of return static super switch this throw try typeof var void "
        "while with yield"
    ).split(),
    "ocaml": (
        "and as assert begin class constraint do done downto else end exception external false for fun function "
        "functor if in include inherit initializer lazy let match method module mutable new nonrec object of open "
        "or private rec sig struct then to true try type val virtual when while with"
    ).split(),
    "php": (
        "abstract and array as break callable case catch class clone const continue declare default die do echo "
        "else elseif empty enddeclare endfor endforeach endif endswitch endwhile exit extends final finally fn for "
        "foreach function global goto if implements include include_once instanceof insteadof interface isset list "
        "match namespace new or print private protected public require require_once return static switch throw "
        "trait try unset use var while xor yield"
    ).split(),
    "python": (
        "False None True and as assert async await break class continue def del elif else except finally for from "
        "global if import in is lambda nonlocal not or pass raise return try while with yield"
    ).split(),
    "ql": (
        "and any as asc avg by class concat count desc else exists extends false forall forex from if implies "
        "import in instanceof max min module newtype none not or order predicate rank result select strictconcat "
        "strictcount strictsum sum super then this true where"
    ).split(),
    "ruby": (
        "BEGIN END alias and begin break case class def defined? do else elsif end ensure false for if in module "
        "next nil not or redo rescue retry return self super then true undef unless until when while yield"
    ).split(),
    "rust": (
        "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod "
        "move mut pub ref return self Self static struct super trait true type unsafe use where while"
    ).split(),
    "typescript": (
        "abstract any as async await boolean break case catch class const continue declare default delete do else "
        "enum export extends finally for from function get if implements import in instanceof interface keyof let "
        "module namespace never new null number object of private protected public readonly return set static "
        "string super switch symbol this throw try type typeof undefined unknown var void while with yield"
    ).split(),
}

def _not_word(words: list[str]) -> str:
    """None of the words comes next. They are grouped by their first letter, so few are tried."""
    rests: dict[str, list[str]] = {}
    for word in words:
        rests.setdefault(word[0], []).append(word[1:])
    return rf"(?!(?:{'|'.join(f'{first}(?:{"|".join(rest)})' for first, rest in rests.items())})\b)" if words else ""


def _call(lang: str, name: str = IDENTIFIER, before: str = "", gap: str = r"\s*", extra: str = "") -> str:
    """A name followed by an opening parenthesis that is no reserved word and no declaration."""
    # The parenthesis is looked for first, as few names have one.
    return rf"(?<![\w$])(?={name}{gap}\(){before}{_not_word(KEYWORDS[lang] + extra.split())}({name}){gap}\("


# Where a line break ends a statement, a parenthesis on the next line does not make a call.
_SAME_LINE = "[ ]*"
# Before the parenthesis of a head whose closing one is followed by a body, an arrow, or the end of a signature.
_BODY, _ARROW, _SIGNATURE = (rf"[ \n]*{mark}\(" for mark in (r"\f", r"\x0B", r"\t"))

_JS_NAME = r"[A-Za-z_$][\w$]*"
_JS_FUNCTION = rf"(?:async\s+)?(?:function\b|{_ARROW}|{_JS_NAME}\s*=>)"
_JS_CONTROL = _not_word("if for while switch catch function return constructor with".split())
_JS_METHOD_HEAD = r"^\s*(?:(?:static|async|get|set|public|private|protected|override|readonly)\s+|\*\s*)*"

_JAVA_MODIFIERS = "public private protected static final abstract synchronized native default strictfp".split()
_JAVA_METHOD = (
    rf"^\s*(?:(?:{'|'.join(_JAVA_MODIFIERS)})\s+)*(?:<[^(){{}};]*>\s+)?"
    rf"{_not_word(_JAVA_MODIFIERS + 'return new else throw case assert do instanceof extends implements throws'.split())}"
    r"[\w.]+(?:<>)?(?:\[\])*\s+([A-Za-z_$][\w$]*)\s*\("
)
_CS_MODIFIERS = (
    "public private protected internal static virtual override abstract sealed async extern unsafe new partial readonly"
).split()
_CS_METHOD = (
    rf"^\s*(?:(?:{'|'.join(_CS_MODIFIERS)})\s+)*"
    rf"{_not_word(_CS_MODIFIERS + 'return else throw case await yield using lock goto delegate do in and or not when select where from join on orderby'.split())}"
    r"[\w.]+(?:<>)?(?:\[\])*\??\s+([A-Za-z_]\w*)\s*(?:<[^>()]*>)?\("
)
# A name after a type or another word is being declared; one after these words is being called.
_NOT_DECLARED = (
    r"(?:(?<=\b(?:return|else|throw|case|assert|await|yield|do)\s{1,2})"
    r"|(?<![\w$\]]\s{0,2})(?<!\w[>*&]\s{1,2})(?<!<>\s{1,2}))"
)
# Words and types one after the other, each taken whole: the last of them is not the function's name. They start after a sign
# that ends a statement or a head, not at every word of a run, so that a long run is walked once.
_C_TYPES = (
    r"(?<![\w,*&<(=.+\-/|!?%^~\[]\s{0,2})"
    rf"{_not_word('return else goto case typedef if while for switch sizeof new delete throw using do'.split())}"
    r"(?:[A-Za-z_][\w:]*+(?!\s*\()(?:<[^;(){}=]*>)?[\s*&]++)"
)

_OCAML_OPERAND = rf"{_not_word([w for w in KEYWORDS['ocaml'] if w not in ('true', 'false')])}[\w(\[~]"

RULES: list[Rule] = [
    # c: definitions only, references are filled in
    Rule("c", "def", "class", r"\bstruct\s+([A-Za-z_]\w*)\s*\{"),
    Rule("c", "def", "class", r"^\s*union\s+([A-Za-z_]\w*)\s*[{\w*]"),
    Rule("c", "def", "function", _C_TYPES + r"++([A-Za-z_]\w*)\s*\("),
    Rule("c", "def", "type",
         r"(?:\btypedef\b[^(){};]*[\s*]|\btypedef\b[^(){};]*\{[^{}]*\}\s*|^\s*\}[ *]*)([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?;"),
    Rule("c", "def", "type", r"\benum\s+([A-Za-z_]\w*)"),
    # cpp: definitions only, references are filled in
    Rule("cpp", "def", "class", r"\bstruct\s+([A-Za-z_]\w*)\s*(?:final\s*)?(?::[^:;(){}][^;(){}]*)?\{"),
    Rule("cpp", "def", "class", r"^\s*union\s+([A-Za-z_]\w*)\s*[{\w*]"),
    Rule("cpp", "def", "function", _C_TYPES + r"++(?<!::)(~?[A-Za-z_]\w*)\s*\("),
    Rule("cpp", "def", "method", _C_TYPES + r"++(?:[A-Za-z_]\w*(?:<[^;(){}=]*>)?::)+([A-Za-z_]\w*)\s*\("),
    Rule("cpp", "def", "method", rf"^\s*(?:[A-Za-z_]\w*(?:<[^;(){{}}=]*>)?::)+([A-Za-z_]\w*){_BODY}"),
    Rule("cpp", "def", "type",
         r"(?:\btypedef\b[^(){};]*[\s*]|\btypedef\b[^(){};]*\{[^{}]*\}\s*|^\s*\}[ *]*)([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?;"),
    Rule("cpp", "def", "type", r"\benum\s+(?!class\b|struct\b)([A-Za-z_]\w*)"),
    Rule("cpp", "def", "type", r"\benum\s+(?:class|struct)\s+([A-Za-z_]\w*)"),
    Rule("cpp", "def", "class", r"(?<!\benum\s{1,2})\bclass\s+([A-Za-z_]\w*)(?!\s*[>,])"),
    # c_sharp
    Rule("c_sharp", "def", "class", r"\bclass\s+([A-Za-z_]\w*)"),
    Rule("c_sharp", "def", "interface", r"\binterface\s+([A-Za-z_]\w*)"),
    Rule("c_sharp", "def", "method", _CS_METHOD),
    Rule("c_sharp", "def", "module", r"\bnamespace\s+([A-Za-z_]\w*)\s*[;{]"),
    Rule("c_sharp", "ref", "class", r"(?:\bclass\s+\w+(?:<\s*>)?\s*:\s*|(?!^)\G(?:<\s*>)?\s*,\s*)([A-Za-z_][\w.]*)"),
    Rule("c_sharp", "ref", "interface", r"(?:\binterface\s+\w+(?:<\s*>)?\s*:\s*|(?!^)\G(?:<\s*>)?\s*,\s*)([A-Za-z_][\w.]*)"),
    Rule("c_sharp", "ref", "class", r"\bnew\s+([A-Za-z_]\w*)\s*[({\[]"),
    Rule("c_sharp", "ref", "class", r"\bwhere\s+([A-Za-z_]\w*)\s*:"),
    Rule("c_sharp", "ref", "class", r"\bwhere\s+\w+\s*:\s*(?!class\b|struct\b|new\b|notnull\b)([A-Za-z_]\w*)"),
    Rule(
        "c_sharp", "ref", "class",
        r"^\s*(?:(?:public|private|protected|internal|static|readonly|const|volatile)\s+)*"
        rf"{_not_word(KEYWORDS['c_sharp'] + ['var'])}([A-Za-z_]\w*)\s+[A-Za-z_]\w*\s*(?:=(?!=)|;|,)",
    ),
    Rule("c_sharp", "ref", "send", r"\.\s*([A-Za-z_]\w*)\s*\("),
    # elisp
    Rule("elisp", "def", "function", r"\(\s*(?:defun|defsubst)\s+([^\s()'\"`,;\[\]]+)"),
    Rule("elisp", "def", "function", r"\(\s*defmacro\s+([^\s()'\"`,;\[\]]+)"),
    Rule(
        "elisp", "ref", "function",
        r"(?<![^\s('`,@])(?<!\bdef(?:un|subst|macro)\s{1,2})(?!(?:defun|defsubst|defmacro|let\*?|if|cond|while|quote"
        r"|function|progn|setq|and|or|lambda)[\s)])(?![:&?\d.])([^\s()'\"`,;\[\]]+)",
    ),
    # elixir: the forms that define things are calls themselves
    Rule("elixir", "def", "module", r"\bdef(?:module|protocol)\s+([A-Z]\w*(?:\.[A-Z]\w*)*)"),
    Rule(
        "elixir", "def", "function",
        r"\b(?:def|defp|defdelegate|defguard|defguardp|defmacro|defmacrop|defn|defnp)\s+([a-z_]\w*[?!]?)",
    ),
    Rule("elixir", "ref", "call", _call("elixir", r"[a-z_]\w*[?!]?", gap=_SAME_LINE)),
    Rule(
        "elixir", "ref", "call",
        r"^\s*@?(defmodule|defprotocol|defimpl|defstruct|defexception|defdelegate|defguardp|defguard|defmacrop"
        r"|defmacro|defnp|defn|defp|def|alias|import|require|use|case|cond|if|unless|for|with|raise|quote)\s",
    ),
    Rule("elixir", "ref", "call", r"\|>\s*([a-z_]\w*[?!]?)(?![\w?!]|[ ]*[.(])"),
    Rule("elixir", "ref", "module", r"(?<![\w.:])([A-Z]\w*(?:\.[A-Z]\w*)*)"),
    # elm: a line that is not indented starts something new
    Rule("elm", "def", "function", rf"^{_not_word(KEYWORDS['elm'])}([a-z]\w*)(?:\s+[^=:|]*)?=(?!=)"),
    Rule("elm", "def", "type", r"^type\s+(?!alias\b)([A-Z]\w*)"),
    Rule("elm", "def", "union", r"(?:^type\s+[A-Z][\w\s]*=|^ [=|]|(?!^)\G(?:[^|=\n]|\n )*+\|)\s*([A-Z]\w*)"),
    Rule("elm", "def", "module", r"^(?:port\s+)?module\s+([A-Z]\w*(?:\.[A-Z]\w*)*)"),
    Rule("elm", "ref", "function",
         rf"(?<![\w.])(?<!^){_not_word(KEYWORDS['elm'])}((?:[A-Z]\w*\.)*[a-z]\w*)(?=[ ][\w(\[])"),
    Rule("elm", "ref", "function",
         r"(?:\bexposing\s*\((?:\s*[A-Z]\w*(?:\s*\([^)]*\))?\s*,)*|(?!^)\G(?:\s*,\s*[A-Z]\w*(?:\s*\([^)]*\))?)*\s*,)\s*([a-z]\w*)"),
    Rule("elm", "ref", "function", r"^([a-z]\w*)\s*:(?!:)"),
    Rule("elm", "ref", "type", r"(?:(?<!:):(?!:)\s*|->[ ]*)[ (]*(?:[A-Z]\w*\.)*([A-Z]\w*)"),
    Rule("elm", "ref", "type", r"\bexposing\s*\([^)]*?([A-Z]\w*)"),
    Rule("elm", "ref", "union",
         r"(?:(?<![<>=/|])=\s+|\bof[ ]+|\b(?:then|else|in)\s+|[(\[,][ ]+)(?:[A-Z]\w*\.)*([A-Z]\w*)(?![\w.]|\(\.\.\))"),
    # go: a type's own definition is a type identifier too
    Rule("go", "def", "function", r"^func\s+([A-Za-z_]\w*)\s*[(\[]"),
    Rule("go", "def", "method", r"^func\s*\([^)]*\)\s*([A-Za-z_]\w*)"),
    Rule("go", "def", "type", r"^\s*type\s+([A-Za-z_]\w*)"),
    Rule("go", "def", "type", r"^ ([A-Z]\w*)\s+(?:struct|interface)\s*\{"),
    Rule("go", "ref", "call", _call("go", before=r"(?<!\bfunc\s)(?<!\) )", gap=_SAME_LINE)),
    Rule("go", "ref", "type", r"^\s*type\s+([A-Za-z_]\w*)"),
    Rule("go", "ref", "type", r"(?:\*|\[\]|&)\s*([A-Z]\w*)(?![\w(.])"),
    Rule("go", "ref", "type", r"(?<![\w.*&\]])([A-Z]\w*)\{"),
    Rule("go", "ref", "type", r"(?<=\w |\) )([A-Z]\w*)[ ]*(?=[,){]|$)"),
    Rule(
        "go", "ref", "type",
        r"\b(bool|byte|complex64|complex128|error|float32|float64|int|int8|int16|int32|int64|rune|string|uint|uint8"
        r"|uint16|uint32|uint64|uintptr)\b(?!\s*\()",
    ),
    # java
    Rule("java", "def", "class", r"\bclass\s+([A-Za-z_$][\w$]*)"),
    Rule("java", "def", "method", _JAVA_METHOD),
    Rule("java", "def", "interface", r"\binterface\s+([A-Za-z_$][\w$]*)"),
    Rule("java", "ref", "call", _call("java", r"[A-Za-z_$][\w$]*", before=rf"(?<!@){_NOT_DECLARED}")),
    Rule("java", "ref", "implementation",
         r"(?:\bimplements\s+|\binterface\s+\w+(?:<\s*>)?\s+extends\s+|(?!^)\G(?:<\s*>)?\s*,\s*)([A-Za-z_$][\w$]*)"),
    Rule("java", "ref", "class", r"\bnew\s+([A-Za-z_$][\w$]*)\s*[(<]"),
    Rule("java", "ref", "class", r"\bclass\s+\w+(?:<\s*>)?\s+extends\s+([A-Za-z_$][\w$]*)"),
    # javascript
    Rule("javascript", "def", "method", rf"{_JS_METHOD_HEAD}{_JS_CONTROL}({_JS_NAME}){_BODY}"),
    Rule("javascript", "def", "class", rf"\bclass\s+(?!extends\b)({_JS_NAME})"),
    Rule("javascript", "def", "function", rf"\bfunction\s*\*?\s*({_JS_NAME})"),
    Rule("javascript", "def", "function", rf"\b(?:const|let|var)\s+({_JS_NAME})\s*=\s*{_JS_FUNCTION}"),
    Rule("javascript", "def", "function",
         rf"(?<!\b(?:const|let|var)\s{{1,2}})(?<![\w$])({_JS_NAME})\s*=\s*{_JS_FUNCTION}"),
    Rule("javascript", "def", "function", rf"(?<![\w$?])({_JS_NAME})\s*:\s*{_JS_FUNCTION}"),
    Rule("javascript", "ref", "call",
         _call("javascript", _JS_NAME, r"(?<!\b(?:function|new)\s{1,2})(?<!\bfunction\s{0,2}\*\s{0,2})",
               r"\s*(?<!\f)", extra="require")),
    Rule("javascript", "ref", "class", rf"\bnew\s+({_JS_NAME}(?:\.{_JS_NAME})*)"),
    # ocaml
    Rule("ocaml", "def", "module", r"\bmodule\s+(?!type\b)(?:rec\s+)?([A-Z][\w']*)"),
    Rule("ocaml", "def", "interface", r"\bmodule\s+type\s+([A-Za-z_][\w']*)"),
    Rule("ocaml", "def", "function",
         r"\b(?:let|and)\s+(?:rec\s+)?(?!open\b|module\b|exception\b)([a-z_][\w']*)\s+(?=[\w(~?{\[])[^=]*="),
    Rule("ocaml", "def", "function", r"\b(?:let|and)\s+(?:rec\s+)?([a-z_][\w']*)\s*(?::[^=]*)?=\s*(?:fun|function)\b"),
    Rule("ocaml", "def", "function", r"\bexternal\s+([a-z_][\w']*)"),
    Rule("ocaml", "def", "function", r"\b(?:let|and)\s+(?:rec\s+)?\(\s*([^\s\w()]+)\s*\)"),
    Rule("ocaml", "def", "class", r"\bclass\s+(?:type\s+)?(?:virtual\s+)?(?:\[[^\]]*\]\s*)?([a-z_][\w']*)"),
    Rule("ocaml", "def", "method", r"\bmethod!?\s+(?:(?:private|virtual)\s+)*([a-z_][\w']*)"),
    Rule("ocaml", "ref", "module", r"\b([A-Z][\w']*)\s*\."),
    Rule("ocaml", "ref", "module", r"\b(?:open|include)!?\s+(?:[A-Z][\w']*\.)*([A-Z][\w']*)(?![\w'.])"),
    Rule("ocaml", "ref", "implementation", r"\bmodule\s+[A-Z][\w']*\s*:\s*(?:[A-Z][\w']*\.)*([A-Z][\w']*)(?![\w'.])"),
    Rule("ocaml", "ref", "call",
         r"\b(?:let|and)\s+(?:rec\s+)?(?:[a-z_][\w']*|\([^()]*\))\s+(?=[\w(~?{\[])[^=]*=|"  # heads are passed over
         r"(?<![\w'#~?])(?<!\b(?:let|and|rec|method|external|val|class|type|fun|inherit|new)\s{1,2})"
         rf"{_not_word(KEYWORDS['ocaml'])}([a-z_][\w']*)"
         rf"(?![\w'])(?=\s+{_OCAML_OPERAND})"),
    Rule("ocaml", "ref", "call", r"([a-z_][\w']*)\s*@@"),
    Rule("ocaml", "ref", "call", rf"\|>\s*(?:[A-Z][\w']*\.)*([a-z_][\w']*)(?![\w'])(?!\s+{_OCAML_OPERAND})"),
    Rule("ocaml", "ref", "call",
         r"\b(?:let|and)\s+(?:rec\s+)?\([^\w()]*\)|(?<![!$%&*+\-/<=>@^|~?:])(?!->|<-|\|\]|:|=(?![=<>@^|&+\-*/$%])|\|(?![|>]))([!$%&*+\-/<=>@^|~]+|:=|mod\b|land\b|lor\b)"),
    Rule("ocaml", "ref", "class", r"\b(?:inherit|new)!?\s+(?:[A-Z][\w']*\.)*([a-z_][\w']*)"),
    Rule("ocaml", "ref", "call", r"#\s*([a-z_][\w']*)"),
    # php: what is made or declared is passed over
    Rule("php", "def", "class", r"(?<![:$>\w])class\s+([A-Za-z_]\w*)"),
    Rule("php", "def", "function", r"\bfunction\s+&?\s*([A-Za-z_]\w*)"),
    Rule("php", "ref", "class", r"\bnew\s+\\?(?:\w+\\)*([A-Za-z_]\w*)"),
    Rule("php", "ref", "call", rf"\b(?:new|function)\s+&?\s*[\w\\]+|{_call('php')}"),
    # python
    Rule("python", "def", "class", r"^\s*class\s+([A-Za-z_]\w*)"),
    Rule("python", "def", "function", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)"),
    Rule("python", "ref", "call", _call("python", before=r"(?<!\b(?:def|class)\s)", gap=_SAME_LINE)),
    # ql: a name after a type is declared and passed over
    Rule("ql", "def", "function",
         rf"^(?:(?:private|cached|deprecated|external|pragma\[\w+\])\s+)*(?!class\b|module\b|newtype\b|import\b)[A-Za-z]\w*\s+([a-z]\w*)\s*\("),
    Rule("ql", "def", "method",
         rf"^ (?:(?:private|override|final|abstract|cached|deprecated)\s+)*{_not_word('and or not if then else in exists forall'.split())}[A-Za-z]\w*\s+([a-z]\w*){_BODY}"),
    Rule("ql", "def", "module", r"\bmodule\s+([A-Za-z]\w*)"),
    Rule("ql", "def", "class", r"\bclass\s+([A-Z]\w*)"),
    Rule("ql", "def", "class", r"\bnewtype\s+([A-Z]\w*)"),
    Rule("ql", "def", "class", r"(?:^\s*newtype\s+\w+\s*=|^\s*(?:=|or))\s*([A-Z]\w*)\s*\("),
    Rule("ql", "ref", "call",
         rf"(?<![\w.$]){_not_word('and or not if then else in where select implies'.split())}[A-Za-z]\w*\s+[a-z]\w*\s*\("
         rf"|(?<![\w.$]){_not_word(KEYWORDS['ql'])}([a-z]\w*)\s*\("),
    Rule("ql", "ref", "call", r"\.\s*([a-z]\w*)\s*\("),
    Rule("ql", "ref", "type", r"(?<!\bclass\s{1,2})(?<!\bnewtype\s{1,2})(?<!\bmodule\s{1,2})\b([A-Z]\w*)\b(?!\s*(?:\(|::))"),
    # ruby: every name is a reference, a call with a receiver is one twice
    Rule("ruby", "def", "method", r"\bdef\s+(?:\w+\.)?([A-Za-z_]\w*[?!=]?)"),
    Rule("ruby", "def", "method", r"\balias\s+:?([A-Za-z_]\w*[?!=]?)"),
    Rule("ruby", "def", "class", r"\bclass\s+(?:[A-Z]\w*::)*([A-Z]\w*)"),
    Rule("ruby", "def", "class", r"\bclass\s*<<\s*(?:[A-Z]\w*::)*([A-Z]\w*)(?![\w:])"),
    Rule("ruby", "def", "module", r"\bmodule\s+(?:[A-Z]\w*::)*([A-Z]\w*)"),
    Rule("ruby", "ref", "call", r"\.\s*([a-z_]\w*[?!]?)"),
    Rule("ruby", "ref", "call", _call("ruby", r"[a-z_]\w*[?!]?", before=r"(?<![.:@$])(?<!\bdef\s)", gap=_SAME_LINE)),
    Rule(
        "ruby", "ref", "call",
        r"(?<![\w:@$])"
        rf"{_not_word([w for w in KEYWORDS['ruby'] if w != 'defined?'] + 'lambda load require require_relative __FILE__ __LINE__'.split())}"
        r"([A-Za-z_]\w*[?!]?)(?!:(?!:))",
    ),
    # rust: functions of an impl or mod body are captured twice
    Rule("rust", "def", "class", r"\bstruct\s+([A-Za-z_]\w*)"),
    Rule("rust", "def", "class", r"\benum\s+([A-Za-z_]\w*)"),
    Rule("rust", "def", "class", r"\bunion\s+([A-Za-z_]\w*)"),
    Rule("rust", "def", "class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+([A-Za-z_]\w*)[^;={}]*="),
    Rule("rust", "def", "method", rf"^ [^/{{}}();=\n]*\bfn\s+([A-Za-z_]\w*)(?:<[^(){{}};]*>)?{_BODY}"),
    Rule("rust", "def", "function", rf"\bfn\s+([A-Za-z_]\w*)(?:<[^(){{}};]*>)?{_BODY}"),
    Rule("rust", "def", "interface", r"\btrait\s+([A-Za-z_]\w*)"),
    Rule("rust", "def", "module", r"\bmod\s+([A-Za-z_]\w*)"),
    Rule("rust", "def", "macro", r"\bmacro_rules!\s*([A-Za-z_]\w*)"),
    Rule("rust", "ref", "call", _call("rust", before=r"(?<!\bfn\s{1,2})(?<!::)(?<!\bstruct\s{1,2})(?<!#\[)")),
    Rule("rust", "ref", "call", r"(?<![\w:])(?!macro_rules\b)([A-Za-z_]\w*)!\s*[(\[{]"),
    Rule("rust", "ref", "implementation", r"^\s*(?:unsafe\s+)?impl(?:<\s*>)?\s+!?([A-Za-z_]\w*)(?:<\s*>)?\s+for\b"),
    Rule("rust", "ref", "implementation", r"^\s*(?:unsafe\s+)?impl(?:<\s*>)?\s+([A-Za-z_]\w*)(?:<\s*>)?\s*(?:\bwhere\b[^{;]*)?\{"),
    # typescript: an interface is captured twice
    Rule("typescript", "def", "function", rf"\bdeclare\s+function\s+({_JS_NAME})"),
    Rule("typescript", "def", "method", rf"^ {_JS_CONTROL}({_JS_NAME})\??\s*(?:<[^>()]*>)?{_SIGNATURE}"),
    Rule("typescript", "def", "method",
         rf"\babstract\s+(?!class\b)(?:(?:async|static|readonly|get|set|override|public|protected|private)\s+)*({_JS_NAME})\s*(?:<[^>()]*>)?\s*\("),
    Rule("typescript", "def", "class", rf"\babstract\s+class\s+({_JS_NAME})"),
    Rule("typescript", "def", "module", rf"\bmodule\s+({_JS_NAME})"),
    Rule("typescript", "def", "interface", rf"\binterface\s+({_JS_NAME})"),
    Rule("typescript", "ref", "type", rf"(?<!\?\s?):\s*{_not_word('string number boolean any void never unknown object symbol undefined null'.split())}({_JS_NAME})(?![\w$.(:]|\s*=>)"),
    Rule("typescript", "ref", "class", rf"\bnew\s+({_JS_NAME})\s*[(<]"),
    Rule("typescript", "def", "function", rf"(?<!\bdeclare\s{{1,2}})\bfunction\s+({_JS_NAME})"),
    Rule("typescript", "def", "method", rf"{_JS_METHOD_HEAD}{_JS_CONTROL.replace('|constructor', '')}({_JS_NAME})\s*(?:<[^>()]*>)?{_BODY}"),
    Rule("typescript", "def", "class", rf"(?<!\babstract\s{{1,2}})\bclass\s+(?!extends\b)({_JS_NAME})"),
    Rule("typescript", "def", "class", rf"\binterface\s+({_JS_NAME})"),
    Rule("typescript", "def", "type", rf"^\s*(?:export\s+)?(?:declare\s+)?type\s+({_JS_NAME})[^=;{{}}]*="),
    Rule("typescript", "def", "enum", rf"\benum\s+({_JS_NAME})"),
]


def _top_level(pattern: str) -> tuple[list[int], tuple[int, int] | None]:
    """Places of the alternations at the top level of a regular expression, and where its first capturing group is."""
    bars, group, opened = [], None, []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if pattern[i + 1 : i + 2].isdigit() and pattern[i + 1] != "0":
                raise ValueError(f"a rule cannot refer back to a group by number: {pattern}")
            i += 2
            continue
        if c == "[":  # a class; brackets in it may nest, and one may stand first
            depth, i = 1, i + (2 if pattern[i + 1 : i + 2] == "^" else 1)
            i += pattern[i : i + 1] == "]"
            while i < len(pattern) and depth:
                depth += (pattern[i] == "[") - (pattern[i] == "]")
                i += 2 if pattern[i] == "\\" else 1
            continue
        if c == "(":
            capturing = pattern[i + 1 : i + 2] != "?" or re.match(r"\(\?<[A-Za-z]", pattern[i:]) is not None
            if capturing and group is None:
                if opened:
                    raise ValueError(f"the name must be a group at the top level of a rule: {pattern}")
                group = (i, -1)
            opened.append(i)
        elif c == ")":
            start = opened.pop()
            if group and group[0] == start:
                group = (start, i + 1)
        elif c == "|" and not opened:
            bars.append(i)
        i += 1
    return bars, group


def _class_of(code: int) -> str:
    return rf"\x{{{code:x}}}"


_CATEGORIES = {
    _parser.CATEGORY_WORD: r"\w", _parser.CATEGORY_SPACE: r"\s", _parser.CATEGORY_DIGIT: r"\d",
    _parser.CATEGORY_NOT_WORD: r"\W", _parser.CATEGORY_NOT_SPACE: r"\S", _parser.CATEGORY_NOT_DIGIT: r"\D",
}
# What Java reads otherwise than Python, or Python does not read: escapes, and what is left when they are taken out.
_OTHER_ESCAPES = re.compile(r"[^bBdDsSwWfnrtxuAG\W]")
_OTHER_SYNTAX = re.compile(r"\[\^?\]|&&|\[[^\]]*\[|\(\?[A-Za-z-]")


def _first_of(sequence) -> tuple[set[str], bool] | None:
    """Java classes of the signs a match of the parsed pattern can begin with, and whether it can be empty; None if not told."""
    found: set[str] = set()
    for op, value in sequence:
        empty = False
        if op in (_parser.AT, _parser.ASSERT, _parser.ASSERT_NOT):
            continue
        if op is _parser.LITERAL:
            found.add(_class_of(value))
        elif op is _parser.NOT_LITERAL:
            found.add(f"[^{_class_of(value)}]")
        elif op is _parser.IN:
            parts = []
            for kind, item in value:
                if kind is _parser.LITERAL:
                    parts.append(_class_of(item))
                elif kind is _parser.RANGE:
                    parts.append(f"{_class_of(item[0])}-{_class_of(item[1])}")
                elif kind is _parser.CATEGORY:
                    parts.append(_CATEGORIES[item])
            negated = value[0][0] is _parser.NEGATE
            found |= {f"[^{''.join(parts)}]"} if negated else set(parts)
        else:
            if op is _parser.BRANCH:
                parts = [_first_of(branch) for branch in value[1]]
            elif op is _parser.SUBPATTERN and not value[1] and not value[2]:
                parts = [_first_of(value[3])]
            elif op is _parser.ATOMIC_GROUP:
                parts = [_first_of(value)]
            elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT, _parser.POSSESSIVE_REPEAT):
                parts, empty = [_first_of(value[2])], value[0] == 0
            else:
                return None
            if None in parts:
                return None
            found = found.union(*(classes for classes, _ in parts))
            empty = empty or any(nothing for _, nothing in parts)
        if not empty:
            return found, False
    return found, True


def first_sign(pattern: str) -> str:
    """A test of the sign a match of the pattern begins with, to be made before all else; empty if that is not told.

    Most places of a text fail it, which costs far less than the groups, word bounds and tests of what stands before.
    """
    escapes = re.findall(r"\\(.)", pattern, re.DOTALL)
    if any(map(_OTHER_ESCAPES.match, escapes)) or _OTHER_SYNTAX.search(re.sub(r"\\.", "_", pattern, flags=re.DOTALL)):
        return ""
    # Where the last match ended tells nothing of signs, nor does the name of a group.
    plain = re.sub(r"\\(.)", lambda m: "" if m[1] == "G" else m[0], pattern, flags=re.DOTALL)
    try:
        parsed = _parser.parse(re.sub(r"(?<!\\)\(\?<[A-Za-z]\w*>", "(?:", plain))
    except (re.error, OverflowError):
        return ""
    told = _first_of(parsed)
    if told is None or told[1] or not told[0]:
        return ""
    start = "^" if parsed.data[0] == (_parser.AT, _parser.AT_BEGINNING) else ""
    return f"{start}(?=[{''.join(sorted(told[0]))}])"


def marking(pattern: str) -> str:
    """The pattern with its match in named groups: ``before``, ``name`` and ``after``, or ``skip`` and ``pass`` where an
    alternative without a name matches. Replacing a match by its groups can then set the name off and leave the text as it is."""
    flags = re.match(r"(?:\(\?[A-Za-z-]+\))*", pattern).group()
    body = pattern[len(flags) :]
    bars, group = _top_level(body)
    if group is None:
        raise ValueError(f"a rule needs a group for the name: {pattern}")
    begin = max([b + 1 for b in bars if b < group[0]], default=0)
    end = min([b for b in bars if b >= group[1]], default=len(body))
    name = body[group[0] : group[1]]
    inner = re.sub(r"^\((?:\?<\w+>)?", "", name)[:-1]
    found = f"(?<before>{body[begin:group[0]]})(?<name>{inner})(?<after>{body[group[1]:end]})"
    skip, rest = body[: max(begin - 1, 0)], body[end + 1 :]
    found = f"(?<skip>{skip})|{found}" if begin else f"(?<skip>){found}"
    found = f"{found}|(?<pass>{rest})" if end < len(body) else f"{found}(?<pass>)"
    return f"(?md){flags}{found}"


def guarded(pattern: str) -> str:
    """``marking`` that tests the first sign before all else."""
    marked, sign = marking(pattern), first_sign(pattern)
    return f"(?md){sign}(?:{marked.removeprefix('(?md)')})" if sign else marked


def rules_table(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    return spark.createDataFrame(rules if rules is not None else RULES, RULES_SCHEMA)


def extensions_table(spark: SparkSession, extensions: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(list((extensions or EXTENSION_LANGUAGES).items()), EXTENSIONS)


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules from a JSON-lines file or folder with the columns of the rules schema: configuration, held by the driver.

    Rows whose kind is neither ``def`` nor ``ref`` are dropped, as captures of other kinds are.
    """
    table = spark.read.schema(RULES_SCHEMA).json(path).where(F.col("kind").isin("def", "ref"))
    return [Rule(*row) for row in table.collect()]
