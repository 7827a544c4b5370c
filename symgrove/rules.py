"""What definitions look like, language by language, on masked source text.

A pattern may span lines and match several times a line. Group ``n`` is the
name, ``d`` where the definition starts (else the match itself), ``o`` the
word that opens its block. In masked text strings are ``\\x02`` and ``\\x01``
of their length, comments and other text that is no code are blanks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

NAME = r"[^\W\d]\w*"
STRING = r"\x02\x01*"
# A statement starts here; the match then begins with its white space.
START = r"(?<![^;{}])\s*"


@dataclass(frozen=True)
class Rule:
    """``end`` says how the end is found; ``where`` what must enclose the definition directly.

    Ends: ``brace`` (a block, or the statement's end), ``word`` (the closing
    word), ``head`` (the parameter list), ``match`` (the match itself),
    ``value`` (an expression), ``do`` and ``scala``. Places: ``any``, ``top``,
    ``type`` (the body of a type), ``open`` (top or body of a type), ``code``
    (not a table), ``own`` (the body of the type of that name), ``typed``
    (anywhere with a body; without one only in a type).
    """

    tag: str
    pattern: str
    end: str = "brace"
    where: str = "any"

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.M)


def _words(*names: str) -> str:
    """Optional leading modifiers."""
    return rf"(?:(?:{'|'.join(names)})\s+)*"


_ARGS = r"(?:\((?:[^()]|\([^()]*\))*\))?"
_GENERIC = r"<(?:[^<>;{}]|<(?:[^<>;{}]|<[^<>;{}]*>)*>)*>"
_SQUARE = r"\[(?:[^\[\]]|\[[^\[\]]*\])*\]"

_CS = rf"(?P<d>(?:{_SQUARE}\s*)*" + _words(
    "public", "private", "protected", "internal", "static", "abstract", "sealed", "partial", "unsafe", "new",
    "readonly", "async", "override", "virtual", "extern", "required", "file")
_CS_TYPE = (r"(?!(?:new|return|throw|await|operator|event|delegate|implicit|explicit|class|struct|interface|enum|"
            r"record|namespace|using|const|public|private|protected|internal|static|abstract|sealed|partial|unsafe|"
            r"readonly|async|override|virtual|extern|required|file)\b)(?:ref\s+(?:readonly\s+)?)?"
            rf"(?:\((?:[^()]|\([^()]*\))*\)|{NAME}(?:(?:\.|::){NAME})*(?:{_GENERIC})?(?:\.{NAME}(?:{_GENERIC})?)*)"
            r"(?:\[[,\s]*\]|\?|\*)*")
_RS = r"(?P<d>(?:pub(?:\s*\([^)]*\))?\s+)?"
_SW = rf"(?P<d>(?:@\w+{_ARGS}\s+)*(?:(?:" + "|".join([
    "public", "private", "internal", "fileprivate", "open", "final", "static", r"class(?=\s+func\b)", "override",
    "mutating", "nonmutating", "indirect", "convenience", "required", "isolated", "nonisolated"]) + r")(?:\(\w+\))?\s+)*"
_PHP = rf"(?P<d>(?:#{_SQUARE}\s*)*(?<![\w$:>\\])" + _words(
    "abstract", "final", "readonly", "public", "private", "protected", "static")
_DART = _words("abstract", "base", "final", "sealed", "interface", "mixin")
_DART_TYPE = (r"(?!(?:return|await|else|new|throw|yield|assert|case|var|if|for|while|switch|in|get|set|operator|"
              r"factory|const|typedef|import|export|class|enum|late|final|required)\b)"
              rf"{NAME}(?:\.{NAME})*\s*(?:{_GENERIC})?\??")
_DART_NOTES = rf"(?:@{NAME}(?:\.{NAME})*{_ARGS}\s*)*"
_SCALA = rf"(?P<d>(?:@{NAME}{_ARGS}\s+)*" + _words(
    "override", r"private(?:\[\w+\])?", r"protected(?:\[\w+\])?", "final", "implicit", "inline", "sealed", "abstract",
    "lazy", "case", "open", "transparent")
_EX_DEFS = "def|defp|defdelegate|defguard|defguardp|defmacro|defmacrop|defn|defnp"

RULES: dict[str, list[Rule]] = {
    "python": [],       # by logical lines, see scanner
    "go": [
        Rule("method", rf"\bfunc\s*\([^()]*\)\s*(?P<n>{NAME})\s*(?=\()", where="top"),
        Rule("function", rf"\bfunc\s+(?P<n>{NAME})\s*(?=[(\[])", where="top"),
    ],
    "rust": [
        Rule("function", rf"{_RS}(?:(?:default|const|async|unsafe|extern(?:\s*{STRING})?)\s+)*\bfn\s+(?P<n>{NAME}))"),
        Rule("struct", rf"{_RS}\bstruct\s+(?P<n>{NAME}))"),
        Rule("interface", rf"{_RS}(?:unsafe\s+)?(?:auto\s+)?\btrait\s+(?P<n>{NAME}))"),
        Rule("macro", rf"\bmacro_rules!\s*(?P<n>{NAME})"),
        Rule("enum", rf"{_RS}\benum\s+(?P<n>{NAME}))"),
    ],
    "ruby": [
        Rule("method", rf"(?<![\w.:$@])(?P<o>def)\s+(?:(?:{NAME}|@{NAME})\s*\.\s*)?"
                       rf"(?P<n>{NAME}(?:[?!]|=(?=\s*\())?|\[\]=?|[+\-~!]@|[+\-*/%<>=!~^&|]+)", "word"),
        Rule("method", r"(?<![\w.:$@])alias\s+(?P<n>\S+)[ \t]+[^\s;]+", "match"),
        Rule("class", r"(?<![\w.:$@])(?P<o>class)\s*<<\s*(?:[A-Z]\w*::)*(?P<n>[A-Z]\w*)", "word"),
        Rule("class", r"(?<![\w.:$@])(?P<o>class)\s+(?:::)?(?:[A-Z]\w*::)*(?P<n>[A-Z]\w*)", "word"),
    ],
    "c-sharp": [
        Rule("class", rf"{START}{_CS}class\s+(?P<n>{NAME}))"),
        Rule("interface", rf"{START}{_CS}interface\s+(?P<n>{NAME}))"),
        Rule("method", rf"{START}{_CS}{_CS_TYPE}\s+(?:{NAME}(?:{_GENERIC})?\.)*(?P<n>{NAME})\s*(?:{_GENERIC})?\s*(?=\())",
             where="type"),
    ],
    "swift": [
        Rule("function", rf"{_SW}\bfunc\s+(?P<n>{NAME}))"),
        Rule("struct", rf"{_SW}\bstruct\s+(?P<n>{NAME}))"),
        Rule("interface", rf"{_SW}\bprotocol\s+(?P<n>{NAME}))"),
        Rule("class", rf"{_SW}\bextension\s+(?P<n>{NAME}))"),
        Rule("class", rf"{_SW}(?<![\w.])class\s+(?!func\b|var\b|let\b|subscript\b)(?P<n>{NAME}))"),
    ],
    "php": [
        Rule("class", rf"{_PHP}\bclass\s+(?!extends\b|implements\b)(?P<n>{NAME}))"),
        Rule("function", rf"{_PHP}\bfunction\s+&?\s*(?P<n>{NAME})\s*(?=\())"),
    ],
    "dart": [
        Rule("interface", rf"\b(?P<d>(?:base\s+)?mixin\s+(?!class\b)(?P<n>{NAME}))", where="top"),
        Rule("class", rf"{START}{_DART_NOTES}(?P<d>{_DART}class\s+(?P<n>{NAME}))", where="top"),
        Rule("class", rf"{START}{_DART_NOTES}(?P<d>extension\s+(?!type\b)(?P<n>{NAME})\s*(?:{_GENERIC})?\s+on\b)", where="top"),
        Rule("function", rf"{START}{_DART_NOTES}(?:external\s+)?(?P<d>(?:const\s+|factory\s+)?(?P<n>{NAME})(?:\.\w+)?\s*(?=\())",
             "head", "own"),
        Rule("function", rf"{START}{_DART_NOTES}(?:(?:static|external|covariant|augment)\s+)*"
                         rf"(?P<d>{_DART_TYPE}\s+(?P<n>(?!(?:get|set|operator|is|as|in)\b){NAME})\s*(?:{_GENERIC})?\s*(?=\())",
             "head", "typed"),
        Rule("function", rf"{START}{_DART_NOTES}(?:(?:static|external)\s+)*"
                         rf"(?P<d>(?!(?:if|for|while|switch|catch|return|assert|super|this|await|throw|get|set)\b)"
                         rf"(?P<n>{NAME})\s*(?=\())", "head", "bodied"),
    ],
    "perl": [Rule("function", rf"(?<![\w$@%&>])sub\s+(?P<n>{NAME}(?:(?:::|'){NAME})*)(?=[^;{{}}]*\{{)")],
    "lua": [
        Rule("function", rf"(?<![\w.])(?P<d>(?:local\s+)?(?P<o>\bfunction)\s+(?:{NAME}\s*[.:]\s*)*(?P<n>{NAME}))", "word"),
        Rule("function", rf"(?<![\w.:\]])(?P<d>(?:{NAME}\s*\.\s*)*(?P<n>{NAME}))\s*=\s*(?P<o>function)\b", "word", "code"),
    ],
    "r": [Rule("function", rf"(?<![\w.$@:\x01\x02`])(?P<n>[\w.]+|{STRING}|`[^`\n]*`)\s*(?:<-|(?P<e>=))\s*(?:function\b|\\)\s*(?=\()",
               "value", "assigned")],
    "elixir": [Rule("function", rf"(?<![\w.:@])(?:{_EX_DEFS})\s+(?!unquote\()(?P<n>[^\W\dA-Z]\w*[?!]?)"
                                r"(?=\(|\s*,|\s+do\b|[ \t]*(?:\n|\Z))", "do")],
    "erlang": [], "haskell": [],    # by forms and top-level declarations, see scanner
    "scala": [
        Rule("class", rf"{_SCALA}\bclass\s+(?P<n>{NAME}))", "scala"),
        Rule("interface", rf"{_SCALA}\btrait\s+(?P<n>{NAME}))", "scala"),
        Rule("function", rf"{_SCALA}\bdef\s+(?P<n>{NAME}))", "scala"),
    ],
}

_JAVA = r"(?P<d>" + rf"(?:@(?!interface\b){NAME}(?:\.{NAME})*{_ARGS}\s*)*" + _words(
    "public", "private", "protected", "static", "abstract", "final", "synchronized", "native", "default", "strictfp")
_JS = r"(?P<d>"
_KT = r"(?P<d>" + rf"(?:@{NAME}{_ARGS}\s+)*" + _words(
    "public", "private", "protected", "internal", "open", "abstract", "final", "sealed", "data", "inline", "override",
    "suspend", "operator", "enum", "annotation", "infix")
_C_HEAD = (rf"{START}(?P<d>(?!(?:return|else|typedef|using|if|for|while|switch|do|case|goto|new|delete|throw)\b)"
           rf"[A-Za-z_][\w\s*&:<>,]*?[\s*&](?P<n>{NAME}(?:::~?\w+)?)\s*(?=\())")

# Rules of languages that give no rows by default.
EXTENDED_RULES: dict[str, list[Rule]] = {
    "java": [
        Rule("class", rf"{START}{_JAVA}class\s+(?P<n>{NAME}))"),
        Rule("interface", rf"{START}{_JAVA}interface\s+(?P<n>{NAME}))"),
        Rule("method", rf"{START}{_JAVA}(?:{_GENERIC}\s*)?(?!(?:new|return|throw|else)\b){NAME}(?:\.{NAME})*(?:{_GENERIC})?"
                       rf"(?:\[\])*\s+(?P<n>{NAME})\s*(?=\())", where="type"),
    ],
    "javascript": [
        Rule("class", rf"{_JS}(?<![\w.$])class\s+(?!extends\b)(?P<n>{NAME}))"),
        Rule("function", rf"{_JS}(?<![\w.$])(?:async\s+)?function\s*\*?\s*(?P<n>{NAME}))"),
    ],
    "typescript": [
        Rule("class", rf"{_JS}(?<![\w.$])(?:abstract\s+)?class\s+(?!extends\b|implements\b)(?P<n>{NAME}))"),
        Rule("interface", rf"{_JS}(?<![\w.$])interface\s+(?P<n>{NAME})(?=[^=;{{]*\{{))"),
        Rule("function", rf"{_JS}(?<![\w.$])(?:async\s+)?function\s*\*?\s*(?P<n>{NAME}))"),
    ],
    "c": [
        Rule("struct", rf"{START}(?P<d>(?:typedef\s+)?struct\s+(?P<n>{NAME})\s*(?=\{{))"),
        Rule("function", _C_HEAD, where="body"),
    ],
    "cpp": [
        Rule("class", rf"{START}(?P<d>(?:class|struct)\s+(?P<n>{NAME})(?=[^;(){{}}]*\{{))"),
        Rule("function", _C_HEAD, where="body"),
    ],
    "kotlin": [
        Rule("class", rf"{_KT}\bclass\s+(?P<n>{NAME}))", "scala"),
        Rule("interface", rf"{_KT}\binterface\s+(?P<n>{NAME}))", "scala"),
        Rule("function", rf"{_KT}\bfun\s+(?:{_GENERIC}\s*)?(?:[\w<>]+\.)?(?P<n>{NAME}))", "scala"),
    ],
    "bash": [
        Rule("function", r"(?<![\w.$-])function\s+(?P<n>[\w.-]+)"),
        Rule("function", r"(?<![\w.$-])(?P<n>[\w.-]+)\s*\(\s*\)(?=\s*\{)"),
    ],
}

# Blocks that words open and close; ``end`` closes the innermost, ``until`` a ``repeat``.
BLOCK_WORDS: dict[str, str] = {
    "ruby": r"(?<![\w.:$@])(?:class|module|def|begin|do|case|if|unless|while|until|for|end)\b(?![?!:=]|\s*=>)|"
            r"(?<![\w.:$@])(?:class|module|def|begin|do|case|if|unless|while|until|for|end)\b(?=::|==|=~)",
    "lua": r"(?<![\w.:])(?:function|do|if|repeat|until|end)\b",
    "elixir": r"(?<![\w.:@])(?:do|fn|end)\b(?!:(?!:)|[?!])",
    "erlang": r"(?<![\w@?])(?:begin|case|if|receive|try|maybe|end)\b(?!\s*\()|(?<![\w@?])(?:if|case|receive|try|begin)\b(?=\s*\()|"
              r"(?<![\w@?])fun\b(?=\s*(?:[A-Z_]\w*\s*)?\((?!\())",
}
# A Ruby condition that opens a block stands where a value or statement begins.
BEFORE_VALUE = re.compile(r"(?:[;({\[=,|&!?:<>+*-]|\b(?:then|do|else|elsif|begin|ensure|return|and|or|not|when|in|yield|puts))\s*\Z")
ENDLESS = re.compile(r"def\s+[\w.]+[?!]?\s*(?:\((?:[^()\n]|\([^()\n]*\))*\))?\s+=\s")

# Strings (s), comments and other text that is no code (c), comments that nest (n), heredocs (h). Loops are possessive.
_TRIPLE_DOUBLE = r'"""[^"\\]*+(?:(?:\\.|"{1,2}(?!"))[^"\\]*+)*+(?:"""|\Z)'
_TRIPLE_SINGLE = _TRIPLE_DOUBLE.replace('"', "'")
_DOUBLE = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_SINGLE = _DOUBLE.replace('"', "'")
_DOUBLE_LINES = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_SINGLE_LINES = _DOUBLE_LINES.replace('"', "'")
_CHAR = r"'(?:[^'\\\n]|\\[^\n]{1,8}?)'"
_BACKTICK = r"`[^`]*+`"
_LINE = r"//[^\n]*+"
_BLOCK = r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\Z)"
_HASH = r"(?<![^\s;(){}\[\],])#[^\n]*+"
_RAW_QUOTES = r'(?P<q>"{3,})(?:(?!(?P=q)).)*+(?P=q)'

MASKS: dict[str, dict[str, list[str]]] = {
    "python": {"s": [_TRIPLE_DOUBLE, _TRIPLE_SINGLE, _DOUBLE, _SINGLE], "c": [r"#[^\n]*+"]},
    "elixir": {"s": [_TRIPLE_DOUBLE, _TRIPLE_SINGLE, r"~[a-zA-Z]/(?:[^/\\\n]|\\.)*+/", _DOUBLE_LINES, r"(?<!\w)\?\\?[\"'#]", _SINGLE],
               "c": [_HASH]},
    "ruby": {"h": [r"(?<![\w\])])<<[~-](?P<u>[\"'`]?)(?P<id>\w+)(?P=u)|<<(?P<v>[\"'`]?)(?P<ie>[A-Z_]\w*)(?P=v)"],
             "s": [_DOUBLE_LINES, _SINGLE_LINES, r"(?<=[\s=(,!~&|;{}\[])/(?![\s=])[^/\\\n]*+(?:\\.[^/\\\n]*+)*+/[a-z]*"],
             "c": [r"(?<![^\n])=begin\b(?:[^\n]++|\n(?!=end))*+(?:\n=end[^\n]*|\Z)", r"(?<![^\n])__END__\s*\n(?:.*+)", _HASH]},
    "go": {"c": [_LINE, _BLOCK], "s": [_DOUBLE, _CHAR, _BACKTICK]},
    "rust": {"c": [_LINE], "n": [r"/\*"], "s": [r'\bb?r(?P<r>#+)"(?:(?!"(?P=r)).)*+"(?P=r)', r'\bb?r"[^"]*+"', _DOUBLE_LINES, _CHAR]},
    "c-sharp": {"c": [_LINE, _BLOCK, r"(?<![^\n])[ \t]*#[^\n]*+"],
                "s": [_RAW_QUOTES, r'(?:@\$?|\$@)"[^"]*+(?:""[^"]*+)*+"', _DOUBLE, _CHAR]},
    "swift": {"c": [_LINE], "n": [r"/\*"], "s": [r'(?P<r>#+)"(?:(?!"(?P=r)).)*+"(?P=r)', _TRIPLE_DOUBLE, _DOUBLE]},
    "php": {"c": [r"\A(?:(?!<\?(?:php|=)).)++(?:<\?(?:php\b|=))?", r"<\?(?:php\b|=)", r"\?>(?:(?!<\?(?:php|=)).)*+(?:<\?(?:php\b|=))?",
                  r"//(?:(?!\?>)[^\n])*+", _BLOCK, r"#(?!\[)(?:(?!\?>)[^\n])*+"],
            "s": [r"<<<[ \t]*(?P<u>[\"']?)(?P<id>\w+)(?P=u)\n(?:(?!^[ \t]*(?P=id)\b).)*+^[ \t]*(?P=id)\b", _DOUBLE_LINES, _SINGLE_LINES]},
    "dart": {"c": [_LINE], "n": [r"/\*"], "s": [r"\br(?:" + r'"""(?:(?!""").)*+"""' + r"|'''(?:(?!''').)*+'''" + r'|"[^"\n]*+"|' + r"'[^'\n]*+')",
                                               _TRIPLE_DOUBLE, _TRIPLE_SINGLE, _DOUBLE, _SINGLE]},
    "perl": {"h": [r"<<~?(?P<u>[\"'])(?P<id>[^\"'\n]+)(?P=u)|<<~?(?P<ie>[A-Z_]\w*)"],
             "s": [r"\$#", _DOUBLE_LINES, _SINGLE_LINES],
             "c": [r"(?<![^\n])=[a-zA-Z]\w*\b(?:[^\n]++|\n(?!=cut))*+(?:\n=cut[^\n]*|\Z)", r"(?<![^\n])__(?:END|DATA)__\s*\n(?:.*+)", _HASH]},
    "lua": {"c": [r"--\[(?P<x>=*)\[(?:(?!\](?P=x)\]).)*+(?:\](?P=x)\]|\Z)", r"--[^\n]*+"],
            "s": [r"\[(?P<y>=*)\[(?:(?!\](?P=y)\]).)*+(?:\](?P=y)\]|\Z)", _DOUBLE, _SINGLE]},
    "r": {"c": [r"#[^\n]*+"], "s": [r"\b[rR]\"\((?:(?!\)\").)*+\)\"", _DOUBLE_LINES, _SINGLE_LINES]},
    "erlang": {"c": [r"%[^\n]*+"], "s": [r"\$\\?[^\n]", _DOUBLE_LINES, _SINGLE]},
    "haskell": {"c": [r"(?<![!#$%&*+./<=>?@\\^|~:-])--+(?![!#$%&*+./<=>?@\\^|~:])[^\n]*+", r"(?<![^\n])#[^\n]*+"], "n": [r"\{-"],
                "s": [_DOUBLE, r"(?<![\w'])" + _CHAR]},
    "scala": {"c": [_LINE], "n": [r"/\*"], "s": [_TRIPLE_DOUBLE, _DOUBLE, _CHAR]},
    "java": {"c": [_LINE, _BLOCK], "s": [_TRIPLE_DOUBLE, _DOUBLE, _CHAR]},
    "javascript": {"c": [_LINE, _BLOCK], "s": [_DOUBLE, _SINGLE, _BACKTICK]},
    "typescript": {"c": [_LINE, _BLOCK], "s": [_DOUBLE, _SINGLE, _BACKTICK]},
    "c": {"c": [_LINE, _BLOCK, r"(?<![^\n])[ \t]*#(?:[^\n\\]|\\.)*+"], "s": [_DOUBLE, _CHAR]},
    "cpp": {"c": [_LINE, _BLOCK, r"(?<![^\n])[ \t]*#(?:[^\n\\]|\\.)*+"], "s": [_DOUBLE, _CHAR]},
    "kotlin": {"c": [_LINE], "n": [r"/\*"], "s": [_TRIPLE_DOUBLE, _DOUBLE, _CHAR]},
    "bash": {"c": [_HASH], "s": [_DOUBLE_LINES, r"'[^']*+'"]},
}
NESTED = {"/*": re.compile(r"/\*|\*/"), "{-": re.compile(r"\{-|-\}")}


def mask_pattern(language: str) -> re.Pattern:
    """One alternation; the group of a token that matched is its kind. The first alternative wins, in this order."""
    kinds = MASKS[language]
    return re.compile("|".join(f"(?P<k{kind}>{'|'.join(kinds[kind])})" for kind in "chns" if kind in kinds), re.S | re.M)


def rules_for(extended: bool = False) -> dict[str, list[Rule]]:
    return {**RULES, **EXTENDED_RULES} if extended else RULES
