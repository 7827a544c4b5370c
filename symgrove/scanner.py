"""Definitions in one text: mask, nesting, heads, extents.

The helper that ``operators.symbols`` applies to each file of an Arrow batch.
Strings and comments are masked, length for length. One fold over the text's
brackets and block words gives each opener its closer and each place the
opener around it. Heads are patterns over the masked text, wherever on a line
they stand; extents follow the nesting. Offsets are characters until the end.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np

from symgrove import rules as ru

_BLANK, _MARKED = re.compile(r"[^\n]"), "\x01"
_TYPE_HEAD = re.compile(rf"(?<![:,\w.])\s*\b(?:class|interface|struct|record|enum|mixin|extension|trait|protocol|@interface)\s+(?:type\s+|class\s+|struct\s+)?({ru.NAME})")
_OPENERS, _CLOSERS = "([{", ")]}"
# Fixed spellings: words after which an expression or a signature goes on.
_SIGNATURE_GOES_ON = re.compile(r"\s*(?:\{|->|where\b|throws\b|rethrows\b|async\b)")
_HEADER_GOES_ON = re.compile(r"\s*(?:\{|extends\b|with\b|derives\b|\(|:\s)")
_VALUE_GOES_ON = re.compile(r"(?:[+\-*/^|&<>=~,%]|%[^%\n]*%)\s*\Z")

Found = tuple[str, str, int, int]      # tag, name, start, end


@functools.cache
def _compiled(language: str, extended: bool) -> tuple[re.Pattern, re.Pattern, list]:
    words = ru.BLOCK_WORDS.get(language)
    events = re.compile(r"[()\[\]{}]" + (f"|{words}" if words else ""))
    return ru.mask_pattern(language), events, [(rule, rule.compiled()) for rule in ru.rules_for(extended)[language]]


def masked(text: str, pattern: re.Pattern, language: str) -> str:
    """Comments as blanks, strings as ``\\x02\\x01...``; a string has no line ends, a comment keeps its own."""
    out, at, heredocs = [], 0, []

    def blank(piece: str) -> str:
        return _BLANK.sub(" ", piece)

    while True:
        m = pattern.search(text, at)
        line = text.find("\n", at) if heredocs else -1
        if heredocs and line >= 0 and (m is None or m.start() > line):
            end = line + 1
            for close in heredocs:       # bodies follow the line, one after another
                found = close.search(text, end)
                end = found.end() if found else len(text)
            out += [text[at:line + 1], blank(text[line + 1:end])]
            at, heredocs = end, []
            continue
        if m is None:
            out.append(text[at:])
            return "".join(out)
        kind, end = m.lastgroup, m.end()
        groups = m.groupdict()
        kind = next(k for k in ("kc", "kh", "kn", "ks") if groups.get(k) is not None)
        out.append(text[at:m.start()])
        if kind == "kn":
            depth = 1
            while depth and (step := ru.NESTED[m[0]].search(text, end)):
                depth += 1 if step[0] == m[0] else -1
                end = step.end()
            end = len(text) if depth else end
        elif kind == "kh":
            name = groups.get("id") or groups.get("ie")
            loose = r"[ \t]*" if groups.get("id") or m[0][2:3] in "~-" else ""
            heredocs.append(re.compile(rf"^{loose}{re.escape(name)}\r?$", re.M))
        piece = text[m.start():end]
        out.append(blank(piece) if kind in ("kc", "kn") else "\x02" + _MARKED * (len(piece) - 1))
        at = end


class Scan:
    """A masked text and its nesting."""

    def __init__(self, text: str, language: str, extended: bool = False):
        self.language = language
        pattern, events, self.rules = _compiled(language, extended)
        self.text, self.code = text, masked(text, pattern, language)
        self.end = len(self.code.rstrip())
        self.closer: dict[int, int] = {}            # of each opener: where its closer ends
        self._at: list[int] = []                    # events, and the innermost opener after each
        self._inside: list[int] = []
        self._fold(events)

    def _fold(self, events: re.Pattern) -> None:
        stack: list[tuple[int, str]] = []
        code, language = self.code, self.language
        for m in events.finditer(code):
            word, at = m[0], m.start()
            if word in _OPENERS:
                stack.append((at, word))
            elif word in _CLOSERS or word in ("end", "until"):
                wanted = {")": "(", "]": "[", "}": "{"}.get(word)
                for i in range(len(stack) - 1, -1, -1):
                    # A bracket closes its own kind, a word the last word; what is open inside was never closed.
                    if stack[i][1] == wanted or (wanted is None and stack[i][1] not in _OPENERS):
                        self.closer[stack[i][0]] = m.end()
                        del stack[i:]
                        break
                    if wanted is not None and stack[i][1] not in _OPENERS:
                        break
            elif language != "ruby" or self._opens(word, at, stack):
                stack.append((at, word))
            self._at.append(at)
            self._inside.append(stack[-1][0] if stack else -1)

    def _opens(self, word: str, at: int, stack: list[tuple[int, str]]) -> bool:
        """Ruby: whether a word opens a block, and is no modifier, loop mark or endless method."""
        line = self.code.rfind("\n", 0, at) + 1
        if word in ("if", "unless", "while", "until"):
            before = self.code[line:at]
            return not before.strip() or ru.BEFORE_VALUE.search(before) is not None
        if word == "do" and stack and stack[-1][1] in ("while", "until", "for") and stack[-1][0] >= line:
            return False
        return not (word == "def" and ru.ENDLESS.match(self.code, at))

    def owner(self, at: int) -> int:
        """The innermost opener around a place, or -1."""
        i = bisect_right(self._at, at - 1) - 1
        return self._inside[i] if i >= 0 else -1

    def end_of(self, opener: int) -> int:
        return self.closer.get(opener, self.end)

    def type_name(self, opener: int) -> str | None:
        """Name of the type whose body a brace opens."""
        if opener < 0 or self.code[opener] != "{":
            return None
        head = max(self.code.rfind(c, 0, opener) for c in ";{}") + 1
        found = _TYPE_HEAD.search(self.code[head:opener])
        return found[1] if found else None

    def trimmed(self, begin: int, end: int) -> int:
        """The end without the white space before it."""
        return begin + len(self.code[begin:end].rstrip())

    def indent(self, at: int) -> int:
        line = self.code.rfind("\n", 0, at) + 1
        return len(re.match(r"[ \t]*", self.code[line:])[0].expandtabs(8)) if line < len(self.code) else 0

    def in_macro(self, at: int) -> bool:
        """Rust: whether a place lies in the tokens of a macro."""
        opener = self.owner(at)
        while opener >= 0:
            if re.search(r"(?:\w!|\bmacro_rules!\s*\w+)\s*\Z", self.code[max(opener - 200, 0):opener]):
                return True
            opener = self.owner(opener)
        return False


# --- where definitions end --------------------------------------------------------

_STOP = re.compile(r"[()\[\]{};\n]|=>")


def _walk(scan: Scan, at: int) -> Iterator[re.Match]:
    """Marks from a place on, without those inside brackets; the caller leaves at a closer."""
    while m := _STOP.search(scan.code, at):
        yield m
        at = scan.end_of(m.start()) if m[0] in _OPENERS else m.end()


def _block_end(scan: Scan, begin: int, at: int) -> tuple[int, bool]:
    """(end, whether there is a block) of a definition with a block or without."""
    by_line = scan.language in ("swift", "go")
    arrow = False
    for m in _walk(scan, at):
        if m[0] == "{" and not arrow:
            if not (scan.language == "go" and re.search(r"\b(?:interface|struct)\s*\Z", scan.code[max(at, m.start() - 20):m.start()])):
                return scan.end_of(m.start()), True
        elif m[0] == "=>":
            arrow = scan.language in ("c-sharp", "dart")
        elif m[0] == ";":
            return (scan.trimmed(begin, m.start()) if by_line else m.end()), arrow
        elif m[0] in _CLOSERS:
            return scan.trimmed(begin, m.start()), False
        elif m[0] == "\n" and by_line and not _SIGNATURE_GOES_ON.match(scan.code, m.end()):
            return scan.trimmed(begin, m.start()), False
    return scan.trimmed(begin, len(scan.code)), False


def _value_end(scan: Scan, begin: int, at: int, indent: int | None = None) -> int:
    """The end of an expression: of its line, or of the lines that go on from it, within its block."""
    opener = scan.owner(begin)
    limit = scan.end_of(opener) - 3 if opener >= 0 and scan.code[opener] not in _OPENERS else len(scan.code)
    while (blank := re.compile(r"\s*").match(scan.code, at).end()) > at:
        at = blank
    for m in _walk(scan, at):
        if m.start() >= limit:
            break
        if m[0] in _CLOSERS or m[0] == ";":
            return scan.trimmed(begin, m.start())
        if m[0] == "\n":
            following = re.compile(r"\s*").match(scan.code, m.end()).end()
            deeper = indent is not None and following < len(scan.code) and scan.indent(following) > indent
            if not deeper and (indent is not None or not _VALUE_GOES_ON.search(scan.code[max(m.start() - 80, at):m.start()])):
                return scan.trimmed(begin, m.start())
    return scan.trimmed(begin, limit)


def _scala_end(scan: Scan, tag: str, begin: int, at: int) -> int | None:
    """Scala, Kotlin: a block, a value after ``=``, or a header alone; a method without body is no definition in Scala."""
    indent = scan.indent(begin)
    after = re.compile(r"=(?![>=])|:[ \t]*\n")
    while True:
        m = re.compile(r"[()\[\]{};\n]|=(?![>=])|=>|:[ \t]*\n").search(scan.code, at)
        if m is None:
            end = scan.trimmed(begin, len(scan.code))
            break
        if m[0] == "{":
            return scan.end_of(m.start())
        if m[0] in "([":
            at = scan.end_of(m.start())
            continue
        if after.fullmatch(m[0]):
            return _value_end(scan, begin, m.end(), indent)
        if m[0] == "=>" or (m[0] == "\n" and _HEADER_GOES_ON.match(scan.code, m.end())):
            at = m.end()
            continue
        end = scan.trimmed(begin, m.start())
        break
    return None if tag == "function" and scan.language == "scala" else end


def _do_end(scan: Scan, begin: int, at: int) -> int:
    """Elixir: a do block, a ``do:`` value, or a head alone."""
    m = re.compile(r"\s*(?=\()").match(scan.code, at)
    at = scan.end_of(m.end()) if m else at
    found = re.compile(r"\bdo\b(:?)|\n(?=[ \t]*(?:\n|@|def|end\b))|[;)\]}]").search(scan.code, at)
    if found and found[0] == "do":
        return scan.end_of(found.start())
    if found and found[0] == "do:":
        return _value_end(scan, begin, found.end(), scan.indent(begin))
    return scan.trimmed(begin, found.start() if found else len(scan.code))


def _by_rules(scan: Scan) -> Iterator[Found]:
    for rule, pattern in scan.rules:
        for m in pattern.finditer(scan.code):
            groups = m.groupdict()
            begin = m.start("d") if "d" in groups else m.start("n") if scan.language == "r" else m.start()
            begin = m.start("o") if rule.end == "word" and "d" not in groups else begin
            name, at = scan.text[m.start("n"):m.end("n")], m.end()
            owner = scan.owner(begin)
            if not _placed(scan, rule, m, owner, name):
                continue
            if rule.end == "match":
                yield rule.tag, name, begin, at
            elif rule.end == "head":
                at = scan.code.index("(", m.end("n"))
                yield rule.tag, name, begin, scan.end_of(at)
            elif rule.end == "word":
                if scan.language == "ruby" and ru.ENDLESS.match(scan.code, begin):
                    yield rule.tag, name, begin, _value_end(scan, begin, at, scan.indent(begin))
                else:
                    yield rule.tag, name, begin, scan.end_of(m.start("o"))
            elif rule.end == "value":
                at = scan.end_of(scan.code.index("(", at))
                block = re.compile(r"\s*\{").match(scan.code, at)
                yield rule.tag, name, begin, scan.end_of(block.end() - 1) if block else _value_end(scan, begin, at)
            elif rule.end == "do":
                yield rule.tag, name, begin, _do_end(scan, begin, at)
            elif rule.end == "scala":
                end = _scala_end(scan, rule.tag, begin, at)
                if end is not None:
                    yield rule.tag, name, begin, end
            else:
                end, block = _block_end(scan, begin, at)
                if block or rule.where != "body":
                    yield rule.tag, name, begin, end
                if rule.tag == "enum" and block:
                    yield from _variants(scan, begin, end)


def _placed(scan: Scan, rule: ru.Rule, m: re.Match, owner: int, name: str) -> bool:
    """Whether a head stands where its rule wants it."""
    if scan.language == "rust":
        return not scan.in_macro(m.start())
    if rule.where in ("any", "body"):
        return True
    if rule.where == "top":
        return owner < 0
    if rule.where == "code":
        return owner < 0 or scan.code[owner] not in "{("
    if rule.where == "assigned":        # ``=`` names an argument inside a call
        return m["e"] is None or owner < 0 or scan.code[owner] == "{" or (
            scan.code[owner] == "(" and not re.search(r"[\w.)\]]\s*\Z", scan.code[max(owner - 80, 0):owner]))
    enclosing = scan.type_name(owner)
    if rule.where == "type":
        return enclosing is not None
    if rule.where == "own":
        return enclosing == name
    # Dart: what follows the parameters tells a function from a call.
    after = scan.code[scan.end_of(scan.code.index("(", m.end("n"))):][:80]
    if re.match(r"\s*(?:(?:async|sync)\*?\s*)?(?:\{|=>)", after):
        return rule.where == "typed" or (enclosing != name and (owner < 0 or scan.code[owner] == "{"))
    return rule.where == "typed" and (enclosing is not None or (owner < 0 and m[0].lstrip().startswith("external"))) \
        and re.match(r"\s*(?:;|native\b)", after) is not None


def _variants(scan: Scan, begin: int, end: int) -> Iterator[Found]:
    """Rust: the variants of an enum, each up to its comma."""
    at = next((m.start() for m in _walk(scan, begin) if m[0] == "{"), None)
    if at is None:
        return
    head = re.compile(rf"\s*(?:#{ru._SQUARE}\s*)*(?P<d>(?:pub(?:\s*\([^)]*\))?\s+)?(?P<n>{ru.NAME}))")
    at += 1
    while m := head.match(scan.code, at):
        stop = re.compile(r"[,(\[{}]|\Z")
        step = stop.search(scan.code, m.end())
        while step[0] and step[0] in _OPENERS:
            step = stop.search(scan.code, scan.end_of(step.start()))
        yield "struct", scan.text[m.start("n"):m.end("n")], m.start("d"), scan.trimmed(m.start("d"), step.start())
        if step[0] != ",":
            return
        at = step.end()


# --- languages whose layout counts ---------------------------------------------------

def _logical_lines(scan: Scan) -> list[tuple[int, int, int]]:
    """(first code character, end, indent) of lines with code that begin outside all brackets."""
    lines, at, joined = [], 0, False
    for line in scan.code.split("\n"):
        body = line.lstrip(" \t\r\f\v")
        end = at + len(line.rstrip())
        if body.strip():
            first = at + len(line) - len(body)
            if joined or scan.owner(first) >= 0:
                if lines:
                    lines[-1] = (lines[-1][0], end, lines[-1][2])
            else:
                lines.append((first, end, len(line[:len(line) - len(body)].replace("\f", "").expandtabs(8))))
            joined = line.rstrip().endswith("\\")
        at += len(line) + 1
    return lines


def _python(scan: Scan) -> Iterator[Found]:
    head = re.compile(rf"(?:async\s+)?(?:(?P<f>def)|class)\s+(?P<n>{ru.NAME})")
    open_: list[tuple[int, str, str, int]] = []        # indent, tag, name, start
    last = 0
    for first, end, indent in _logical_lines(scan):
        while open_ and indent <= open_[-1][0]:
            _, tag, name, start = open_.pop()
            yield tag, name, start, last
        last = scan.trimmed(first, end)
        while scan.code[last - 1:last] == ";":
            last = scan.trimmed(first, last - 1)
        if m := head.match(scan.code, first):
            open_.append((indent, "function" if m["f"] else "class", scan.text[m.start("n"):m.end("n")], first))
    for _, tag, name, start in reversed(open_):
        yield tag, name, start, last


def _erlang(scan: Scan) -> Iterator[Found]:
    """Forms end at a dot; clauses of a function form at a semicolon outside of all blocks."""
    attribute = re.compile(r"\s*-\s*(?:(?P<define>define)\s*\(\s*(?P<a>\w+)\s*\(|(?P<record>record)\s*\(\s*(?P<b>[a-z][\w@]*)|"
                           r"(?:spec|callback)\s*\(?\s*(?P<c>[a-z][\w@]*)\s*\()")
    clause = re.compile(r"\s*(?P<n>[a-z][\w@]*)\s*(?=\()")
    mark = re.compile(r"\.(?=\s|\Z)|;|->")
    begin, arrow, form = 0, False, True
    for m in mark.finditer(scan.code):
        if scan.owner(m.start()) >= 0:
            continue
        if m[0] == "->":
            arrow = True
            continue
        head = attribute.match(scan.code, begin) if form else None
        if head is None and (c := clause.match(scan.code, begin)) and arrow:
            yield "function", c["n"], c.start("n"), scan.trimmed(c.start("n"), m.start())
        is_attribute = re.compile(r"\s*-").match(scan.code, begin) is not None if form else False
        if is_attribute and m[0] == ";":
            continue                                     # further clauses of a specification
        if head:
            tag, name = ("macro", head["a"]) if head["define"] else ("struct", head["b"]) if head["record"] \
                else ("interface", head["c"])
            start = scan.code.index("-", begin)
            yield tag, name, start, scan.trimmed(start, m.start())
        begin, arrow, form = m.end(), False, m[0] == "."


def _haskell(scan: Scan) -> Iterator[Found]:
    """Top-level declarations: from a line that is not indented to the next such line."""
    starts = [m.start() for m in re.finditer(r"^(?=\S)", scan.code, re.M)] + [len(scan.code)]
    data = re.compile(r"(?P<k>data|newtype|class)\s+(?!instance\b|family\b)(?:[^=]*?=>\s*)?(?P<n>[A-Z][\w']*)")
    name = re.compile(r"(?!(?:module|import|where|type|instance|data|newtype|class|infix[lr]?|deriving|if|then|else|case|"
                      r"of|let|in|do|foreign|default|pattern)\b)(?P<n>[^\W\dA-Z][\w']*)")
    for begin, stop in zip(starts, starts[1:]):
        end = scan.trimmed(begin, stop)
        if m := data.match(scan.code, begin):
            yield "interface" if m["k"] == "class" else "struct", m["n"], begin, end
        elif m := name.match(scan.code, begin):
            at, patterns = m.end(), False
            for sign in re.compile(r"[(\[{]|[!#$%&*+./<=>?@\\^|~:-]+|[^\s()\[\]{}!#$%&*+./<=>?@\\^|~:-]+").finditer(scan.code, at, end):
                if sign.start() < at:
                    continue
                if sign[0] in _OPENERS:
                    at, patterns = scan.end_of(sign.start()), True
                elif sign[0] == "::":
                    if not patterns:
                        yield "function", m["n"], begin, end
                    break
                elif sign[0] in ("=", "|"):
                    if patterns:
                        yield "function", m["n"], begin, end
                    break
                elif sign[0] in ("@", "~", "!"):
                    continue
                elif re.fullmatch(r"[!#$%&*+./<=>?\\^|:-]+", sign[0]) or sign[0].startswith("`") or sign[0].startswith(","):
                    break                                # an operator is defined, or several names are typed
                else:
                    patterns = True


_BY_LAYOUT = {"python": _python, "erlang": _erlang, "haskell": _haskell}


def definitions(text: str, language: str, extended: bool = False) -> list[tuple[str, str, int, int, str]]:
    """(tag, name, start byte, end byte, source) of all definitions of a text, by start."""
    scan = Scan(text, language, extended)
    found = sorted(set(_BY_LAYOUT.get(language, _by_rules)(scan)), key=lambda d: (d[2], -d[3], d[0], d[1]))
    if text.isascii():
        return [(tag, name, start, end, text[start:end]) for tag, name, start, end in found]
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    return [(tag, name, int(upto[start]), int(upto[end]), text[start:end]) for tag, name, start, end in found]
