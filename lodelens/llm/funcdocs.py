"""Functions paired with their documentation.

Method. Chunks are lexed (comments and strings told from code), signatures found, and each function's own
documentation taken: the string that opens a Python body; elsewhere the comment right above, annotations passed over, which may lie
at the end of the chunk that ends on the line before. Class headers give the class hierarchy; a method whose own
documentation is missing, trivial or asks to be inherited takes that of the method it overrides, by joins repeated up the
hierarchy. What stays empty or trivial is dropped.

Scale. One Arrow pass over the chunks; only rows for found functions, for comments at chunk ends and for class headers
leave it. Joins are on (project, path, line) and (project, class, method). Each round of inheritance moves only the
methods still without documentation.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodelens import shared

# Extensions and language names, and the family whose lexing rules they follow.
FAMILY = {
    "py": "python", "pyi": "python", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "js", "tsx": "js",
    "java": "java", "kt": "java", "cs": "cs", "go": "go", "rs": "rust", "rb": "ruby", "c": "c", "h": "c", "cc": "c",
    "cpp": "c", "hpp": "c",
    "python": "python", "javascript": "js", "typescript": "js", "csharp": "cs", "c#": "cs", "golang": "go", "rust": "rust",
    "ruby": "ruby", "c++": "c",
}
# Where the signature has no def, func, fn, fun or function before the name, the words that are none. In
# JavaScript any word may name a method; these open statements that look like one.
RESERVED = {
    "js": set("case catch for function if switch while with".split()),
    "java": set(
        "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for"
        " goto if implements import instanceof int interface long native new package private protected public return short static strictfp"
        " super switch synchronized this throw throws transient try void volatile while true false null".split()
    ),
    "cs": set(
        "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event"
        " explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null"
        " object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static"
        " string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while".split()
    ),
    "c": set(
        "auto break case catch char const continue default do double else enum extern float for goto if inline int long register restrict"
        " return short signed sizeof static struct switch typedef union unsigned void volatile while".split()
    ),
}
_STRING = r'"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)|\'(?:\\.|[^\'\\\n])*(?:\'|(?=\n)|\Z)'
_C_COMMENT = r"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))"
_LEX = {
    "python": re.compile(r'(?P<c>#[^\n]*)|[rRbBuUfF]{0,2}(?P<q>"""|\'\'\')(?:\\.|(?!(?P=q)).)*(?:(?P=q)|\Z)|' + _STRING, re.S),
    "ruby": re.compile(r"(?P<c>^=begin\b.*?(?:^=end[^\n]*|\Z)|\#(?!\{)[^\n]*)|" + _STRING, re.S | re.M),
    "js": re.compile(_C_COMMENT + r"|`(?:\\.|[^`\\])*(?:`|\Z)|" + _STRING, re.S),
    "go": re.compile(_C_COMMENT + r"|`[^`]*(?:`|\Z)|" + _STRING, re.S),
    "rust": re.compile(_C_COMMENT + r"|\"(?:\\.|[^\"\\])*(?:\"|\Z)|'(?:\\[^\n]{1,8}?|[^'\\\n])'", re.S),
    "java": re.compile(_C_COMMENT + r'|"""(?:\\.|[^\\])*?(?:"""|\Z)|' + _STRING, re.S),
    "cs": re.compile(_C_COMMENT + r'|[$@]*@[$@]*"(?:""|[^"])*(?:"|\Z)|' + _STRING, re.S),
    "c": re.compile(_C_COMMENT + r"|" + _STRING, re.S),
}
_ARGS = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
_TYPE = r"[\w$.]+(?:\s*<[^;{}()]*>)?(?:\s*\[\s*\])*(?:\s*[?*&]+)?"
_SIGNATURE = {
    "python": re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<n>\w+)[ \t]*(?:\[[^\]]*\])?\(", re.M),
    "ruby": re.compile(r"^[ \t]*(?:(?:private|protected|public|module_function|private_class_method)[ \t]+)?def[ \t]+(?:[\w:]+\.)?(?P<n>\w+[?!=]?|[-+*/%<>=!\[\]~^&|]+)(?=[ \t(;\n=]|\Z)", re.M),
    "go": re.compile(r"^[ \t]*func[ \t]+(?:\([^)]*\)[ \t]*)?(?P<n>\w+)[ \t]*(?:\[[^\]]*\])?\(", re.M),
    "rust": re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+\S+)?)\s+)*fn\s+(?P<n>(?:r#)?\w+)\s*[<(]", re.M),
    "js": re.compile(
        r"^[ \t]*(?:(?:@\w[\w.]*(?:\([^()\n]*\))?)[ \t]+)*(?:"
        r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*(?P<n>[\w$]+)\s*(?:<[^;{}]*?>)?\s*\("
        r"|(?:export\s+)?(?:const|let|var)\s+(?P<n2>[\w$]+)\s*(?::[^=;\n]+)?=\s*(?:async\s*)?(?:function\b\s*\*?\s*[\w$]*\s*\(|(?:<[^;{}=]*>\s*)?" + _ARGS + r"\s*(?::[^=;{}\n]+|:\s*\{[^}]*\})?\s*=>|[\w$]+\s*=>)"
        r"|(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set|declare)\s+)*\*?\s*#?(?P<n3>[\w$]+)\s*\??(?:<[^;{}()]*>)?\s*" + _ARGS + r"\s*(?::\s*[^;{}=\n]+)?\s*\{"
        r"|(?:(?:public|private|protected|static|readonly|override)\s+)*#?(?P<n4>[\w$]+)\s*(?::[^=;\n]+)?=\s*(?:async\s*)?" + _ARGS + r"\s*(?::[^=;{}\n]+)?\s*=>\s*\{"
        r")",
        re.M,
    ),
    "java": re.compile(
        r"^[ \t]*(?:@[\w.]+(?:\([^()\n]*\))?[ \t]+)*(?:(?:public|private|protected|static|final|abstract|native|synchronized|default|strictfp|open|override|suspend|inline)\s+)*"
        r"(?:<[^;{}()]*>\s*)?(?:(?!return\b|new\b|else\b|throw\b|package\b|import\b)" + _TYPE + r"\s+)?(?P<n>[\w$]+)\s*" + _ARGS + r"\s*(?:throws\s+[\w.,\s]+?)?\s*(?P<e>\{|;)",
        re.M,
    ),
    "cs": re.compile(
        r"^[ \t]*(?:\[[^\]\n]*\][ \t]*)*(?:(?:public|private|protected|internal|static|virtual|override|abstract|sealed|async|extern|unsafe|partial|new|readonly)\s+)*"
        r"(?:(?!return\b|new\b|else\b|throw\b|using\b|namespace\b|await\b)(?:\([^()]*\)|" + _TYPE + r")\s+)?(?:[\w.]+\.)?(?P<n>\w+)\s*(?:<[^;{}()]*>)?\s*" + _ARGS + r"\s*(?::\s*(?:base|this)\s*" + _ARGS + r"\s*)?(?:where\s[^{;=]+)?\s*(?P<e>\{|=>|;)",
        re.M,
    ),
    "c": re.compile(
        r"^(?:template\s*<[^;{}]*>\s*)?[ \t]*(?!return\b|else\b|typedef\b|case\b|goto\b)(?:[\w:~]+(?:\s*<[^;{}()]*>)?[\s*&]+)+(?:\w+::)*(?P<n>~?\w+)\s*" + _ARGS + r"(?:\s*(?:const|noexcept|override|final|__attribute__\s*" + _ARGS + r"))*\s*\{",
        re.M,
    ),
}
_CLASS = {
    "python": re.compile(r"^[ \t]*class[ \t]+(\w+)[ \t]*(?:\[[^\n]*?\][ \t]*)?(?:\(((?:[^()]|\([^()]*\))*)\))?[ \t]*:", re.M),
    "ruby": re.compile(r"^[ \t]*(?:class|module)[ \t]+([\w:]+)(?:[ \t]*<[ \t]*([\w:]+))?", re.M),
    "js": re.compile(r"\b(?:class|interface)\s+([\w$]+)(?:\s*<[^{}]*?>)?((?:\s+(?:extends|implements)\s+[^{]+)?)\s*\{"),
    "java": re.compile(r"\b(?:class|interface|enum|record)\s+(\w+)(?:\s*<[^{}]*?>)?(?:\([^)]*\))?((?:\s+(?:extends|implements)\s+[^{]+)?)\s*\{"),
    "cs": re.compile(r"\b(?:class|interface|struct|record)\s+(\w+)(?:\s*<[^{}]*?>)?((?:\s*:\s*[^{]+)?)\s*\{"),
    "rust": re.compile(r"\b(?:impl|trait)(?:\s*<[^{}]*?>)?\s+(?:([\w:]+)(?:<[^{}]*?>)?\s+for\s+)?(\w+)"),
    "c": re.compile(r"\b(?:class|struct)\s+(\w+)(?:\s+final)?((?:\s*:\s*[^{;]+)?)\s*\{"),
}
# Families in which a class is whole in one file, so that a base class of that file is the one meant.
IN_FILE = ("python", "js", "java")
_ANNOTATION = {
    "java": re.compile(r"@\w[\w.]*(?:\s*\(.*\))?\s*$", re.S),
    "js": re.compile(r"@\w[\w.]*(?:\s*\(.*\))?\s*$", re.S),
    "cs": re.compile(r"(?:\[.*\]\s*)+$", re.S),
    "rust": re.compile(r"#!?\[.*\]\s*$", re.S),
    "c": re.compile(r"(?:__attribute__\s*\(.*\)|\[\[.*\]\]|template\s*<.*>|(?:static|inline|extern|const)\b[\w\s*]*)\s*$", re.S),
    "go": re.compile(r"(?!)"),
    "ruby": re.compile(r"(?:sig\s*\{.*\}|private|public|protected|module_function|memoize)\s*$", re.S),
}
_DOC_ATTRIBUTE = re.compile(r'#!?\[\s*doc\s*=\s*r?#*"((?:\\.|[^"\\])*)"#*\s*\]')
_STRING_HEAD = re.compile(r"([rRuU]?)(\"\"\"|'''|\"|')")

# -- what a documentation says --------------------------------------------------------------------
_INHERIT = re.compile(r"\{?@inherit[dD]oc\}?|<inheritdoc\b[^>]*/?>|:inherited-members:|@see\s+super\b", re.I)
_XML_TAGS = re.compile(r"<(param|typeparam|returns|value|paramref)\b[^>]*(?:/>|>.*?(?:</\1>|\Z))", re.S | re.I)
_MARKUP = re.compile(r"</?(?:summary|remarks|para|c|code|see|seealso|exception|permission|b|i|p|br|ul|li|example|inheritdoc)\b[^>]*>", re.I)
#: Tags of parameters and returned values: their text goes with them.
_TAG = re.compile(
    r"^[ \t]*(?:[@\\](?:param(?:eter)?s?|arg|argument|returns?|retval|rtype|type|types|tparam|typeparam|template|yields?|yieldparam|yieldreturn|property|prop|option)\b"
    r"|:(?:param|parameter|arg|argument|key|keyword|type|vartype|returns?|rtype|yields?|ytype|meta)\b[^:\n]*:"
    r"|(?:Args|Arguments|Parameters|Params|Returns?|Yields|Keyword Args|Attributes)\s*:[ \t]*$)",
    re.I,
)
_SECTION = re.compile(r"^[ \t]*(?:Parameters|Returns|Yields|Other Parameters|Attributes)[ \t]*\n[ \t]*-{3,}[ \t]*$(?:\n(?!\s*\n[ \t]*\S+[ \t]*\n[ \t]*-{3,}).*)*", re.M)
#: Other tags: only their word goes.
_BULLET = re.compile(
    r"^[ \t]*\\(?:brief|short|details?|note|remark)\b|^[ \t]*@(?:brief|short|details?|summary|description|desc|fileoverview)\b"
    r"|^[ \t]*[@\\](?:throws?|raises?|exception|see|since|author|version|deprecated|override|this|public|private|protected|static|async|overload|inheritdoc|internal|api|todo)\b"
    r"|^[ \t]*:(?:raises?|except|exception)\b|^[ \t]*(?:Raises|Throws)\s*:[ \t]*$",
    re.M | re.I,
)
#: Directives by their exact writing; a sentence that begins with the name of a tool is none.
_DIRECTIVE = re.compile(
    r"^[ \t]*(?:eslint-(?:disable|enable|env)\b.*|eslint[ \t]+[\"']?[\w@/-]+[\"']?[ \t]*:[ \t]*(?:[012\[\"']|off\b|warn\b|error\b).*|tslint:(?:disable|enable)\b.*|jshint\s+(?:ignore:|[\w-]+\s*:).*|jslint\s+\w+\s*(?:[:,].*)?|stylelint-(?:disable|enable)\b.*"
    r"|globals?[ \t]+[\w$]+[ \t]*(?::[ \t]*\w+[ \t]*)?(?:,\s*[\w$]+[ \t]*(?::[ \t]*\w+[ \t]*)?)*|@ts-(?:ignore|expect-error|nocheck|check)\b.*|prettier-ignore(?:-start|-end|-attribute)?\s*(?:[-:(].*)?"
    r"|istanbul ignore (?:next|if|else|file)\b.*|(?:c8|v8) ignore (?:next|start|stop|file|if|else)\b.*|biome-ignore\S*\s+(?:lint|format|assist|syntax)\b.*|@(?:no)?flow(?:[ \t]+strict(?:-local)?)?[ \t]*|@jsx\w*[ \t]+\S+[ \t]*|@format\s*|@preserve\b.*|@license\b.*"
    r"|[nN][oO][qQ][aA](?:\s*:.*)?\s*|type:\s*ignore(?:\[[^\]\n]*\])?\s*(?:#.*)?|pylint:\s*(?:disable|enable|skip-file)\b.*|flake8\s*[:=]\s*noqa\b.*|mypy:\s*(?:[a-z]+(?:-[a-z]+)+|strict)\s*(?:[=,].*)?|pyright:\s*(?:ignore|basic|strict|standard|report\w+)\b.*"
    r"|ruff:\s*(?:noqa|isort|ignore|enable|disable)\b.*|fmt:\s*(?:on|off|skip)\s*|isort:\s*(?:skip|skip_file|on|off|split)\b.*|pragma:\s*no[ -]?(?:cover|branch|mutate)\b.*|\#\s*pragma\s+\w+.*|yapf:\s*(?:disable|enable)\b.*"
    r"|\#?nosec(?:\s+[BG]\d+.*|\s*[:#].*)?\s*|pydocstyle:\s*noqa\b.*|coverage:\s*(?:ignore|exclude|on|off)\b.*"
    r"|clang-format\s+(?:on|off)\b.*|NOLINT(?:NEXTLINE|BEGIN|END)?\b.*|cppcheck-suppress\S*.*|coverity\s*\[.*|LCOV_EXCL_\w+.*|GCOVR?_EXCL_\w+.*|uncrustify:\s*(?:on|off)\b.*|indent:\s*(?:on|off)\s*|IWYU pragma:.*"
    r"|ReSharper (?:disable|restore|enable)\b.*|(?:StyleCop|SonarLint)\s*:?\s*(?:disable|enable|ignore|on|off)\b.*|NOSONAR\b.*|CHECKSTYLE\s*[:.]\s*[A-Z]+\b.*|@?SuppressWarnings\s*\(.*|noinspection\s+\w+(?:\s*,\s*\w+)*\s*|@formatter:(?:on|off)\b.*|language=\S+.*"
    r"|rubocop:(?:disable|enable|todo)\b.*|steep:ignore\b.*|typed:\s*(?:true|false|strict|strong|ignore)\s*|frozen_string_literal:\s*(?:true|false)\s*|(?:en)?coding:\s*[\w.-]+\s*|:(?:nodoc|nocov|startdoc|stopdoc):(?:\s*all\b)?|standard:\s*(?:disable|enable)\b.*|:?reek:\w+.*"
    r"|nolint(?::\S+)?\s*(?://.*)?|go:[a-z]+\b.*|lint:(?:file-)?ignore\s.*|\+build\s.*|export\s+\w+\s*|revive:(?:disable|enable)\b.*|gosec:\s*(?:disable|ignore)\b.*"
    r"|rustfmt(?:::|-)skip\w*\s*|clippy::\w+\s*|c[sS]pell:\s*(?:ignore|words?|disable|enable|dictionar|language|locale)\S*.*|spell-?checker:\s*(?:ignore|words?|disable|enable)\b.*|codespell:\s*ignore\b.*|(?:vim?|ex):\s*(?:set?\s.*|\w+=.*)|-\*-.*-\*-|\#(?:end)?region\b.*|@generated\b.*|swiftlint:(?:disable|enable)\b.*)$",
    re.M,
)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+")


def strip_marks(comment: str) -> str:
    """A comment's text without its marks."""
    out = []
    for line in comment.split("\n"):
        s = line.strip()
        s = re.sub(r"^(?:/\*+!?<?|//+!?<?|\*+/|=begin\b|=end\b|#+!?|\*(?!/))[ \t]?", "", s)
        if re.match(r"(?://|#)(?:end)?region\b", line.strip()):
            s = "#" + s  # a fold of the editor, told from prose by the missing blank
        s = re.sub(r"\s*\*+/\s*$", "", s)
        out.append(s)
    return "\n".join(out)


def meaning(doc: str) -> str:
    """What a documentation says beyond parameter and return tags and directives to tools."""
    t = _MARKUP.sub(" ", _XML_TAGS.sub(" ", doc.replace("\r\n", "\n").replace("\r", "\n")))
    t = _SECTION.sub("", _INHERIT.sub(" ", t))
    t = _DIRECTIVE.sub("", _BULLET.sub("", t))
    kept, tag_indent = [], None
    for line in t.split("\n"):
        indent = len(line) - len(line.lstrip())
        if _TAG.match(line):
            tag_indent = indent
        elif tag_indent is not None and line.strip() and indent > tag_indent:
            continue
        else:
            tag_indent = None
            kept.append(line)
    return "\n".join(kept).strip()


def name_words(name: str) -> set[str]:
    return {w.lower() for w in _NAME_PART.findall(name)} | {name.lower()}


def is_real(doc: str, name: str) -> bool:
    """At least four words, not only those of the name and "the"."""
    words = [w.lower() for w in _WORD.findall(meaning(doc))]
    return len(words) >= 4 and bool(set(words) - name_words(name) - {"the"})


# -- parsing --------------------------------------------------------------------------------------
class _Text:
    """A lexed chunk: ``code`` has comments and strings blanked, character by character."""

    def __init__(self, text: str, family: str):
        self.text, self.family = text, family
        self.starts = [0]
        self.starts += [m.end() for m in re.finditer(r"\n", text)]
        self.comments: list[tuple[int, int]] = []
        head = 0
        if family not in ("python", "ruby"):
            a, b = text.find("*/"), text.find("/*")
            if a >= 0 and (b < 0 or a < b) and re.match(r"\s*\*", text):
                head = a + 2  # the chunk begins inside a comment
                self.comments.append((0, head))
        parts, last = [_blank(text[:head])], head
        for m in _LEX[family].finditer(text, head):
            if m.lastgroup == "c" or m.group("c") is not None:
                self.comments.append(m.span())
            parts += [text[last : m.start()], _blank(m.group())]
            last = m.end()
        self.code = "".join([*parts, text[last:]])
        self.pairs: dict[int, int] | None = None

    def line_of(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def line(self, i: int) -> tuple[int, int]:
        return self.starts[i], (self.starts[i + 1] - 1 if i + 1 < len(self.starts) else len(self.text))

    def opened_by(self, at: int) -> int:
        """Where the bracket is opened that is closed at ``at``; -1 if it isn't in the chunk."""
        if self.pairs is None:
            self.pairs, open_ = {}, []
            for m in re.finditer(r"[()\[\]]", self.code):
                if m.group() in "([":
                    open_.append(m.start())
                elif open_:
                    self.pairs[m.start()] = open_.pop()
        return self.pairs.get(at, -1)

    def above(self, i: int) -> tuple[str, bool]:
        """The documentation that ends right above line ``i``, and whether it may go on above the chunk."""
        said: list[str] = []
        i -= 1
        ends = {e: s for s, e in self.comments}
        while i >= 0:
            a, b = self.line(i)
            raw = self.text[a:b].rstrip()
            if not raw.strip():
                return "\n".join(said[::-1]), False
            s = ends.get(a + len(raw), ends.get(b))
            if s is not None:
                first = self.line_of(s)
                if self.text[self.starts[first] : s].strip():
                    break  # code stands before the comment
                said.append(strip_marks(self.text[s : a + len(raw)]))
                i = first - 1
                continue
            code = self.code[a:b].strip()
            pattern = _ANNOTATION.get(self.family)
            if code and pattern is not None and pattern.match(code):
                if self.family == "rust" and (d := _DOC_ATTRIBUTE.search(raw)):
                    said.append(d.group(1).replace('\\"', '"'))
                i -= 1
                continue
            if code and code[-1] in ")]" and pattern is not None:  # an annotation over several lines
                at = self.opened_by(a + len(self.code[a:b].rstrip()) - 1)
                j = self.line_of(at) if at >= 0 else i
                if j < i and pattern.match(self.code[self.line(j)[0] : b].strip()):
                    i = j - 1
                    continue
            break
        return "\n".join(said[::-1]), i < 0


def _blank(s: str) -> str:
    return re.sub(r"[^\n]", " ", s)


def _closing(code: str, at: int, pair: str = "()") -> int:
    """Position after the bracket that closes the one at ``at``; -1 if it isn't there."""
    depth = 0
    for m in re.compile("[" + re.escape(pair) + "]").finditer(code, at):
        depth += 1 if m.group() == pair[0] else -1
        if depth == 0:
            return m.end()
    return -1


def _docstring(t: _Text, after: int) -> str:
    """The string that opens the body behind a ``def`` whose bracket is at ``after``."""
    end = _closing(t.code, after)
    if end < 0:
        return ""
    colon = re.compile(r"[^:\n\[\]]*(?:\[(?:[^\[\]]|\[(?:[^\[\]]|\[[^\[\]]*\])*\])*\][^:\n\[\]]*)*:").match(t.code, end)
    if not colon:
        return ""
    at, said = colon.end(), []
    while True:
        while True:
            m = re.compile(r"\s+|#[^\n]*|\\\n").match(t.text, at)
            if not m:
                break
            at = m.end()
        head = _STRING_HEAD.match(t.text, at)
        if not head:
            break
        q = head.group(2)
        body = re.compile(r"((?:\\.|(?!" + q + r").)*)(" + q + r"|\Z)", re.S).match(t.text, head.end())
        raw = body.group(1)
        if len(q) == 1 and "\n" in raw.replace("\\\n", ""):
            break
        said.append(raw)
        at = body.end()
        rest = re.compile(r"[ \t]*").match(t.text, at).end()
        if rest >= len(t.text) or t.text[rest] in "\r\n;#":
            return "".join(said)
        if t.text[rest] not in "\"'rRuU":
            return ""
    return ""


def _body_end(t: _Text, m: re.Match, line: int) -> int:
    """Where a function ends in its chunk: by brackets, or by indentation."""
    if t.family in ("python", "ruby"):
        a, b = t.line(line)
        depth = len(t.code[a:b]) - len(t.code[a:b].lstrip())
        past = _closing(t.code, m.end() - 1) if t.family == "python" else b
        i = t.line_of(past if past > 0 else b)
        for j in range(i + 1, len(t.starts)):
            x, y = t.line(j)
            s = t.code[x:y]
            if s.strip() and len(s) - len(s.lstrip()) <= depth:
                return y if t.family == "ruby" and s.strip().startswith("end") else x
        return len(t.text)
    brace = t.code.find("{", m.start())
    end = _closing(t.code, brace, "{}") if brace >= 0 else -1
    return end if end > 0 else len(t.text)


def _bases(family: str, m: re.Match) -> tuple[str | None, list[str]]:
    if family == "rust":
        return m.group(2), [m.group(1).rsplit("::", 1)[-1]] if m.group(1) else []
    said, before = m.group(2) or "", None
    while said != before:  # type arguments may hold others
        said, before = re.sub(r"<[^<>]*>|\[[^\[\]]*\]|\([^()]*\)", " ", said), said
    if family == "cs":
        said = re.sub(r"\bwhere\b.*", " ", said, flags=re.S)
    said = re.sub(r"\b(?:extends|implements|public|protected|private|virtual)\b", " ", said.lstrip(" \t\r\n:"))
    parts = [x for x in said.split(",") if "=" not in x] if family == "python" else re.split(r"[,\s]+", said)
    names = [x.strip().rsplit(".", 1)[-1].rsplit("::", 1)[-1].strip() for x in parts]
    return m.group(1).rsplit("::", 1)[-1], [x for x in names if re.fullmatch(r"[\w$]+", x) and x != "object"]


def _owners_by_indent(t: _Text, headers: list[re.Match], signatures: list[re.Match]) -> dict[int, str | None]:
    """By line of a signature, the class in whose body it stands; none for a function inside another."""
    opens = {t.line_of(m.start()): (_bases(t.family, m)[0], t.line_of(m.end())) for m in headers}
    for m in signatures:
        past = _closing(t.code, m.end() - 1) if t.family == "python" else -1
        opens[t.line_of(m.start())] = (None, t.line_of(max(past, m.end() - 1)))
    owners: dict[int, str | None] = {}
    around: list[tuple[int, str | None]] = []
    i = 0
    while i < len(t.starts):
        a, b = t.line(i)
        s = t.code[a:b]
        if s.strip():
            indent = len(s) - len(s.lstrip())
            while around and around[-1][0] >= indent:
                around.pop()
            if i in opens:
                name, last = opens[i]
                if name is None:
                    owners[i] = around[-1][1] if around else None
                around.append((indent, name))
                i = max(i, last)
        i += 1
    return owners


_MODIFIER = re.compile(r"(?:public|private|protected|internal|static|virtual|override|abstract|sealed|async|partial|void)\b")


def _may_be_name(t: _Text, m: re.Match, family: str, name: str, symbol: str | None, opened: list[int], bodies: set[int]) -> bool:
    """Whether a reserved word in the place of a name is one. ``opened`` are the brackets around, ``bodies`` those of classes."""
    if family == "java":  # Kotlin
        return bool(re.search(r"\bfun\b(?:\s*<[^;{}()]*>)?\s*$", m.group()[: m.start("n") - m.start()]))
    if family != "js":
        return False
    if not m.group("n3") or m.group()[: m.start("n3") - m.start()].strip():
        return True
    if name == "function":
        return False
    if not opened:
        return bool(symbol) and re.split(r"[.#:]", symbol)[-1] == name
    if opened[-1] in bodies:
        return True
    # in an object: its bracket stands where a value does
    before = t.code[max(0, opened[-1] - 200) : opened[-1]].rstrip()
    line = before.rsplit("\n", 1)[-1]
    return bool(re.search(r"(?:[=(,\[?]|\breturn|\bexport\s+default)$", before)) or (before.endswith(":") and not re.match(r"\s*(?:case|default)\b", line))


def parse(text: str, family: str, symbol: str | None = None):
    """Functions, the comment at the text's end, and class headers of one chunk.

    Functions are (name, class, documentation, goes on above, line, start, end); headers (class, bases).
    """
    t = _Text(text, family)
    classes = list(_CLASS[family].finditer(t.code)) if family in _CLASS else []
    headers = [_bases(family, m) for m in classes]
    signatures = list(_SIGNATURE[family].finditer(t.code))
    by_indent = family in ("python", "ruby")
    by_line = _owners_by_indent(t, classes, signatures) if by_indent and classes else {}
    by_brace = {} if by_indent else {t.code.find("{", m.end() - (family != "rust")): h[0] for m, h in zip(classes, headers)}
    found, opened = [], []
    bodies = {m.end() - 1 for m in re.finditer(r"\bclass\b[^{};]*\{", t.code)} if family == "js" else set()
    braces = re.finditer(r"[{}]", t.code)
    brace = next(braces, None)
    for m in signatures:
        name = next(g for k, g in m.groupdict().items() if k != "e" and g)
        while brace is not None and brace.start() < m.start():
            if brace.group() == "{":
                opened.append(brace.start())
            elif opened:
                opened.pop()
            brace = next(braces, None)
        if name in RESERVED.get(family, ()) and not _may_be_name(t, m, family, name, symbol, opened, bodies):
            continue
        at = m.start() + len(m.group()) - len(m.group().lstrip())
        line = t.line_of(at)
        if m.groupdict().get("e") == ";":
            # without body: a declaration only if it has modifiers or a type before the name
            before = m.group()[: m.start("n") - m.start()].strip()
            if not before or not re.search(r"[\w>\]]$", before) or re.match(r"(?:return|await|throw|new|var|yield)\b", before):
                continue
            if family in ("java", "cs") and not re.search(r"\b(?:abstract|native|extern|public|protected|private|internal|void|int|long|String|string|bool|boolean|double|float)\b", before):
                continue
        if family in ("java", "cs") and m.groupdict().get("e") != ";":
            before = m.group()[: m.start("n") - m.start()].strip()
            if not before and not any(h[0] == name for h in headers):
                continue
            if family == "cs" and name == "when" and not _MODIFIER.match(before):
                continue  # an arm of a switch
        owner = by_line.get(line) if by_indent else by_brace.get(opened[-1]) if opened else None
        if owner is None and symbol and "." in symbol and symbol.rsplit(".", 1)[-1] == name:
            owner = symbol.rsplit(".", 2)[-2]
        if family == "go":
            r = re.match(r"\s*func\s*\(\s*\w*\s*\*?\s*(\w+)", m.group())
            owner = r.group(1) if r else None
        if family == "c" and (r := re.search(r"(\w+)::$", m.group()[: m.start("n") - m.start()])):
            owner = r.group(1)
        if family == "python":
            doc, more = _docstring(t, t.code.index("(", m.end("n"))), False
        else:
            doc, more = t.above(line)
        found.append((name[2:] if name.startswith("r#") else name, owner, doc, more, line, at, _body_end(t, m, line)))
    return found, t, [h for h in headers if h[0]]


def family_of(rel_path: str | None, language: str | None) -> str | None:
    """By extension; where that says nothing, by the language's name."""
    name = (rel_path or "").rsplit("/", 1)[-1]
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return FAMILY.get(ext) or (FAMILY.get((language or "").strip().lower()) if ext in ("", "txt") or len(ext) > 5 else None)


_PARSED = (
    "what string, project_id string, rel_path string, chunk_id string, name string, owner string, said string, inherits boolean,"
    " above boolean, line int, doc string, code string, bases array<string>, in_file boolean"
)


def _parsed(chunks: DataFrame, with_code: bool) -> DataFrame:
    columns = [c.strip().split()[0] for c in _PARSED.split(",")]

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                family = family_of(r.rel_path, r.language)
                if family is None:
                    continue
                text = r.text.replace("\r\n", "\n").replace("\r", "\n")
                found, t, headers = parse(text, family, r.symbol)
                first = None if r.start_line is None or r.start_line != r.start_line else int(r.start_line)
                last = None if r.end_line is None or r.end_line != r.end_line else int(r.end_line)
                for name, owner, doc, more, _, at, end in found:
                    code = text[at:end] if with_code else None
                    rows.append(
                        ("function", r.project_id, r.rel_path, r.chunk_id, name, owner, meaning(doc), bool(_INHERIT.search(doc)),
                         bool(more and first is not None), first, doc, code, None, family in IN_FILE)
                    )
                for name, bases in headers:
                    rows.append(("class", r.project_id, r.rel_path, r.chunk_id, name, None, None, None, None, None, None, None, bases, family in IN_FILE))
                if family != "python" and last is not None and first is not None:
                    lines = text.count("\n") + 1
                    i = lines - 1 if text.endswith("\n") and last - first + 1 < lines else lines
                    doc, _ = t.above(i)
                    if doc:
                        rows.append(("tail", r.project_id, r.rel_path, r.chunk_id, None, None, meaning(doc), bool(_INHERIT.search(doc)), None, last + 1, doc, None, None, None))
            yield pd.DataFrame(rows, columns=columns)

    texts = chunks.where(F.col("text").isNotNull() & F.col("chunk_id").isNotNull() & (F.length("text") > 0))
    texts = texts.select("project_id", "rel_path", "chunk_id", "language", "symbol", "start_line", "end_line", "text")
    return shared.spread(texts).mapInPandas(run, _PARSED)


def _real(said: str, name: str):
    """The test of :func:`is_real` on columns: words of the meaning against those of the name."""
    words = F.transform(F.regexp_extract_all(F.col(said), F.lit(r"([\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*)"), F.lit(1)), F.lower)
    parts = F.transform(
        F.regexp_extract_all(F.col(name), F.lit(r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+)"), F.lit(1)), F.lower
    )
    own = F.concat(parts, F.array(F.lower(name), F.lit("the")))
    return (F.size(words) >= 4) & (F.size(F.array_except(words, own)) > 0)


def function_docs(chunks: DataFrame, with_code: bool = True, inherit: bool = True) -> DataFrame:
    """(project_id, rel_path, chunk_id, func_name, owner, doc, origin, code), one row per function with real documentation.

    ``origin`` is own or inherited, ``code`` null unless asked for. Repeated rows count once. Null, empty and
    non-program texts give nothing; a null line number only prevents looking into the chunk before. Of several
    candidates (two chunks ending on the same line, two classes of one name in a project) the greatest or least text
    counts, whatever the order of rows. The hierarchy is followed to its top; a (method, class) that was visited isn't visited again, so
    circles end. In Python, JavaScript, TypeScript and Java a base class that the file itself has is the one meant; else classes are told apart
    by their name within a project only. Functions inside functions belong to no class.
    """
    parsed = shared.kept(_parsed(chunks, with_code), "parsed")
    functions = parsed.where("what = 'function'").drop("what", "bases").dropDuplicates()
    tails = (
        parsed.where("what = 'tail'").groupBy("project_id", "rel_path", "line").agg(F.max(F.struct("said", "doc", "inherits")).alias("t"))
    )
    waiting = functions.where("above").alias("f").join(
        tails.alias("t"),
        F.col("f.project_id").eqNullSafe(F.col("t.project_id")) & F.col("f.rel_path").eqNullSafe(F.col("t.rel_path")) & (F.col("f.line") == F.col("t.line")),
        "left",
    ).select(
        *[F.col(f"f.{c}") for c in ("project_id", "rel_path", "chunk_id", "name", "owner", "code", "in_file")],
        F.concat_ws("\n", "t.t.said", "f.said").alias("said"),
        F.concat_ws("\n", "t.t.doc", "f.doc").alias("doc"),
        (F.col("f.inherits") | F.coalesce("t.t.inherits", F.lit(False))).alias("inherits"),
    )
    every = functions.where("NOT above").select("project_id", "rel_path", "chunk_id", "name", "owner", "code", "in_file", "said", "doc", "inherits").unionByName(waiting)
    every = every.withColumn("real", _real("said", "name"))
    result = every.where("real").select(
        "project_id", "rel_path", "chunk_id", F.col("name").alias("func_name"), "owner", "doc", F.lit("own").alias("origin"), "code"
    )
    classes = parsed.where("what = 'class'").withColumnRenamed("name", "class")
    edges = classes.select("project_id", "rel_path", "in_file", F.col("class").alias("owner"), F.explode("bases").alias("base")).distinct()
    if not inherit or edges.isEmpty():
        return result.distinct()
    # a class is looked for in the file ``at``, or in the whole project where that is empty
    place = F.when(F.col("in_file"), F.coalesce("rel_path", F.lit(""))).otherwise("")
    here = classes.where("in_file").select("project_id", "rel_path", F.col("class").alias("base")).distinct().withColumn("here", F.lit(True))
    edges = edges.join(here, ["project_id", "rel_path", "base"], "left").select(
        "project_id", "owner", "base", F.when(F.col("here") & (F.col("base") != F.col("owner")), place).otherwise("").alias("base_at"), place.alias("at")
    )
    edges = edges.unionByName(edges.withColumn("at", F.lit(""))).where("base <> owner OR base_at <> at").distinct()
    edges = shared.kept(edges, "hierarchy")
    known = every.where("real AND owner IS NOT NULL").select("project_id", "owner", "name", "doc", place.alias("at"))
    known = known.unionByName(known.withColumn("at", F.lit(""))).groupBy("project_id", "owner", "at", "name").agg(F.min("doc").alias("found"))
    open_ = every.where("NOT real AND owner IS NOT NULL").select("project_id", "rel_path", "chunk_id", "name", F.col("owner").alias("own"), "code", "owner", place.alias("at"))
    known, open_ = shared.kept(known, "known"), shared.kept(open_, "open")
    keys = ["project_id", "rel_path", "chunk_id", "name", "own"]
    visited, step = open_.select(*keys, "owner", "at"), 0
    while not open_.isEmpty():
        up = open_.join(edges, ["project_id", "owner", "at"]).drop("owner", "at").withColumnsRenamed({"base": "owner", "base_at": "at"}).distinct()
        up = _without(up, visited, [*keys, "owner", "at"])
        seen = shared.kept(up.join(known, ["project_id", "owner", "at", "name"], "left"), f"inherit{step}")
        got = shared.kept(seen.where("found IS NOT NULL").groupBy(*keys, "code").agg(F.min("found").alias("doc")), f"inherited{step}")
        result = result.unionByName(
            got.select("project_id", "rel_path", "chunk_id", F.col("name").alias("func_name"), F.col("own").alias("owner"), "doc", F.lit("inherited").alias("origin"), "code")
        )
        open_ = shared.kept(_without(seen.where("found IS NULL").drop("found"), got, keys), f"open{step}")
        visited = shared.kept(visited.unionByName(open_.select(*keys, "owner", "at")), f"visited{step}")
        step += 1
    return result.distinct()


def _without(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Anti-join that treats null keys as equal."""
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    return rows.alias("r").join(others.select(*keys).alias("o"), on, "left_anti")
