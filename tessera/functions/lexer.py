"""A lexer of model code and the definitions in it: one pass over the tokens with a stack of open definitions.

Comments, strings and quoted names are tokens of their own, so nothing in them opens or ends a definition.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

# Words of the language.
KINDS = {"package", "class", "model", "block", "connector", "function", "record", "type"}
BEFORE = {"final", "encapsulated", "partial", "expandable", "pure", "impure", "operator", "replaceable", "redeclare", "inner", "outer"}
CONTROL = {"if", "for", "while", "when"}
SECTIONS = {"equation", "algorithm"}
OTHER_SECTIONS = {"public", "protected", "annotation", "external"}

TOKEN = re.compile(r"""(?s)(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:[^"\\]|\\.)*(?:"|\Z))|(?P<name>[^\W\d]\w*|'(?:[^'\\\n]|\\.)*')|(?P<other>\d[\w.]*|\S)""")
OPENING, CLOSING = "([{", ")]}"


@dataclass
class Definition:
    """A definition with its span in the text; parent is the number of the one around it, or -1."""

    number: int
    parent: int
    kind: str
    name: str
    scope: list[str]
    first: int
    last: int = -1
    closed: bool = False
    comment: str = ""
    extends: list[str] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    children: list[tuple[int, int]] = field(default_factory=list)
    sections: list[tuple[str, bool, int, list[tuple[int, int]]]] = field(default_factory=list)  # (section, initial, first, statements)
    inside: bool = False  # a section is open
    begun: int = -1
    body: int = -1  # where the header and its description end
    sectioned: list[tuple[int, int]] = field(default_factory=list)  # spans of the sections

    def left(self, at: int) -> None:
        """Ends the open section."""
        if self.inside:
            self.sectioned.append((self.sections[-1][2], at))
        self.inside = False


def without(text: str, first: int, last: int, cuts: list[tuple[int, int]], glue: str = "") -> str:
    """text[first:last] with glue in place of the cuts, which are sorted; one that begins inside another is left out."""
    out, at = [], first
    for a, b in cuts[bisect_left(cuts, (first, first)) :]:
        if a >= last:
            break
        if a >= at:
            out.append(text[at:a])
            at = b
    return glue.join([*out, text[at:last]])


class Reader:
    """definitions and comments (spans) of a text, in the order in which they begin."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [(m.lastgroup, m.start(), m.end()) for m in TOKEN.finditer(text)]
        self.comments = [(a, b) for kind, a, b in self.tokens if kind == "comment"]
        self.definitions: list[Definition] = []
        self.stack: list[Definition] = []
        self.root: list[str] = []
        self._read()

    def _word(self, k: int) -> str:
        """The k-th token that is no comment; empty beyond the end."""
        return self.text[self.code[k][1] : self.code[k][2]] if 0 <= k < len(self.code) else ""

    def _is_name(self, k: int) -> bool:
        return k < len(self.code) and self.code[k][0] == "name"

    def _qualified(self, k: int) -> tuple[str, int]:
        """The name with dots that begins at k, and the place behind it."""
        parts = []
        while self._is_name(k):
            parts.append(self._word(k))
            if self._word(k + 1) != "." or not self._is_name(k + 2):
                return ".".join(parts), k + 1
            k += 2
        return ".".join(parts), k

    def _read(self) -> None:
        self.code = [t for t in self.tokens if t[0] != "comment"]
        brackets: list[str] = []
        start, k = -1, 0  # start: where words that may stand before a header begin
        while k < len(self.code):
            kind, a, b = self.code[k]
            word = self.text[a:b]
            top = self.stack[-1] if self.stack else None
            if kind == "other" and word in OPENING:
                brackets.append(word)
            elif kind == "other" and word in CLOSING and brackets:
                brackets.pop()
            elif word == ";" and kind == "other" and "[" not in brackets:
                brackets.clear()  # an open ( or { ends with its statement
                if top and top.begun >= 0:
                    top.sections[-1][3].append((top.begun, a))
                    top.begun = -1
                start = -1
                k += 1
                continue
            if brackets or kind != "name":
                k, start = k + 1, -1 if not brackets else start
                self._begin(top, a, word)
                continue
            if word in BEFORE and not (top and top.inside):
                start, k = a if start < 0 else start, k + 1
                continue
            if word in KINDS and self._is_name(k + 1):
                k = self._open(k, a if start < 0 else start)
            elif word == "end":
                k = self._end(k)
            elif word == "within" and top is None:
                name, k = self._qualified(k + 1)
                self.root = name.split(".") if name else []
            elif word in SECTIONS and top:
                initial = self._word(k - 1) == "initial"
                top.left(self.code[k - 1][1] if initial else a)
                top.sections.append((word, initial, self.code[k - 1][1] if initial else a, []))
                top.inside, top.begun, k = True, -1, k + 1
            elif word in OTHER_SECTIONS and top:
                top.left(a)
                top.begun, k = -1, k + 1
            elif word == "initial" and self._word(k + 1) in SECTIONS:
                k += 1
            elif word in ("extends", "import") and top:
                at = k + 3 if word == "import" and self._word(k + 2) == "=" else k + 1
                name, k = self._qualified(at)
                if name:
                    (top.extends if word == "extends" else top.imports).append(name)
            else:
                self._begin(top, a, word)
                k += 1
            start = -1
        for d in self.stack:
            d.last = len(self.text)
            self._note(d)

    @staticmethod
    def _begin(top: Definition | None, at: int, word: str) -> None:
        if top and top.inside and top.begun < 0 and word != ";":
            top.begun = at

    def _open(self, k: int, first: int) -> int:
        kind, at = self._word(k), k + 1
        own = self._word(at) == "extends" and self._is_name(at + 1)  # model extends Base: the name is Base's
        at += own
        name = self._word(at)
        d = Definition(len(self.definitions), self.stack[-1].number if self.stack else -1, kind, name, [*self.root, *(x.name for x in self.stack)], first, comment=self._comment(first))
        if own:
            d.extends.append(name)
        self.definitions.append(d)
        at += 1
        told = at < len(self.code) and self.code[at][0] == "string"
        d.body = self.code[at if told else at - 1][2]
        if self._word(at) != "=":
            self.stack.append(d)
            return at
        if self._is_name(at + 1) and self._word(at + 1) not in ("enumeration", "der"):
            d.extends.append(self._qualified(at + 1)[0])
        rows = 0  # ; parts the rows of a matrix
        while at < len(self.code) and (self._word(at) != ";" or rows > 0):
            rows += {"[": 1, "]": -1}.get(self._word(at), 0)
            at += 1
        d.last, d.closed = self.code[at][2] if at < len(self.code) else len(self.text), at < len(self.code)
        self._note(d)
        return at + 1

    def _end(self, k: int) -> int:
        name = self._word(k + 1)
        if name in CONTROL:
            self._begin(self.stack[-1] if self.stack else None, self.code[k][1], name)
            return k + 2
        if not any(d.name == name for d in self.stack):
            return k + 1
        last = self.code[k + 2][2] if self._word(k + 2) == ";" else self.code[k + 1][2]
        while True:
            d = self.stack.pop()
            d.closed = d.name == name
            d.last = last if d.closed else self.code[k][1]  # one that was left open ends before the end of the one around it
            self._note(d)
            if d.closed:
                return k + 3 if self._word(k + 2) == ";" else k + 2

    def _note(self, d: Definition) -> None:
        d.left(d.last)
        if d.parent >= 0:
            self.definitions[d.parent].children.append((d.first, d.last))

    def _comment(self, first: int) -> str:
        """The comments right above, with nothing but white space between."""
        k, said = bisect_left(self.comments, (first, first)) - 1, []
        while k >= 0 and not self.text[self.comments[k][1] : first].strip():
            first = self.comments[k][0]
            said.append(self.text[first : self.comments[k][1]])
            k -= 1
        return "\n".join(reversed(said))


def definitions(text: str | None) -> list[dict]:
    """A row for every definition of a text, in the order in which they begin: number, parent (or -1), kind, name, scope
    (names around it), first_line, last_line, first, last (places in the text), closed, comment, extends, imports, own (its
    text without that of the definitions in it), bare (own without comments and header), declared (bare
    without its sections) and sections (section, initial, first_line, last_line, statements (str, first_line, last_line)). Own texts don't overlap: together they are no longer than the text."""
    text = text or ""
    reader = Reader(text)
    ends = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_right(ends, at - 1) + 1
    out = []
    for d in reader.definitions:
        cuts = sorted(d.children)
        gaps = zip([d.first, *(b for _, b in cuts)], [*(a for a, _ in cuts), d.last], strict=True)
        said = [c for a, b in gaps for c in reader.comments[bisect_left(reader.comments, (a, a)) : bisect_left(reader.comments, (b, b))]]
        both = sorted([*cuts, *said]) if said else cuts
        out.append({
            "number": d.number, "parent": d.parent, "kind": d.kind, "name": d.name, "scope": d.scope, "first_line": line(d.first), "last_line": line(max(d.first, d.last - 1)),
            "first": d.first, "last": d.last, "closed": d.closed, "comment": d.comment, "extends": list(dict.fromkeys(d.extends)), "imports": list(dict.fromkeys(d.imports)),
            "declared": without(text, max(d.first, d.body), d.last, sorted([*both, *d.sectioned]), " "), "own": without(text, d.first, d.last, cuts), "bare": without(text, max(d.first, d.body), d.last, both, " "),
            "sections": [
                {"section": s, "initial": i, "first_line": line(at), "last_line": line(max([at, *(b for _, b in xs)])),
                 "statements": [{"str": without(text, a, b, reader.comments, " ").strip(), "first_line": line(a), "last_line": line(b)} for a, b in xs]}
                for s, i, at, xs in d.sections
            ],
        })
    return out
