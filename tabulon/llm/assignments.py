"""A lexer of assignments in source code and configuration files, with constants propagated.

What is read: names, quoted names and subscripts before ``=``, ``:``, ``:=`` or ``=>`` (with or
without a type), named arguments, ``#define``, ``export`` and XML elements; and as their values
quoted, triple-quoted and bare literals, joined by ``+`` or ``..``, by standing side by side or over
continued lines, in brackets, calls, formatted strings and YAML blocks. A name in a value stands
for the literals that it was given before. An entry with a general name such as ``value`` belongs to
the entry around it, too.
"""

import re
from collections.abc import Callable
from dataclasses import dataclass, field

_SIGN = r"[ \t]*+(?::[ \t]*[A-Za-z_][\w.\[\]]*[ \t]*=(?!=)|:=|=>|=(?![=~])|:(?![:/]))[ \t]*+"
_TOKEN = re.compile(
    rf"""(?P<slot>\$\{{[^}}\n]{{0,200}}+\}}|\{{\{{[^}}\n]{{0,200}}+\}}\}}|\$\([^)\n]{{0,200}}+\)|<%[^\n]{{0,200}}?%>)
    |<(?P<tag>[A-Za-z_][\w.\-]*+)(?:[ \t][^<>\n]*+)?>(?P<element>[^<>]++)</
    |(?P<subscript>[A-Za-z_$][\w$.\-]*+(?:\[[^\[\]\n]*+\])*?\[(?P<sq>["'])(?P<key>[^"'\n]*+)(?P=sq)\]{_SIGN})
    |\#[ \t]*+define[ \t]++(?P<define>[A-Za-z_]\w*+)(?:\([^()\n]*+\))?[ \t]*+
    |(?P<prefix>(?<!\w)[bBrRuUfFlL]{{0,2}}+)(?:(?P<tq>\"\"\"|''')(?P<triple>(?:[^\\]|\\.)*?)(?P=tq)
      |"(?P<double>(?:[^"\\\n]|\\.)*+)(?:"|(?=\n)|\\?\Z)|(?<!\w')'(?P<single>(?:[^'\\\n]|\\.)*+)'|`(?P<back>[^`\n]*+)`)
    |(?P<name>[A-Za-z_$][\w$.\-]*+)
    |(?P<plus>\+|\.\.)
    |(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<end>[,;])
    |(?P<line>\\?\n)""",
    re.VERBOSE | re.DOTALL,
)
_AFTER = re.compile(_SIGN)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""")
_NAME = re.compile(r"[A-Za-z_$][\w$.\-]*\Z")
_KEY = re.compile(r"[A-Za-z_$][\w$.\-]*+(?::(?=\s)|:?=|:\Z)")
_BLOCK = re.compile(r"[|>][+\-]?[0-9]?[ \t]*(?=\n)")
# Blanks and the dash of a list item before a value.
_LEAD = re.compile(r"[ \t]*+(?:-[ \t]++)?+")
_MORE = re.compile(r"""[ \t]*+(?:\n[ \t]*+)?+(?:\+|\.\.|(["'`])|(-[ \t]))""")
_PLACES = re.compile(r"\{([A-Za-z_][\w.]*)[^{}]*\}")
# Names that say nothing of their own.
GENERAL = {"value", "val", "data", "default", "content", "text", "current", "plain", "raw", "literal"}


@dataclass
class Given:
    """What a name was given: literals, and other names' literals. ``weight`` is the largest of the names it reaches."""

    spans: list[tuple[int, int]] = field(default_factory=list)
    others: list["Given"] = field(default_factory=list)
    weight: float = 0.0

    def reach(self, weight: float) -> None:
        """Every node is passed once for each larger weight, so long chains of names stay linear."""
        todo = [self]
        while todo:
            at = todo.pop()
            if at.weight < weight:
                at.weight = weight
                todo += at.others


@dataclass
class _Target:
    name: str
    weight: float
    depth: int
    at: int
    colon: bool
    given: Given = field(default_factory=Given)
    done: bool = False
    quoted: bool = False


def _indent(text: str, at: int) -> int:
    start = text.rfind("\n", 0, at) + 1
    return len(text[start:at]) - len(text[start:at].lstrip(" \t-"))


def weighted_literals(text: str, weigh: Callable[[str], float], least: int = 1) -> list[tuple[int, int, float]]:
    """Spans of literals, without their quotes, with the largest weight of the names that they reach.

    ``weigh`` gives the weight of a name. Only what comes before counts for a name in a value, and a
    name that is given anew no longer stands for what it was. ``least`` letters make a formatted
    string a literal of its own.
    """
    known: dict[str, Given] = {}
    targets: list[_Target] = []
    every: list[Given] = []
    depth, at, n = 0, 0, len(text)

    def begin(name: str, start: int, colon: bool) -> None:
        around = targets[-1].weight if targets and name.lower() in GENERAL else 0.0
        targets.append(_Target(name, max(weigh(name), around), depth, start, colon))

    def finish(down_to: int) -> None:
        """End the targets that began in brackets at least so deep."""
        while targets and targets[-1].depth >= down_to:
            t = targets.pop()
            every.append(t.given)
            known[t.name] = t.given
            if t.weight:
                t.given.reach(t.weight)

    def same_line(sign: str) -> None:
        """A new target at this depth ends the one before."""
        if targets and targets[-1].depth == depth and (targets[-1].done or not targets[-1].colon):
            finish(depth)

    while at < n:
        top = targets[-1] if targets else None
        if top and not top.done:
            at = _LEAD.match(text, at).end()
            if (block := _BLOCK.match(text, at)) and top.colon:
                at = block.end()
                continue
            bare = _BARE.match(text, at)
            if bare and bare[0] in ("-", "+"):
                at = bare.end()
                continue
            plain = bare and bare[0] not in ("&", "|", "*") and text[bare.end() : bare.end() + 1] not in ("(", "[", "{", '"', "'", "`", "<")
            # A name with a sign on a line of its own is the next target, not a value.
            key = plain and _KEY.match(text, at) and not text[text.rfind("\n", 0, at) + 1 : at].strip(" \t-")
            if plain and not key and not _NAME.match(bare[0]) and not _AFTER.match(text, bare.end()) and not bare[0].startswith(("$", "+", "..", "#", "\\")):
                names = bare[0].split("+")
                if len(names) > 1 and all(x in known for x in names):
                    top.given.others += [known[x] for x in names]
                else:
                    top.given.spans.append(bare.span())
                top.done, top.quoted, at = True, False, bare.end()
                continue
        m = _TOKEN.search(text, at)
        if not m:
            break
        if top and not top.done and text[at : m.start()].strip():
            top.done = True
        at, kind = m.end(), m.lastgroup
        if m["slot"] is not None:
            if top and not top.done:
                inner = m[0].strip("${}() %<>")
                if inner in known:
                    top.given.others.append(known[inner])
                top.done = True
        elif m["tag"] is not None:
            a, b = m.span("element")
            begin(m["tag"], m.start(), False)
            value = text[a:b]
            targets[-1].given.spans.append((a + len(value) - len(value.lstrip()), b - len(value) + len(value.rstrip())))
            t = targets.pop()
            every.append(t.given)
            known[t.name] = t.given
            if t.weight:
                t.given.reach(t.weight)
        elif m["subscript"] is not None:
            same_line("=")
            begin(m["key"], m.start(), False)
        elif m["define"] is not None:
            finish(0)
            depth = 0
            begin(m["define"], m.start(), False)
        elif m["prefix"] is not None:
            group = next(g for g in ("triple", "double", "single", "back") if m[g] is not None)
            a, b = m.span(group)
            if sign := _AFTER.match(text, at):
                if group != "triple" and m[group]:
                    same_line(sign[0])
                    begin(m[group], m.start(), ":" in sign[0])
                    at = sign.end()
                    continue
            if top and (not top.done or top.quoted):
                formatted = "f" in m["prefix"].lower() or "${" in m[group]
                names = _PLACES.findall(m[group]) if formatted else []
                top.given.others += [known[x] for x in names if x in known]
                if not names or len(_PLACES.sub("", m[group])) >= least:
                    top.given.spans.append((a, b))
                top.done = top.quoted = True
        elif m["name"] is not None:
            if sign := _AFTER.match(text, at):
                same_line(sign[0])
                begin(m["name"], m.start(), ":" in sign[0] and "=" not in sign[0])
                at = sign.end()
            elif top and not top.done:
                following = text[at : at + 1]
                if m["name"] in known:
                    top.given.others.append(known[m["name"]])
                elif top.weight and following not in ("(", "["):
                    top.given.spans.append(m.span("name"))
                top.done, top.quoted = following not in ("(", "["), False
        elif kind == "plus":
            if top:
                top.done = False
        elif kind == "open":
            depth += 1
            if top:
                top.done = False
        elif kind == "close":
            finish(depth)
            depth = max(0, depth - 1)
            if targets:
                targets[-1].done, targets[-1].quoted = True, False
        elif kind == "end":
            if top and depth > top.depth and m[0] == ",":
                top.done = False
            else:
                finish(depth)
                if targets:
                    targets[-1].done = False
        elif kind == "line" and top and depth == top.depth and m[0] == "\n":
            line = text[at : at + 200].lstrip("\n")
            deeper = len(line) - len(line.lstrip(" \t")) > _indent(text, top.at) or line.lstrip(" \t").startswith("- ")
            if top.done:
                more = _MORE.match(text, at)
                item = more and more[2] and top.colon
                # Literals go on below where a sign joins them, or as further items of a block.
                if item and deeper:
                    top.done = False
                elif not (more and not more[2] and (not more[1] or (top.quoted and deeper and not top.colon))):
                    finish(depth)
            elif not line.strip() or text[at : at + 1] == "\n" or (top.colon and not deeper):
                finish(depth)
        elif kind == "line" and top and m[0] != "\n" and top.quoted:
            top.done = True
    finish(0)
    best: dict[tuple[int, int], float] = {}
    for g in every:
        for span in g.spans:
            if g.weight > best.get(span, 0.0):
                best[span] = g.weight
    return sorted((a, b, w) for (a, b), w in best.items())
