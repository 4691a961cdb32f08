"""What a page's styles say about display, visibility and white space.

Sheets are read token by token, so braces and semicolons in strings and comments are not taken
for rules; blocks may nest.  Rules count if every block around them applies to a screen: media
lists of ``all`` and ``screen`` do, those with conditions do not, and neither do other
conditional blocks; layers do.  Selectors are tags, classes and ids, joined as descendants or
children, of up to ``PARTS`` parts; others are left out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

PARTS = 4
_TOKEN = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*+\"?|'(?:[^'\\\n]|\\.)*+'?|\\.|[{};]", re.S)
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility|white-space)\s*:\s*([\w-]+)[^;]*?(!\s*important)?\s*(?=;|\Z)", re.I)
_COMPOUND = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)\Z")
_PART = re.compile(r"([.#])([\w-]+)")
_JOINED = re.compile(r"\s*>\s*|\s+")
_SCREEN = re.compile(r"(?:only\s+)?(?:all|screen)|not\s+print|")

Compound = tuple[str, frozenset, frozenset]


def applies(media: str) -> bool:
    """Whether a media list applies to a screen of unknown size."""
    return any(_SCREEN.fullmatch(m.strip().lower()) for m in media.split(","))


def plain(text: str) -> str:
    """Declarations without comments, and strings emptied."""
    return _TOKEN.sub(lambda m: " " if m[0][:2] == "/*" else '""' if m[0][0] in "\"'" else m[0], text)


def declarations(text: str) -> list[tuple[str, str, bool]]:
    return [(name.lower(), value.lower(), bool(important)) for name, value, important in _DECLARED.findall(text)]


def rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that count, in order."""
    stack: list[tuple[str, str, bool]] = []  # what stands before a block, the text around it, whether it counts
    now, at = "", 0
    counts = True
    ends = sheet.count("{")  # blocks that the sheet leaves open end with it
    for m in (*_TOKEN.finditer(sheet), *[None] * ends):
        now += sheet[at : m.start()] if m else sheet[at:]
        at = m.end() if m else len(sheet)
        token = m[0] if m else "}"
        if token == "{":
            around, _, head = now.rpartition(";")
            head = head.strip()
            inside = bool(stack) and not stack[-1][0].startswith("@")
            stack.append((head, around, counts))
            name, _, rest = head.partition(" ")
            if head.startswith("@"):
                counts &= name.lower() == "@layer" or (name.lower() == "@media" and applies(rest)) or (head.lower().startswith("@media") and applies(head[6:]))
            else:
                counts &= not inside
            now = ""
        elif token == "}":
            if not stack:
                now = ""
                continue
            head, around, before = stack.pop()
            if counts and not head.startswith("@"):
                yield head, now
            counts, now = before, around + ";" if around else ""
        elif token == ";":
            now = now + ";" if stack and not stack[-1][0].startswith("@") else ""
        else:
            now += " " if token[:2] == "/*" else '""' if token[0] in "\"'" else token


def selector(text: str) -> list[tuple[Compound, bool]] | None:
    """Compounds from right to left, each with whether it is the parent of the one before; null if it is of another kind."""
    names, joins = _JOINED.split(text.strip()), _JOINED.findall(text.strip())
    if len(names) > PARTS:
        return None
    out = []
    for name, join in zip(reversed(names), ["", *reversed(joins)]):
        m = _COMPOUND.match(name)
        if m is None or not m[0]:
            return None
        parts = _PART.findall(m[2])
        out.append((((m[1] or "*").lower(), *(frozenset(x for k, x in parts if k == kind) for kind in ".#")), ">" in join))
    return out


def _fits(compound: Compound, node) -> bool:
    tag, classes, ids = compound
    return tag in ("*", node.tag) and (not classes or classes <= set(node.attrs.get("class", "").split())) and (not ids or ids == {node.attrs.get("id")})


def _under(parts: list[tuple[Compound, bool]], k: int, path: list, at: int) -> bool:
    """Whether parts ``k`` and on match elements above place ``at`` of the path."""
    if k == len(parts):
        return True
    compound, child = parts[k]
    for j in range(at - 1, at - 2 if child else -1, -1):
        if j >= 0 and _fits(compound, path[j]) and _under(parts, k + 1, path, j):
            return True
    return False


class Styles:
    """The rules of a page by what their last compound asks for."""

    def __init__(self, sheets: list[str]):
        self.rules: dict[tuple[str, str], list] = defaultdict(list)
        for order, (selectors, body) in enumerate(r for sheet in sheets for r in rules(sheet)):
            declared = declarations(body)
            for text in selectors.split(",") if declared else ():
                if (parts := selector(text)) is None:
                    continue
                tag, classes, ids = parts[0][0]
                key = ("#", min(ids)) if ids else (".", min(classes)) if classes else ("", tag)
                weight = (sum(len(c[2]) for c, _ in parts), sum(len(c[1]) for c, _ in parts), sum(c[0] != "*" for c, _ in parts), order)
                self.rules[key].append((parts, weight, declared))

    def of(self, node, path: list) -> dict[str, str]:
        """The values that hold for an element; ``path`` has the elements around it, outermost first."""
        best: dict[str, tuple] = {}

        def declare(declared: list, weight: tuple) -> None:
            for name, value, important in declared:
                found = ((important, *weight), value)
                if name not in best or found[0] >= best[name][0]:
                    best[name] = found

        if self.rules:
            keys = [("", "*"), ("", node.tag), ("#", node.attrs.get("id", "")), *((".", c) for c in set(node.attrs.get("class", "").split()))]
            for key in keys:
                for parts, weight, declared in self.rules.get(key, ()):
                    if _fits(parts[0][0], node) and _under_first(parts, path):
                        declare(declared, weight)
        if "style" in node.attrs:
            declare(declarations(plain(node.attrs["style"])), (1 << 30,))
        return {name: value for name, (_, value) in best.items()}


def _under_first(parts: list[tuple[Compound, bool]], path: list) -> bool:
    """Whether what stands left of the last compound matches the path; a compound knows whether it is a parent."""
    return len(parts) == 1 or _under(parts, 1, path, len(path))
