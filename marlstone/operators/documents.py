"""Parsing of single documents in plain Python: HTML and thesis files.

Called from Arrow-batched functions only; each takes and returns plain values.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

# Tags.
HIDDEN = {"script", "style", "noscript"}
BLOCKS = {"p", "div", "section", "article", "li", "tr", "br", "blockquote", "pre", "table", "thead", "tbody", "tfoot"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Tree(HTMLParser):
    """Elements as [tag, children]; text as str."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["", []]
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node: list = [tag, []]
        self.open[-1][1].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1][1].append([tag, []])

    def handle_endtag(self, tag: str) -> None:
        depth = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i][0] == tag), 0)
        if depth:
            del self.open[depth:]

    def handle_data(self, data: str) -> None:
        self.open[-1][1].append(data)


def _tree(html: str) -> list:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.root


def _texts(node: list) -> list[str]:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x[0] not in HIDDEN:
            todo.extend(reversed(x[1]))
    return out


def _tidy(text: str) -> str:
    lines = (re.sub(r"[ \t]+", " ", line.strip()) for line in text.splitlines())
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def html_text(html: str | None) -> str:
    """Text nodes on lines of their own, hidden parts left out."""
    return _tidy("\n".join(_texts(_tree(html or ""))))


def _find(node: list, tag: str) -> list | None:
    todo = [node]
    while todo:
        x = todo.pop(0)
        if x[0] == tag:
            return x
        todo[:0] = [c for c in x[1] if isinstance(c, list)]
    return None


def html_markdown(html: str | None) -> str:
    """Headings and blocks of the body, blocks as flat text; all text if there are none."""
    root = _tree(html or "")
    body = _find(root, "body") or root
    out: list[str] = []
    todo = [c for c in reversed(body[1]) if isinstance(c, list)]
    while todo:
        node = todo.pop()
        tag = node[0]
        if tag in HIDDEN:
            continue
        heading = re.fullmatch("h([1-6])", tag)
        if heading or tag in BLOCKS:
            words = [t.strip() for t in _texts(node) if t.strip()]
            if words:
                out.append("\n\n" + "#" * int(heading[1]) + " " + "".join(words) + "\n\n" if heading else " ".join(words) + "\n\n")
        else:
            todo += [c for c in reversed(node[1]) if isinstance(c, list)]
    return _tidy("".join(out) or " ".join(t.strip() for t in _texts(body) if t.strip()))


# --- thesis and letter files

_FENCE = re.compile(r"```yaml\s*\n(.*?)```", re.S)


def metadata(content: str | None) -> str | None:
    """The YAML block of a document as JSON; NULL without one. Read by libyaml where it is there, but for blocks with tabs, about which it is laxer."""
    import yaml

    m = _FENCE.search(content or "")
    try:
        value = yaml.load(m[1], yaml.SafeLoader if "\t" in m[1] else getattr(yaml, "CSafeLoader", yaml.SafeLoader)) if m else None
    except yaml.YAMLError:
        value = None
    return json.dumps(value, default=str, sort_keys=True) if isinstance(value, dict) else None


def with_metadata(content: str, changes: dict[str, object]) -> str:
    """Flat keys of the YAML block set anew, in place, comments kept; new keys go to its end."""
    m = _FENCE.search(content)
    if not m:
        return content
    left = dict(changes)
    lines = []
    for line in m[1].splitlines():
        key = re.match(r"(\w[\w-]*)\s*:", line)
        if key and key[1] in left:
            comment = re.search(r"\s+#.*$", line)
            line = f"{key[1]}: {left.pop(key[1])}" + (comment[0] if comment else "")
        lines.append(line)
    lines += [f"{k}: {v}" for k, v in left.items()]
    return content[: m.start(1)] + "\n".join(lines) + "\n" + content[m.end(1) :]
