"""Small per-document helper of the Markdown job: one pass over the tags of a fragment.

No tree is built. Each open element is a frame collecting the Markdown of its content; when the
element ends, its frame is rendered and handed to the frame below. Blank input, editor comments,
newline runs and outer trimming are handled by column expressions around the helper.
"""

from __future__ import annotations

import re
from html.entities import name2codepoint

BLANKS = " \t\n\r\0\x0b"

# --- Fixed values: how HTML 4 parsers recover from missing end tags --------------------------
# new element -> open elements it ends, tested against the innermost one, repeatedly; after the
# start-close table of the public libxml2 HTML parser, from its documentation and memory
CLOSED_BY = {
    "p": {"p", "h1", "h2", "h3", "h4", "h5", "h6", "b", "i", "u", "s", "tt", "big", "small", "strike"},
    "div": {"p"},
    "dir": {"p"},
    "blockquote": {"p"},
    "listing": {"p"},
    "xmp": {"p"},
    "hr": {"p"},
    "caption": {"p"},
    "address": {"p", "ul"},
    "pre": {"p", "ul"},
    "menu": {"p", "ul"},
    "ol": {"p", "ul"},
    "ul": {"p", "ol", "menu", "dir", "address", "pre", "listing"},
    "li": {"p", "h1", "h2", "h3", "h4", "h5", "h6", "dl", "address", "pre", "listing", "xmp", "li"},
    "dl": {"p", "dt", "menu", "dir", "address", "pre", "listing", "xmp"},
    "dt": {"p", "menu", "dir", "address", "pre", "listing", "xmp", "dd"},
    "dd": {"p", "menu", "dir", "address", "pre", "listing", "xmp", "dt"},
    "center": {"p", "font", "b", "i"},
    "a": {"a"},
    "form": {"form", "p", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "dl", "ul", "ol", "menu", "dir", "address", "pre", "listing"},
    "fieldset": {"legend", "p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "listing", "xmp", "a"},
    "table": {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "listing", "xmp", "a"},
    "th": {"th", "td", "p", "span", "font", "a", "b", "u"},
    "td": {"th", "td", "p", "span", "font", "a", "b", "u"},
    "tr": {"th", "td", "tr", "caption", "col", "colgroup", "p"},
    "col": {"caption", "col", "p"},
    "colgroup": {"caption", "col", "colgroup", "p"},
    "thead": {"caption", "col", "colgroup"},
    "tbody": {"th", "td", "tr", "caption", "col", "colgroup", "thead", "tbody", "tfoot", "p"},
    "tfoot": {"th", "td", "tr", "caption", "col", "colgroup", "thead", "tbody", "tfoot", "p"},
    "option": {"option"},
    "optgroup": {"option"},
    "h1": {"p"},
    "h2": {"p"},
    "h3": {"p"},
    "h4": {"p"},
    "h5": {"p"},
    "h6": {"p"},
    "title": {"p"},
}
# an end tag is ignored when it would have to close an element of higher rank than its own
END_RANK = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190}
DEFAULT_RANK = 100
VOID = frozenset("area base basefont br col frame hr img input isindex link meta param".split())
SHELL = frozenset(("html", "head", "body"))
RAW_TEXT = frozenset(("script", "style"))
ENTITIES = {**name2codepoint, "apos": 39}
LANGUAGE = re.compile(r"(?:^|\s)language-(\w+)", re.A)
# ---------------------------------------------------------------------------------------------

_MARKUP = re.compile(
    r"""(?P<note><!--.*?(?:-->|\Z)|<[!?][^>]*>?)
      | </(?P<end>[a-zA-Z][^\s>/]*)[^>]*>?
      | <(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*(?=>)|[^>]*)>?""",
    re.S | re.X,
)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_ENTITY = re.compile(r"&(?:#[xX]([0-9a-fA-F]+);?|#([0-9]+);?|([a-zA-Z][a-zA-Z0-9]*);)")
# Whitespace runs other than a single blank, which may stay as it is.
_SPACE = re.compile(r" \s+|[^\S ]\s*", re.A)
_NEWLINE = re.compile(r"\s*\n\s*", re.A)
_PARAGRAPHS = re.compile(r"\n{2,}")


def _entity(match: re.Match) -> str:
    hexa, deci, name = match.groups()
    code = int(hexa, 16) if hexa else int(deci) if deci else ENTITIES.get(name)
    if code is None or code > 0x10FFFF or 0xD800 <= code <= 0xDFFF or code == 0:
        return match.group(0) if name else ""
    return chr(code)


def decode(text: str) -> str:
    return _ENTITY.sub(_entity, text) if "&" in text else text


def one_line(text: str) -> str:
    return _NEWLINE.sub(" ", text).strip(BLANKS)


def emphasise(mark: str, inner: str) -> str:
    core = inner.strip(BLANKS)
    if not core:
        return inner
    lead = " " if inner[0] in BLANKS else ""
    return f"{lead}{mark}{core}{mark}{' ' if inner[-1] in BLANKS else ''}"


class Frame:
    """An open element: its role, its inherited context and what it has collected."""

    __slots__ = ("tag", "role", "code", "pre", "depth", "out", "lists", "rows", "head", "note")

    def __init__(self, tag: str, role: str, below: Frame | None, attrs: dict[str, str]):
        self.tag, self.role = tag, role
        self.code = tag in ("code", "pre") or (below is not None and below.code)
        self.pre = tag == "pre" or (below is not None and below.pre)
        self.depth = (below.depth if below else 0) + (role == "item")
        self.out: list[str] = []
        self.lists: list[str] = []
        self.rows: list[tuple[list[str], bool]] = []
        self.head = False
        self.note = attrs.get("href", "") if tag == "a" else None

    # Which role a new child plays; anything unlisted is an ordinary element.
    def role_of(self, tag: str) -> str:
        if tag in ("ul", "ol"):
            return "list"
        if tag == "li" and self.role == "list":
            return "item"
        if tag == "table":
            return "table"
        if tag in ("thead", "tbody", "tfoot") and self.role == "table":
            return "section"
        if tag == "tr" and self.role in ("table", "section"):
            return "row"
        if tag in ("td", "th") and self.role == "row":
            return "cell"
        return "plain"

    def render(self, inside_pre: bool) -> str:
        inner, tag = "".join(self.out), self.tag
        if self.role == "list":
            return f"\n{inner}\n" if self.depth == 0 else inner
        if self.role == "table":
            return render_table(self.rows)
        if tag in ("strong", "b"):
            return emphasise("**", inner)
        if tag in ("em", "i"):
            return emphasise("*", inner)
        if tag == "p":
            return inner.strip(BLANKS) + "\n\n"
        if tag == "a":
            return f"[{inner}]({self.note})" if self.note else inner
        if tag == "code":
            return inner if inside_pre else f"`` {inner} ``" if "`" in inner else f"`{inner}`"
        if tag == "pre":
            return f"\n\n```{self.note or ''}\n{inner.strip(BLANKS)}\n```\n\n"
        if tag == "blockquote":
            return "\n\n> " + inner.strip(BLANKS).replace("\n", "\n> ") + "\n\n"
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            return f"\n\n{'#' * int(tag[1])} {one_line(inner)}\n\n"
        return inner

    def take(self, child: Frame) -> None:
        """Receive a finished child; lists and tables keep only the parts they know."""
        if self.role == "list":
            if child.role == "item":
                indent = "  " * self.depth
                body = _PARAGRAPHS.sub("\n", "".join(child.out).strip(BLANKS))
                body = body.replace("\n", f"\n{indent}  ")
                self.out.append(f"{indent}- {body}\n{''.join(child.lists)}")
        elif self.role in ("table", "section"):
            if child.role == "section":
                self.rows += child.rows
            elif child.role == "row" and child.rows:
                self.rows.append((child.rows[0][0], child.head))
        elif self.role == "row":
            if child.role == "cell":
                cell = one_line("".join(child.out)).replace("|", "\\|")
                self.rows = self.rows or [([], False)]
                self.rows[0][0].append(cell)
                self.head |= child.tag == "th"
        elif self.role == "item" and child.role == "list":
            self.lists.append(child.render(self.pre))
        else:
            self.out.append(child.render(self.pre))

    def add(self, piece: str) -> None:
        if self.role not in ("list", "table", "section", "row"):
            self.out.append(piece)


def render_table(rows: list[tuple[list[str], bool]]) -> str:
    if not rows:
        return ""
    width = max(len(cells) for cells, _ in rows)
    lines = ["| " + " | ".join(cells + [""] * (width - len(cells))) + " |\n" for cells, _ in rows]
    rule_after = next((i for i, (_, head) in enumerate(rows) if head), 0)
    lines.insert(rule_after + 1, "| " + " | ".join(["---"] * width) + " |\n")
    return "\n\n" + "".join(lines) + "\n"


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTR.findall(source):
        found.setdefault(name.lower(), decode(double or single or bare))
    return found


def fold(html: str, drop_raw_text: bool = False) -> str:
    """Markdown of an HTML fragment, before newline runs are squeezed and ends trimmed."""
    stack = [Frame("body", "plain", None, {})]
    waiting: list[str] = []

    def flush() -> None:
        if waiting:
            text = "".join(waiting).replace("\u00a0", " ")
            waiting.clear()
            stack[-1].add(text if stack[-1].code else _SPACE.sub(" ", text))

    def close() -> None:
        flush()
        done = stack.pop()
        stack[-1].take(done)

    at, size = 0, len(html)
    while at < size:
        stop = html.find("<", at)
        token = _MARKUP.match(html, stop) if stop >= 0 else None
        if token is None:
            # The rest of the text, or up to and with a "<" that starts no markup.
            upto = size if stop < 0 else stop + 1
            waiting.append(decode(html[at:upto]))
            at = upto
            continue
        if stop > at:
            waiting.append(decode(html[at:stop]))
        at = token.end()
        if token.lastgroup == "attrs":
            tag, source = token["tag"].lower(), token["attrs"]
            if tag in SHELL:
                continue
            ends = CLOSED_BY.get(tag, ())
            while stack[-1].tag in ends:
                close()
            flush()
            attrs = attributes(source) if "=" in source and tag in ("a", "img", "code") else {}
            if tag in VOID:
                if tag == "br":
                    stack[-1].add("  \n")
                elif tag == "hr":
                    stack[-1].add("\n\n---\n\n")
                elif tag == "img":
                    stack[-1].add(f"![{attrs.get('alt', '')}]({attrs.get('src', '')})")
                continue
            if tag == "code":
                found = LANGUAGE.search(attrs.get("class", ""))
                for frame in stack:
                    if frame.tag == "pre" and frame.note is None:
                        frame.note = found[1] if found else ""
            stack.append(Frame(tag, stack[-1].role_of(tag), stack[-1], attrs))
            if source.endswith("/"):
                close()
            elif tag in RAW_TEXT:
                end = re.compile(f"</{tag}", re.I).search(html, at)
                stop = end.start() if end else size
                if not drop_raw_text:
                    waiting.append(html[at:stop])
                at = stop
        elif token.lastgroup == "end":
            tag = token["end"].lower()
            rank = END_RANK.get(tag, DEFAULT_RANK)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    while len(stack) > i:
                        close()
                    break
                if END_RANK.get(stack[i].tag, DEFAULT_RANK) > rank:
                    break
        else:
            flush()
    while len(stack) > 1:
        close()
    flush()
    return "".join(stack[0].out)
