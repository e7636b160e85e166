"""Clean text from HTML, Markdown, wiki and LaTeX markup by composite text density (problem 1).

All four notations are read into one tree of elements. Composite text density is computed for every node:
characters per tag, corrected by how much of them are link text. The densities of a node's children are
summed; the node of the largest sum is the main text, and the least density on the path from the body to it
is the threshold. The way to the main text is kept, so is every other block at or above the threshold; a block below
it is left out if nearly all of it is link text (headings, items and cells are short by nature, and most texts are
excerpts), and reported. What is kept is written as plain text in which headings, lists, code blocks
and formulas are still told apart; the structures of a text are those of its kept nodes.

Every sign is found in time linear in the text, and nothing is limited in length or depth.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRUCTURES = ["heading", "list", "code", "formula"]

# Element names of HTML and of wiki extensions that count as markup, and those that start a new line.
HTML_NAMES = "a abbr acronym address article aside b big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em figcaption figure font footer form gallery h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark math meta nav nowiki ol option p pre q ref references s samp script section select small source span strike strong style sub summary sup syntaxhighlight table tbody td textarea tfoot th thead title tr tt u ul var video wbr".split()
BLOCKS = set("address article aside blockquote body caption center dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody thead tfoot tr ul head title br".split())
VOID = {"br", "hr", "img", "input", "link", "meta", "wbr", "col", "source"}
#: Opening one of these ends an open one of its group.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "p": {"p"}, "option": {"option"}} | {f"h{n}": {f"h{k}" for k in range(1, 7)} for n in range(1, 7)}
# LaTeX environments by what they hold, and commands by what they mark.
LIST_ENVS = "itemize|enumerate|description"
CODE_ENVS = "lstlisting|verbatim|Verbatim|minted|alltt|algorithmic"
MATH_ENVS = "equation|align|gather|multline|eqnarray|displaymath|math|flalign"
HEAD_COMMANDS = ["part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph", "title"]
TEXT_COMMANDS = "textbf|textit|texttt|textsc|textrm|textsf|emph|underline|uline|footnote|caption|author|date|mbox|text|url"
MARK_COMMANDS = "cite|citep|citet|ref|eqref|label|pageref|autoref|cref|bibliography|usepackage|documentclass|includegraphics|input|include|vspace|hspace"
BARE_COMMANDS = "maketitle|tableofcontents|noindent|newline|newpage|clearpage|centering|hline|par|LaTeX|TeX|ldots|dots"
MATH_COMMANDS = "frac|sum|prod|int|sqrt|alpha|beta|gamma|delta|epsilon|theta|lambda|mu|pi|sigma|omega|leq|geq|neq|cdot|times|infty|partial|nabla|cos|sin|tan|ln|log|exp|mathbf|mathrm|mathcal|left|right"

#: A text without any of these signs holds no markup; such rows never leave the JVM.
SIGNS = r"[<&\\$#*`~=\[{|>_\-'+]|\d\.[ \t]"

# Behaviour switches of wiki pages.
SWITCHES = "NOTOC|FORCETOC|TOC|NOEDITSECTION|NEWSECTIONLINK|NONEWSECTIONLINK|NOGALLERY|HIDDENCAT|EXPECTUNUSEDCATEGORY|NOCONTENTCONVERT|NOCC|NOTITLECONVERT|NOTC|INDEX|NOINDEX|STATICREDIRECT|DISAMBIG|NOGLOBAL"
OPTION, BRACED = r"(?:\[[^\[\]\n]*+\])", r"(?:[^{}\n]++|\{[^{}\n]*+\})*+"
#: A paragraph up to a sign: blank lines end it, pairs of backslashes are skipped.
RUN = r"(?:[^\\\n]++|\\\\|\\(?![\[\]()\\])|\n(?![ \t]*\n))*+"

PATTERN = re.compile(
    r"(?P<fence>^[ \t]{0,3}(?P<tick>`{3,}|~{3,})(?P<info>[^\n`~]*)\n(?P<fbody>.*?)(?:^[ \t]{0,3}(?P=tick)[`~]*[ \t]*$|\Z))"
    r"|(?P<comment><!--.*?(?:-->|\Z))"
    rf"|(?P<texcode>\\begin\{{(?P<cenv>{CODE_ENVS})\*?\}}(?:{OPTION}|\{{[^{{}}\n]*+\}})*(?P<cbody>.*?)(?:\\end\{{(?P=cenv)\*?\}}|\Z))"
    r"|(?P<hcode>(?i:<(?P<htag>pre|syntaxhighlight|source)(?=[\s>])[^<>]*>(?P<hbody>.*?)(?:</(?P=htag)\s*>|\Z)))"
    r"|(?P<script>(?i:<(?P<stag>script|style)\b[^<>]*>.*?(?:</(?P=stag)\s*>|\Z)))"
    rf"|(?P<texmath>\\begin\{{(?P<menv>{MATH_ENVS})\*?\}}(?P<mbody>.*?)(?:\\end\{{(?P=menv)\*?\}}|\Z))"
    rf"|(?P<dmath>\$\$(?=[^$])(?P<dbody>(?:[^$\n]++|\$(?!\$)|\n(?![ \t]*\n))++)\$\$|\\\[(?P<dbody2>{RUN})\\\]|(?i:<math\b[^<>]*>(?P<dbody3>.+?)(?:</math\s*>|\Z)))"
    rf"|(?P<imath>\\\((?P<ibody>{RUN})\\\)|(?<![\\$\w])\$(?=[^\s$])(?P<ibody2>[^$\n]*[^\s$\\])\$(?![\d$]))"
    rf"|(?P<texlist>\\begin\{{(?:{LIST_ENVS})\*?\}}{OPTION}?)|(?P<texlistend>\\end\{{(?:{LIST_ENVS})\*?\}})|(?P<texitem>\\item\b{OPTION}?[ \t]*)"
    rf"|(?P<texenv>\\(?:begin|end)\{{[a-zA-Z]+\*?\}}{OPTION}?)"
    rf"|(?P<texhead>\\(?P<hcmd>{'|'.join(HEAD_COMMANDS)})\*?{OPTION}?\{{(?P<htext>{BRACED})\}})"
    rf"|(?P<textext>\\(?:{TEXT_COMMANDS})\{{(?P<ttext>{BRACED})\}})"
    rf"|(?P<texmark>~?\\(?:{MARK_COMMANDS})\*?{OPTION}*\{{[^{{}}\n]*+\}}|\\(?:{BARE_COMMANDS})\b(?!\\))"
    r"|(?P<texsign>(?<=[\s\d\w])\\,?\\?[%&#_,;]|(?<=\s)\\[%&#$](?=\s))"
    rf"|(?P<baremath>\\(?:{MATH_COMMANDS})\b(?=[\s_^{{=\\\d])[^\n。，；]*)"
    r"|(?P<wtable>^\{\|[^\n]*$)|(?P<wtableend>^\|\}[ \t]*$)|(?P<wrow>^\|-[^\n|]*$)"
    r"|(?P<mdrule>^[ \t]*+(?:\|[ \t]*+)?:?-{2,}+:?[ \t]*+(?:\|[ \t]*+:?-{2,}+:?[ \t]*+)+\|?[ \t]*$|^[ \t]*+\|[ \t]*+:?-{3,}+:?[ \t]*+\|[ \t]*$)"
    r"|(?P<atx>(?:^[ \t]{0,3}|(?<=[.!?。！？][ \t]))(?P<hashes>#{1,6})[ \t]+(?P<atext>[^\s#][^\n]*)$)"
    r"|(?P<whead>(?:^|(?<=[.!?。！？][ \t]))(?P<eqs>={1,6}+)[ \t]*+(?P<wtext>[^=\s][^=\n]*+)(?P=eqs)[ \t]*$)"
    r"|(?P<setext>(?:\A|(?<=\n\n))(?P<stext>[^\n\s|<>=#*\-][^\n]*)\n(?P<bar>={3,}|-{3,})[ \t]*$)"
    r"|(?P<item>^(?P<lead>[ \t]*)(?P<mark>[-+]|\*{1,6}|[#:;]{2,6}|:|;|\d{1,4}\.)[ \t]+(?P<task>\[[ xX]\][ \t]+)?(?=\S))"
    r"|(?P<quote>^[ \t]{0,3}(?:>[ \t]?)*>(?:[ \t]+(?=\S)|[ \t]*$))"
    rf"|(?P<template>\{{\{{(?:[^{{}}\n]++|\{{\{{[^{{}}\n]*+\}}\}})++\}}\}})|(?P<magic>__(?:{SWITCHES})__)|(?P<sign>(?<!~)~{{3,5}}(?!~)[ \t]*$)"
    r"|(?P<wfile>\[\[(?i:File|Image|Category|Datei|Kategorie|Fichier|Catégorie|文件|图像|分类):(?:[^\[\]\n]++|\[\[[^\[\]\n]*+\]\])*+\]\])"
    r"|(?P<wlink>\[\[(?P<wl>[^\[\]\n|]++)(?:\|(?P<wt>[^\[\]\n]*+))?\]\])"
    r"|(?P<image>!\[(?P<alt>[^\[\]\n]*+)\]\([^()\s]*+(?:[ ]\"[^\"\n]*\")?\))|(?P<mdlink>\[(?P<lt>[^\[\]\n]++)\]\([^()\s]*+(?:[ ]\"[^\"\n]*\")?\))|(?P<reflink>\[(?P<rt>[^\[\]\n]++)\]\[[^\[\]\n]*+\](?=[\s.,;]|$)(?<!\d\]))|(?P<elink>\[https?://[^\s\[\]]++ (?P<et>[^\[\]\n]++)\])|(?P<autolink><(?i:https?|ftp|mailto):[^<>\s]+>)"
    r"|(?P<footnote>\[\^[^\[\]\s]++\]:?)"
    r"|(?P<strike>~~(?=\S)(?P<st>[^~\n]+?)(?<=\S)~~)"
    r"|(?P<wbold>'{2,5}(?P<wb>[^'\n]+?)'{2,5})"
    r"|(?P<strong>\*\*(?=\S)(?P<sb>[^*\n]+?)(?<=\S)\*\*)|(?P<em>(?<![\w*\\/)\]])\*(?=[^\s*])(?P<eb>[^*\n]+?)(?<=[^\s*])\*(?![\w*(])|(?<=[^\x00-\x7f])\*(?=[^\s*])(?P<eb2>[^*\n]+?)(?<=[^\s*])\*(?=[^\x00-\x7f]|\s|$)|(?<=\s)\*(?=[^\s*])(?P<eb3>[^*\n]+?)(?<=[^\s*])\*(?=[^\x00-\x7f]))"
    r"|(?P<inline>(?<!`)`(?=[^\s`])(?P<ic>[^`\n]+?)`(?!`))"
    rf"|(?P<tag></?(?P<name>(?i:{'|'.join(sorted(HTML_NAMES, key=len, reverse=True))}))(?P<attrs>(?:\s+[a-zA-Z_:-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?)*)\s*(?P<self>/)?>)"
    r"|(?P<entity>&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});)",
    re.M | re.S,
)
#: What an element of these names is.
STRUCTURE_OF = {f"h{n}": "heading" for n in range(1, 7)} | dict.fromkeys(("ul", "ol", "li", "dl", "dt", "dd", "mditem"), "list") | dict.fromkeys(("pre", "syntaxhighlight"), "code") | dict.fromkeys(("formula", "math"), "formula")
AMOUNT = re.compile(r"\d[\d.,]*(?:\s|$)")
#: A block below the threshold is left out when more than this share of its characters is link text.
LINK_SHARE = 0.8
FORMULA = re.compile(r"[\\^_{}=+<>]|^[A-Za-z]$|[A-Za-z]\s*[-*/]\s*\w")
SPACE = re.compile(r"[^\S\n]+")
TABLE_ROW = re.compile(r"^[ \t]*\|.*\|[ \t]*$")


@dataclass(eq=False)
class Node:
    """An element; kids holds nodes and strings in order."""

    tag: str
    kids: list = field(default_factory=list)
    level: int = 0
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    structure: str = ""

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [k for k in reversed(n.kids) if isinstance(k, Node)]


class Builder:
    """Makes the tree from the signs of a text in order."""

    def __init__(self, text: str) -> None:
        self.text, self.root = text, Node("body")
        self.open, self.names = [self.root], Counter()
        self.marks = 0
        self.line: tuple[int, int, int] = (0, -1, 0)

    def leaf(self, tag: str, text: str = "", level: int = 0, structure: str = "") -> None:
        self.open[-1].kids.append(Node(tag, [text] if text else [], level, structure=structure or STRUCTURE_OF.get(tag, "")))

    def push(self, tag: str, level: int = 0) -> None:
        n = Node(tag, [], level, structure=STRUCTURE_OF.get(tag, ""))
        self.open[-1].kids.append(n)
        self.open.append(n)
        self.names[tag] += 1

    def pop(self, tags: set[str], stop: set[str] | None = None) -> bool:
        """Close the nearest open element of one of these names, unless one of stop is nearer; was there one?"""
        if not any(self.names[t] for t in tags):
            return False
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                for n in self.open[i:]:
                    self.names[n.tag] -= 1
                del self.open[i:]
                return True
            if stop and self.open[i].tag in stop:
                return False
        return False

    def end_line_item(self) -> None:
        self.pop({"mditem", "mdquote"})

    def plain(self, text: str) -> None:
        if not text:
            return
        if "\n" in text and self.open[-1].tag in ("mditem", "mdquote"):
            first, _, rest = text.partition("\n")
            self.open[-1].kids.append(first)
            self.end_line_item()
            self.open[-1].kids.append("\n" + rest)
        else:
            self.open[-1].kids.append(text)

    def build(self) -> Node:
        at = 0
        runs = self._items()
        for m in PATTERN.finditer(self.text):
            kind = m.lastgroup and next((g for g in KINDS if m.start(g) >= 0), None)
            if kind is None or not self._valid(kind, m, runs):
                continue
            self.plain(self.text[at : m.start()])
            at = m.end()
            self.marks += 1
            self._take(kind, m)
        self.plain(self.text[at:])
        return self.root

    def _items(self) -> dict[int, bool]:
        """For each start of a line that looks like an item: does it stand in a list?

        Items are kin when nothing but blank lines and indented lines stands between them and their marks agree.
        """
        out, before = {}, None
        for m in ITEM_LINE.finditer(self.text):
            mark, strong = m["mark"], bool(m["task"]) or m["rest"].startswith(("**", "''", "[[", "[ ]", "`"))
            near = before is not None and (before[1] + 1 >= m.start() or BETWEEN.fullmatch(self.text, before[1], m.start()) is not None)
            counted = near and mark[0].isdigit() and before[0][0].isdigit() and int(before[0][:-1]) + 1 == int(mark[:-1])
            kin = counted or near and not mark[0].isdigit() and before[0][0] == mark[0]
            out[m.start()] = strong or kin
            if kin and not strong:
                out[before[2]] = True
            before = (mark, m.end(), m.start())
        return out

    def _dollars(self, at: int) -> int:
        """Dollar signs in the line of a position; lines are counted once."""
        if not self.line[0] <= at <= self.line[1]:
            a = self.text.rfind("\n", 0, at) + 1
            b = self.text.find("\n", at)
            b = len(self.text) if b < 0 else b
            self.line = (a, b, self.text.count("$", a, b))
        return self.line[2]

    def _valid(self, kind: str, m: re.Match, runs: dict[int, bool]) -> bool:
        if kind == "item":
            return runs.get(m.start(), False) and m["mark"] not in (":", ";")
        if kind == "imath":
            if m["ibody"] is not None:
                return True
            # an odd dollar sign in a line of amounts is an amount
            return bool(FORMULA.search(m["ibody2"].strip())) and not (AMOUNT.match(m["ibody2"]) and self._dollars(m.start()) % 2)
        if kind == "wbold":
            return not (m["wb"].isspace() or m.start() and self.text[m.start() - 1].isalpha() and self.text[m.start() - 1].isascii() and len(m[0]) - len(m["wb"]) < 5)
        if kind == "entity":
            return html.unescape(m[0]) != m[0]
        if kind == "reflink":
            return not m["rt"].isdigit() and not self.text[max(0, m.start() - 1) : m.start()].isalnum() and " " in m["rt"]
        if kind == "whead":
            return len(m["eqs"]) > 1
        if kind in ("texhead", "textext"):
            return self.text[max(0, m.start() - 1) : m.start()] not in (":", "\\")
        if kind == "texmark":
            return not (m[0].startswith("\\") and m.start() and self.text[m.start() - 1] in ":\\" or re.match(r"\\[A-Za-z]+$", m[0]) and self.text[m.end() : m.end() + 1] in ("\\", "_"))
        if kind == "baremath":
            return not (m.start() and self.text[m.start() - 1] in ":\\") and self.text[m.end() : m.end() + 1] != "\\"
        return True

    def _take(self, kind: str, m: re.Match) -> None:
        if kind in ("fence", "texcode", "hcode"):
            self.end_line_item()
            body = m["fbody"] if kind == "fence" else m["cbody"] if kind == "texcode" else html.unescape(re.sub(r"</?code\b[^<>]*>", "", m["hbody"], flags=re.I))
            self.leaf("pre", body.strip("\n"))
        elif kind in ("texmath", "dmath", "imath", "baremath"):
            body = next((m[g] for g in ("mbody", "dbody", "dbody2", "dbody3", "ibody", "ibody2") if m[g] is not None), m[0])
            self.leaf("formula", " ".join(body.split()), int(kind in ("texmath", "dmath")))
        elif kind in ("atx", "whead", "setext", "texhead"):
            self.end_line_item()
            level = {"atx": lambda: len(m["hashes"]), "whead": lambda: len(m["eqs"]), "setext": lambda: 1 + (m["bar"][0] == "-"), "texhead": lambda: max(1, HEAD_COMMANDS.index(m["hcmd"].lower()) - 1)}[kind]()
            self.push(f"h{min(6, level)}", level)
            inner(self, bare_heading(m["atext"]) if m["atext"] else (m["wtext"] or m["stext"] or m["htext"] or "").strip())
            self.pop({f"h{min(6, level)}"})
        elif kind == "texlist":
            self.push("ul")
        elif kind == "texlistend":
            if not self.pop({"ul"}):
                self.leaf("mark", structure="list")
        elif kind == "texitem":
            self.pop({"li"}, {"ul"})
            self.push("li")
        elif kind == "item":
            self.end_line_item()
            self.push("mditem", len(m["lead"]) // 2 if m["mark"][0] in "-+" or len(m["mark"]) == 1 else len(m["mark"]) - 1)
        elif kind == "quote":
            self.end_line_item()
            self.push("mdquote")
        elif kind in ("mdlink", "wlink", "elink", "reflink"):
            self.push("a")
            inner(self, m["lt"] or m["wt"] or m["wl"] or m["et"] or m["rt"] or "")
            self.pop({"a"})
        elif kind == "wtable":
            self.push("table")
        elif kind == "wtableend":
            self.pop({"table"})
        elif kind == "wrow":
            self.leaf("br")
        elif kind in ("strike", "wbold", "strong", "em", "textext"):
            self.push("b")
            inner(self, m["st"] or m["wb"] or m["sb"] or m["eb"] or m["eb2"] or m["eb3"] or m["ttext"] or "")
            self.pop({"b"})
        elif kind == "inline":
            self.leaf("code", m["ic"])
        elif kind == "image":
            self.leaf("img", m["alt"] or "")
        elif kind == "entity":
            self.plain(html.unescape(m[0]))
        elif kind == "texsign":
            self.plain(m[0].lstrip("\\,;") or " ")
        elif kind == "tag":
            self._tag(m["name"].lower(), m[0].startswith("</"), bool(m["self"]))
        elif kind in ("comment", "script", "texenv", "texmark", "template", "magic", "sign", "wfile", "footnote", "mdrule", "autolink"):
            self.leaf("mark")

    def _tag(self, name: str, closing: bool, alone: bool) -> None:
        self.end_line_item()
        if name in VOID or alone:
            self.leaf(name)
        elif closing:
            if not self.pop({name}):  # an excerpt may hold the end of an element only
                self.leaf("mark", structure=STRUCTURE_OF.get(name, ""))
        else:
            if name in SIBLINGS:
                self.pop(SIBLINGS[name], {"ul", "ol", "dl", "table"} - SIBLINGS[name])
            self.push(name, int(name[1]) if re.fullmatch(r"h[1-6]", name) else 0)


def bare_heading(text: str) -> str:
    """A heading without the signs that may close it."""
    text = text.rstrip()
    bare = text.rstrip("#")
    return bare.rstrip() if bare != text and bare[-1:] in (" ", "\t") else text


def inner(builder: Builder, text: str) -> None:
    """Read the signs inside a heading, a link or an emphasis into the open node."""
    if not re.search(SIGNS, text):
        builder.open[-1].kids.append(text)
        return
    sub = Builder(text)
    builder.open[-1].kids += sub.build().kids
    builder.marks += sub.marks


KINDS = ["fence", "comment", "texcode", "hcode", "script", "texmath", "dmath", "imath", "texlist", "texlistend", "texitem", "texenv", "texhead", "textext", "texmark", "texsign", "baremath", "wtable", "wtableend", "wrow", "mdrule", "atx", "whead", "setext", "item", "quote", "template", "magic", "sign", "wfile", "wlink", "image", "mdlink", "reflink", "elink", "autolink", "footnote", "strike", "wbold", "strong", "em", "inline", "tag", "entity"]
#: What may stand between two items of a list: the rest of the line, blank lines, indented lines.
BETWEEN = re.compile(r"\n(?:[ \t]*\n|[ \t]+\S[^\n]*\n)*")
ITEM_LINE = re.compile(r"^(?P<lead>[ \t]*)(?P<mark>[-+]|\*{1,6}|[#]{2,6}|\d{1,4}\.)[ \t]+(?P<task>\[[ xX]\][ \t]+)?(?P<rest>\S[^\n]*)$", re.M)


def measure(root: Node) -> None:
    """Composite text density of every node, from the leaves up."""
    for n in reversed(list(root.walk())):
        n.chars = sum(len(k.strip()) if isinstance(k, str) else k.chars for k in n.kids)
        nodes = [k for k in n.kids if isinstance(k, Node)]
        n.tags = sum(k.tags + 1 for k in nodes)
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, sum(k.link_tags + (k.tag == "a") for k in nodes)
        else:
            n.link_chars = sum(k.link_chars for k in nodes)
            n.link_tags = sum(k.link_tags + (k.tag == "a") for k in nodes)
    body_chars, body_links = max(1, root.chars), root.link_chars
    for n in root.walk():
        c, t, lc, lt = n.chars, max(1, n.tags), n.link_chars, n.link_tags
        if not c:
            continue
        base = math.log(c * lc / max(1, c - lc) + body_links * c / body_chars + math.e)
        n.density = c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt))) / max(1e-9, base) if c > 1 else 0.0


def main_text(root: Node) -> tuple[list[Node], float]:
    """(path, threshold): from the body to the node whose children's densities sum highest, and the least density on it."""
    best, best_sum = root, -1.0
    above: dict[int, Node] = {}
    for n in root.walk():
        total = 0.0
        for k in n.kids:
            if isinstance(k, Node):
                above[id(k)] = n
                total += k.density
        if total > best_sum:
            best, best_sum = n, total
    path = [best]
    while path[-1] is not root:
        path.append(above[id(path[-1])])
    return path[::-1], min(n.density for n in path)


def select_text(root: Node) -> list[str]:
    """Keep the main text, its way and the blocks that reach the threshold; the texts of the blocks left out."""
    path, least = main_text(root)
    way = {id(n) for n in path}
    gone, todo = [], [root]
    while todo:
        n = todo.pop()
        kept = []
        for k in n.kids:
            if isinstance(k, Node) and id(k) not in way and k.tag in BLOCKS and k.chars and k.density < least and k.link_chars > LINK_SHARE * k.chars:
                gone.append(" ".join(render(k).split()))
            else:
                kept.append(k)
        n.kids = kept
        todo += [k for k in reversed(kept) if isinstance(k, Node)]
    return gone


def structures(root: Node) -> list[str]:
    """Kinds of structure of the nodes of a tree, in the order of STRUCTURES."""
    has = {n.structure for n in root.walk()}
    return [s for s in STRUCTURES if s in has]


def _trim(out: list[str], start: int) -> None:
    """Strip the text of out from start on, in place."""
    while len(out) > start and not (last := out[-1].rstrip()):
        out.pop()
    if len(out) > start:
        out[-1] = last
    for i in range(start, len(out)):
        out[i] = out[i].lstrip()
        if out[i]:
            return


def render(node: Node) -> str:
    """Plain text of a tree. One buffer and no recursion, so depth and length cost only what they hold."""
    out: list[str] = []
    todo: list[tuple[Node, int, int, Iterator]] = [(node, 0, 0, iter(node.kids))]
    while todo:
        parent, depth, start, kids = todo[-1]
        for k in kids:
            if isinstance(k, str):
                out.append(k)
                continue
            tag = k.tag
            if tag == "pre":
                out.append("\n```\n" + "".join(x for x in k.kids if isinstance(x, str)) + "\n```\n")
            elif tag == "formula":
                sign = "$$" if k.level else "$"
                out.append(sign + "".join(k.kids) + sign)
            elif tag not in ("mark", "script", "style"):
                deep = depth + (tag in ("ul", "ol", "dl"))
                if tag in ("li", "dt", "dd"):
                    out.append("\n" + "  " * min(max(0, depth - 1), 20) + "- ")
                elif tag == "mditem":
                    out.append("  " * min(k.level, 20) + "- ")
                elif tag in BLOCKS and tag not in ("td", "th"):
                    out.append("\n")
                todo.append((k, deep, len(out), iter(k.kids)))
                break
        else:
            todo.pop()
            if not todo:
                break
            tag = parent.tag
            if tag in ("li", "dt", "dd", "mditem"):
                _trim(out, start)
            elif tag in ("td", "th"):
                _trim(out, start)
                out.append(" | ")
            elif STRUCTURE_OF.get(tag) == "heading":
                text = " ".join("".join(out[start:]).split())
                out[start:] = [f"{'#' * int(tag[1])} {text}", "\n"]
            elif tag in BLOCKS:
                out.append("\n")
    return "".join(out)


def tidy(text: str) -> str:
    """Blanks of each line made one (not in code blocks, not before items), at most one empty line in a row."""
    out, code = [], False
    for line in text.split("\n"):
        if line.strip() == "```":
            code = not code
        lead = re.match(r"[ ]*(?=- )", line)
        line = line.rstrip() if code else (lead[0] if lead else "") + SPACE.sub(" ", line).strip().removesuffix(" |")
        if line or not out or out[-1]:
            out.append(line)
    return "\n".join(out).strip("\n")


def clean_markup(text: str) -> tuple[str, list[str], bool, list[str]]:
    """(clean text, structures in the order of STRUCTURES, is there markup, texts of the blocks left out)."""
    if not re.search(SIGNS, text):
        return text, [], False, []
    b = Builder(text)
    root = b.build()
    if not b.marks:
        return text, [], False, []
    measure(root)
    gone = select_text(root)
    return tidy(render(root)), structures(root), True, gone


def extract_text(df: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """(id, clean_text, structures, has_markup, dropped) for every row of df; dropped holds the texts of blocks left out.

    Rows without any sign of markup stay in the JVM with their text as it is; the rest are parsed where they
    are, without a shuffle. NULL text gives NULL text and no structures; empty text stays empty. Repeated rows
    give repeated rows; other columns are not read.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sign = F.coalesce(F.col("text").rlike(SIGNS), F.lit(False))
    none = F.array().cast("array<string>")
    plain = src.where(~sign).select("id", F.col("text").alias("clean_text"), none.alias("structures"), F.lit(False).alias("has_markup"), none.alias("dropped"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [clean_markup(t) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "clean_text": [g[0] for g in got], "structures": [g[1] for g in got], "has_markup": [g[2] for g in got], "dropped": [g[3] for g in got]})

    id_type = src.schema["id"].dataType.simpleString()
    parsed = src.where(sign).mapInPandas(parse, f"id {id_type}, clean_text string, structures array<string>, has_markup boolean, dropped array<string>")
    return plain.unionByName(parsed).withColumnRenamed("id", id_col)


def found_structures(extracted: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(id, structure): a row per kind of structure of each text with markup, `other` where it has none of them."""
    marked = extracted.where("has_markup")
    kinds = F.when(F.size("structures") > 0, F.col("structures")).otherwise(F.array(F.lit("other")))
    return marked.select(id_col, F.explode(kinds).alias("structure")).distinct()
