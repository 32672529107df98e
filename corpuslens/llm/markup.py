"""Markup residue: content nodes by tag-path ratios, and marked-up fields as clean text that keeps its structure.

* Nodes.  Every text node has the path of blocks it stands in, root to leaf; inline formatting is no part of it.  Class
  names only tell paths apart, none is known beforehand.
* Ratios.  Per answer and path, text length, punctuation and linked text are aggregated; each node takes its path's
  ratio, and the sequence of ratios is smoothed with a small Gaussian window, so a short value beside long ones keeps
  its company.  Over all answers, a path's score is its smoothed text ratio, raised by punctuation and lowered by the
  share of linked text.
* Content.  Paths are content if their score reaches a fixed share of the geometric mean over nodes, which one huge
  node doesn't move.  All other nodes are left out of every value, wherever they stand.
* Fields.  Two more aggregates of the same pass tell what content paths hold.  An inline path carries labels if most of
  its elements are labels that are known; a block path carries the texts of results if most of its blocks are followed
  by a block with labels.  A text begins a result; a block with labels belongs to the text before it, or begins one.

Answers are parsed once and written; ratios are aggregated from what was written and joined back to it.

Clean values lose tags, comments, scripts, styles, link targets and emphasis marks (HTML, Markdown, wiki, LaTeX); they
keep headings, list items, cells, code, note numbers and formulas.  Entities are decoded until none is left.

NULL and empty answers hold nothing.  Stray and crossed end tags close what they can and are otherwise ignored.  Rows
given twice are read twice.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .base import cut, map_arrow

# Labels of the values in an answer.
LABELS = {"الراوي": "rawi", "المحدث": "muhaddith", "المصدر": "book", "الصفحة أو الرقم": "ref", "خلاصة حكم المحدث": "verdict"}
SHARE_OF_MEAN = 0.1
_VOID = {"br", "hr", "img", "link", "meta", "input", "wbr", "col", "area", "base", "source"}
_INLINE = {"span", "a", "b", "i", "em", "strong", "u", "font", "mark", "sup", "sub", "code", "small", "big", "s", "tt", "q", "cite", "abbr", "ins", "del"}

_GONE = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<![^>]*>|<\?.*?>")
_TAG = re.compile(r"""(?s)<(/?)([A-Za-z][\w:-]*)((?:\s*(?:[^\s"'>=/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+))?|/))*)\s*>""")
_CLASS = re.compile(r"""(?i)\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_COUNTER = re.compile(r"^\s*\d+\s*-\s*")
_FORMULA = regex.compile(r"(?s)\$\$.+?\$\$|\$[^$\n]+\$|\\\(.+?\\\)|\\\[.+?\\\]|\\begin\{(equation|align|math|displaymath)\*?\}.*?\\end\{\1\*?\}")
_FENCE = re.compile(r"(?s)```.*?```")
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{Nd}]+")
# What structure tags become in clean text, where they open and where they close.
_OPENS = {"p": "\n", "div": "\n", "br": "\n", "hr": "\n", "ul": "\n", "ol": "\n", "table": "\n", "tr": "\n", "blockquote": "\n", "pre": "\n",
          "li": "\n- ", "td": " | ", "th": " | ", "code": "`", **{f"h{i}": "\n# " for i in range(1, 7)}}
_CLOSES = {**_OPENS, "li": "", **{f"h{i}": "\n" for i in range(1, 7)}}


@lru_cache(maxsize=1 << 14)
def _kind(attributes: str) -> str:
    m = _CLASS.search(attributes)
    return next((x for x in m.groups() if x is not None), "").strip().lower() if m else ""


class Answer:
    """One pass over the tags of an answer.

    ``paths`` numbers block paths and, behind ">", inline paths; ``blocks`` are (parent, path); ``pieces`` are [block,
    inline path if it may be a label else -1, text with structure]; ``nodes`` are (block, shown text, whether linked);
    ``inline`` are (inline path, whether it is a known label).
    """

    __slots__ = ("paths", "blocks", "pieces", "nodes", "inline")

    def __init__(self, source: str):
        self.paths: dict[str, int] = {"": 0}
        self.blocks: list[tuple[int, int]] = [(-1, 0)]
        self.nodes: list[tuple[int, str, bool]] = []
        self.inline: list[tuple[int, bool]] = []
        source = _GONE.sub("", source) if "<!" in source or "<?" in source or "<s" in source or "<S" in source else source
        names, flow, elements = [""], [], []  # path of each block; (block, text); (inline path, from, to)
        stack: list[tuple[str, int]] = []
        open_inline: list[tuple[str, str, int]] = []
        here = links = at = 0
        for m in _TAG.finditer(source):
            a, b = m.span()
            if a > at:
                self._text(flow, here, source[at:a], links > 0)
            at = b
            closes, name = m[1] == "/", m[2].lower()
            if name in _VOID:
                if name in _OPENS:
                    flow.append((here, _OPENS[name]))
            elif name in _INLINE:
                if name == "a":
                    links = max(0, links + (-1 if closes else 1))
                if name == "code":
                    flow.append((here, "`"))
                if not closes:
                    kind = _kind(m[3])
                    open_inline.append((name, f"{names[here]}>{name}.{kind}" if kind else f"{names[here]}>{name}", len(flow)))
                else:
                    for i in range(len(open_inline) - 1, -1, -1):
                        if open_inline[i][0] == name:
                            _, path, first = open_inline.pop(i)
                            elements.append((path, first, len(flow)))
                            break
            elif not closes:
                kind = _kind(m[3])
                leaf = f"{name}.{kind}" if kind else name
                names.append(f"{names[here]}/{leaf}" if names[here] else leaf)
                self.blocks.append((here, self.paths.setdefault(names[-1], len(self.paths))))
                stack.append((name, here))
                here = len(self.blocks) - 1
                open_inline.clear()
                flow.append((here, _OPENS.get(name, "")))
            elif any(t == name for t, _ in stack):
                flow.append((here, _CLOSES.get(name, "")))
                open_inline.clear()
                while True:
                    t, here = stack.pop()
                    if t == name:
                        break
        if at < len(source):
            self._text(flow, here, source[at:], links > 0)
        self._pieces(flow, elements)

    def _text(self, flow, here, text, linked):
        flow.append((here, text))
        if not text.isspace():
            self.nodes.append((here, html.unescape(text) if "&" in text else text, linked))

    def _pieces(self, flow, elements):
        known = [label_of("".join(t for _, t in flow[a:b])) is not None for _, a, b in elements]
        at_label = {path for (path, _, _), k in zip(elements, known) if k}
        start = {}
        for (path, a, b), k in zip(elements, known):
            no = self.paths.setdefault(path, len(self.paths))
            self.inline.append((no, k))
            if path in at_label and b > a:
                start[a] = (no, b)
        self.pieces: list[list] = []
        i = 0
        while i < len(flow):
            label, end = start.get(i, (-1, i + 1))
            block, text = flow[i][0], "".join(t for _, t in flow[i:end])
            if label < 0 and self.pieces and self.pieces[-1][0] == block and self.pieces[-1][1] < 0:
                self.pieces[-1][2] += text
            else:
                self.pieces.append([block, label, text])
            i = end


@lru_cache(maxsize=1 << 14)
def label_of(text: str) -> str | None:
    """The field a known label names."""
    return LABELS.get(_SPACE.sub(" ", decoded(text)).strip().rstrip(":").strip())


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Per code point 1 for letters and decimal digits, 2 for punctuation, else 0; planes without letters are left out."""
    t = np.zeros(0x110000, np.uint8)
    for cp in range(0x33480):
        c = unicodedata.category(chr(cp))
        t[cp] = 1 if c[0] == "L" or c == "Nd" else 2 if c[0] == "P" else 0
    return t


STATS = ("nodes", "soft", "letters", "punct", "linked", "blocks", "followed", "inline", "known")


def ratios(answers: list[Answer]) -> list[np.ndarray]:
    """Per answer a table path x ``STATS``."""
    texts = [t for a in answers for _, t, _ in a.nodes]
    codes, lens = vec.codes_of(pa.array(texts, pa.string()))
    kind = _classes()[codes]
    node = np.repeat(np.arange(len(lens)), lens)
    n, p = (np.bincount(node[kind == k], minlength=len(lens)) for k in (1, 2))
    out, done = [], 0
    for a in answers:
        t = np.zeros((len(a.paths), len(STATS)))
        some = [(i, b, linked) for i, (b, _, linked) in enumerate(a.nodes, done) if n[i] or p[i]]
        done += len(a.nodes)
        if some:
            i, block, linked = (np.array(x) for x in zip(*some))
            path = np.array([x for _, x in a.blocks])[block]
            for c, v in ((0, np.ones(len(i))), (2, n[i]), (3, p[i]), (4, n[i] * linked)):
                t[:, c] = np.bincount(path, weights=v, minlength=len(t))
            ratio = t[path, 2] / t[path, 0]
            soft = np.convolve(np.pad(ratio, 1, mode="edge"), (0.25, 0.5, 0.25), "valid")
            t[:, 1] = np.bincount(path, weights=soft, minlength=len(t))
            _followers(a, t, set(block[(n[i] > 0) & ~linked.astype(bool)].tolist()))
        for no, k in a.inline:
            t[no, 7] += 1
            t[no, 8] += k
        out.append(t)
    return out


def _followers(a: Answer, t: np.ndarray, holders: set[int]) -> None:
    """Blocks with text of their own, and how many of them come just before a block with labels."""
    labelled = {block for block, label, _ in a.pieces if label >= 0}
    before: int | None = None
    for b in sorted(holders | labelled):  # blocks are numbered as they begin
        parent, path = a.blocks[b]
        t[path, 5] += 1
        if b in labelled and before is not None:
            t[a.blocks[before][1], 6] += 1
        while parent > 0 and parent != before:
            parent = a.blocks[parent][0]
        before = before if parent == before and before is not None and b not in labelled else b  # what is inside a block doesn't follow it


def _parse(batch):
    answers = [Answer(s or "") for s in batch["source"].to_pylist()]
    tables = ratios(answers)
    offsets = lambda sizes: np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    lists = lambda sizes, values, kind: pa.ListArray.from_arrays(pa.array(offsets(sizes)), pa.array(values, kind))
    n_paths, n_blocks, n_pieces = ([len(getattr(a, c)) for a in answers] for c in ("paths", "blocks", "pieces"))
    out = {"key": batch["key"], "paths": lists(n_paths, [p for a in answers for p in a.paths], pa.string())}
    flat = np.concatenate(tables) if tables else np.zeros((0, len(STATS)))
    out |= {c: lists(n_paths, flat[:, i], pa.float64()) for i, c in enumerate(STATS)}
    out |= {c: lists(n_blocks, [b[i] for a in answers for b in a.blocks], pa.int32()) for i, c in enumerate(("parent", "path_no"))}
    kinds = (pa.int32(), pa.int32(), pa.string())
    return out | {c: lists(n_pieces, [x[i] for a in answers for x in a.pieces], k) for (i, c), k in zip(enumerate(("piece_block", "piece_label", "piece_text")), kinds)}


def parsed(answers: DataFrame) -> DataFrame:
    """Answers (key, source) parsed once and written: (row, key, paths, statistics of each path, blocks, pieces)."""
    kind = answers.schema["key"].dataType.simpleString()
    schema = ", ".join([f"key {kind}", "paths array<string>", *(f"{c} array<double>" for c in STATS), "parent array<int>", "path_no array<int>",
                        "piece_block array<int>", "piece_label array<int>", "piece_text array<string>"])
    given = answers.select("key", "source").where("key is not null and source is not null")
    return cut(map_arrow(given, _parse, schema)).withColumn("row", F.monotonically_increasing_id())


def scored_paths(written: DataFrame, share_of_mean: float = SHARE_OF_MEAN) -> DataFrame:
    """(path, nodes, score, content, leads, labels) over all answers.

    ``content``: the score reaches the threshold, NULL for paths without text of their own; ``leads``: most of its blocks come before one with labels; ``labels``:
    most of its inline elements are known labels.
    """
    per = written.select(F.explode(F.arrays_zip(F.col("paths").alias("path"), *STATS)).alias("x")).select("x.*").groupBy("path").agg(*[F.sum(c).alias(c) for c in STATS])
    some = F.when(F.col("letters") > 0, 1 - F.col("linked") / F.col("letters")).otherwise(0.0)
    score = F.when(F.col("nodes") > 0, (F.col("soft") / F.col("nodes")) * (1 + F.col("punct") / (F.col("letters") + 1)) * some).otherwise(0.0)
    per = per.withColumn("score", score)
    mean = per.agg((F.exp(F.sum(F.log1p("score") * F.col("nodes")) / F.sum("nodes")) - 1).alias("mean"))
    content = F.when(F.col("nodes") > 0, F.col("score") >= F.col("mean") * share_of_mean)
    return per.crossJoin(F.broadcast(mean)).select(  # one row
        "path", F.col("nodes").cast("long").alias("nodes"), F.round("score", 4).alias("score"), content.alias("content"),
        ((F.col("followed") > 0) & (F.col("followed") * 2 >= F.col("blocks"))).alias("leads"), ((F.col("known") > 0) & (F.col("known") * 2 >= F.col("inline"))).alias("labels"),
    )


def path_scores(answers: DataFrame) -> DataFrame:
    """(path, nodes, score, content) of the block paths with text of answers (key, source)."""
    return scored_paths(parsed(answers)).where("nodes > 0").select("path", "nodes", "score", "content")


def decoded(text: str) -> str:
    while "&" in text:  # each round is shorter than the one before
        new = html.unescape(text)
        if new == text:
            break
        text = new
    return text


_EMPHASIS = [(regex.compile(a), b) for a, b in (
    (r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1"),
    (r"!?\[([^\[\]]*)\]\((?:[^()\s]|\([^()\s]*\))*(?:\s+\"[^\"]*\")?\)", r"\1"),
    (r"\\href\s*\{[^{}]*\}\s*\{([^{}]*)\}", r"\1"),
    (r"\\(?:text(?:bf|it|tt|sc|rm|sf|sl|normal|md|up)|emph|underline|textsuperscript|textsubscript|mbox|bf|it|em)\s*\{([^{}]*)\}", r"\1"),
    (r"(?m)^\s*\\(?:sub)*section\*?\s*\{([^{}]*)\}", r"# \1"),
    (r"(?s)(\*{1,3}|_{2,3})(?=\S)(.+?)(?<=\S)\1", lambda m: m[2] if m[1] != "*" or "\n" not in m[2] else m[0]),
    (r"(?s)'{2,5}(.+?)'{2,5}", r"\1"),
    (r"(?s)~~(.+?)~~", r"\1"),
)]
_STRUCTURE = [(regex.compile(a), b) for a, b in (
    (r"(?m)^\s*\\item\b\s*", "- "),
    (r"\\(?:begin|end)\s*\{(?:itemize|enumerate|center|quote)\}", ""),
    (r"(?m)^\s*={1,6}\s*(.+?)\s*={1,6}\s*$", r"# \1"),
)]
_KEPT = re.compile("\ue000(\\d+)\ue001")
_ANY_MARK = re.compile(r"[\[*_~'\\=]")
_LINES, _BLANKS, _SPACE = re.compile(r"[^\S\n]*\n\s*"), re.compile(r"[^\S\n]+"), re.compile(r"\s+")


def _marks(text: str) -> str:
    """Emphasis marks, links and commands of Markdown, wiki and LaTeX, outside formulas and code."""
    if not _ANY_MARK.search(text):
        return text
    kept: list[str] = []

    def keep(m):
        kept.append(m[0])
        return f"\ue000{len(kept) - 1}\ue001"

    text = _FORMULA.sub(keep, _FENCE.sub(keep, text))
    old = None
    while text != old:  # each round is shorter than the one before
        old = text
        for pattern, instead in _EMPHASIS:
            text = pattern.sub(instead, text)
    for pattern, instead in _STRUCTURE:
        text = pattern.sub(instead, text)
    return _KEPT.sub(lambda m: kept[int(m[1])], text) if kept else text


def _plain(text: str) -> str:
    """Text whose tags are structure already, as clean text."""
    return _LINES.sub("\n", _BLANKS.sub(" ", _marks(decoded(text)))).strip()


def clean(fragment: str) -> str:
    """A marked-up fragment as clean text with its structure."""
    return _plain("".join(text for _, _, text in Answer(fragment).pieces))


def letters(text: str) -> str:
    return _NOT_LETTERS.sub("", text)


def results(parent, path_no, piece_block, piece_label, piece_text, content, leads, labels) -> list[tuple[int, str, str]]:
    """(item number, field, clean value) of a parsed answer, given what its paths are."""
    labelled = {b for b, label in zip(piece_block, piece_label) if b and label >= 0 and labels[label] and content[path_no[b]]}
    unit: list[int] = []  # of each block: the block it is read with, or -1
    for b, (up, path) in enumerate(zip(parent, path_no)):
        above = unit[up] if b else -1  # text outside all blocks belongs to none
        if content[path] is False:
            unit.append(-1)
        elif b in labelled or (above < 0 and b and content[path] and leads[path]):
            unit.append(b)
        else:
            unit.append(above)
    found: dict[int, list[tuple[str | None, list[str]]]] = {}
    for b, label, text in zip(piece_block, piece_label, piece_text):
        u = unit[b]
        if u >= 0:
            parts = found.setdefault(u, [(None, [])])
            if label >= 0 and labels[label]:
                parts.append((label_of(text), []))
            else:
                parts[-1][1].append(text)
    out, item, taken = [], 0, True
    for u in sorted(found):
        if u in labelled:
            item += taken
            taken = True
            out += [(item, field, _plain("".join(texts))) for field, texts in found[u] if field]
        else:
            item, taken = item + 1, False
            raw = "".join(found[u][0][1])
            short = _COUNTER.sub("", raw, 1)
            out.append((item, "text", _plain(short) if short != raw else _COUNTER.sub("", _plain(raw), 1)))
    return out


_READ = ("parent", "path_no", "piece_block", "piece_label", "piece_text")
_FLAGS = ("content", "leads", "labels")


def fields(answers: DataFrame, share_of_mean: float = SHARE_OF_MEAN) -> DataFrame:
    """(key, item_no, field_name, value, letters_md5) of the content nodes of answers (key, source); values without letters are left out."""
    kind = answers.schema["key"].dataType.simpleString()
    written = parsed(answers)

    def fn(batch):
        given = [batch[c].to_pylist() for c in ("key", *_READ, *_FLAGS)]
        rows = [(k, i, f, v, hashlib.md5(w.encode()).hexdigest()) for k, *answer in zip(*given) for i, f, v in results(*answer) if (w := letters(v))]
        cols = list(zip(*rows)) or [[]] * 5
        kinds = (batch.schema.field("key").type, pa.int32(), pa.string(), pa.string(), pa.string())
        return {n: pa.array(list(c), t) for n, c, t in zip(("key", "item_no", "field_name", "value", "letters_md5"), cols, kinds)}

    of_path = scored_paths(written, share_of_mean).select("path", *_FLAGS)
    used = written.select("row", F.posexplode("paths").alias("no", "path")).join(of_path.hint("merge"), "path")
    flags = used.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("no", *_FLAGS))).alias("f"))  # an answer's own paths
    read = written.select("row", "key", *_READ).join(flags.hint("merge"), "row").select("key", *_READ, *[F.col("f")[c].alias(c) for c in _FLAGS])
    return map_arrow(read, fn, f"key {kind}, item_no int, field_name string, value string, letters_md5 string")
