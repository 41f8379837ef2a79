"""Sentence boundaries across languages and scripts.

Method: lines are grouped into blocks (heading, list line, fenced code, paragraph); over each paragraph a pushdown
automaton runs on the structural characters only (end marks, openers, closers, quotes, spaces between Thai letters).
Its stack holds the open quotations and brackets, so end marks inside them never end the sentence around them; a group
that stands alone and ends with an end mark is a sentence. Before a full stop, abbreviations are read backwards in a
trie; its entry says whether the stop never ends a sentence, ends it before a capital, or needs a number behind it.

Output: one row per unit with code-point offsets, neither end on white space. A null, empty or blank text has no units;
a repeated row gives its units again. Any length of text works: one pass, nothing cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Unicode White_Space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_STRIP = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
WIDE_END = "。！？｡।॥؟۔"
THAI = "ก-ฺเ-๎"
CJK = "　-ヿ㐀-鿿＀-￯"
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "「": "」", "『": "』", "《": "》", "«": "»", "“": "”", "‘": "’", "„": "“", "‚": "‘", "〈": "〉", "［": "］", "‹": "›"}
BRACKETS = set("([{（【［")
CLOSERS = set(PAIRS.values()) | {'"', "'"}

#: Abbreviations (fixed values). NEVER: the stop does not end a sentence. CASE: it does before a capital. NUMBER: it doesn't before a number.
NEVER = """e.g i.e a.k.a cf vgl ср approx ca vs bzw ggf resp Dr Mr Mrs Ms Mx Prof St Hr Fr Sr Sra Srta Dra Mme Mlle MM Me Rev Gen Col Lt Capt Sen Rep Hon Ing Dipl evtl sog inkl exkl
напр см См тов гр акад c.-à-d p.ex p.ej z.B d.h u.a т.е т.н núm pág págs fig Fig figs Figs Abb Tab Nr Bd рис стр гл EE env av""".split()
CASE = """etc usw u.s.w т.д т.п a.m p.m U.S U.K U.N E.U D.C Inc Ltd Co Corp UU Jr Snr al ed gr др пр""".split()
NUMBER = """No Nos Sec Secs Ch Chap Vol Art Eq Ref Refs App p pp S n nos Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec п ст т vol art chap sec cap tom""".split()
#: After a day number a German sentence goes on with the month (fixed values).
MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jänner"
#: What goes on after a closed quotation or an ellipsis in scripts without capitals (fixed values).
GO_ON = re.compile(r"(?:然后|但是|而且|并且|于是|所以|不过|接着|随后|就|并|地|说|说道|写道|と|って|という|は|が|を|に|の|라고|하고|고|이라고|ثم|وقال|و(?=[؀-ۿ])|कहा|और|फिर|แล้ว)")
#: A word in lower case that names a thing of code: a capital inside, or a path, call or quoted code.
LOWER_NAME = re.compile(r"(?:[a-z]+[A-Z]\w*|\S*[/_`(]\S*)")

_TRIE: dict = {}
for _kind, _words in (("never", NEVER), ("case", CASE), ("number", NUMBER)):
    for _w in sorted({*_words, *(w[0].upper() + w[1:] for w in _words)}):
        _n = _TRIE
        for _c in reversed(_w):
            _n = _n.setdefault(_c, {})
        _n[""] = _kind

_LINE = re.compile(r"[^\n\r]*(?:\r\n|\n|\r|$)")
_FENCE = re.compile(r"[ \t]{0,3}(```+|~~~+)")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?=[ \t]|$)")
_LIST = re.compile(r"[ \t]*(?:[-*](?=[ \t])|\d+\.(?=[ \t]))")
_EVENT = re.compile("`+|(?:[.!?…]|[" + WIDE_END + "])+|[" + re.escape("".join(set(PAIRS) | CLOSERS)) + "]|(?<=[" + THAI + "])[^\\S\\n\\r]+(?=[" + THAI + "])")
_AFTER = re.compile(r"""(?:[)\]}”’»」』）】》〉›"']|\*+(?=\s|$)|_+(?=\s|$)|\[\d+(?:\s*[,–-]\s*\d+)*\]|[¹²³⁰-⁹])+""")
_NOTE = re.compile(r"\[\d+(?:\s*[,–-]\s*\d+)*\]")
_WS = re.compile("[" + SPACE + "]+")
#: A sentence set without a space behind the stop of the one before it: a capitalised word that ends in a space.
_GLUED = re.compile(r"[^\W\d_a-zà-ÿа-я][^\W\d_A-ZА-Я]*(?=[\s,])")
_CJK = re.compile("[" + CJK + "]")


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" \t"))


def _blocks(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) with kind unit or para, in order.

    The open list levels are kept on a stack of indentations. A number and a full stop begin a list line after running text
    only where a list is open at that indentation or around it; elsewhere it is a wrapped line.
    """
    pos, n, para, fence, mark, before = 0, len(text), None, None, "", "blank"
    levels: list[int] = []
    while pos < n:
        m = _LINE.match(text, pos)
        end = m.end()
        line = text[pos:end]
        if fence is not None:
            s = line.strip(_STRIP)
            if s.startswith(mark) and not s.strip(mark[0]):
                yield "unit", fence, end
                fence, before = None, "unit"
            pos = end
            continue
        if not line.strip(_STRIP):
            if para is not None:
                yield "para", para, pos
            para, before = None, "blank"
        elif f := _FENCE.match(line):
            if para is not None:
                yield "para", para, pos
            para, fence, mark = None, pos, f[1]
        elif (head := _HEADING.match(line)) or ((x := _LIST.match(line)) and (before != "para" or not x[0].strip()[0].isdigit() or levels and (_indent(x[0]) in levels or _indent(x[0]) > levels[-1]))):
            if para is not None:
                yield "para", para, pos
            yield "unit", pos, end
            para, before = None, "unit"
            if head:
                levels.clear()
            else:
                while levels and levels[-1] >= _indent(x[0]):
                    levels.pop()
                levels.append(_indent(x[0]))
        else:
            # Text that is not indented deeper than a level ends it.
            while levels and (before == "blank" or para is not None) and levels[-1] >= _indent(line):
                levels.pop()
            if para is None:
                para = pos
            before = "para"
        pos = end
    if fence is not None:
        yield "unit", fence, n
    elif para is not None:
        yield "para", para, n


def _abbreviation(t: str, at: int, start: int) -> str | None:
    """The trie's entry for the word that ends before the stop at ``at``; spaces inside (z. B.) are left out."""
    i, node = at - 1, _TRIE
    found = None
    while i >= start:
        c = t[i]
        if c.isspace():
            if i - 1 >= start and t[i - 1] == "." and "." in node:
                i -= 1
                continue
            break
        if c not in node:
            break
        node = node[c]
        i -= 1
        if "" in node and (i < start or not (t[i].isalnum() or t[i] == "_")):
            found = node[""]
    if found is None and at - 1 >= start and t[at - 1].isalpha() and (at - 2 < start or not (t[at - 2].isalnum() or t[at - 2] in "_'’")):
        return "initial"
    return found


def _match_groups(t: str, events: list[tuple[int, int, str]]) -> dict[int, int]:
    """Event index of each opener -> that of its closer, for those that are closed inside the paragraph."""
    stack: list[tuple[int, str]] = []
    # Depths of the open groups by what closes them: a closer finds its opener, or none, without a search.
    depth: dict[str, list[int]] = {}
    pairs: dict[int, int] = {}
    n = len(t)

    def push(k: int, want: str) -> None:
        depth.setdefault(want, []).append(len(stack))
        stack.append((k, want))

    def close(s: str, k: int) -> None:
        d = depth[s][-1]
        pairs[stack[d][0]] = k
        while len(stack) > d:
            depth[stack.pop()[1]].pop()

    for k, (i, _, s) in enumerate(events):
        if s[0] == "`":
            if depth.get(s):
                close(s, k)
            else:
                push(k, s)
            continue
        if len(s) != 1 or (s not in PAIRS and s not in CLOSERS):
            continue
        before, after = (t[i - 1] if i else " "), (t[i + 1] if i + 1 < n else " ")
        opens = s in PAIRS
        if s in "\"'":
            opens = (not before.isalnum()) and not after.isspace() and (before.isspace() or before in "([{（「“‘«„:：" or _CJK.match(before) is not None)
            want = s
        elif s in "’‘“":
            if depth.get(s):  # also closes „ and ‚
                opens = False
            elif s == "’":
                opens = False
            want = PAIRS.get(s, "")
        else:
            want = PAIRS.get(s, "")
        if s in "'’" and before.isalnum() and after.isalnum():
            continue
        if s in CLOSERS and not (opens and s not in "\"'"):
            if depth.get(s) and not (s in "\"'" and opens and before.isspace()):
                close(s, k)
                continue
        if opens:
            push(k, want)
    return pairs


def _name_before(t: str, at: int, start: int) -> bool:
    """Does a capitalised word of Latin letters, set apart before, end at this place?"""
    i = at
    while i > start and (t[i - 1].isalnum() or t[i - 1] == "_"):
        i -= 1
    return i < at and "A" <= t[i] <= "Z" and (i == start or t[i - 1].isspace() or t[i - 1] == "(")


def _starts_low(t: str, i: int) -> bool:
    return i < len(t) and t[i].islower() and not LOWER_NAME.match(t, i)


def _sentences(t: str) -> Iterator[tuple[int, int]]:
    """Offsets of the sentences of one paragraph."""
    n = len(t)
    events = [(m.start(), m.end(), m[0]) for m in _EVENT.finditer(t)]
    pairs = _match_groups(t, events) if events else {}
    begin = _WS.match(t).end() if _WS.match(t) else 0
    k, count = 0, len(events)
    while k < count:
        i, j, s = events[k]
        if i < begin:
            k += 1
            continue
        cut = None
        if k in pairs:
            close = pairs[k]
            e = events[close][1]
            if s[0] != "`":
                inner = t[j : events[close][0]].rstrip(_STRIP).rstrip("”’»」』）)]\"'")
                ended = bool(inner) and (inner[-1] in ".!?…" or inner[-1] in WIDE_END) and not (inner[-1] == "." and _abbreviation(t, j + len(inner) - 1, j) is not None)
                if ended:
                    m = _WS.match(t, e)
                    nxt = m.end() if m else e
                    spaced = m is not None or nxt >= n or _CJK.match(t[nxt]) is not None or _CJK.match(t[e - 1]) is not None or (_CJK.match(inner[-1]) is not None)
                    alone = i == begin
                    on = nxt < n and (t[nxt] in ",;:，；：、،؛.!?…" or t[nxt] in WIDE_END)
                    if spaced and not on:
                        if s in BRACKETS:
                            if alone:
                                cut = e
                        elif nxt >= n or not ((_starts_low(t, nxt) and _CJK.match(inner[-1]) is None) or GO_ON.match(t, nxt)):
                            cut = e
                        if cut is not None and (m2 := _NOTE.match(t, e)):
                            cut = m2.end()
            k = close + 1
        elif s[0] in ".!?…" or s[0] in WIDE_END:
            k += 1
            wide = s[-1] in WIDE_END or any(c in WIDE_END for c in s)
            m = _AFTER.match(t, j)
            e = j
            if m:  # closers that belong to an open group are met as its end; here only loose ones and notes count
                e = m.end()
                while k < count and events[k][0] < e:
                    if k in pairs and not _NOTE.match(t, events[k][0]):
                        e = events[k][0]
                        break
                    k += 1
                while k < count and events[k][0] < e:
                    k += 1
            w = _WS.match(t, e)
            nxt = w.end() if w else e
            if nxt >= n:
                cut = e
            elif wide:
                cut = e
            else:
                cjk = i > 0 and _CJK.match(t[i - 1]) is not None
                if s[0] == "…" and len(s) > 1 or "…" in s or s.startswith(".."):
                    if w or cjk or _CJK.match(t[nxt]) is not None:
                        if not (GO_ON.match(t, nxt) if (cjk or not w or _CJK.match(t[nxt]) is not None) else _starts_low(t, nxt)):
                            cut = e
                    elif e == j and _CJK.match(t[nxt]) is None and _GLUED.match(t, nxt):
                        cut = e
                elif w or (e == j and i > begin and not t[i - 1].isspace() and _CJK.match(t[nxt]) is None and t[nxt].isupper() and _GLUED.match(t, nxt) and not _name_before(t, i, begin)) or (s[0] in "!?" and _CJK.match(t[nxt]) is not None and cjk):
                    cut = e
                    if s == ".":
                        kind = _abbreviation(t, i, begin) if i > begin else None
                        if e > j and kind is not None:
                            kind = None if kind in ("number",) else kind
                        if kind in ("never", "initial"):
                            cut = None
                        elif kind == "case":
                            c = t[nxt]
                            if c in "([\"“‘«„'" and nxt + 1 < n:
                                c = t[nxt + 1]
                            if not (c.isupper() or c == "`" or LOWER_NAME.match(t, nxt) or _CJK.match(c)):
                                cut = None
                        elif kind == "number":
                            if t[nxt].isdigit() or t[nxt].islower() or t[nxt] in "§#IVX" and not t[nxt + 1 : nxt + 2].islower():
                                cut = None
                        elif kind is None and t[i - 1 : i].isdigit() and re.match(rf"(?:{MONTHS})\b", t[nxt : nxt + 12]) and re.search(r"(?<![\w.,])\d{1,2}$", t[max(begin, i - 4) : i]):
                            cut = None
        elif s[0].isspace():
            k += 1
            if i > begin:
                cut = i
        else:
            k += 1
        if cut is not None:
            yield begin, cut
            w = _WS.match(t, cut)
            begin = w.end() if w else cut
            if begin >= n:
                return
    end = len(t.rstrip(_STRIP))
    if end > begin:
        yield begin, end


def split(text: str | None) -> list[tuple[int, int]]:
    """Offsets (start, end) of the units of a text."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    for kind, a, b in _blocks(text):
        if kind == "unit":
            piece = text[a:b]
            lead = len(piece) - len(piece.lstrip(_STRIP))
            out.append((a + lead, a + len(piece.rstrip(_STRIP))))
        else:
            out += [(a + x, a + y) for x, y in _sentences(text[a:b])]
    return out


def sentence_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_char, end_char) of every unit of every document; one Arrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts, ends = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for s, e in split(t):
                    ids.append(i)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "start_char", "end_char"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).where(docs[text_col].isNotNull()).mapInArrow(run, f"doc_id {kind}, start_char bigint, end_char bigint")
