"""Garbled text from wrong character encoding (problem 8).

Best-first search over the operations "encode as X, decode as Y" and "unescape",
with the visited texts hashed.  A cost of implausible characters guides it: the
cheapest text that can be reached wins if it is clearly cheaper than the input.
The search has no bound on its depth or on the texts it looks at: it ends at a
text that is plausible throughout or when no way is left.  Undoing a wrong reading
of UTF-8 and unescaping are always followed (each shortens the text); a change
between two legacy codes costs more and is followed where it at least halves the
cost, so the ways are few and end.  A caller may set ``max_expanded``.
The search runs on lines and, where a line as a whole has no way back, on the
runs of words that hold unusual characters, so partly garbled texts are found.

Defined results: null, empty and plain ASCII texts are never garbled; a text
with U+FFFD, itself read in whatever code, has lost characters and counts as
garbled, its other parts are restored; a text is compared whole, however long; extra columns are dropped.
"""

from __future__ import annotations

import codecs
import heapq
import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Russian letters by how common they are.
_RU = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
_RU_COST = {c: 0.02 + 0.025 * i for i, c in enumerate(_RU)}
#: Accented letters of the languages at hand.
_COMMON_LATIN = set("áàâäãåçéèêëíìîïñóòôöõøúùûüæœßÁÀÂÄÃÅÇÉÈÊËÍÎÏÑÓÔÖÕØÚÙÛÜÆŒ")
_QUOTES = set("’‘“”«»–—…‹›„‚\u00a0")
#: Accented letters that stand side by side in the languages at hand.
_PAIRS = {"çã", "çõ", "ée", "éé", "äß", "öß", "üß", "ñá", "ñó", "ñí"}
MIN_GAIN = 2.2
#: Cost above that of plausible characters from which a piece is searched.
SUSPICIOUS = 1.0
#: What a step of the search costs: to UTF-8 or unescaped, part by part, between legacy codes.
UTF8_STEP, PART_STEP, LEGACY_STEP = 0.2, 0.3, 0.6
#: A change between legacy codes is followed if it leaves this share of the cost at most.
LEGACY_GAIN = 0.5
#: Letters of scripts without a frequency of their own: first and end code point, class.
_SCRIPTS = (
    (0x370, 0x400, "g"), (0x1F00, 0x2000, "g"), (0x530, 0x590, "e"), (0x590, 0x600, "w"), (0x600, 0x780, "r"), (0x8A0, 0x900, "r"), (0x900, 0xE00, "d"), (0xE00, 0xF00, "t"),
    (0x10A0, 0x1100, "e"), (0x1200, 0x1380, "e"), (0x1100, 0x1200, "n"), (0x3130, 0x3190, "n"), (0xAC00, 0xD7B0, "n"), (0x1780, 0x1800, "t"),
)
_SCRIPT_LETTERS = "gewrdtn"


def _frequent_han(c: str) -> bool:
    """In the first level of the Chinese or the Japanese standard."""
    for code, last in (("gb2312", 0xD7), ("euc_jp", 0xCF)):
        try:
            if 0xB0 <= c.encode(code)[0] <= last:
                return True
        except UnicodeEncodeError:
            pass
    return False


def _kind(c: str) -> tuple[str, float]:
    """(class of a character, its own cost)."""
    o = ord(c)
    if o < 0x80:
        return ("a" if c.isalpha() else "s" if c.isspace() else "p"), (2.0 if o < 32 and c not in "\t\r\n" else 0.0)
    if o < 0xA0:
        return "x", 4.0
    if c == "�":
        return "f", 3.0
    if 0xE000 <= o <= 0xF8FF:
        return "x", 4.0
    if c in _QUOTES:
        return "q", 0.1
    if 0x2500 <= o < 0x25A0:
        return "b", 0.7
    if o in (0xAA, 0xBA):
        return "y", 0.3
    if c.isalpha():
        if o < 0x250 or 0x1E00 <= o < 0x1F00:
            return "l", 0.3 if c in _COMMON_LATIN else 0.8
        if 0x400 <= o < 0x530:
            low = c.lower()
            return "c", _RU_COST.get(low, 1.3)
        if 0x3040 <= o < 0x3100:
            return "j", 0.15
        if 0x3400 <= o < 0xA000:
            return "j", 0.2 if _frequent_han(c) else 1.0
        if 0xFF66 <= o < 0xFFA0:
            return "h", 1.2
        for first, end, cls in _SCRIPTS:
            if first <= o < end:
                return cls, 0.18
        return "o", 0.8
    if 0x3000 <= o < 0x3040 or 0xFF00 <= o < 0xFF66 or 0x30FB <= o < 0x3100:
        return "j", 0.1
    if unicodedata.category(c) in ("Mn", "Cf"):
        return "m", 0.3
    return "y", 0.4


_kinds: dict[str, tuple[str, float]] = {}
_RUN = re.compile(r"[^\x00-\x7f]+(?:[A-Za-z]{1,2}[^\x00-\x7f]+)*")
_runs: dict[str, tuple[float, float]] = {}
_MEMO_SIZE = 60_000
#: What a plausible character of a class costs; more than that is suspicious.
_PLAIN = {"l": 0.3, "c": 0.24, "j": 0.2, "q": 0.1, "m": 0.3} | dict.fromkeys(_SCRIPT_LETTERS, 0.18)
_LETTERS, _CASED = frozenset("alc" + _SCRIPT_LETTERS), frozenset("alcge")


def _run_cost(run: str, skip: int) -> tuple[float, float]:
    """(cost, cost above that of plausible characters) of an unusual run; its first ``skip`` characters are context."""
    total = plain = 0.0
    classes: list[str] = []
    ups: list[bool] = []
    for i, c in enumerate(run):
        k = _kinds.get(c)
        if k is None:
            k = _kinds[c] = _kind(c)
        cls, own = k
        up = c.isupper() if cls in _CASED else False
        prev = classes[-1] if classes else "s"
        before = classes[-2] if len(classes) > 1 else "s"
        prev_up = ups[-1] if ups else True
        classes.append(cls)
        ups.append(up)
        if i < skip:
            continue
        total += own
        plain += _PLAIN.get(cls, 0.0)
        if cls in _LETTERS:
            if up and prev in "lcg" and not prev_up or up and cls != "a" and prev == "a" and not prev_up:
                total += 1.6  # a capital after a small letter
            if prev == "y" and before in _LETTERS:
                total += 1.6  # a symbol inside a word
            if cls == "l" and prev == "l" and (run[i - 1] + c).lower() not in _PAIRS:
                total += 0.8
            elif cls == "l" and prev not in "al" and not run[i + 1 : i + 2].isalpha():
                total -= own - 0.15  # a letter that stands alone
            elif prev != cls and prev != "a" and cls != "a" and (prev in _LETTERS or prev == "o") or cls == "a" and prev in "cgewr" or cls in "cgewr" and prev == "a":
                total += 1.2  # two scripts in a word
            elif cls == "c" and up and prev == "c" and prev_up:
                total += 0.25
            elif cls == "a" and prev == "j":
                total += 1.0
        elif cls in "yx":
            if prev in "lcgwr":
                total += 1.6
            elif prev in "yx" and run[i - 1] != c:
                total += 0.6
            elif prev in "aq" and (cls == "x" or prev == "q"):
                total += 1
        elif cls == "b":
            total += 1.6 if prev in "alc" else 0.0
        elif cls == "q":
            if c in "‚„‹" and prev in "alc" or c in "—–“" and prev in "alc" and run[i + 1 : i + 2].isalpha():
                total += 1.6
            elif c in "—–" and prev == "s" and run[i + 1 : i + 2].isalpha():
                total += 0.5  # a dash that clings to one word
            total += 0.5 if prev == "l" else 1.0 if prev == "y" and run[i - 1] not in "%)]" else 0.0
        elif cls == "j" and (prev in _LETTERS or prev == "o"):
            total += 1.0
    return total, total - plain


def costs(text: str) -> tuple[float, float]:
    """(implausibility of a text's characters, its part above that of plausible ones); 0 for plain ASCII."""
    total = above = 0.0
    for m in _RUN.finditer(text):
        a, b = max(0, m.start() - 2), min(len(text), m.end() + 2)
        key = text[a:b]
        hit = _runs.get(key)
        if hit is None:
            hit = _run_cost(key, m.start() - a)
            if len(_runs) < _MEMO_SIZE and len(key) < 200:
                _runs[key] = hit
        total += hit[0]
        above += hit[1]
    return total, above


def cost(text: str) -> float:
    return costs(text)[0]


def _sloppy(name: str) -> tuple[dict[int, int], str]:
    """(code point -> byte, decoding table) of a one-byte code; its undefined bytes stand for themselves."""
    table = []
    for b in range(256):
        try:
            table.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            table.append(chr(b))
    return {ord(c): b for b, c in enumerate(table)}, "".join(table)


_ONE_BYTE = ("cp1252", "latin-1", "mac_roman", "cp1251", "koi8_r", "cp866", "cp437", "cp850", "cp1250", "iso8859_5", "mac_cyrillic")
_MULTI = ("gbk", "cp932", "euc_jp", "big5")
_tables = {n: _sloppy(n) for n in _ONE_BYTE}
for _b in range(0x80, 0xA0):
    _tables["cp1252"][0].setdefault(_b, _b)  # texts mix cp1252 with Latin-1's control characters


def _sequences(name: str) -> re.Pattern:
    """UTF-8 sequences as they look when read in a one-byte code."""
    by_byte = [(b, chr(c)) for c, b in _tables[name][0].items()]
    pick = lambda lo, hi: "[" + "".join(re.escape(c) for b, c in by_byte if lo <= b <= hi) + "]"
    more = pick(0x80, 0xBF)
    return re.compile(f"{pick(0xC2, 0xDF)}{more}|{pick(0xE0, 0xEF)}{more}{{2}}|{pick(0xF0, 0xF4)}{more}{{3}}")


_partial = {n: _sequences(n) for n in ("cp1252", "mac_roman", "cp1251", "cp437", "cp850")}
_CROSS = {
    "cp1252": ("cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5", "gbk", "cp932", "euc_jp"),
    "latin-1": ("cp1251", "koi8_r", "cp866", "iso8859_5", "gbk", "cp932", "euc_jp"),
    "mac_roman": ("cp1252", "cp1251", "mac_cyrillic", "cp932", "gbk"),
    "cp1251": ("koi8_r", "cp866", "mac_cyrillic", "iso8859_5"),
    "koi8_r": ("cp1251", "cp866", "iso8859_5"),
    "cp866": ("cp1251", "koi8_r", "iso8859_5"),
    "iso8859_5": ("cp1251", "koi8_r", "cp866"),
    "mac_cyrillic": ("cp1251",),
    "cp437": ("cp1252", "cp866", "cp1251"),
    "cp850": ("cp1252", "cp866", "cp1251"),
    "cp1250": ("cp1252", "cp1251"),
}


def _encode(text: str, name: str) -> bytes | None:
    try:
        return codecs.charmap_encode(text, "strict", _tables[name][0])[0] if name in _tables else text.encode(name)
    except UnicodeEncodeError:
        return None


def _decode(data: bytes, name: str) -> str | None:
    try:
        return codecs.charmap_decode(data, "strict", _tables[name][1])[0] if name in _tables else data.decode(name)
    except UnicodeDecodeError:
        return None


def steps(text: str) -> Iterator[tuple[str, float]]:
    """(text, cost of the step) of every text that one operation makes of this one."""
    for name in (*_ONE_BYTE, *_MULTI):
        data = _encode(text, name)
        if data is None or data.isascii():
            continue
        if x := _decode(data, "utf-8"):
            yield x, UTF8_STEP
        for to in _CROSS.get(name, ()):
            if x := _decode(data, to):
                yield x, LEGACY_STEP
    for name, pattern in _partial.items():
        if pattern.search(text):

            def one(m: re.Match, name=name) -> str:
                return _decode(_encode(m[0], name), "utf-8") or m[0]

            yield pattern.sub(one, text), PART_STEP
    if "Ã " in text:  # a no-break space that became a plain one
        yield text.replace("Ã ", "Ã\u00a0"), UTF8_STEP
    if "&" in text and ";" in text:
        yield html.unescape(text), UTF8_STEP
    if "\\u" in text:
        yield re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text), UTF8_STEP


def search(text: str, max_expanded: int | None = None) -> tuple[str, float, float]:
    """(cheapest reachable text, its cost, cost of the text itself); costs hold the steps to a text."""
    start = cost(text)
    best = (start, text)
    heap = [(start, 0.0, text)]
    seen = {text}
    expanded = 0
    while heap and (max_expanded is None or expanded < max_expanded):
        _, way, at = heapq.heappop(heap)
        expanded += 1
        if at.isascii():
            continue
        here = cost(at)
        for x, price in steps(at):
            if x in seen:
                continue
            seen.add(x)
            c = cost(x) + way + price
            if c < best[0]:
                best = (c, x)
            if price != LEGACY_STEP or c - way <= LEGACY_GAIN * here:
                heapq.heappush(heap, (c, way + price, x))
        if costs(best[1])[1] < SUSPICIOUS:
            break  # plausible throughout
    return best[1], best[0], start


def _accepted(new: str, old: str) -> bool:
    """Clearly cheaper, and what was suspicious is mostly gone."""
    (c1, a1), (c0, a0) = costs(new), costs(old)
    return c0 - c1 >= MIN_GAIN and a1 <= 0.6 * a0


#: A line of nothing but box drawing is a drawing.
_DRAWING = re.compile(r"[\s\d|+\-─│┌┐└┘├┤┬┴┼═║╔╗╚╝]*")
_WORDS = re.compile(r"\S*[^\x00-\x7f]\S*(?:[^\S\n]+\S*[^\x00-\x7f]\S*)*")
_memo: dict[str, tuple[str, bool]] = {}
#: The mark of a lost character, also where its UTF-8 was read in another code.
_LOST = ("�", *sorted({_decode("�".encode(), n) for n in ("cp1252", "latin-1", "mac_roman", "cp1251", "cp437", "cp850")}))


def repair_line(line: str) -> tuple[str, bool]:
    """(restored line, whether it was garbled)."""
    if line.isascii():
        return line, False
    if (hit := _memo.get(line)) is not None:
        return hit
    lost = any(x in line for x in _LOST)
    if _DRAWING.fullmatch(line):
        return line, lost
    out, garbled = line, lost
    if costs(line)[1] >= SUSPICIOUS:
        found = False

        def piece(m: re.Match) -> str:
            nonlocal found
            if costs(m[0])[1] < SUSPICIOUS:
                return m[0]
            text, _, _ = search(m[0])
            if _accepted(text, m[0]) and costs(text)[1] < SUSPICIOUS:
                found = True
                return text
            return re.sub(r"\S+", piece, m[0]) if " " in m[0] else m[0]

        text, new, _ = search(line)
        whole = _accepted(text, line)
        if whole and costs(text)[1] < SUSPICIOUS:
            out, garbled = text, True
        else:  # piece by piece, if less is left that is suspicious
            pieces = _WORDS.sub(piece, line)
            if found and (not whole and cost(pieces) <= new or costs(pieces)[1] + 0.5 < costs(text)[1]):
                out, garbled = pieces, True
            elif whole:
                out, garbled = text, True
    if len(_memo) < _MEMO_SIZE and len(line) < 2000:
        _memo[line] = (out, garbled)
    return out, garbled


def repair(text: str | None) -> tuple[str | None, bool]:
    """(restored text, whether any part was garbled)."""
    if not text or text.isascii():
        return text, False
    parts, any_garbled = [], False
    for line in text.split("\n"):
        x, g = repair_line(line)
        parts.append(x)
        any_garbled |= g
    return "\n".join(parts), any_garbled


def restore(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, garbled, restored): restored is the text with every garbled part undone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [repair(t) for t in pdf[text]]
            yield pd.DataFrame({key: pdf[key], "garbled": [g for _, g in done], "restored": pd.array([t for t, _ in done], dtype="object")})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, garbled boolean, restored string")
