"""p10: text that was decoded with the wrong encoding, found and repaired by round trips."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.terms import sliced

#: Legacy encodings as which UTF-8 bytes get read; where a byte has no character, the C1 control stands.
READ_AS = ("cp1252", "latin-1", "cp1251", "cp437", "cp850", "cp866", "koi8-r", "mac_roman", "iso8859-15", "cp1250")
#: Fixed values: (read as, meant) of text in an old encoding that was read as another old one.
LEGACY = (("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "gbk"), ("cp1252", "cp866"), ("cp1252", "big5"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"))
LATIN, REST = [x for x in LEGACY if x[0] == "cp1252"], [x for x in LEGACY if x[0] != "cp1252"]
#: Russian letters from frequent to rare.
RUSSIAN = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
RANK = {c: k for k, c in enumerate(RUSSIAN)}


def _table(codec: str) -> dict[str, int]:
    """Character -> byte of the upper half of a codec; undefined bytes are C1 controls."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out.setdefault(bytes([b]).decode(codec), b)
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


BYTES = {x: _table(x) for x in dict.fromkeys([*READ_AS, *(a for a, _ in LEGACY)])}
if "�" in BYTES["cp1252"]:
    raise AssertionError("a legacy table holds the replacement character")


def _class(table: dict[str, int], low: int, high: int) -> str:
    return "[" + "".join(re.escape(c) for c, b in table.items() if low <= b <= high) + "]"


def _utf8_pattern(codec: str) -> re.Pattern[str]:
    t = BYTES[codec]
    tail = _class(t, 0x80, 0xBF)
    one = f"(?:{_class(t, 0xC2, 0xDF)}{tail}|{_class(t, 0xE0, 0xEF)}{tail}{{2}}|{_class(t, 0xF0, 0xF4)}{tail}{{3}})"
    return re.compile(f"{one}+")


UTF8 = {x: _utf8_pattern(x) for x in READ_AS}
LEADS = {x: {c for c, b in BYTES[x].items() if 0xC2 <= b <= 0xF4} for x in READ_AS}
TAILS = {x: {c for c, b in BYTES[x].items() if 0x80 <= b <= 0xBF} for x in READ_AS}
#: Encodings whose upper half holds Cyrillic letters.
CYRILLIC = {"cp1251", "cp866", "koi8-r"}
#: Encodings whose upper half is made of letters and signs that good text has side by side.
PLAIN = {"mac_roman", "cp437", "cp850"}
#: What UTF-8 read in two of these always shows: signs for drawing boxes.
BOXES = {chr(n) for n in range(0x2500, 0x25A1)}
BOXED = {"cp866", "koi8-r"}
HIGH = re.compile(r"[^\x00-\x7f]")
LETTER = re.compile(r"[А-Яа-яЁё]")
#: Words of only upper-half Latin characters, as Cyrillic or Chinese bytes read as Latin show.
LATIN_RUN = re.compile(r"[\x80-\xffŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]+(?:[\s\d.,!?:;()\"'/+-]*[\x80-\xffŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]+)*")
#: Fixed value: the ten commonest letters of Russian, which make up over half of any text.
COMMON = "оеаинтсрвл"
#: Fixed value: the commonest characters of Chinese, which make up a third of any text.
CHINESE = set("的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实日军者意无力它与长把机十民第公此已工使情明性知全三又关点正业外将两高间由问很最重并物手应战向头文体政美相见被利什二等产或新己制身果加西斯月话合回特代内信表化老给世位次度门任常先海通教儿原东声提立及比员解水名真论处走义各入几口认条平系气题活尔更别打女变四神总何电数安少报才结反受目太量再感建务做接必场件计管期市直德资命山金指克许统区保至队形社便空决治展马科司五基眼书非则听白却界达光放强即像难且权思王象完设式色路记南品住告类求据程北边死张该交规万取拉格望觉术领共确传师观清今切院让识候带导争运")
#: Pairs of letters that Russian words don't have.
UNRUSSIAN = re.compile("\\b[ьъы]|[бвгджзклмнпрстфхцчшщ]й|[аеиоуыэюя][ьъ]|щ[бвгджзклмпстфхцчш]|[гкх][яю]|[жшщцч][ыэ]")
LATIN_CORE = re.compile(r"[\xa1-\xffŒœŠšŸŽžƒ€]{3}")
#: Runs of Cyrillic and of signs that its bytes show, within a sentence.
CYRILLIC_RUN = re.compile(r"[Ё-џҐґ─-╿▀-■\xa0-\xbf№]+(?:[\s\d,:;()\"'/+-]*[Ё-џҐґ─-╿▀-■\xa0-\xbf№]+)*")
HAN_RUN = re.compile(r"[　-鿿-￥㈠-㊣ㄅ-ㄩ�€\xa4-\xf7]*[　-鿿][　-鿿-￥�€\d.,\xa4-\xf7]*")


#: Where the blocks of letters of one script begin; a block lasts to the next begin. Signs that all scripts share are ``""``.
BLOCKS = [
    (0x0, "latin"), (0x250, "phonetic"), (0x2B0, ""), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x750, "arabic"),
    (0x780, "other"), (0x8A0, "arabic"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, ""), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E00, ""), (0x3040, "east"), (0x3130, "hangul"), (0x3190, "east"), (0xA000, "other"), (0xA720, "latin"),
    (0xA800, "other"), (0xAC00, "hangul"), (0xD800, ""), (0xF900, "east"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, ""), (0xFE70, "arabic"), (0xFEFF, ""), (0x10000, "other"),
    (0x1D000, ""), (0x1E000, "other"), (0x1F000, ""), (0x20000, "east"), (0x323B0, ""),
]
BEGINS = [b for b, _ in BLOCKS]
#: Punctuation that stands at the end of words in good text, and so is no proof of a wrong decoding behind a letter.
TYPOGRAPHIC = "”’»…–—"


@cache
def script(c: str) -> str:
    """The script of a letter, mark or number that isn't ASCII's; empty for signs and for spaces."""
    return BLOCKS[bisect_right(BEGINS, ord(c)) - 1][1] if unicodedata.category(c)[0] in "LMN" and not c.isdecimal() or c.isdecimal() and c > "\x7f" else ""


@cache
def _possible_text(c: str) -> bool:
    """Whether a character can stand in text of any language: it is assigned and no control."""
    return unicodedata.category(c) not in ("Cc", "Cn", "Co", "Cs")


def _plausible(c: str) -> bool:
    """Whether a character is a commonplace one of Western European, Russian, Ukrainian or East Asian prose.

    What a single sequence stands for must be one, unless the text has further proof; so must all
    that comes of an old encoding, as those have no wrong sequences.
    """
    n = ord(c)
    return (
        0xA0 <= n <= 0xFF or n in (0x152, 0x153, 0x160, 0x161, 0x178, 0x17D, 0x17E) or n == 0x401 or 0x410 <= n <= 0x44F or n in (0x451, 0x456, 0x457, 0x454, 0x404, 0x406, 0x407, 0x490, 0x491)
        or 0x2010 <= n <= 0x2026 or n in (0x20AC, 0x2122, 0x2116, 0x2030, 0x2039, 0x203A, 0x192, 0x2C6, 0x2DC, 0x2190, 0x2192, 0x2212, 0x200D, 0xFE0F) or 0x3000 <= n <= 0x30FF or 0x3400 <= n <= 0x9FFF or 0xFF00 <= n <= 0xFFEF or 0x1F300 <= n <= 0x1FAFF or n == 0xFEFF
    )


@cache
def _common_han(c: str) -> bool:
    """Whether a Han character is in the first level of GB 2312, ordered by use."""
    try:
        raw = c.encode("gb2312")
    except UnicodeEncodeError:
        return False
    return 0xB0 <= raw[0] <= 0xD7


def cost(text: str) -> float:
    """How garbled a passage looks: a weight for each unlikely character or sequence.

    Replacement characters, controls, box drawing and symbols that prose hardly has weigh by
    themselves; so do neighbours of different scripts, three or more upper-half Latin characters
    that follow one another, and lower case letters before upper case ones beyond ASCII. Letters of
    every script are cheap if they stand among their own; Russian ones weigh by their rarity, Han
    characters by whether they are common ones.
    """
    out, last = 0.0, ""
    for c in text:
        n = ord(c)
        own = ("latin" if c.isalpha() else "") if n < 0x80 else script(c)
        if own and last and own != last:
            out += 2.5
        last = own
        if n < 0x80:
            continue
        if n == 0xFFFD or not _possible_text(c):
            out += 3
        elif 0x2500 <= n <= 0x25A0:
            out += 2
        elif 0xA1 <= n <= 0xBF and c not in "°½©¿¡«»":
            out += 1
        elif 0x3400 <= n <= 0x9FFF:
            out += 0.1 if _common_han(c) else 1
        elif not _plausible(c):
            out += 0 if own == "latin" else 0.2 if own and own != "phonetic" else 1.5
    out += sum(1.5 * (len(m) - 2) for m in re.findall(r"[\xa1-\xff]{3,}", text))
    out += len(re.findall("[a-zà-öø-ÿ][À-ÖØ-ÞŸŠŽŒ]", text))
    letters = LETTER.findall(text)
    if letters:
        ranks = [RANK.get(c.lower(), 33) for c in letters]
        out += sum(max(0, r - 9) for r in ranks) / 12 + 2 * len(re.findall(r"[а-яё][А-ЯЁ]", text))
    return out


def _encode(text: str, codec: str) -> bytes | None:
    table = BYTES[codec]
    out = bytearray()
    for c in text:
        if c < "\x80":
            out.append(ord(c))
        elif (b := table.get(c)) is not None:
            out.append(b)
        elif c < "Ā":
            out.append(ord(c))
        else:
            return None
    return bytes(out)


def _possible(text: str) -> list[str]:
    """The encodings as which UTF-8 in this text may have been read, by the characters it has."""
    have = set(text)
    return [x for x in READ_AS if not have.isdisjoint(LEADS[x]) and not have.isdisjoint(TAILS[x]) and (x not in BOXED or not have.isdisjoint(BOXES)) and UTF8[x].search(text)]


def _decoded(codec: str, sequence: str) -> str | None:
    """What a run of UTF-8 sequences stands for, None if it is no valid or no possible text."""
    try:
        new = bytes(BYTES[codec][c] for c in sequence).decode("utf-8")
    except UnicodeDecodeError:
        return None
    inner = codec in ("cp1252", "latin-1")  # controls may be the bytes of a further layer
    return new if all(_possible_text(c) or inner and "\x80" <= c < "\xa0" for c in new) else None


def _falls(text: str, start: int, end: int, new: str) -> float:
    """By how much the cost falls if a run of UTF-8 sequences is undone, its neighbours counted.

    Each sequence weighs two, as such a one comes about by chance once in many pages.
    """
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    return cost(before + text[start:end] + after) + 2 * len(new) - cost(before + new + after)


def _utf8_once(text: str) -> tuple[str, int]:
    """One layer of UTF-8 sequences read as a legacy encoding undone: the text and the number of passages.

    Of the encodings the one is taken under which the cost falls most.
    """
    best, best_gain, best_n = text, 0.0, 0
    for codec in _possible(text):
        n, gain = 0, 0.0
        runs = [(m, new) for m in UTF8[codec].finditer(text) if (new := _decoded(codec, m.group())) is not None]
        sure = any(len(m.group()) > 4 for m, _ in runs) or len({m.group() for m, _ in runs if m.group()[-1] not in TYPOGRAPHIC}) > (2 if codec in CYRILLIC else 1)
        dense = _dense(text, runs) if sure else set()
        out, at = [], 0
        for (m, new), k in zip(runs, range(len(runs)), strict=True):
            old, fall = m.group(), _falls(text, m.start(), m.end(), new)
            if fall <= 0:
                continue
            if k not in dense:
                beside = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
                letters = set(map(script, new)) - {""}
                if codec in CYRILLIC and all(LETTER.match(c) for c in old) and not re.search("[A-Za-z]", beside) or codec in PLAIN and old.isalpha() and letters or len(letters) > 1:
                    continue
                if len(new) < 3 and re.search("[\xa1-\xff]", beside):
                    continue
                if len(new) == 1:
                    common = new < "\xa0" or _plausible(new) and "east" not in letters and not (codec in PLAIN and (len(old) < 3 or letters))
                    if not (fall >= 3 and old[-1] not in TYPOGRAPHIC or common and _alone(text, m, new, codec)):
                        continue
            out += [text[at : m.start()], new]
            at = m.end()
            n += 1
            gain += fall
        if n and gain > best_gain:
            best, best_gain, best_n = "".join(out) + text[at:], gain, n
    return best, best_n


def _dense(text: str, runs: list[tuple[re.Match[str], str]]) -> set[int]:
    """The runs in lines whose unusual characters mostly belong to such runs, and stand for at most two scripts."""
    by: dict[int, list[int]] = {}
    for k, (m, _) in enumerate(runs):
        by.setdefault(text.rfind("\n", 0, m.start()) + 1, []).append(k)
    out: set[int] = set()
    for start, own in by.items():
        end = text.find("\n", runs[own[-1]][0].end())
        high = len(HIGH.findall(text, start, len(text) if end < 0 else end))
        scripts = {script(c) for k in own for c in runs[k][1]} - {""}
        if 5 * sum(len(runs[k][0].group()) for k in own) >= 3 * high and len(scripts) < 3:
            out.update(own)
    return out


def _alone(text: str, m: re.Match[str], new: str, codec: str) -> bool:
    """Whether a single decoded character is no accident of two ordinary ones side by side."""
    if codec in ("cp1252", "latin-1", "iso8859-15", "cp1250"):
        return not (m.group()[1:] in TYPOGRAPHIC and text[m.start() - 1 : m.start()].isupper())
    if LETTER.fullmatch(new):
        return False
    if codec not in CYRILLIC:
        return True
    around = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
    return not LETTER.search(around) and (len(m.group()) > 2 or new.isalpha() or not LETTER.search(text[max(0, m.start() - 40) : m.start()] + text[m.end() : m.end() + 40]))


def _unlike_russian(run: str) -> bool:
    """Whether a run of mostly Cyrillic letters may be no Russian: few common letters or odd capitals."""
    letters = len(LETTER.findall(run))
    low = run.lower()
    return 2 * letters > len(HIGH.findall(run)) and (2 * sum(map(low.count, COMMON)) < 1.1 * letters or re.search("[а-яё][А-ЯЁ]", run) is not None)


def _likely(text: str, meant: str) -> bool:
    """Whether text of an old encoding is of the language that it was made for, as any bytes decode to something."""
    if meant in CYRILLIC:
        letters, low = LETTER.findall(text), text.lower()
        capitals = sum(map(str.isupper, letters))
        return 20 * len(UNRUSSIAN.findall(low)) <= len(letters) and 5 * sum(map(low.count, COMMON)) >= 2 * len(letters) and (len(letters) < 6 or 5 * capitals <= 3 * len(letters))
    han = [c for c in text if "\u3400" <= c <= "\u9fff"]
    return 5 * sum(map(_common_han, han)) >= 3 * len(han) and (len(han) < 8 or 12 * sum(c in CHINESE for c in han) >= len(han))


def _legacy_once(text: str) -> tuple[str, int]:
    """Passages of one legacy encoding read as another undone: the text and their number."""
    n = 0

    def best(old: str, pairs: list[tuple[str, str]], share: float) -> str:
        nonlocal n
        found, least = old, cost(old)
        start = least
        for read, meant in pairs:
            raw = _encode(old, read)
            if raw is None:
                continue
            try:
                new = raw.decode(meant)
            except UnicodeDecodeError:
                continue
            if all(c < "\x80" or _plausible(c) for c in new) and _likely(new, meant) and (c := cost(new)) < least:
                found, least = new, c
        if found is not old and least <= share * start and start - least >= 4:
            n += 1
            return found
        return old

    def better(line: str, new: str, found: int) -> str:
        """The line put otherwise, unless undoing UTF-8 sequences leaves a lower cost."""
        nonlocal n
        if new != line and cost(_utf8_once(line)[0]) < cost(new):
            n, new = found, line
        return new

    lines = text.split("\n")
    for k, line in enumerate(lines):
        before = n
        if LATIN_CORE.search(line):
            new = LATIN_RUN.sub(lambda m: best(m.group(), LATIN, 0.5) if LATIN_CORE.search(m.group()) else m.group(), line)
            lines[k] = line = better(line, new, before)
        before = n
        if LETTER.search(line):
            new = line
            for run in [m.group() for m in CYRILLIC_RUN.finditer(line) if len(m.group()) >= 8 and _unlike_russian(m.group())]:
                new = new.replace(run, best(run, REST, 0.6))
            lines[k] = better(line, new, before)
    return "\n".join(lines), n


def _gbk_once(text: str) -> tuple[str, int]:
    """Passages of UTF-8 read as GBK undone, where no byte was lost."""
    n = 0

    def undo(m: re.Match[str]) -> str:
        nonlocal n
        old = m.group()
        if len(old) < 3 or "�" in old:
            return old
        try:
            new = old.encode("gbk").decode("utf-8")
        except UnicodeError:
            return old
        if not all(c < "\x80" or _possible_text(c) for c in new) or _falls(m.string, m.start(), m.end(), new) <= 0:
            return old
        n += 1
        return new

    return HAN_RUN.sub(undo, text), n


def _remainder(new: str) -> bool:
    """Whether a line that was repaired still has what no good text has: controls, or halves of sequences.

    Such a half is an upper-half letter that opens a sequence, before a sign, in a line that had more of them.
    """
    if re.search("[A-Za-zÀ-ɏ][Ѐ-ӿ─-╿]|[Ѐ-ӿ─-╿][A-Za-zÀ-ɏ]", new):
        return True
    return any("\x80" <= c < "\xa0" and c != "\x85" for c in new) or re.search("[ÂÃÄÅÎÏÐÑ][\xa1-\xbf€™œ‚„†‡ˆ‰‹›˜•]", new) is not None


def repair(text: str) -> tuple[str, int, int, bool]:
    """``(text, passages, layers, whole)`` after undoing all nested wrong decodings, line by line.

    A layer is undone only where the garbling cost falls, and layers until it falls no more.
    Passages are counted in the layer that has most. ``whole`` is false where characters were lost
    (replacement characters are left), or where a line has a remainder that no decoding explains;
    such a line stays as it was.
    """
    if not HIGH.search(text):
        return text, 0, 0, True
    lost = len(re.findall("�+", text))
    passages, layers, whole, before, seen = 0, 0, not lost, text, {text}
    while True:
        n = 0
        for once in (_legacy_once, _utf8_once, _gbk_once):
            text, k = once(text)
            n += k
            if k:
                break
        if not n or text in seen:
            break
        seen.add(text)
        passages, layers = max(passages, n), layers + 1
    if passages:
        old, new = before.split("\n"), text.split("\n")
        bad = [k for k, (a, b) in enumerate(zip(old, new, strict=True)) if a != b and _remainder(b)] if len(old) == len(new) else []
        for k in bad:
            new[k] = old[k]
        whole = whole and not bad
        text = "\n".join(new)
    return text, passages + lost, layers, whole


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        out = [(i, *r) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if (r := repair(t))[1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.int32()), pa.array([r[4] for r in out], pa.bool_()), pa.array([r[1] for r in out], pa.string())],
            ["doc_id", "passages", "layers", "recovered", "text"],
        )


def garbled(documents: DataFrame) -> DataFrame:
    """``(doc_id, passages, layers, recovered, text)`` of each document with a garbled passage.

    Each passage is re-encoded under the candidate legacy encodings and strictly decoded as the
    encoding meant; the pair that lowers the garbling cost most is taken, and again for nested
    layers until it falls no more. ``text`` is the text as far as it could be repaired; ``recovered``
    is false where characters were lost, or a line's garbling isn't explained whole and so was left. Texts of ASCII alone can't be garbled in this way and never reach Python.
    Null and empty texts give no row, repeated documents a row each. Nothing is shuffled.
    """
    return documents.select("doc_id", "text").where(F.col("text").rlike("[^\\x00-\\x7f]")).mapInArrow(_run, "doc_id bigint, passages int, layers int, recovered boolean, text string")


def found(documents: DataFrame) -> DataFrame:
    """p10_found: the documents with a garbled passage, recovered or not."""
    return garbled(documents).select("doc_id").distinct()
